"""Dense numbers for the rows of a table, without a window over all of it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallbook.config import keep


def numbered(rows: DataFrame, name: str, number: str = "id") -> tuple[DataFrame, int]:
    """`rows` written as a table with numbers from 1 without gaps, and how many there are.

    Rows count up within their partition; the partitions' sizes, one row each, say where the next
    one goes on.
    """
    shift = 33  # monotonically_increasing_id has the partition above this bit
    kept = keep(rows.withColumn("__place", F.monotonically_increasing_id()), name)
    part = F.shiftright("__place", shift)
    sizes = sorted((r.part, r["count"]) for r in kept.groupBy(part.alias("part")).count().collect())
    total, starts = 0, []
    for p, n in sizes:
        starts.append((p, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(starts, "__part long, __start long")
    within = F.col("__place").bitwiseAND(F.lit((1 << shift) - 1))
    return kept.join(F.broadcast(offsets), part == F.col("__part")).withColumn(
        number, F.col("__start") + within + 1).drop("__place", "__part", "__start"), total
