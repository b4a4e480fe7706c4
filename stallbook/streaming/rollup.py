"""Visit counts per page and day, kept up as visits arrive, so that readers never count all visits.

Every micro-batch adds its own small table of counts, and from time to time the finished ones are
merged into a bucketed table (`sources.buckets`, by page). The version of that table is the mark:
the number of batches it holds. Readers add what is merged and the counts of the batches beyond
the mark; counts are sums, so it does not matter how many rows a page and day have on the way.

Visits may be delivered more than once and at any time. A visit is known by its id and
`created_at`: the ids of every day that was counted are kept in a folder per day, and a
batch looks only into the folders of the days it has visits of. So a repeated one is not counted
again, and a late one corrects its day, however old. There is no watermark and no state in memory.

Days are those of `created_at` as stored; for a `timestamp`, those of the session's zone.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import keep
from ..sources import buckets as BU
from ..sources.tables import LOG, finished_versions, log_entry

TABLE = "page_days"
_COUNTS = "page string, day date, visits bigint"
_NO_DAY = "none"


def _folder_day(day: Column) -> Column:
    return F.coalesce(day.cast("string"), F.lit(_NO_DAY))


def counted(spark: SparkSession, root: str, days: set[str], like: DataFrame, batch_id: int) -> DataFrame:
    """id and created_at of the visits of these days that earlier batches have counted. Only
    the folders of the days are read."""
    columns = like.select("id", "created_at")
    try:
        names = "{" + ",".join(sorted(days)) + "}"
        rows = spark.read.schema(columns.schema.add("day", "string").add("batch", "long")).option(
            "basePath", f"{root}/arrived").parquet(f"{root}/arrived/day={names}")
    except AnalysisException:
        return columns.limit(0)  # nothing was counted on any of them
    return rows.where(F.col("batch") < batch_id).select("id", "created_at")


def fresh_visits(batch: DataFrame, batch_id: int, root: str) -> DataFrame:
    """The visits of a micro-batch that were not counted before, each once, with their `day`.

    Rows without id are never taken for one another. Of the known ids only those that the batch
    has too go on to find the batch's rows, so the known side is not shuffled where Spark
    finds the batch, a written table, small enough to broadcast.
    """
    spark, key = batch.sparkSession, ["id", "created_at"]
    rows = batch.select("id", "page", "created_at", F.to_date("created_at").alias("day"))
    named = rows.where(F.col("id").isNotNull()).dropDuplicates(key)
    rows = keep(named.unionByName(rows.where(F.col("id").isNull())), "arrivals")
    days = {r.day for r in rows.select(_folder_day(F.col("day")).alias("day")).distinct().collect()}
    if not days:
        return rows
    ours, theirs = rows.select(*key).alias("a"), counted(spark, root, days, rows, batch_id).alias("b")
    same = (F.col("a.id") == F.col("b.id")) & F.col("a.created_at").eqNullSafe(F.col("b.created_at"))
    known = theirs.join(ours, same, "left_semi")
    return rows.alias("a").join(known, same, "left_anti")


def taken(spark: SparkSession, root: str) -> set[int]:
    """The batches whose counts are finished, numbered from 1."""
    log = finished_versions(spark, f"{root}/counts")
    return set() if log is None else {r.version for r in log.select("version").distinct().collect()}


def take(batch: DataFrame, batch_id: int, root: str) -> None:
    """Count a micro-batch of visits. One that runs again overwrites what it had not finished and
    skips what it had."""
    spark = batch.sparkSession
    if batch_id + 1 in taken(spark, root):
        return
    fresh = keep(fresh_visits(batch, batch_id, root), "visits")
    fresh.select("id", "created_at", _folder_day(F.col("day")).alias("day"), F.lit(batch_id).alias("batch")).where(
        "id IS NOT NULL").repartition("day").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{root}/arrived")
    fresh.groupBy("page", "day").agg(F.count("*").alias("visits")).write.mode("overwrite").parquet(
        f"{root}/counts/v{batch_id + 1}")
    log_entry(spark, batch_id + 1, [TABLE]).write.mode("append").parquet(f"{root}/counts/{LOG}")


def mark(spark: SparkSession, root: str) -> int:
    """How many batches the merged table holds; 0 before the first merge."""
    known = finished_versions(spark, f"{root}/merged")
    return 0 if known is None else known.agg(F.max("version")).first()[0] or 0


def _tail(spark: SparkSession, root: str, since: int) -> DataFrame | None:
    """Counts of the finished batches after `since`; None if there are none."""
    paths = [f"{root}/counts/v{n}" for n in sorted(taken(spark, root)) if n > since]
    return spark.read.schema(_COUNTS).parquet(*paths) if paths else None


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id", "day").agg(F.sum("visits").alias("visits"))


def merge(spark: SparkSession, root: str, buckets: int = 64, most: int = 8) -> int:
    """Take the finished batches beyond the mark into the buckets; returns the new mark.

    A merge adds a folder to the buckets whose pages were visited, and rewrites those that have
    `most`, so a page costs few folders and each count is written again once in `most` merges.
    """
    since = mark(spark, root)
    tail = _tail(spark, root, since)
    if tail is None:
        return since
    rows, last = _summed(tail.withColumnRenamed("page", "id")), max(taken(spark, root))
    if since == 0:
        BU.create(rows, f"{root}/merged", TABLE, buckets, version=last)
    else:
        BU.merge_rows(rows, f"{root}/merged", TABLE, last, _summed, most)
    return last


def page_days(spark: SparkSession, root: str, pages: list[str] | None = None) -> DataFrame:
    """page, day and visits: what is merged and the batches beyond the mark. A page and day may have
    several rows, to be added up, which the readers in `operators.visits` do.

    With `pages`, a short list, only the buckets of these are read.
    """
    since = mark(spark, root)
    tail = _tail(spark, root, since)
    found = spark.createDataFrame([], _COUNTS) if tail is None else tail
    if since:
        table, only = BU.stored(spark, f"{root}/merged", TABLE, since), None
        if pages is not None:
            asked = spark.createDataFrame([(p,) for p in pages], "id string")
            only = {r.b for r in asked.select(
                BU.bucket_of(F.col("id"), table.buckets).alias("b")).collect()}
        found = table.rows(only).select(F.col("id").alias("page"), "day", "visits").unionByName(found)
    return found if pages is None else found.where(F.col("page").isin(pages))


def stream(visits: DataFrame, root: str, checkpoint: str, every: int = 8, buckets: int = 64) -> StreamingQuery:
    """Keep the counts under `root` up with a stream of visits (id, page, created_at), merging after
    each `every` batches. Takes what there is and stops."""
    def run(batch: DataFrame, batch_id: int) -> None:
        take(batch, batch_id, root)
        if (batch_id + 1) % every == 0:
            merge(batch.sparkSession, root, buckets)

    return (visits.writeStream.option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(run).start())
