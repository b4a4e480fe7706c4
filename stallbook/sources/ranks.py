"""A rank index: a table stored in a total order, from which a page is read by its place.

`build` deals the rows into ranges of the sort order, sorts each and writes it to a folder of its
own, every row with its place in its range. The counts of the ranges, a row each, are written
beside them. A page at any offset is then found from the counts' prefix sums: only the folders
of the ranges it lies in are opened, and within them the place is a filter that Parquet's
statistics answer, so that an offset of half the table costs what the first page costs.

An index is a snapshot: it is built anew, into another folder, when the table has changed.
Ranges are cut on sampled rows of the whole order, ties and all, so one value that fills a third
of the table is many ranges. Fully equal rows may stand in one range, beside each other. The
driver holds one number per range, `ranges` of them, and no rows.
"""

from bisect import bisect_right
from collections.abc import Sequence
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..functions.ordering import ascending, newest

RANGES = 1024
_PLACES = 33  # monotonically_increasing_id keeps the place in the lower 33 bits


class RankIndex(NamedTuple):
    """A stored order: where it is, the columns of its rows, and how many rows each range has."""

    spark: SparkSession
    path: str
    columns: StructType
    numbers: list[int]
    ends: list[int]  # rows up to and with each range

    @property
    def rows(self) -> int:
        return self.ends[-1] if self.ends else 0

    def _at(self, rank: int) -> tuple[int, int]:
        """Number of the range that has the row of a rank (from 0), and its stored place."""
        n = bisect_right(self.ends, rank)
        number = self.numbers[n]
        return number, (number << _PLACES) + rank - (self.ends[n - 1] if n else 0)

    def page(self, limit: int | None, offset: int | None = 0) -> DataFrame:
        """Rows in order, the first `offset` left out, at most `limit` of them (None: all).

        A negative offset leaves none out; a limit below 1 and an offset beyond the table
        give no rows.
        """
        start = max(0, offset or 0)
        stop = self.rows if limit is None else min(self.rows, start + max(0, limit))
        if start >= stop:
            return self.spark.createDataFrame([], self.columns)
        (first, low), (last, high) = self._at(start), self._at(stop - 1)
        kept = self.columns.fieldNames()
        stored = StructType([*self.columns.fields]).add("_at", LongType()).add("_range", LongType())
        return self.spark.read.schema(stored).parquet(f"{self.path}/ranges").filter(
            F.col("_range").between(first, last) & F.col("_at").between(low, high)
        ).orderBy("_at").select(*kept)

    def numbered(self, first: int = 1, name: str = "number") -> DataFrame:
        """All rows with their number in the order, from `first`, without a gap.

        A row's number is what the ranges before its own hold plus its place, so nothing is
        sorted again and no task numbers more than it reads. The broadcast has a row per range.
        """
        starts = [first, *(first + e for e in self.ends)]
        ranges = self.spark.createDataFrame(
            list(zip(self.numbers, starts, strict=False)), "_range bigint, _start bigint")
        stored = StructType([*self.columns.fields]).add("_at", LongType()).add("_range", LongType())
        rows = self.spark.read.schema(stored).parquet(f"{self.path}/ranges")
        place = F.col("_at").bitwiseAND(F.lit((1 << _PLACES) - 1))
        return rows.join(F.broadcast(ranges), "_range").select(
            *self.columns.fieldNames(), (F.col("_start") + place).alias(name))


def order_of(keys: Sequence[str]) -> list[Column]:
    """`-created_at` is newest first with NULL first, `id` is ascending with NULL last."""
    return [newest(k[1:])[0] if k.startswith("-") else ascending(k)[0] for k in keys]


def build(rows: DataFrame, path: str, keys: Sequence[str], ranges: int = RANGES) -> RankIndex:
    """Store `rows` in the order of `keys`, ties broken by all their columns in turn."""
    clash = {"_at", "_range"} & {c.lower() for c in rows.columns}
    if clash:
        raise ValueError(f"columns of the index itself: {sorted(clash)}")
    order = [*order_of(keys), *ascending(*rows.columns)]
    placed = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn(
        "_at", F.monotonically_increasing_id())
    placed.withColumn("_range", F.shiftright("_at", _PLACES)).write.partitionBy("_range").parquet(
        f"{path}/ranges")
    spark = rows.sparkSession
    stored = StructType([*rows.schema.fields]).add("_range", LongType())
    spark.read.schema(stored).parquet(f"{path}/ranges").groupBy("_range").agg(
        F.count("*").alias("n")).write.parquet(f"{path}/counts")
    return opened(spark, path, rows.schema)


def opened(spark: SparkSession, path: str, columns: StructType) -> RankIndex:
    """The index in a folder; `columns` is the schema of the rows it was built from."""
    counts = sorted((r["_range"], r["n"]) for r in spark.read.schema(
        "_range bigint, n bigint").parquet(f"{path}/counts").collect())
    return RankIndex(spark, path, columns, [r for r, _ in counts],
                     list(accumulate(n for _, n in counts)))
