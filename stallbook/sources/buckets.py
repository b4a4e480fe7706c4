"""Tables kept in hash buckets of the id, so that a change rewrites only what it touches.

A bucket is a folder of Parquet files under `<table>/v<version>/_bucket=<number>`; a row
belongs to the bucket that the hash of its id names. Each snapshot has a manifest: for every
bucket, the versions whose folders make it up. A change reads the buckets that its requests name
and writes these anew; new rows go to a folder of their own beside what their bucket has. All
other folders are carried over by name. Folders are never written again once a snapshot
names them, and a snapshot exists only once the log has it, which is written last. So
a reader sees all of a change or nothing of it, and readers of older snapshots are not disturbed.

The driver handles one manifest row per bucket and folder, never rows of the table. Choose the
number of buckets so that one is some hundred MB; it is fixed when the table is made.
"""

import json
from collections import Counter
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from ..config import Cut, keep
from ..operators.changes.base import Change
from .tables import LOG, finished_versions, log_entry

_MANIFESTS = "_manifests"
_MANIFEST = ("table string, buckets int, columns string, bucket int, version bigint, rows bigint, "
             "highest bigint")


class Stored(NamedTuple):
    """A snapshot of a bucketed table: where its rows are."""

    spark: SparkSession
    root: str
    name: str
    version: int
    buckets: int
    columns: StructType
    folders: list  # rows of the manifest

    @property
    def highest(self) -> int | None:
        """The highest id, from the manifest alone; None where ids are no numbers."""
        if not isinstance(self.columns["id"].dataType, IntegralType):
            return None
        return max((f.highest for f in self.folders if f.highest is not None), default=0)

    def paths(self, only: set[int] | None = None) -> list[str]:
        """The folders of the snapshot, or of some of its buckets."""
        return [f"{self.root}/{self.name}/v{f.version}/_bucket={f.bucket}" for f in self.folders
                if only is None or f.bucket in only]

    def rows(self, only: set[int] | None = None) -> DataFrame:
        """The table, or the rows of some of its buckets."""
        paths = self.paths(only)
        if not paths:
            return self.spark.createDataFrame([], self.columns)
        return self.spark.read.schema(self.columns).parquet(*paths)


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, root: str, name: str, version: int, buckets: int) -> list[tuple]:
    """Write rows to folders by bucket; a manifest row for each folder."""
    folder = f"{root}/{name}/v{version}"
    dealt = rows.withColumn("_bucket", bucket_of(F.col("id"), buckets))
    dealt.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(folder)
    columns = rows.schema
    written = rows.sparkSession.read.schema(
        StructType([columns["id"]]).add("_bucket", "integer")).parquet(folder)
    highest = F.max(F.col("id").try_cast("bigint"))
    return [(name, buckets, columns.json(), r.bucket, version, r.rows, r.highest)
            for r in written.groupBy(F.col("_bucket").alias("bucket")).agg(
                F.count("*").alias("rows"), highest.alias("highest")).collect()]


def _enter(spark: SparkSession, root: str, version: int, manifest: list[tuple], names) -> None:
    """Write the manifest of a version, then the log entry that makes it count."""
    rows = spark.createDataFrame(manifest, _MANIFEST)
    rows.coalesce(1).write.mode("overwrite").parquet(f"{root}/{_MANIFESTS}/v{version}")
    log_entry(spark, version, sorted(names)).write.mode("append").parquet(f"{root}/{LOG}")


def _unused(spark: SparkSession, root: str, version: int) -> None:
    known = finished_versions(spark, root)
    if known is not None and not known.where(F.col("version") >= version).isEmpty():
        raise ValueError(f"version {version} is not after the last one under {root}")


def create(rows: DataFrame, root: str, name: str, buckets: int, version: int = 1) -> None:
    """Make a bucketed table of rows with an `id`."""
    spark = rows.sparkSession
    _unused(spark, root, version)
    empty = [(name, buckets, rows.schema.json(), None, None, 0, None)]
    _enter(spark, root, version, _write(rows, root, name, version, buckets) or empty, [name])


def stored(spark: SparkSession, root: str, name: str, version: int | None = None) -> Stored:
    """The latest finished snapshot of a table, up to a given version."""
    known = finished_versions(spark, root)
    last = None
    if known is not None:
        done = known.where(F.array_contains("tables", name))
        if version is not None:
            done = done.where(F.col("version") <= version)
        last = done.agg(F.max("version")).first()[0]
    if last is None:
        raise ValueError(f"no finished snapshot of {name}")
    folders = spark.read.schema(_MANIFEST).parquet(f"{root}/{_MANIFESTS}/v{last}").where(
        F.col("table") == name).orderBy("bucket", "version").collect()
    return Stored(spark, root, name, last, folders[0].buckets,
                  StructType.fromJson(json.loads(folders[0].columns)),
                  [f for f in folders if f.bucket is not None])


def _manifest(table: Stored, replaced: set[int], written: list[tuple]) -> list[tuple]:
    held = [tuple(f) for f in table.folders if f.bucket not in replaced]
    # a table without any row left still has a number of buckets
    return held + written or [(table.name, table.buckets, table.columns.json(), None, None, 0, None)]


def change_rows(spark: SparkSession, root: str, name: str, requests: DataFrame,
                change: Callable[[DataFrame, DataFrame], Change], version: int,
                state: str = "table", cut: Cut = keep) -> DataFrame:
    """Apply a change that reaches rows by the `id` of its requests, and return its results.

    `change(rows, requests)` is any of the operators on rows by id (patch, delete, upsert, set a
    field); `state` names the frame of its new rows. It gets the buckets that the requests
    name and the bucket of the highest id, from which new ids are counted. Only the buckets that
    requests name are written again; rows with ids above the highest are added beside theirs.
    A batch that runs again under the same version overwrites what it had not entered.
    """
    _unused(spark, root, version)
    table = stored(spark, root, name)
    named = requests.where(F.col("id").isNotNull()).select(
        bucket_of(F.col("id"), table.buckets).alias("bucket")).distinct()
    touched = {r.bucket for r in named.collect()}
    highest = table.highest
    top = {f.bucket for f in table.folders if highest is not None and f.highest == highest}
    done = change(table.rows(touched | top), requests)
    results = cut(done.results)
    own = bucket_of(F.col("id"), table.buckets)
    new = F.lit(False) if highest is None else F.col("id") > F.lit(highest)
    rows = done.state[state].select(*table.columns.names).where(new | own.isin(sorted(touched)))
    written = _write(rows, root, name, version, table.buckets)
    _enter(spark, root, version, _manifest(table, touched, written), [name])
    return results


def add_rows(rows: DataFrame, root: str, name: str, version: int) -> None:
    """Add rows with new ids: a folder more for their buckets, nothing else is written."""
    spark = rows.sparkSession
    _unused(spark, root, version)
    table = stored(spark, root, name)
    written = _write(rows, root, name, version, table.buckets)
    _enter(spark, root, version, _manifest(table, set(), written), [name])


def merge_rows(rows: DataFrame, root: str, name: str, version: int,
               combine: Callable[[DataFrame], DataFrame], most: int = 8) -> None:
    """Add rows whose ids may be there already, to a table whose readers combine the rows of an id.

    Each bucket gets a folder more; those that have `most` are written anew as `combine` of all
    their rows, so a row is written again once in `most` calls, not at each.
    """
    spark = rows.sparkSession
    _unused(spark, root, version)
    table = stored(spark, root, name)
    held = Counter(f.bucket for f in table.folders)
    full = {b for b, n in held.items() if n >= most}
    written = _write(combine(table.rows(full).unionByName(rows)), root, name, version, table.buckets)
    _enter(spark, root, version, _manifest(table, full, written), [name])


def compact(spark: SparkSession, root: str, name: str, version: int, most: int = 8) -> int:
    """Write buckets of more than `most` folders into one each; how many there were."""
    _unused(spark, root, version)
    table = stored(spark, root, name)
    count: dict[int, int] = {}
    for f in table.folders:
        count[f.bucket] = count.get(f.bucket, 0) + 1
    many = {b for b, n in count.items() if n > most}
    if many:
        written = _write(table.rows(many), root, name, version, table.buckets)
        _enter(spark, root, version, _manifest(table, many, written), [name])
    return len(many)
