"""Tables at rest: Parquet folders under one root, read with declared schemas.

Parquet has no update in place. A new state is written as a new snapshot folder
next to the old ones and entered in a log only once it is complete, so a reader
takes the latest finished snapshot and a lost executor costs a retry, not a table.
"""

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import keep
from ..functions import fixed_values as V
from ..functions.ordering import ascending
from ..schemas import TABLES, schema


def read_table(spark: SparkSession, root: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A table of the marketplace, projected to `columns` when given."""
    reader = spark.read
    if name in TABLES:
        reader = reader.schema(schema(name))
    df = reader.parquet(f"{root}/{name}")
    return df.select(*columns) if columns else df


def append_rows(rows: DataFrame, root: str, name: str) -> DataFrame:
    """Append rows to a table's folder and return them; they are worked out once."""
    rows = keep(rows, name)
    rows.write.mode("append").parquet(f"{root}/{name}")
    return rows


LOG = "_versions"


def publish(state: Mapping[str, DataFrame], root: str, version: int) -> dict[str, str]:
    """Write the new state of a change as snapshot `version` of its tables.

    One log entry names them all once the last is complete, so a reader sees all of a change
    or nothing of it.
    """
    paths = {name: f"{root}/{name}/v{version}" for name in state}
    for name, path in paths.items():
        state[name].write.mode("overwrite").parquet(path)
    spark = next(iter(state.values())).sparkSession
    log_entry(spark, version, sorted(paths)).write.mode("append").parquet(f"{root}/{LOG}")
    return paths


def log_entry(spark: SparkSession, version: int, names: list[str]) -> DataFrame:
    """The log's row of a finished version and its tables."""
    return spark.createDataFrame([(version, names)], "version bigint, tables array<string>").coalesce(1)


def finished_versions(spark: SparkSession, root: str) -> DataFrame | None:
    """The log: version and tables; None where nothing was finished yet."""
    try:
        return spark.read.schema("version bigint, tables array<string>").parquet(f"{root}/{LOG}")
    except AnalysisException:
        return None


def read_snapshot(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table's latest finished snapshot, up to a given version."""
    log = spark.read.schema("version bigint, tables array<string>").parquet(f"{root}/{LOG}")
    done = log.filter(F.array_contains("tables", name))
    if version is not None:
        done = done.filter(F.col("version") <= version)
    version = done.agg(F.max("version")).first()[0]
    if version is None:
        raise ValueError(f"no finished snapshot of {name}")
    reader = spark.read.schema(schema(name)) if name in TABLES else spark.read
    return reader.parquet(f"{root}/{name}/v{version}")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) per table, sorted by name. Counts are exact; Parquet
    answers them from file footers without reading columns."""
    lines = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in sorted(tables.items())
    ]
    if not lines:
        raise ValueError("no tables to count")
    total = lines[0]
    for line in lines[1:]:
        total = total.unionByName(line)
    return total.orderBy("table_name")


def known_tables(spark: SparkSession, tables: dict[str, DataFrame],
                 names=V.OVERVIEW_TABLES) -> DataFrame:
    """(table_name, exists, row_count) of the marketplace's known tables, sorted by name; one
    that is not among `tables` is reported with no rows."""
    found = row_counts({n: df for n, df in tables.items() if n in names})
    listed = spark.createDataFrame([(n,) for n in names], "table_name string")
    return listed.join(found, "table_name", "left").select(
        "table_name", F.col("row_count").isNotNull().alias("exists"),
        F.coalesce("row_count", F.lit(0)).cast("bigint").alias("row_count")).orderBy("table_name")


def overview(spark: SparkSession, root: str, names=V.OVERVIEW_TABLES) -> DataFrame:
    """`known_tables` of the tables under `root`; a missing one does not stop the rest."""
    tables = {}
    for name in names:
        try:
            tables[name] = read_table(spark, root, name)
        except AnalysisException:
            continue
    return known_tables(spark, tables, names)


def as_json(table: DataFrame) -> DataFrame:
    """Each row as one JSON document; a NULL column keeps its key."""
    return table.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("item"))


def preview(table: DataFrame, limit: int = V.PREVIEW_LIMIT, order: str | None = None) -> DataFrame:
    """Some rows of any table as JSON, at most the preview's maximum: any rows, or the
    first by `order`."""
    rows = table.orderBy(*ascending(order)) if order else table
    return as_json(rows.limit(min(max(limit, 0), V.PREVIEW_MAX)))
