"""Columns made from a text column by numpy code over Arrow batches."""

import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Rows of an Arrow batch. Spark's own 10,000 are too many when a row is a whole text.
BATCH_ROWS = 1000

#: Makes the new columns, by name, from a column of texts.
Make = Callable[[pa.Array], dict[str, object]]

_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
          "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
          "array<string>": pa.list_(pa.string())}


def ready(spark: SparkSession) -> None:
    """Prepare the session for numpy code: call it before a plan that runs Python is made.

    At most `BATCH_ROWS` rows go to Python at a time, or what the session has if less: a batch is
    held by the JVM and, with what is made of it, by the Python worker beside it. And Python
    workers on this machine find the library wherever the program was started; on a cluster it
    is shipped as any Python code is.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = int(spark.conf.get(key))
    if not 0 < given <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int):
    """What is planned and run inside sends at most `rows` rows to Python at a time: for rows that
    are long arrays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, given)


def with_text_columns(docs: DataFrame, text: str, made: dict[str, str],
                      make: Callable[[], Make]) -> DataFrame:
    """Add the columns `made` (name to type); a column of that name is replaced.

    Only the texts go to Python and only the new columns come back. `make` is called once per
    task and gives the function that works on a batch, so that tables are built once.
    """
    ready(docs.sparkSession)
    fields = [pa.field(name, _TYPES[kind]) for name, kind in made.items()]

    def run(batches):
        fn = make()
        for batch in batches:
            got = fn(batch)
            columns = [got[f.name] if isinstance(got[f.name], pa.Array)
                       else pa.array(got[f.name], type=f.type) for f in fields]
            yield pa.StructArray.from_arrays(
                [c.cast(f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(run, ", ".join(f"`{n}` {k}" for n, k in made.items()))
    rest = [c for c in docs.columns if c not in made]
    held = docs.select(*rest, udf(F.col(text)).alias("__made"))
    return held.select(*rest, *[F.col("__made").getField(n).alias(n) for n in made])
