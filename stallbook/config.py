"""Session settings and the shared checkpoint folder."""

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Cut = Callable[[DataFrame], DataFrame]

#: A written table of more rows is never sent to every task, however small its files are.
BROADCAST_ROWS = 100_000


def local_session(cores: str = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("stallbook")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`.

    Only a session in one process, as in tests, may fall back to a folder of its own:
    on a cluster a machine-local folder would be lost with the machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stallbook-"))
    return spark.sparkContext.getCheckpointDir()


def large_state(spark: SparkSession) -> None:
    """Let streams of this session keep their state in RocksDB, unless it names a store."""
    key = "spark.sql.streaming.stateStore.providerClass"
    given = spark.conf.get(key)
    if given.endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(key, given.replace("HDFSBacked", "RocksDB"))


def as_is(df: DataFrame) -> DataFrame:
    """The `cut` that cuts nothing: Spark plans everything as one lazy query."""
    return df


def settle(df: DataFrame) -> DataFrame:
    """The `cut` that writes `df` once to the shared folder and goes on from there.

    The files outlive any executor, so a lost one never recomputes what lies
    before the cut, and several frames built on `df` share one evaluation.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def _kept_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/stallbook-{spark.sparkContext.applicationId}"


def keep(df: DataFrame, name: str = "rows") -> DataFrame:
    """Write `df` as Parquet to the shared folder and return the written table.

    A `cut` like `settle`, for frames that are large or joined again: columns can be
    pruned, Spark knows the size, and both sides of a later join are plain scans, so
    adaptive execution can broadcast a small one and split a skewed one. The tables stay
    until `forget`, as results that are not written yet may still read them.
    """
    spark = df.sparkSession
    path = f"{_kept_folder(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(kept: DataFrame) -> None:
    """Remove one table that `keep` has written, when nothing that is still to run reads it."""
    spark = kept.sparkSession
    folders = {f.split("/")[-3] for f in kept.inputFiles() if "/stallbook-" in f}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{_kept_folder(spark)}/{folder}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def keep_counted(df: DataFrame, name: str = "rows") -> DataFrame:
    """As `keep`, for frames with a row per request or row of a table, which later joins meet.

    Spark takes the size of the files for that of the rows. Statuses, messages and ids in order
    shrink to a few bytes a row, so a table of millions would be collected in the driver as a small
    one. Its rows are counted, from the file footers; many are joined by a shuffle.
    """
    kept = keep(df, name)
    return kept.hint("merge") if kept.count() > BROADCAST_ROWS else kept


def forget(spark: SparkSession) -> None:
    """Remove what this application has kept, once the results built on it are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_kept_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
