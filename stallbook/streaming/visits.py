"""Running visit counts over a stream of visits."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..config import large_state

LATENESS = "1 day"


def utc_instant(ts) -> F.Column:
    """A zone-less time read as UTC. Event time must be an instant; going through the
    text keeps the session zone out of it."""
    return F.concat(ts.cast("string"), F.lit("Z")).cast("timestamp")


def daily_visits(visits: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Visits per page and UTC day. `created_at` must be a `timestamp`.

    The watermark bounds the state: a day is dropped from it once no visit for it
    can be on time any more. Later visits are not counted.
    """
    return (
        visits.withWatermark("created_at", lateness)
        .groupBy(F.window("created_at", "1 day"), "page")
        .agg(F.count("*").alias("visits"))
        .select("window", "page", "visits")
    )


def total_visits(visits: DataFrame) -> DataFrame:
    """Visits per page since the stream began. The state has a row per page and keeps it: it
    grows with the number of pages, never with the visits."""
    return visits.groupBy("page").agg(F.count("*").alias("visits"))


def utc_day(window: str = "window") -> F.Column:
    return F.date_from_unix_date(
        F.floor(F.unix_seconds(F.col(f"{window}.start")) / F.lit(86400)).cast("int"))


def write_changes(counts: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write the counts that each micro-batch changed to a folder of its own.

    A batch that is run again after a failure overwrites its folder, so every
    change is there exactly once. The counts are kept on the executors' disks (RocksDB), not
    in their memory. Takes what there is and stops.
    """
    large_state(counts.sparkSession)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return (counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(save).start())


def current_counts(spark: SparkSession, folder: str, schema: T.StructType,
                   keys: list[str]) -> DataFrame:
    """The running counts after the last batch: counts only grow, so the highest holds."""
    return spark.read.schema(schema).parquet(folder).groupBy(*keys).agg(
        F.max("visits").alias("visits"))
