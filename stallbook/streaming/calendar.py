"""Expiry from a calendar of due days: a trigger costs what is due, not what there is.

Subscriptions are kept in a bucketed table (`sources.buckets`), their newest version each. Every
version that can run out also has an entry in the calendar, a folder per day on which it does,
unless that day had passed before it came: then it is due at once and needs no reminder.
A trigger takes the changed rows of its micro-batch into both, then opens the days that have
passed since the trigger before and rewrites the buckets of the subscriptions named there and
of those that were due when they came. An entry is only a reminder: whether the
subscription still runs out then is read from its row, so renewals and cancellations need not
be looked for in the calendar; the renewed row has an entry of its own on its new day.

Versions may come late and out of order: the one with the latest `updated_at` holds, and the sweep's
own stamp does not count as a version, so it never hides a renewal that was on its way.
"""

from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import keep
from ..functions import predicates as P
from ..functions.clock import moment
from ..operators.changes.base import Change
from ..operators.changes.lifecycle import expire
from ..sources import buckets as BU
from ..sources.tables import finished_versions
from .expiry import latest_versions

TABLE = "subscriptions"
#: Versions of the table that a trigger may make: one for the changed rows, one for the sweep.
_STEPS = 2


def entries(rows: DataFrame) -> DataFrame:
    """id, expires_at and the day of the rows that can run out."""
    can = P.equals("status", "active") & F.col("expires_at").isNotNull()
    return rows.filter(can).select("id", "expires_at", F.col("expires_at").cast("date").alias("day"))


def enter(rows: DataFrame, calendar: str, batch_id: int) -> None:
    """Write entries of a batch; a batch that runs again overwrites its own. Opening a file for
    each day takes longer than its rows, so the days are dealt to a given number of tasks, which
    Spark does not join to fewer for being small."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows.withColumn("batch", F.lit(batch_id)).repartition(parts, "day").write.mode(
        "overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(calendar)


def due(spark: SparkSession, calendar: str, days: set[date], rows: DataFrame) -> DataFrame | None:
    """The entries of these days, whose folders alone are read; None if there are none. `rows` has the
    types of id and expires_at. One pattern names all days, so there is one listing and one scan
    however many they are, and days without entries are left out by it."""
    if not days:
        return None
    named = ",".join(str(day) for day in sorted(days))
    entry = rows.select("id", "expires_at").schema
    try:
        return spark.read.schema(entry).option("basePath", calendar).parquet(
            f"{calendar}/day={{{named}}}").select("id", "expires_at")
    except AnalysisException:
        return None  # nothing runs out on these days


def _newest(rows: DataFrame, changes: DataFrame) -> Change:
    """Of each subscription the version with the latest `version_at`."""
    fields = [c for c in rows.columns if c not in ("id", "version_at")]
    order = F.struct("version_at", *fields)
    state = rows.unionByName(changes).groupBy("id").agg(F.max(order).alias("_row")).select(
        "id", "_row.*").select(*rows.columns)
    return Change({"table": state}, changes.select("id"))


def _done(spark: SparkSession, root: str) -> int:
    known = finished_versions(spark, root)
    return 0 if known is None else known.agg(F.max("version")).first()[0] or 0


def trigger(batch: DataFrame, batch_id: int, root: str, calendar: str, now: datetime,
            since: datetime, buckets: int = 64) -> DataFrame | None:
    """Take a micro-batch of subscription versions in and expire what has run out by `now`.

    `since` is the clock of the trigger before, or an earlier one. Returns the expired rows' ids, or
    None when nothing was due. A trigger that runs again skips the steps that it had finished.
    """
    spark, first = batch.sparkSession, 1 + _STEPS * batch_id
    changes = keep(latest_versions(batch).withColumn("version_at", F.col("updated_at")), "changes")
    if _done(spark, root) == 0:
        BU.create(changes.limit(0), root, TABLE, buckets, version=first - 1 if batch_id else 0)
    dated, passed = entries(changes), F.col("day") < F.lit(since.date())
    enter(dated.filter(~passed), calendar, batch_id)
    if _done(spark, root) < first:
        BU.change_rows(spark, root, TABLE, changes, _newest, version=first)
    day, days = since.date(), set()
    while day <= now.date():
        days.add(day)
        day += timedelta(days=1)
    # versions that came after their day had passed are due at once
    late = dated.filter(passed).select("id", "expires_at")
    found = due(spark, calendar, days, changes)
    if (found is None and late.isEmpty()) or _done(spark, root) >= first + 1:
        return None
    found = late if found is None else found.unionByName(late)
    asked = keep(found.filter(F.col("expires_at") < moment(now, found, "expires_at")).select(
        "id").distinct(), "due")

    def run_out(rows: DataFrame, requests: DataFrame) -> Change:
        gone = P.expired(moment(now, rows, "expires_at"))
        return Change({"table": expire(rows, now)}, rows.filter(gone).select("id"))

    return BU.change_rows(spark, root, TABLE, asked, run_out, version=first + 1)


def stream(changes: DataFrame, root: str, calendar: str, clock: Callable[[], datetime],
           since: Callable[[], datetime], save: Callable[[DataFrame | None, int], None], checkpoint: str,
           buckets: int = 64) -> StreamingQuery:
    """`trigger` for every micro-batch of a stream of subscription versions; takes what there is.

    `clock` gives the time and `since` that of the last finished trigger, both read once per
    batch; `save` gets the ids that expired and must overwrite by batch id.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        save(trigger(batch, batch_id, root, calendar, clock(), since(), buckets), batch_id)

    return (changes.writeStream.option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(run).start())


def current(spark: SparkSession, root: str) -> DataFrame:
    """The newest state of every subscription."""
    return BU.stored(spark, root, TABLE).rows().drop("version_at")
