"""Subscription expiry over a stream of subscription changes."""

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import predicates as P
from ..functions.clock import moment
from ..operators.changes.lifecycle import expire


def sweep(subscriptions: DataFrame, as_of: datetime) -> DataFrame:
    """Only the subscriptions that expire now, with their new state."""
    gone = P.expired(moment(as_of, subscriptions, "expires_at"))
    return expire(subscriptions.filter(gone), as_of)


def sweep_stream(ticks: DataFrame, snapshot: Callable[[], DataFrame],
                 clock: Callable[[], datetime], save: Callable[[DataFrame, int], None],
                 checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Sweep the whole table of subscriptions at every trigger.

    `ticks` is any stream that makes a micro-batch when the sweep is due: a rate source for a
    schedule, or the stream of changed rows. Its rows do not matter, as a subscription runs out
    without being changed. `snapshot` gives the newest version of every subscription and
    `clock` the time, both read once per batch. `save` gets the expired rows and the batch
    id and must overwrite by that id, as a batch may run again. `every` is the trigger
    interval; without it the stream takes what there is and stops.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        save(sweep(snapshot(), clock()), batch_id)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (ticks.writeStream.option("checkpointLocation", checkpoint)
            .trigger(**trigger).foreachBatch(run).start())


def latest_versions(changes: DataFrame) -> DataFrame:
    """The newest version of each subscription in a table of versions."""
    fields = [c for c in changes.columns if c != "id"]
    order = F.struct("updated_at", *[F.col(c) for c in fields if c != "updated_at"])
    newest = changes.groupBy("id").agg(F.max(order).alias("_row"))
    return newest.select("id", "_row.*").select(*changes.columns)
