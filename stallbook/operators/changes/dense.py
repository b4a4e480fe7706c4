"""Ids without gaps for the rows that a batch adds.

The change operators number new rows by the distance of their request from the first of the
batch, which leaves a gap for every request that adds nothing. `dense` gives the rows that are
there the ids next to the table's highest, in the same order, and carries them to every column
that names one. Ranges of the ids are counted and the counts summed, so no task sorts or
numbers the batch alone, and a rerun gives each request the same id.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...sources.ranks import build
from .base import Change

#: Where ids of new rows stand, by table: pairs of a frame (`results` or a table) and its column.
Uses = Mapping[str, Sequence[tuple[str, str]]]
RANGES = 256


def _renamed(frame: DataFrame, column: str, highest: int, numbers: DataFrame) -> DataFrame:
    """`frame` with its new ids replaced; rows that name an old id or none are not shuffled."""
    new = F.col(column) > highest
    old = frame.filter(~F.coalesce(new, F.lit(False)))
    found = frame.filter(new).join(numbers.withColumnRenamed("id", column), column, "left")
    return old.unionByName(found.withColumn(
        column, F.coalesce("_number", column)).select(*frame.columns))


def dense(change: Change, before: Mapping[str, DataFrame], uses: Uses, path: str,
          ranges: int = RANGES) -> Change:
    """`change` with the new rows of the tables in `uses` numbered without gaps.

    `before` has each of these tables as it was before the batch; a new row is one above its
    highest id. An id of `results` above it that no row has, as of a refused request, stays as it
    is. The numbers are written to `path`, a folder of this batch alone.
    """
    state, results = dict(change.state), change.results
    for name, places in uses.items():
        highest = before[name].agg(F.coalesce(F.max("id"), F.lit(0).cast("bigint"))).first()[0]
        new = state[name].filter(F.col("id") > highest).select("id")
        numbers = build(new, f"{path}/{name}", ["id"], ranges).numbered(highest + 1, "_number")
        for frame, column in [(name, "id"), *places]:
            if frame == "results":
                results = _renamed(results, column, highest, numbers)
            else:
                state[frame] = _renamed(state[frame], column, highest, numbers)
    return Change(state, results)
