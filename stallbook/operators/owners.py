"""Distinct owners of places that can be merged: exact bitmaps per day and status.

A distinct count cannot be added up over days. Bitmaps can: every owner has a number without
gaps, and a day's owners are bits in buckets of 32768. The count of any span of days and set of
statuses is the bits left after or-ing its buckets, without looking at a place again. Daily parts
may be made when their day is over, in any order, and more than once.
"""

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ranks import RANGES, build


def number_owners(users: DataFrame, path: str, known: DataFrame | None = None,
                  ranges: int = RANGES) -> DataFrame:
    """user_id and `number`: every user of `users` that has none yet, numbered after `known`.

    Numbers go up from 1 without a gap, so that bitmaps stay as full as they can be. Returns the
    known users and the new ones; the new ones are stored in `path`.
    """
    new, first = users.select("user_id").filter(F.col("user_id").isNotNull()).distinct(), 1
    if known is not None:
        new = new.join(known.select("user_id"), "user_id", "left_anti")
        first += known.agg(F.coalesce(F.max("number"), F.lit(0).cast("bigint"))).first()[0]
    found = build(new, path, ["user_id"], ranges).numbered(first)
    return found if known is None else known.unionByName(found)


def owner_days(providers: DataFrame, numbers: DataFrame) -> DataFrame:
    """day, status, bucket and bits: the owners of the places made on each day.

    An owner is counted once per day and status before the numbers are looked up, so that one with
    a third of all places is a few rows. Places without an owner count nowhere. Every owner must
    be numbered.
    """
    seen = providers.filter(F.col("user_id").isNotNull()).select(
        F.to_date("created_at").alias("day"), "status", "user_id").distinct()
    return seen.join(numbers, "user_id").groupBy(
        "day", "status", F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))


def owners(days: DataFrame, by: Sequence[str] = (), since: date | None = None,
           until: date | None = None) -> DataFrame:
    """`total_users` of the days from `since` up to `until`, both included, per group of `by`.

    `by` are columns of `days`; a NULL status is a group. Without a span, places without a date
    count too. Without groups there is always one row.
    """
    if since is not None:
        days = days.filter(F.col("day") >= F.lit(since))
    if until is not None:
        days = days.filter(F.col("day") <= F.lit(until))
    merged = days.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy(*by).agg(
        F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0).cast("bigint")).alias("total_users"))
