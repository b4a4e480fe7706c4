"""Visit statistics: total and today's visits for the site and per page.

Counts are combined before the shuffle, so a page with most of the traffic
costs one row per input partition. Every function takes the visits themselves or their counts
per page and day (`streaming.rollup`: page, day, visits), which add up to the same.
"""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.clock import on_day


def _counts(visits: DataFrame, as_of: datetime) -> list[Column]:
    if visits.columns == ["page", "day", "visits"]:
        today = F.when(F.col("day") == F.lit(as_of.date()), F.col("visits"))
        return [F.coalesce(F.sum(c), F.lit(0)).alias(name)
                for c, name in ((F.col("visits"), "total_visits"), (today, "today_visits"))]
    return [
        F.count("*").alias("total_visits"),
        F.count_if(on_day(F.col("created_at"), as_of)).alias("today_visits"),
    ]


def site_visits(visits: DataFrame, as_of: datetime) -> DataFrame:
    return visits.agg(*_counts(visits, as_of))


def page_visits(visits: DataFrame, page: str, as_of: datetime) -> DataFrame:
    """Counts of one page; zeros when it was never visited."""
    return visits.filter(P.equals("page", page)).agg(*_counts(visits, as_of))


def visits_per_page(visits: DataFrame, as_of: datetime) -> DataFrame:
    return visits.filter(F.col("page").isNotNull()).groupBy("page").agg(*_counts(visits, as_of))


def pages_visits(pages: DataFrame, visits: DataFrame, as_of: datetime,
                 count_repeats: bool = False) -> DataFrame:
    """Counts for each page asked for, zeros for pages never visited.

    `pages` has columns `position` and `page`. A page asked for twice gives one
    row at its first position; `count_repeats` multiplies its counts by the number
    of times it was asked for. A NULL page matches no visit.
    """
    asked = pages.groupBy("page").agg(F.min("position").alias("position"),
                                      F.count("*").alias("_times"))
    times = F.col("_times") if count_repeats else F.lit(1)
    joined = asked.join(visits_per_page(visits, as_of), "page", "left")
    return joined.select(
        "position", "page",
        (F.coalesce("total_visits", F.lit(0)) * times).cast("bigint").alias("total_visits"),
        (F.coalesce("today_visits", F.lit(0)) * times).cast("bigint").alias("today_visits"),
    ).orderBy("position")


def pages_frame(spark, pages: list[str | None]) -> DataFrame:
    """A list of pages as the frame `pages_visits` takes, positions in list order."""
    rows = spark.range(1).select(F.posexplode(F.lit(pages).cast("array<string>")))
    return rows.select(F.col("pos").cast("bigint").alias("position"), F.col("col").alias("page"))
