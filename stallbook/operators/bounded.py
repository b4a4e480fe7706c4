"""The ranked listing by bounds: a page of places without joining every place to a package.

A place's priority is its owner's weight plus a bonus for being new, and the bonus is 0 once
the place is a month old. So no place can have more than the greatest weight of all owners
plus its own bonus, which its date alone tells. The k-th priority among a few probes, the
newest places and those of the owners with the greatest weights, is a floor under the page's
last place. What cannot reach the floor is left out before any join:

* places with a bonus come by date, from a filter on `created_at` that the scan is given;
* places without one come by owner, joined only to owners whose weight alone reaches the floor.

What is left has its exact priority and is sorted like the plain listing, so ties fall the
same way. The floor only decides how much is left, not what is right: in a market without new
places and packages nothing can be ruled out, and every place is ranked.
"""

from collections.abc import Callable
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Cut, keep
from ..functions import fixed_values as V
from ..functions import predicates as P
from ..functions.clock import moment, stamp
from ..functions.ordering import newest, top
from ..functions.scalars import recency
from .entitlement import Basis
from .listing import CARD, RANKED_CARD, SMALL_PAGE, owner_weights

PLACE = ["id", "user_id", "created_at"]


def _weight() -> Column:
    return F.coalesce(F.col("_weight"), F.lit(0).cast("bigint"))


def _small(rows: int) -> Callable[[DataFrame], DataFrame]:
    return F.broadcast if rows <= SMALL_PAGE else lambda df: df


def _exact(places: DataFrame) -> DataFrame:
    """Places with `_weight` and `_bonus` to places with their priority."""
    return places.select(*PLACE, (_weight() + F.col("_bonus")).alias("priority"))


def priority_floor(shown: DataFrame, weights: DataFrame, k: int) -> int | None:
    """A priority that at least `k` of the places reach; None if the probes are fewer than `k`.

    Probes are k new places, k places without an owner (priority 0) and the places of the k
    owners with the greatest weights; the last are cut to k before they leave their tasks.
    """
    small = _small(k)
    owned = shown.filter(F.col("user_id").isNotNull())
    new = owned.orderBy(F.desc("_bonus"), F.asc("id")).limit(k)
    theirs = weights.join(small(new.select("user_id").distinct()), "user_id", "left_semi")
    heavy = weights.orderBy(F.desc("_weight"), F.asc("user_id")).limit(k)
    lone = shown.filter(F.col("user_id").isNull()).limit(k)
    best = top(_exact(owned.join(small(heavy), "user_id")), newest("priority"),
               ["id", "priority"], k)
    probes = reduce(DataFrame.unionByName, [
        _exact(new.join(small(theirs), "user_id", "left")).select("id", "priority"),
        lone.select("id", F.lit(0).cast("bigint").alias("priority")), best,
    ]).distinct()
    got = probes.orderBy(F.desc("priority")).limit(k).agg(
        F.count("*").alias("n"), F.min("priority").alias("least")).first()
    return got["least"] if got["n"] == k else None


def candidates(shown: DataFrame, weights: DataFrame, floor: int | None,
               as_of: datetime) -> DataFrame:
    """Every place whose priority is at least `floor`, with that priority; all without a floor.

    `shown` has id, user_id, created_at and `_bonus`; `weights` one row per user.
    """
    owned = shown.filter(F.col("user_id").isNotNull())
    lone = shown.filter(F.col("user_id").isNull()).select(
        *PLACE, F.lit(0).cast("bigint").alias("priority"))
    if floor is None:
        return _exact(owned.join(weights, "user_id", "left")).unionByName(lone)
    most = weights.agg(F.greatest(F.max("_weight"), F.lit(0).cast("bigint"))).first()[0]
    need = floor - most
    # A day more than the bonus asks for, so that a change of clocks leaves nothing out.
    days = max(V.RECENCY_DAYS + 2 - max(need, 1), 0)
    since = stamp(as_of - timedelta(days=days), shown.schema["created_at"].dataType)
    by_date = owned.filter((F.col("created_at") > since) & (F.col("_bonus") >= max(need, 1)))
    found = [by_date.join(weights, "user_id", "left")]
    if need <= 0:  # a weight alone can reach the floor
        old = owned.filter(F.col("_bonus") == 0)
        how = "inner" if floor > 0 else "left"
        enough = weights.filter(F.col("_weight") >= floor) if floor > 0 else weights
        found.append(old.join(enough, "user_id", how))
    reach = [_exact(df).filter(F.col("priority") >= floor) for df in found]
    return reduce(DataFrame.unionByName, [*reach, lone] if floor <= 0 else reach)


def ranked_providers(providers: DataFrame, basis: Basis, source: DataFrame, packages: DataFrame,
                     as_of: datetime, status: str | None = "active",
                     limit: int | None = V.LISTING_LIMIT, offset: int | None = 0,
                     cut: Cut = keep) -> DataFrame:
    """The rows of `listing.ranked_providers`, found by bounds.

    Runs jobs when called: owners' weights are cut to a narrow table once, and one number,
    the floor, comes to the driver. Only the places that reach it meet that table.
    """
    rows, skip = max(1, limit or 0), max(0, offset or 0)
    bonus = recency(F.col("created_at"), moment(as_of, providers, "created_at"))
    shown = providers.filter(P.equals_if_given(
        F.coalesce(F.col("status"), F.lit("pending")), status)).select(*PLACE, bonus.alias("_bonus"))
    weights = cut(owner_weights(basis, source, packages, as_of))
    reach = candidates(shown, weights, priority_floor(shown, weights, rows + skip), as_of)
    order = newest("priority", "created_at")
    page = top(reach, order, ["id", "priority", "created_at"], rows, skip)
    cards = providers.select(*CARD, "status").join(_small(rows)(page), "id")
    return top(cards, order, RANKED_CARD, rows)
