"""The listing by bounds against the plain listing, and what it leaves out before a join."""

import random
from datetime import timedelta

import pytest
from market_rows import NOW, by, dicts
from pyspark.sql import functions as F

from stallbook.config import as_is
from stallbook.functions.clock import moment
from stallbook.functions.scalars import recency
from stallbook.operators import bounded as N
from stallbook.operators import listing as L

DAY = timedelta(days=1)


def market(tables, seed, ages, weights, owners=40, places=300):
    rnd = random.Random(seed)
    packages = tables("packages", [{"id": i, "name": f"k{i}", "priority_weight": w}
                                   for i, w in enumerate(weights)])
    subscriptions = tables("subscriptions", [
        {"id": i, "user_id": f"u{rnd.randrange(owners)}", "package_id": rnd.randrange(len(weights) + 1),
         "status": rnd.choice(["active", "active", "pending"]), "amount": None, "created_at": NOW,
         "updated_at": NOW, "started_at": NOW - rnd.randint(0, 5) * DAY,
         "expires_at": rnd.choice([None, NOW - DAY, NOW + DAY])} for i in range(owners)])
    providers = tables("providers", [
        {"id": i, "name": f"p{i % 7}", "status": rnd.choice(["active", "active", None]),
         "user_id": rnd.choice([None, "u0", "u0", f"u{rnd.randrange(2 * owners)}"]),
         "created_at": rnd.choice([None, *(NOW - d * DAY for d in ages)])} for i in range(places)])
    return providers, subscriptions, packages


CASES = {
    "new and old": (range(0, 400, 9), [0, 1, 5, None]),
    "all old": ([40, 50, 50, 60], [0, 3, 3]),
    "all of one day": ([3], [2, 9]),
    "no packages": (range(0, 90, 4), []),
    "weights below zero": (range(0, 90, 4), [-4, -40]),
    "weights above any bonus": (range(0, 90, 4), [0, 100]),
    "future dates": ([-900, -3, 2, 400], [1, 2]),
}


@pytest.mark.parametrize("case", CASES)
def test_gives_the_plain_listing(spark, tables, case):
    places, subscriptions, packages = market(tables, len(case), *CASES[case])
    args = (places, "subscriptions", subscriptions, packages, NOW)
    pages = [{"limit": 10}, {"status": None, "limit": 7, "offset": 33}]
    if case == "new and old":
        pages += [{"limit": 400}, {"limit": None, "offset": -2}]
    for page in pages:
        assert dicts(N.ranked_providers(*args, **page, cut=as_is)) == dicts(
            L.ranked_providers(*args, **page)), page


def test_no_places(tables):
    places, subscriptions, packages = market(tables, 1, [1], [1], places=0)
    assert dicts(N.ranked_providers(places, "subscriptions", subscriptions, packages, NOW, cut=as_is)) == []


def left_over(places, subscriptions, packages, k):
    shown = places.select(*N.PLACE, recency(
        F.col("created_at"), moment(NOW, places, "created_at")).alias("_bonus"))
    weights = L.owner_weights("subscriptions", subscriptions, packages, NOW)
    floor = N.priority_floor(shown, weights, k)
    return floor, N.candidates(shown, weights, floor, NOW)


def test_only_places_that_reach_the_floor_are_left(tables):
    for seed, ages in ((1, range(0, 400, 9)), (2, [40, 50, 60])):
        places, subscriptions, packages = market(tables, seed, ages, [0, 1, 5])
        places = places.unionByName(tables("providers", [
            {"id": 1000 + i, "name": "p", "user_id": "v", "created_at": NOW - 70 * DAY} for i in range(20)]))
        subscriptions = subscriptions.unionByName(tables("subscriptions", [
            {"id": 1000, "user_id": "v", "package_id": 2, "status": "active", "created_at": NOW,
             "updated_at": NOW, "started_at": NOW}]))
        floor, left = left_over(places, subscriptions, packages, 10)
        true = by(L.provider_priority(places, "subscriptions", subscriptions, packages, NOW), "id")
        want = {i: r["priority"] for i, r in true.items() if r["priority"] >= floor}
        assert {r["id"]: r["priority"] for r in dicts(left)} == want
        assert 10 <= len(want) < 160 and floor > 0


def test_dates_that_cannot_reach_the_floor_are_not_read(spark, tables, tmp_path):
    places, subscriptions, packages = market(tables, 5, range(0, 400, 3), [0, 1], places=2000)
    places.write.parquet(str(tmp_path / "places"))
    stored = spark.read.schema(places.schema).parquet(str(tmp_path / "places"))
    floor, left = left_over(stored, subscriptions, packages, 5)
    text = left._jdf.queryExecution().toString()
    assert floor > 1 and "GreaterThan(created_at," in text
    assert all(r["created_at"] > NOW - 31 * DAY for r in dicts(left))
