"""Ids without gaps for the rows of a batch, and owners counted by mergeable bitmaps."""

import random
from datetime import timedelta
from decimal import Decimal

from market_rows import NOW, dicts

from stallbook.operators import owners as O
from stallbook.operators import reports as R
from stallbook.operators.changes import base as B
from stallbook.operators.changes import dense as D
from stallbook.sources import ranks as K

DAY = timedelta(days=1)


def test_refused_requests_leave_no_gap(tables, tmp_path):
    payments = tables("payments", [{"id": 10, "user_id": "u", "status": "completed"}])
    packages = tables("packages", [{"id": 1, "name": "k", "price": Decimal(5)}])
    profiles = tables("user_profiles", [{"id": "boss", "role": "admin"}, {"id": "u", "role": "user"}])
    rnd = random.Random(5)
    asked = sorted(rnd.sample(range(1000), 60))
    requests = tables.rows(
        "request_id bigint, actor_id string, user_id string, package_id bigint, amount decimal(18,2)",
        [(i, rnd.choice(["boss", "u"]), f"u{i}", 1, None) for i in asked])
    change = B.append_manual_payments(payments, packages, profiles, requests, NOW)
    good = [r["request_id"] for r in sorted(dicts(change.results), key=lambda r: r["request_id"]) if r["ok"]]
    assert 5 < len(good) < 55
    for run in ("1", "2"):
        got = D.dense(change, {"payments": payments}, {"payments": [("results", "payment_id")]},
                      str(tmp_path / run), ranges=8)
        assert {r["request_id"]: r["payment_id"] for r in dicts(got.results) if r["ok"]} == {
            r: 11 + n for n, r in enumerate(good)}
        assert {r["id"]: r["user_id"] for r in dicts(got.state["payments"])} == {
            10: "u"} | {11 + n: f"u{r}" for n, r in enumerate(good)}


def test_ids_that_name_new_rows_follow(tables, tmp_path):
    places, services = tables("providers", [{"id": 4, "name": "x"}]), tables("services", [
        {"id": 9, "provider_id": 4, "name": "s"}, {"id": 3, "provider_id": None, "name": "t"}])
    requests = tables.rows("request_id bigint, name string", [(50, "c"), (7, "a"), (20, "b")])
    change = B.append_standalone_services(places, services, requests, NOW)
    uses = {"providers": [("services", "provider_id"), ("results", "provider_id")],
            "services": [("results", "service_id")]}
    got = D.dense(change, {"providers": places, "services": services}, uses, str(tmp_path / "a"), ranges=4)
    assert sorted((r["id"], r["provider_id"], r["name"]) for r in dicts(got.state["services"])
                  if r["provider_id"]) == [(9, 4, "s"), (10, 5, "a"), (11, 6, "b"), (12, 7, "c")]
    assert sorted((r["id"], r["name"]) for r in dicts(got.state["providers"])) == [
        (4, "x"), (5, "a"), (6, "b"), (7, "c")]
    assert sorted((r["request_id"], r["provider_id"], r["service_id"]) for r in dicts(got.results)) == [
        (7, 5, 10), (20, 6, 11), (50, 7, 12)]
    assert {f.name for f in got.state["services"].schema} == {f.name for f in services.schema}
    none = B.append_standalone_services(places, services, requests.limit(0), NOW)
    got = D.dense(none, {"providers": places, "services": services}, uses, str(tmp_path / "b"), ranges=4)
    assert dicts(got.results) == [] and len(dicts(got.state["services"])) == 2


def test_numbers_do_not_depend_on_the_ranges(tables, tmp_path):
    df = tables.rows("k int, id bigint", [(i % 3, i) for i in range(100)])
    got = [sorted(tuple(r) for r in K.build(df, str(tmp_path / str(n)), ["-k"], n).numbered(5).collect())
           for n in (1, 7, 30)]
    want = sorted(((i % 3, i) for i in range(100)), key=lambda r: (-r[0], r[1]))
    assert got[0] == got[1] == got[2] == sorted((*r, 5 + n) for n, r in enumerate(want))


def test_owners_of_any_span_are_the_distinct_ones(tables, tmp_path):
    rnd = random.Random(8)
    rows = [{"id": i, "name": "p", "status": rnd.choice(["active", "pending", None]),
             "user_id": rnd.choice([None, "hot", "hot", f"u{rnd.randrange(60)}"]),
             "created_at": rnd.choice([None, *(NOW - d * DAY for d in range(12))])} for i in range(300)]
    first, rest = tables("providers", rows[:150]), tables("providers", rows)
    known = O.number_owners(first, str(tmp_path / "1"), ranges=4)
    numbers = O.number_owners(rest, str(tmp_path / "2"), known, ranges=4)
    users = {r["user_id"] for r in rows} - {None}
    assert sorted(r["number"] for r in dicts(numbers)) == list(range(1, len(users) + 1))
    early = O.owner_days(first, known)
    days = early.unionByName(O.owner_days(rest, numbers)).unionByName(early)  # parts may come again

    def plain(keep=lambda r: True, key=lambda r: None):
        out = {}
        for r in rows:
            if r["user_id"] and keep(r):
                out.setdefault(key(r), set()).add(r["user_id"])
        return {k: len(v) for k, v in out.items()}

    assert dicts(O.owners(days)) == [{"total_users": len(users)}] == dicts(
        R.site_stats(rest, tables("payments", [])), "total_users")
    assert {r["status"]: r["total_users"] for r in dicts(O.owners(days, ["status"]))} == plain(
        key=lambda r: r["status"])
    since, until = (NOW - 6 * DAY).date(), (NOW - 2 * DAY).date()
    got = dicts(O.owners(days, ["status"], since, until))
    assert {r["status"]: r["total_users"] for r in got} == plain(
        lambda r: r["created_at"] and since <= r["created_at"].date() <= until, lambda r: r["status"])
    assert dicts(O.owners(days, since=(NOW + DAY).date())) == [{"total_users": 0}]


def test_more_owners_than_a_bucket_holds(spark, tmp_path):
    places = spark.range(70_000).selectExpr(
        "id", "concat('u', id % 35000) user_id", "'active' status", "timestamp'2024-01-01' created_at")
    numbers = O.number_owners(places, str(tmp_path / "n"), ranges=4)
    days = O.owner_days(places, numbers)
    assert days.count() == 2 and dicts(O.owners(days)) == [{"total_users": 35_000}]
