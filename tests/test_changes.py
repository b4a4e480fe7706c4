import random
from datetime import timedelta
from decimal import Decimal

import pytest
from market_rows import NOW, by, dicts

from stallbook.functions import fixed_values as V
from stallbook.operators.changes import base as B
from stallbook.operators.changes import quota as K

DAY = timedelta(days=1)
ROOT = {"id": "root", "full_name": "Root", "role": "admin"}


def test_patch_rules(tables):
    places = tables("providers", [
        {"id": 1, "name": "a", "city": "x", "user_id": "u"}, {"id": 2, "name": "b", "user_id": None},
        {"id": 3, "name": "c", "city": "z", "user_id": "u"}])
    reqs = tables.rows("request_id long, id long, user_id string, name string, city string", [
        (1, 1, "u", "first", None), (2, 1, None, "second", "y"), (3, 1, "u", None, None),
        (4, 2, "u", "stolen", None), (5, 9, None, "ghost", None), (6, 1, "v", "wrong", "wrong")])
    change = B.patch_providers(places, reqs, NOW)
    got = by(change.state["table"], "id")
    assert (got[1]["name"], got[1]["city"], got[1]["updated_at"]) == ("second", "y", NOW)
    assert (got[2]["name"], got[2]["updated_at"]) == ("b", None)
    assert (got[3]["name"], got[3]["city"], got[3]["updated_at"]) == ("c", "z", None)
    assert {r["request_id"]: r["found"] for r in dicts(change.results)} == {
        1: True, 2: True, 3: True, 4: False, 5: False, 6: False}
    assert change.state["table"].columns == places.columns


def test_service_patch_does_not_touch_time(tables):
    services = tables("services", [{"id": 1, "name": "a", "price": Decimal("1.00"), "created_at": NOW}])
    reqs = tables.rows("request_id long, id long, price decimal(18,2)", [(1, 1, Decimal("2.00"))])
    got = dicts(B.patch_services(services, reqs).state["table"])
    assert got[0]["price"] == Decimal("2.00") and got[0]["name"] == "a"


def test_delete_rules(tables):
    places = tables("providers", [{"id": i, "user_id": u} for i, u in ((1, "u"), (2, "v"), (3, None))])
    reqs = tables.rows("request_id long, id long, user_id string",
                       [(1, 1, "v"), (2, 1, "u"), (3, 1, None), (4, 3, "u"), (5, 8, None)])
    change = B.delete_providers(places, reqs)
    assert set(by(change.state["table"], "id")) == {2, 3}
    assert {r["request_id"]: r["found"] for r in dicts(change.results)} == {
        1: False, 2: True, 3: False, 4: False, 5: False}


def test_package_deletes_need_an_admin_and_no_subscription(tables):
    packages = tables("packages", [{"id": i, "name": "a"} for i in (1, 2, 3)])
    subs = tables("subscriptions", [{"id": i, "user_id": "u", "package_id": 3} for i in range(5)])
    reqs = tables.rows("request_id long, actor_id string, id long",
                       [(1, "root", 1), (2, "u", 2), (3, "root", 3), (4, "root", 77), (5, "u", 3)])
    change = B.delete_packages(packages, tables("user_profiles", [ROOT]), reqs, subs)
    assert set(by(change.state["packages"], "id")) == {2, 3}
    assert {r["request_id"]: r["error"] for r in dicts(change.results)} == {
        1: None, 2: V.FORBIDDEN, 3: B.PACKAGE_IN_USE, 4: None, 5: V.FORBIDDEN}


def test_deletes_keep_references_whole(tables):
    subs = tables("subscriptions", [{"id": 1, "user_id": "u", "package_id": 1, "payment_id": 5},
                                    {"id": 2, "user_id": "v", "package_id": 1, "payment_id": 6}])
    ids = lambda kind, *x: tables.rows(f"request_id long, id {kind}", list(enumerate(x)))
    paid = B.delete_payments(tables("payments", [{"id": 5}, {"id": 6}]), subs, ids("long", 5, 9))
    assert set(by(paid.state["payments"], "id")) == {6}
    assert {i: r["payment_id"] for i, r in by(paid.state["subscriptions"], "id").items()} == {1: None, 2: 6}
    assert [r["found"] for r in dicts(paid.results.orderBy("request_id"))] == [True, False]
    left = B.delete_profiles(tables("user_profiles", [{"id": "u"}, {"id": "v"}]), subs, ids("string", "u"))
    assert set(by(left.state["user_profiles"], "id")) == {"v"}
    assert set(by(left.state["subscriptions"], "id")) == {2}


PACKAGE_REQUEST = ("request_id long, actor_id string, id long, name string, price decimal(18,2),"
                   " duration_days int, is_active boolean, description string, max_places int,"
                   " priority_weight int")


def test_package_upsert(tables):
    packages = tables("packages", [{"id": 4, "name": "old", "price": Decimal("1.00"), "duration_days": 5,
                                    "is_active": False, "description": "d", "max_places": 7,
                                    "priority_weight": 3, "ads_limit": 2}])
    two = Decimal("2.00")
    reqs = tables.rows(PACKAGE_REQUEST, [
        (1, "root", None, "new", two, 30, None, None, None, None),
        (2, "root", 4, "mid", two, 9, True, "x", None, None),
        (3, "root", 4, "last", two, 8, None, None, None, 1),
        (4, "u", 4, "no", two, 8, None, None, None, None),
        (5, "root", 99, "none", two, 8, None, None, None, None)])
    change = B.upsert_packages(packages, tables("user_profiles", [ROOT]), reqs, NOW)
    got = by(change.state["packages"], "id")
    assert set(got) == {4, 5}
    assert (got[5]["is_active"], got[5]["max_places"], got[5]["priority_weight"]) == (True, 1, 0)
    assert got[5]["created_at"] == NOW
    assert (got[4]["name"], got[4]["is_active"], got[4]["description"], got[4]["max_places"],
            got[4]["priority_weight"], got[4]["ads_limit"]) == ("last", True, None, 7, 1, 2)
    assert {r["request_id"]: (r["ok"], r["package_id"]) for r in dicts(change.results)} == {
        1: (True, 5), 2: (True, 4), 3: (True, 4), 4: (False, None), 5: (True, None)}


def test_toggle_and_defaults(spark, tables):
    packages = tables("packages", [
        {"id": 1, "name": "on", "price": Decimal("1.00"), "duration_days": 1, "is_active": True},
        {"id": 2, "name": "unset", "price": Decimal("1.00"), "duration_days": 1, "description": ""}])
    people = tables("user_profiles", [ROOT])
    ids = tables.rows("request_id long, actor_id string, id long", [(1, "root", 1), (2, "root", 2)])
    flipped = by(B.upsert_packages(packages, people, B.toggle_requests(packages, ids), NOW)
                 .state["packages"], "id")
    assert {i: r["is_active"] for i, r in flipped.items()} == {1: False, 2: True}
    assert flipped[2]["description"] is None and flipped[1]["max_places"] == 1

    on = by(B.enable_packages(packages), "id")
    assert on[1]["max_places"] is None and on[2]["max_places"] == 1 and on[2]["is_active"]
    assert on[2]["description"] is None

    from pyspark.sql import functions as F
    seeds = B.default_packages(spark).withColumn("actor_id", F.lit("root"))
    after = by(B.upsert_packages(packages, people, seeds, NOW).state["packages"], "id")
    assert [after[i]["max_places"] for i in (3, 4, 5)] == [3, 10, 50]
    assert after[5]["price"] == Decimal("500.00")


def test_package_and_service_forms(tables):
    people = tables("user_profiles", [ROOT])
    forms = tables.rows(
        "request_id long, actor_id string, name string, price string, duration_days string,"
        " description string, max_places string, priority_weight string",
        [(1, "root", " Gold ", "12.5", "0", " ", "x", None), (2, "root", "  ", "1", "1", "", "1", "1")])
    got = dicts(B.upsert_packages(tables("packages", []), people, B.package_requests(forms), NOW)
                .state["packages"])
    assert len(got) == 1
    p = got[0]
    assert (p["name"], p["price"], p["duration_days"], p["description"], p["max_places"],
            p["priority_weight"], p["is_active"]) == ("Gold", Decimal("12.50"), 30, None, 1, 0, True)

    asked = tables.rows("request_id long, provider_id string, name string, description string,"
                        " price string, image_url string",
                        [(1, "7", "cut", "", "0", ""), (2, "7", "dye", "d", "4.5", "i")])
    made = by(B.append_services(tables("services", []), B.service_requests(asked), NOW)
              .state["services"], "name")
    assert (made["cut"]["price"], made["cut"]["description"], made["cut"]["provider_id"]) == (None, None, 7)
    assert (made["dye"]["price"], made["dye"]["image_url"]) == (Decimal("4.50"), "i")


def test_status_and_role_rights(tables):
    people = tables("user_profiles", [ROOT, {"id": "own", "role": "owner"}, {"id": "u", "role": None}])
    places = tables("providers", [{"id": 1, "status": "pending"}, {"id": 2, "status": "active"}])
    reqs = tables.rows("request_id long, actor_id string, id long, status string",
                       [(1, "own", 1, "active"), (2, "root", 1, None), (3, "u", 2, "suspended")])
    got = by(B.set_provider_status(places, people, reqs, NOW).state["table"], "id")
    assert (got[1]["status"], got[1]["updated_at"]) == (None, NOW)
    assert (got[2]["status"], got[2]["updated_at"]) == ("active", None)

    roles = tables.rows("request_id long, actor_id string, id string, role string",
                        [(1, "own", "u", "admin"), (2, "root", "own", "user")])
    change = B.set_user_role(people, roles)
    assert {i: r["role"] for i, r in by(change.state["table"], "id").items()} == {
        "root": "admin", "own": "user", "u": None}
    assert [r["ok"] for r in sorted(dicts(change.results), key=lambda r: r["request_id"])] == [False, True]


def test_bulk_rules(tables):
    people = tables("user_profiles", [{"id": i, "role": r} for i, r in
                                      (("a", None), ("b", ""), ("c", " Admin "), ("d", "user"))])
    assert {i: r["role"] for i, r in by(B.fill_roles(people), "id").items()} == {
        "a": "user", "b": "user", "c": " Admin ", "d": "user"}
    assert [r["id"] for r in dicts(B.admin_profiles(people))] == ["c"]
    places = tables("providers", [{"id": 1, "status": "pending"}, {"id": 2}, {"id": 3, "status": "x"}])
    assert {i: r["status"] for i, r in by(B.approve_pending(places), "id").items()} == {
        1: "active", 2: None, 3: "x"}


def test_appends(tables):
    places = tables("providers", [{"id": 41, "name": "a"}])
    reqs = tables.rows("request_id long, name string, status string, delivery boolean",
                       [(10, "x", "active", None), (12, "y", None, True)])
    change = B.append_providers(places, reqs, NOW)
    got = by(change.state["providers"], "id")
    assert set(got) == {41, 42, 44}
    assert got[42]["status"] == "pending" and got[42]["created_at"] == NOW
    assert got[42]["online_service"] is False and got[44]["delivery"] is True
    assert {r["request_id"]: r["provider_id"] for r in dicts(change.results)} == {10: 42, 12: 44}

    services = tables("services", [])
    made = B.append_services(services, tables.rows(
        "request_id long, provider_id long, name string", [(3, 41, "s")]), NOW)
    assert dicts(made.state["services"], "id", "provider_id", "delivery", "price") == [
        {"id": 1, "provider_id": 41, "delivery": False, "price": None}]


def test_standalone_service_makes_its_place(tables):
    reqs = tables.rows("request_id long, name string, provider_name string, user_id string",
                       [(1, "cut", None, "u"), (2, "wash", "Salon", None)])
    change = B.append_standalone_services(tables("providers", [{"id": 5}]), tables("services", [{"id": 9}]),
                                          reqs, NOW)
    places = by(change.state["providers"], "id")
    services = by(change.state["services"], "id")
    assert (places[6]["name"], places[7]["name"]) == ("cut", "Salon")
    assert places[6]["online_service"] is True and places[6]["status"] == "pending"
    assert (services[10]["provider_id"], services[11]["provider_id"]) == (6, 7)
    assert {(r["provider_id"], r["service_id"]) for r in dicts(change.results)} == {(6, 10), (7, 11)}


def test_profiles_are_made_once(tables):
    people = tables("user_profiles", [ROOT])
    seen = tables.rows("id string", [("root",), ("n",), ("n",), (None,)])
    got = by(B.append_profiles(people, seen, NOW), "id")
    assert set(got) == {"root", "n"} and got["root"]["full_name"] == "Root"
    assert (got["n"]["full_name"], got["n"]["role"], got["n"]["created_at"]) == (V.NEW_USER, "user", NOW)


def test_settings_and_visits(tables):
    from stallbook.operators.reports import latest_settings

    people = tables("user_profiles", [ROOT])
    settings = tables("payment_settings", [{"id": 1, "bank_name": "old", "updated_at": NOW - DAY}])
    reqs = tables.rows("request_id long, actor_id string, bank_name string, bank_account string,"
                       " account_name string, mobile_wallet string, instructions string",
                       [(1, "root", "new", None, None, None, None), (2, "u", "bad", None, None, None, None)])
    change = B.append_settings(settings, people, reqs, NOW)
    assert dicts(latest_settings(change.state["payment_settings"]))[0]["bank_name"] == "new"
    assert {r["request_id"]: r["id"] for r in dicts(change.results)} == {1: 2, 2: None}
    empty = latest_settings(tables("payment_settings", []), {"bank_name": "fallback"})
    assert dicts(empty)[0]["bank_name"] == "fallback"

    visits = tables("visits", [{"id": 1, "page": "/a", "created_at": NOW - DAY}])
    calls = tables.rows("request_id long, page string", [(1, "/a"), (2, "/a"), (3, "/b")])
    seen = B.record_visits(visits, calls, NOW)
    assert seen.state["visits"].count() == 4
    assert {r["request_id"]: (r["total_visits"], r["today_visits"]) for r in dicts(seen.results)} == {
        1: (2, 1), 2: (3, 2), 3: (1, 1)}


def test_visits_are_counted_call_by_call_over_blocks(tables, monkeypatch):
    monkeypatch.setattr(B, "VISIT_BLOCK", 7)
    rows = [(i * 3, ["/a", "/a", "/b", None][i % 4]) for i in range(40)]
    visits = tables("visits", [{"id": 1, "page": "/a", "created_at": NOW - DAY}])
    got = B.record_visits(visits, tables.rows("request_id long, page string", rows), NOW).results
    seen, want = {"/a": 1}, {}
    for i, page in rows:
        seen[page] = seen.get(page, 0) + 1
        want[i] = seen[page] if page else 0
    assert {r["request_id"]: r["total_visits"] for r in dicts(got)} == want


def test_manual_payments(tables):
    packages = tables("packages", [{"id": 1, "name": "k", "price": Decimal("5.00")}])
    reqs = tables.rows("request_id long, actor_id string, user_id string, package_id long,"
                       " amount decimal(18,2)",
                       [(1, "root", "u", 1, None), (2, "root", "u", 1, Decimal("3.00")),
                        (3, "root", "u", 9, None), (4, "u", "u", 1, None)])
    change = B.append_manual_payments(tables("payments", []), packages, tables("user_profiles", [ROOT]),
                                      reqs, NOW)
    assert {r["id"]: r["amount"] for r in dicts(change.state["payments"])} == {
        1: Decimal("5.00"), 2: Decimal("3.00")}
    assert {r["request_id"]: r["error"] for r in dicts(change.results)} == {
        1: None, 2: None, 3: V.UNKNOWN_PACKAGE_ID + "9", 4: V.FORBIDDEN}


@pytest.mark.parametrize("seed", range(3))
def test_quota_insert_against_calls_one_by_one(tables, seed):
    rnd = random.Random(seed)
    users = ["a", "b", "c", None]
    limits = {"a": rnd.randint(1, 4), "b": rnd.randint(1, 4)}
    packages = tables("packages", [{"id": i, "name": u, "max_places": limits[u]}
                                   for i, u in enumerate(limits)])
    subs = tables("subscriptions", [{"id": i, "user_id": u, "package_id": i, "status": "active"}
                                    for i, u in enumerate(limits)])
    places = [{"id": i, "user_id": rnd.choice(users), "status": rnd.choice([None, "active"])}
              for i in range(6)]
    reqs = [(20 + i, rnd.choice(users), f"n{i}") for i in range(15)]
    change = K.insert_providers(tables("providers", places),
                                tables.rows("request_id long, user_id string, name string", reqs),
                                "subscriptions", subs, packages, NOW)
    count = {u: sum(p["user_id"] == u for p in places) for u in users}
    want = {}
    for rid, user, _ in reqs:
        limit = limits.get(user, 1)
        if user is None or count[user] < limit:
            count[user] += 1
            want[rid] = (True, None, 5 + rid - 20 + 1)
        else:
            tier = user if user in limits else "free"
            want[rid] = (False, V.QUOTA_EXCEEDED % (count[user], limit, tier), None)
    got = {r["request_id"]: (r["ok"], r["error"], r["provider_id"]) for r in dicts(change.results)}
    assert got == want
    new = by(change.state["providers"], "id", "user_id", "status", "name")
    assert set(new) == {p["id"] for p in places} | {w[2] for w in want.values() if w[0]}


def test_touch_marks_changed_rows_only(tables):
    before = tables("subscriptions", [{"id": 1, "status": "a"}, {"id": 2, "status": "b"}])
    after = tables("subscriptions", [{"id": 1, "status": "a"}, {"id": 2, "status": "c"}, {"id": 3}])
    got = by(B.touch(before, after, NOW), "id")
    assert {i: r["updated_at"] for i, r in got.items()} == {1: None, 2: NOW, 3: None}
