from datetime import timedelta

import pytest
from market_rows import NOW, by, dicts

from stallbook.operators import entitlement as E
from stallbook.operators import listing as L
from stallbook.operators import reports as R

DAY = timedelta(days=1)


@pytest.fixture(scope="module")
def market(tables):
    packages = tables("packages", [
        {"id": 1, "name": "basic", "price": None, "duration_days": 30, "is_active": True,
         "max_places": 2, "priority_weight": 5},
        {"id": 2, "name": "free", "duration_days": 10, "is_active": None, "max_places": None},
        {"id": 3, "name": "off", "duration_days": 30, "is_active": False, "priority_weight": 9},
    ])
    subs = tables("subscriptions", [
        # a: two live with equal start, the lower id wins
        {"id": 11, "user_id": "a", "package_id": 2, "status": "active", "started_at": NOW - DAY},
        {"id": 10, "user_id": "a", "package_id": 1, "status": "active", "started_at": NOW - DAY,
         "expires_at": NOW + DAY},
        # b: only an expired one, c: expires right now
        {"id": 12, "user_id": "b", "package_id": 1, "status": "active", "started_at": NOW - 9 * DAY,
         "expires_at": NOW - DAY},
        {"id": 13, "user_id": "c", "package_id": 1, "status": "active", "started_at": NOW - 9 * DAY,
         "expires_at": NOW},
        # d: a missing start sorts as newest
        {"id": 14, "user_id": "d", "package_id": 1, "status": "active", "started_at": NOW},
        {"id": 15, "user_id": "d", "package_id": 2, "status": "active"},
    ])
    pays = tables("payments", [
        # a: the newest payment has run out and hides the older one that still runs
        {"id": 1, "user_id": "a", "package_id": 1, "status": "completed", "completed_at": NOW - 20 * DAY},
        {"id": 2, "user_id": "a", "package_id": 2, "status": "completed", "completed_at": NOW - 15 * DAY},
        # b: runs out right now and still counts; the disabled package does not
        {"id": 3, "user_id": "b", "package_id": 1, "status": "completed", "completed_at": NOW - 30 * DAY},
        {"id": 4, "user_id": "b", "package_id": 3, "status": "completed", "completed_at": NOW},
        {"id": 5, "user_id": "c", "package_id": 1, "status": "pending", "completed_at": NOW},
        {"id": 6, "user_id": "c", "package_id": 1, "status": "completed"},
        {"id": 7, "user_id": None, "package_id": 1, "status": "completed", "completed_at": NOW},
    ])
    providers = tables("providers", [
        {"id": 1, "user_id": "a", "status": "active", "created_at": NOW, "name": "p1"},
        {"id": 2, "user_id": "a", "status": None, "created_at": NOW, "name": "p2"},
        {"id": 3, "user_id": None, "status": "active", "created_at": NOW, "name": "p3"},
        {"id": 4, "user_id": "d", "status": "active", "name": "p4"},
        {"id": 5, "user_id": "z", "status": "active", "created_at": NOW - 3 * DAY, "name": "p5"},
    ])
    users = tables("user_profiles", [{"id": u, "full_name": u.upper()} for u in "abcde"])
    return {"packages": packages, "subscriptions": subs, "payments": pays, "providers": providers,
            "profiles": users, "users": users.selectExpr("id as user_id")}


def test_subscriptions_basis(market):
    got = by(E.latest_entitlement("subscriptions", market["subscriptions"], None, NOW), "user_id")
    assert {u: r["package_id"] for u, r in got.items()} == {"a": 1, "d": 2}


def test_payments_basis_ignores_expiry_and_disabled_packages(market):
    got = by(E.latest_entitlement("payments", market["payments"], market["packages"], NOW), "user_id")
    assert {u: r["payment_id"] for u, r in got.items()} == {"a": 2, "b": 3}
    assert got["a"]["expires_at"] == NOW - 5 * DAY


def test_user_package_has_a_row_for_everyone(market):
    args = (market["users"], "payments", market["payments"], market["packages"], NOW)
    got = by(E.user_package(*args), "user_id")
    assert set(got) == set("abcde")
    assert got["a"]["is_active"] is False and got["a"]["package_id"] == 2
    assert got["b"]["is_active"] is True
    assert got["e"] == {"user_id": "e", "package_id": None, "package_name": None,
                        "duration_days": None, "started_at": None, "expires_at": None,
                        "is_active": False}


def test_active_subscription_has_no_row_without_one(market):
    got = by(E.user_active_subscription(market["subscriptions"], market["packages"], NOW), "user_id")
    assert {u: r["subscription_id"] for u, r in got.items()} == {"a": 10, "d": 15}


def test_quota(market):
    args = (market["users"], "subscriptions", market["subscriptions"], market["packages"], NOW)
    got = by(E.place_quota(*args), "user_id")
    assert (got["a"]["max_places"], got["a"]["tier"]) == (2, "basic")
    assert (got["d"]["max_places"], got["d"]["tier"]) == (1, "free")
    assert (got["e"]["max_places"], got["e"]["tier"]) == (1, "free")


def test_can_add_counts_places_of_any_status(market):
    got = by(E.can_add_provider(market["users"], market["providers"], "subscriptions",
                                market["subscriptions"], market["packages"], NOW), "user_id")
    assert (got["a"]["allowed"], got["a"]["current_count"]) == (False, 2)
    assert (got["b"]["allowed"], got["b"]["current_count"]) == (True, 0)


def test_view_keeps_three_valued_activity(market):
    v1 = by(E.user_active_package(market["providers"], "payments", market["payments"],
                                  market["packages"], NOW), "user_id")
    assert {u: r["is_active"] for u, r in v1.items()} == {
        "a": False, "b": True, "c": None, "d": None, "z": None}
    v2 = by(E.user_active_package(market["providers"], "subscriptions", market["subscriptions"],
                                  market["packages"], NOW), "user_id")
    assert {u: r["is_active"] for u, r in v2.items()} == {
        "a": True, "b": None, "c": None, "d": True, "z": None}


def test_priority(market):
    got = by(L.provider_priority(market["providers"], "subscriptions", market["subscriptions"],
                                 market["packages"], NOW), "id")
    assert {i: r["priority"] for i, r in got.items()} == {1: 35, 2: 35, 3: 0, 4: 0, 5: 27}


def test_ranked_listing_order_and_clamps(market):
    def ids(**kw):
        return [r.id for r in L.ranked_providers(
            market["providers"], "subscriptions", market["subscriptions"], market["packages"], NOW,
            **kw).collect()]

    # equal priority: a missing creation time sorts as newest
    assert ids() == [1, 5, 4, 3]
    assert ids(limit=2, offset=1) == [5, 4]
    assert ids(limit=0) == ids(limit=-5) == ids(limit=None) == [1]
    assert ids(offset=-3) == ids(offset=None) == ids()
    assert ids(status="pending") == [2]
    assert ids(status=None) == [1, 2, 5, 4, 3]


def test_package_named_free_merges(market):
    got = dicts(R.providers_per_package(market["providers"], "subscriptions",
                                        market["subscriptions"], market["packages"], NOW))
    assert got == [{"package_name": "free", "providers_count": 3},
                   {"package_name": "basic", "providers_count": 2}]


def test_excess_counts_active_places_only(tables, market):
    asked = tables.rows("user_id string, package_id long", [("a", 2), ("a", 1), ("a", 99), ("e", 1)])
    got = {(r["user_id"], r["package_id"]): r for r in dicts(
        E.excess_places(asked, market["providers"], market["packages"]))}
    assert set(got) == {("a", 2), ("a", 1), ("e", 1)}
    assert got["a", 2]["has_warning"] is False and got["a", 2]["current_places"] == 1


def test_users_with_stats_for_one(tables, market):
    services = tables("services", [{"id": i, "provider_id": p, "name": "s"}
                                   for i, p in enumerate([1, 1, 2, 3, 5])])
    args = (market["profiles"], market["providers"], services, "subscriptions",
            market["subscriptions"], market["packages"], NOW)
    everyone = by(R.users_with_stats(*args), "user_id")
    assert (everyone["a"]["places_count"], everyone["a"]["services_count"]) == (2, 3)
    assert (everyone["e"]["places_count"], everyone["e"]["services_count"]) == (0, 0)
    assert dicts(R.users_with_stats(*args, user_id="a")) == [everyone["a"]]


def test_package_cards(tables, market):
    pending = tables.rows("user_id string, package_id long", [("a", 1), ("b", 1), ("b", 3)])
    entitled = E.user_package(market["users"], "payments", market["payments"], market["packages"], NOW)
    open_ones = market["packages"].fillna({"is_active": True})
    states = L.package_cards(open_ones, entitled, pending)
    assert {(r["user_id"], r["package_id"]): r["state"] for r in dicts(states)} == {
        ("a", 1): "pending", ("a", 2): "expired", ("b", 1): "subscribed"}
    cards = {r["package_id"]: r["state"] for r in dicts(L.package_cards_of(open_ones, states, "a"))}
    assert cards == {1: "pending", 2: "expired"}
    assert {r["state"] for r in dicts(L.package_cards_of(open_ones, states, "e"))} == {"available"}
