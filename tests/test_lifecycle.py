import random
from datetime import timedelta
from decimal import Decimal

import pytest
from market_rows import NOW, by, dicts
from model import Model, Refused

from stallbook.config import as_is, settle
from stallbook.functions import fixed_values as V
from stallbook.operators.changes import lifecycle as C

DAY = timedelta(days=1)
SUB = ["id", "user_id", "package_id", "status", "started_at", "expires_at", "payment_id", "amount",
       "auto_renew", "notes", "created_at", "updated_at"]
PAY = ["id", "user_id", "package_id", "status", "amount", "completed_at"]
PLACE = ["id", "user_id", "status", "created_at", "updated_at"]


def full(columns, **row):
    return {c: row.get(c) for c in columns}


def world(seed):
    """A small random market in which users share packages, payments and quirks."""
    rnd = random.Random(seed)
    users = [f"u{i}" for i in range(8)]
    packages = [{"id": i, "name": f"k{i}", "price": Decimal(f"{10 * i}.50"),
                 "duration_days": rnd.choice([10, 40]), "max_places": rnd.choice([None, 1, 2, 3]),
                 "is_active": rnd.choice([True, True, True, False, None])} for i in range(1, 5)]
    subs = [full(SUB, id=i, user_id=rnd.choice(users), package_id=rnd.randint(1, 4),
                 status=rnd.choice(["pending", "pending", "active", "active", "cancelled", "expired"]),
                 started_at=rnd.choice([None, NOW - rnd.randint(1, 20) * DAY]),
                 expires_at=rnd.choice([None, NOW - DAY, NOW, NOW + 5 * DAY]),
                 payment_id=rnd.choice([None, rnd.randint(1, 12)]), amount=Decimal("7.25"),
                 auto_renew=False, notes=rnd.choice([None, "old"]), created_at=NOW - 30 * DAY,
                 updated_at=NOW - 30 * DAY) for i in range(1, 41)]
    pays = [full(PAY, id=i, user_id=rnd.choice([None, *users]), package_id=rnd.randint(1, 4),
                 status=rnd.choice([None, "pending", "completed", "completed"]), amount=Decimal("5.00"))
            for i in range(1, 13)]
    places = [full(PLACE, id=i, user_id=rnd.choice([None, *users]),
                   status=rnd.choice([None, "pending", "active", "active"]),
                   created_at=rnd.choice([None, NOW - rnd.randint(1, 4) * DAY]), name=f"p{i}")
              | {"name": f"p{i}"} for i in range(1, 41)]
    profiles = [{"id": u, "full_name": u, "role": rnd.choice([None, "user", "admin", "owner"])}
                for u in users[:6]] + [{"id": "root", "full_name": "root", "role": "admin"}]
    return rnd, users, packages, subs, pays, places, profiles


class Setup:
    def __init__(self, tables, seed):
        (self.rnd, self.users, self.packages, self.subs, self.pays, self.places,
         self.profiles) = world(seed)
        self.model = Model(NOW, self.packages, self.subs, self.pays, self.places, self.profiles)
        for name, rows in (("packages", self.packages), ("subscriptions", self.subs),
                           ("payments", self.pays), ("providers", self.places),
                           ("user_profiles", self.profiles)):
            setattr(self, f"{name}_df", tables(name, rows))


def replay(results, calls):
    """Run all calls one by one in their order; compare each outcome."""
    assert sorted(r["request_id"] for r in results) == sorted(calls)
    for r in sorted(results, key=lambda r: r["request_id"]):
        try:
            outcome = calls[r["request_id"]]()
        except Refused as refusal:
            assert r["error"] == str(refusal), r
        else:
            assert r["ok"] and r["error"] is None, r
            for key, value in outcome.items():
                if key in r:
                    assert r[key] == value, (r, key)


def same(df, rows, columns):
    got = {r["id"]: r for r in dicts(df, *columns)}
    want = {i: {c: r.get(c) for c in columns} for i, r in rows.items()}
    assert got == want


@pytest.mark.parametrize("seed", range(4))
def test_activate_against_calls_one_by_one(tables, seed):
    s = Setup(tables, seed)
    reqs = [(100 + i, s.rnd.choice(["root", "root", "root", *s.users]),
             s.rnd.choice([None, *range(1, 44)]), s.rnd.choice([None, None, *range(1, 13), 990]))
            for i in range(90)]
    df = tables.rows("request_id long, actor_id string, subscription_id long, payment_id long", reqs)
    change = C.activate(s.subscriptions_df, s.payments_df, s.packages_df, s.providers_df,
                        s.user_profiles_df, df, NOW, cut=settle if seed % 2 else as_is)
    results = dicts(change.results)
    assert sorted(r["request_id"] for r in results) == [r[0] for r in reqs]
    calls = {r[0]: (lambda r=r: s.model.activate(r[1], r[2], r[3], 12 + r[0] - 100 + 1)) for r in reqs}
    replay(results, calls)
    same(change.state["subscriptions"], s.model.subs, SUB)
    same(change.state["payments"], s.model.pays, PAY)
    same(change.state["providers"], s.model.places, PLACE)

    # invariants: one live subscription and no more active places than allowed
    limits = {p["id"]: p["max_places"] or 1 for p in s.packages}
    last = {r["user_id"]: r for r in sorted(results, key=lambda r: r["request_id"]) if r["ok"]}
    assert len(last) < sum(r["ok"] for r in results)
    for r in last.values():
        if r["ok"]:
            mine = [x for x in s.model.subs.values() if x["user_id"] == r["user_id"] and s.model.live(x)]
            assert [x["id"] for x in mine] == [r["subscription_id"]]
            active = [p for p in s.model.places.values()
                      if p["user_id"] == r["user_id"] and p["status"] == "active"]
            assert len(active) <= limits[r["package_id"]]


@pytest.mark.parametrize("seed", range(3))
def test_create_against_calls_one_by_one(tables, seed, monkeypatch):
    monkeypatch.setattr(C, "TURN_BLOCK", [100_000, 7, 1][seed])
    s = Setup(tables, seed)
    reqs = [(7 + i, s.rnd.choice([None, "new1", "new2", *s.users]), s.rnd.choice([None, 1, 2, 3, 4, 9]))
            for i in range(80)]
    reqs += [(200 + i, "new1", s.rnd.choice([1, 2, 3])) for i in range(40)]
    df = tables.rows("request_id long, actor_id string, package_id long", reqs)
    change = C.create(s.subscriptions_df, s.packages_df, s.providers_df, s.user_profiles_df, df, NOW)
    results = dicts(change.results)
    calls = {r[0]: (lambda r=r: s.model.create(r[1], r[2], 40 + r[0] - 7 + 1)) for r in reqs}
    replay(results, calls)
    same(change.state["subscriptions"], s.model.subs, SUB)
    profiles = by(change.state["user_profiles"], "id")
    assert {u: r["role"] for u, r in profiles.items()} == s.model.roles
    for r in results:
        if r["ok"]:
            warned = r["places_warning"]
            assert warned["has_warning"] == (warned["excess_places"] is not None)


@pytest.mark.parametrize("seed", range(2))
def test_cancel_against_calls_one_by_one(tables, seed):
    s = Setup(tables, seed)
    reqs = [(i, s.rnd.choice(["root", "root", *s.users]), s.rnd.choice([None, *range(1, 44)]),
             s.rnd.choice([None, "why"])) for i in range(1, 91)]
    df = tables.rows("request_id long, actor_id string, subscription_id long, reason string", reqs)
    change = C.cancel(s.subscriptions_df, s.payments_df, s.user_profiles_df, df, NOW)
    replay(dicts(change.results), {r[0]: (lambda r=r: s.model.cancel(*r[1:])) for r in reqs})
    same(change.state["subscriptions"], s.model.subs, SUB)
    same(change.state["payments"], s.model.pays, PAY)


@pytest.mark.parametrize("seed", range(2))
def test_link_against_calls_one_by_one(tables, seed):
    s = Setup(tables, seed)
    reqs = [(i, s.rnd.choice([None, *range(1, 44)]), s.rnd.choice([None, *range(1, 15)]))
            for i in range(1, 91)]
    df = tables.rows("request_id long, subscription_id long, payment_id long", reqs)
    change = C.link_payments(s.subscriptions_df, s.payments_df, df, NOW)
    replay(dicts(change.results), {r[0]: (lambda r=r: s.model.link(*r[1:])) for r in reqs})
    same(change.state["subscriptions"], s.model.subs, SUB)


def activate_one(tables, packages, subs, places, pays=()):
    return C.activate(tables("subscriptions", subs), tables("payments", list(pays)),
                      tables("packages", packages), tables("providers", places),
                      tables("user_profiles", [{"id": "root", "role": "admin"}]),
                      tables.rows("request_id long, actor_id string, subscription_id long, payment_id long",
                                  [(1, "root", 1, None)]), NOW)


def test_quota_counts_all_places_but_switches_off_active_ones(tables):
    """Five places of which two are active, three allowed: both active ones go off."""
    places = [{"id": i, "user_id": "u", "created_at": NOW - i * DAY,
               "status": "active" if i < 3 else "pending"} for i in range(1, 6)]
    change = activate_one(tables, [{"id": 1, "name": "k", "max_places": 3}],
                          [{"id": 1, "user_id": "u", "package_id": 1, "status": "pending"}], places)
    assert {r["status"] for r in dicts(change.state["providers"])} == {"pending"}
    result = dicts(change.results)[0]
    assert result["places_deactivated"] == 2
    assert result["warning"] == V.WARN_PLACES_SWITCHED_OFF % (2, 5, 3)
    sub = dicts(change.state["subscriptions"])[0]
    assert sub["notes"] == V.NOTE_PLACES_SWITCHED_OFF % (2, 3, 5)
    assert sub["expires_at"] == NOW + 30 * DAY  # no duration: the activation default


def test_note_but_no_warning_when_nothing_was_active(tables):
    places = [{"id": i, "user_id": "u", "status": "pending"} for i in range(1, 4)]
    change = activate_one(tables, [{"id": 1, "name": "k"}],
                          [{"id": 1, "user_id": "u", "package_id": 1, "status": "pending"}], places)
    result = dicts(change.results)[0]
    assert result["places_deactivated"] == 0 and result["warning"] is None
    assert result["message"] == V.ACTIVATED + V.WARN_PLACES_SWITCHED_OFF % (0, 3, 1)
    assert dicts(change.state["subscriptions"])[0]["notes"] is not None


def test_second_cancelled_row_is_reported_as_duplicate(tables):
    from stallbook.operators.quality import duplicate_subscriptions

    subs = [{"id": 1, "user_id": "u", "package_id": 1, "status": "pending"},
            {"id": 2, "user_id": "u", "package_id": 1, "status": "pending"},
            {"id": 3, "user_id": "u", "package_id": 1, "status": "cancelled"}]
    change = activate_one(tables, [{"id": 1, "name": "k"}], subs, [])
    found = dicts(duplicate_subscriptions(change.state["subscriptions"]))
    assert found == [{"user_id": "u", "package_id": 1, "status": "cancelled", "n": 2}]


def test_second_request_of_a_user_sees_the_first(tables):
    subs = [{"id": i, "user_id": "u", "package_id": i, "status": "pending"} for i in (1, 2)]
    reqs = tables.rows("request_id long, actor_id string, subscription_id long, payment_id long",
                       [(5, "root", 2, None), (4, "root", 1, None), (3, "nobody", 2, None),
                        (6, "root", 1, None), (7, "root", 2, None)])
    change = C.activate(tables("subscriptions", subs), tables("payments", []),
                        tables("packages", [{"id": 1, "name": "a"}, {"id": 2, "name": "b"}]),
                        tables("providers", []), tables("user_profiles", [{"id": "root", "role": "admin"}]),
                        reqs, NOW)
    assert {r["request_id"]: r["error"] for r in dicts(change.results)} == {
        3: V.FORBIDDEN, 4: None, 5: None, 6: V.NOT_PENDING + "cancelled", 7: V.NOT_PENDING + "active"}


def test_expire_is_idempotent_and_counts(tables):
    subs = tables("subscriptions", [
        {"id": 1, "status": "active", "expires_at": NOW - DAY},
        {"id": 2, "status": "active", "expires_at": NOW},
        {"id": 3, "status": "active"}, {"id": 4, "status": "pending", "expires_at": NOW - DAY}])
    once = C.expire(subs, NOW)
    assert {r["id"]: r["status"] for r in dicts(once)} == {
        1: "expired", 2: "active", 3: "active", 4: "pending"}
    assert {r["id"] for r in dicts(once) if r["updated_at"] == NOW} == {1}
    assert dicts(C.expired_count(subs, NOW)) == [{"expired": 1}]
    assert dicts(C.expired_count(once, NOW)) == [{"expired": 0}]


def test_payments_era_calls(tables):
    pays = tables("payments", [{"id": 1, "user_id": "u", "package_id": 1, "status": "pending"},
                               {"id": 2, "user_id": "u", "package_id": 1, "status": "completed"},
                               {"id": 3, "user_id": "u", "package_id": 1}])
    people = tables("user_profiles", [{"id": "root", "role": "owner"}])
    reqs = tables.rows("request_id long, actor_id string, payment_id long", [
        (1, "root", 1), (2, "root", 2), (3, "root", 3), (4, "root", 9), (5, "u", 1), (6, "root", 1),
        (7, "root", None)])
    done = C.activate_payments(pays, people, reqs, NOW)
    assert {r["request_id"]: r["error"] for r in dicts(done.results)} == {
        1: None, 2: V.NOT_PENDING + "completed", 3: None, 4: V.SUBSCRIPTION_MISSING, 5: V.FORBIDDEN,
        6: V.NOT_PENDING + "completed", 7: V.SUBSCRIPTION_MISSING}
    assert by(done.state["payments"], "id", "status", "completed_at")[1] == {
        "id": 1, "status": "completed", "completed_at": NOW}
    gone = C.cancel_payments(pays, people, reqs, NOW)
    assert by(gone.state["payments"], "id")[1]["status"] == "cancelled"
    assert by(gone.state["payments"], "id")[1]["completed_at"] is None

    packages = tables("packages", [{"id": 1, "name": "k", "price": Decimal("9.50"), "is_active": True},
                                   {"id": 2, "name": "n", "price": Decimal("1.00")}])
    asks = tables.rows("request_id long, actor_id string, package_id long",
                       [(1, "u", 1), (2, "u", 1), (3, "u", 2), (4, "u", 7), (5, None, 1)])
    for paid in (False, True):
        made = C.create_payments(pays, packages, people, asks, NOW, paid=paid)
        assert {r["request_id"]: r["error"] for r in dicts(made.results)} == {
            1: None, 2: None, 3: V.PACKAGE_INACTIVE, 4: V.PACKAGE_MISSING, 5: V.SIGN_IN_FIRST}
        new = [r for r in dicts(made.state["payments"]) if r["id"] > 3]
        assert sorted(r["id"] for r in new) == [4, 5]
        assert {(r["status"], r["completed_at"], r["created_at"]) for r in new} == {
            ("completed", NOW, None) if paid else ("pending", None, NOW)}
        assert by(made.state["user_profiles"], "id")["u"]["role"] == "user"
