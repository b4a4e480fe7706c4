import os
import random
from datetime import timedelta

import pytest
from market_rows import NOW, dicts

from stallbook.operators.changes import lifecycle as C
from stallbook.schemas import schema
from stallbook.sources import buckets as BU
from stallbook.streaming import calendar as K
from stallbook.streaming import expiry as X

DAY = timedelta(days=1)


def version(i, at, status="active", expires=None):
    return {"id": i, "user_id": f"u{i % 9}", "package_id": i % 4, "status": status, "created_at": NOW,
            "expires_at": expires, "updated_at": at}


def statuses(df):
    return {r["id"]: (r["status"], r["expires_at"]) for r in dicts(df, "id", "status", "expires_at")}


@pytest.mark.parametrize("seed", [0])
def test_triggers_equal_the_batch_sweep(spark, tables, tmp_path, seed):
    """Versions in random order over four triggers, each with a later clock."""
    rnd = random.Random(seed)
    every = [version(i, NOW + rnd.randint(0, 400) * timedelta(hours=1),
                     rnd.choice(["active", "active", "active", "pending", "cancelled"]),
                     rnd.choice([None, *(NOW + rnd.randint(-20, 60) * DAY for _ in range(4))]))
             for i in range(60) for _ in range(rnd.randint(1, 4))]
    rnd.shuffle(every)
    root, days = str(tmp_path / "t"), str(tmp_path / "days")
    clock, seen = NOW, []
    for batch_id in range(4):
        rows, since = every[batch_id::4], clock
        clock = NOW + 9 * batch_id * DAY + rnd.randint(0, 30) * timedelta(hours=1)
        K.trigger(tables("subscriptions", rows), batch_id, root, days, clock, min(since, clock), buckets=8)
        seen += rows
        want = C.expire(X.latest_versions(tables("subscriptions", seen)), clock)
        assert statuses(K.current(spark, root)) == statuses(want), batch_id


def test_work_follows_what_is_due(spark, tables, tmp_path, monkeypatch):
    root, days = str(tmp_path / "t"), str(tmp_path / "days")
    rows = [version(i, NOW, expires=NOW + (1 + i % 40) * DAY) for i in range(400)]
    K.trigger(tables("subscriptions", rows), 0, root, days, NOW, NOW, buckets=64)
    opened = []
    plain = K.due
    monkeypatch.setattr(K, "due", lambda s, c, d, r: opened.append(sorted(d)) or plain(s, c, d, r))
    ids = K.trigger(tables("subscriptions", [version(1000, NOW, "pending")]), 1, root, days,
                    NOW + 1.5 * DAY, NOW, buckets=64)
    assert opened == [[(NOW + k * DAY).date() for k in (0, 1, 2)]] and len(os.listdir(days)) >= 40
    assert {r["id"] for r in dicts(ids)} >= {i for i in range(400) if i % 40 == 0}
    gone = {i for i, (status, _) in statuses(K.current(spark, root)).items() if status == "expired"}
    assert gone == {i for i in range(400) if i % 40 == 0}
    written = {f for f in os.listdir(f"{root}/subscriptions/v4") if f.startswith("_bucket")}
    assert 0 < len(written) <= 10 < len(BU.stored(spark, root, "subscriptions").folders)


def test_a_renewal_on_its_way_is_not_lost(spark, tables, tmp_path):
    root, days = str(tmp_path / "t"), str(tmp_path / "days")
    K.trigger(tables("subscriptions", [version(1, NOW, expires=NOW + DAY), version(2, NOW, expires=NOW + DAY)]),
              0, root, days, NOW, NOW, buckets=4)
    K.trigger(tables("subscriptions", []), 1, root, days, NOW + 3 * DAY, NOW, buckets=4)
    assert {s for s, _ in statuses(K.current(spark, root)).values()} == {"expired"}
    # made before the sweep, delivered after it; the other one ran out long ago when it comes
    late = [version(1, NOW + DAY, expires=NOW + 90 * DAY), version(3, NOW, expires=NOW - 30 * DAY)]
    K.trigger(tables("subscriptions", late), 2, root, days, NOW + 4 * DAY, NOW + 3 * DAY, buckets=4)
    assert statuses(K.current(spark, root)) == {
        1: ("active", NOW + 90 * DAY), 2: ("expired", NOW + DAY), 3: ("expired", NOW - 30 * DAY)}


def test_a_trigger_that_runs_again_changes_nothing(spark, tables, tmp_path, monkeypatch):
    root, days = str(tmp_path / "t"), str(tmp_path / "days")
    rows = tables("subscriptions", [version(i, NOW, expires=NOW + i * DAY) for i in range(1, 9)])

    def stop(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(K, "expire", stop)
        K.trigger(rows, 0, root, days, NOW + 3.5 * DAY, NOW, buckets=4)
    for _ in range(2):
        K.trigger(rows, 0, root, days, NOW + 3.5 * DAY, NOW, buckets=4)
    got = statuses(K.current(spark, root))
    assert {i for i, (s, _) in got.items() if s == "expired"} == {1, 2, 3} and len(got) == 8
    assert BU.stored(spark, root, "subscriptions").rows().count() == 8


def test_over_a_stream_with_a_moving_clock(spark, tables, tmp_path):
    columns, times = schema("subscriptions"), [NOW, NOW + 5 * DAY]
    for rows in ([version(i, NOW, expires=NOW + i * DAY) for i in range(1, 9)],
                 [version(2, NOW + DAY, expires=NOW + 50 * DAY)]):
        tables("subscriptions", rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    saved, ticks = {}, iter([(NOW, NOW), (times[1], NOW)])
    now = {}

    def clock():
        now["t"], now["since"] = next(ticks)
        return now["t"]

    K.stream(source, str(tmp_path / "t"), str(tmp_path / "days"), clock, lambda: now["since"],
             lambda ids, b: saved.update({b: ids and {r["id"] for r in dicts(ids)}}),
             str(tmp_path / "progress"), buckets=4).awaitTermination()
    assert saved[1] == {1, 3, 4}
    got = statuses(K.current(spark, str(tmp_path / "t")))
    assert {i for i, (s, _) in got.items() if s == "expired"} == {1, 3, 4} and got[2][0] == "active"


def test_versions_that_ran_out_long_ago_need_no_days(spark, tables, tmp_path):
    root, days = str(tmp_path / "t"), str(tmp_path / "days")
    rows = [version(i, NOW, expires=NOW + (i - 300) * DAY) for i in range(330)]
    ids = K.trigger(tables("subscriptions", rows), 0, root, days, NOW, NOW, buckets=4)
    assert {r["id"] for r in dicts(ids)} == set(range(300))
    assert len([d for d in os.listdir(days) if d.startswith("day=")]) == 30
    window = {(NOW + k * DAY).date() for k in range(-100, 100)}
    found = K.due(spark, days, window, tables("subscriptions", rows[:1]))
    assert {r["id"] for r in dicts(found, "id")} == set(range(300, 330))
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert K.due(spark, days, {(NOW - 100 * DAY).date()}, tables("subscriptions", rows[:1])) is None
