import os
import random
from datetime import timedelta

import pytest
from market_rows import NOW, dicts
from pyspark.sql import functions as F

from stallbook.operators import listing as L
from stallbook.operators import visits as W
from stallbook.schemas import schema
from stallbook.sources import buckets as BU
from stallbook.streaming import rollup as R

DAY = timedelta(days=1)


def visit(i, page, at):
    return {"id": i, "page": page, "created_at": at}


def some(n, seed=0):
    rnd = random.Random(seed)
    return [visit(i, rnd.choice(["/a", "/a", "/a", "/b", None, "/place/7"]),
                  rnd.choice([None, *(NOW - rnd.randint(0, 9) * DAY for _ in range(8))])) for i in range(n)]


def counts(df):
    return {(r["page"], r["day"]): r["n"] for r in dicts(df.groupBy("page", "day").agg(F.sum("visits").alias("n")))}


def plain(rows):
    out = {}
    for r in rows:
        key = (r["page"], r["created_at"] and r["created_at"].date())
        out[key] = out.get(key, 0) + 1
    return out


def test_repeated_and_late_visits_over_batches_count_once(spark, tables, tmp_path):
    root, rows, rnd = str(tmp_path), some(200), random.Random(4)
    rnd.shuffle(rows)
    seen = []
    for n in range(4):
        new = rows[n::4]
        again = rnd.sample(seen, len(seen) // 3)
        R.take(tables("visits", new + again + new[:5]), n, root)
        seen += new
        if n in (1, 2):
            assert R.merge(spark, root, buckets=4, most=1) == n + 1
        assert counts(R.page_days(spark, root)) == plain(seen), n
    assert R.mark(spark, root) == 3 and R.taken(spark, root) == {1, 2, 3, 4}


def test_readers_give_what_a_full_scan_gives(spark, tables, tmp_path):
    root, rows = str(tmp_path), some(120, 3)
    whole = tables("visits", rows)
    R.take(tables("visits", rows[:70]), 0, root)
    R.merge(spark, root, buckets=4)
    R.take(tables("visits", rows[70:]), 1, root)
    days = R.page_days(spark, root)
    assert dicts(W.site_visits(days, NOW)) == dicts(W.site_visits(whole, NOW))
    for page in ("/a", "/none"):
        got = W.page_visits(R.page_days(spark, root, [page]), page, NOW)
        assert dicts(got) == dicts(W.page_visits(whole, page, NOW))
        assert got.dtypes == W.page_visits(whole, page, NOW).dtypes
    asked = W.pages_frame(spark, ["/b", "/none", None, "/a", "/b"])
    for repeats in (False, True):
        assert dicts(W.pages_visits(asked, days, NOW, repeats)) == dicts(W.pages_visits(asked, whole, NOW, repeats))
    place = spark.range(7, 9).toDF("id")
    assert sorted(map(str, dicts(L.with_badges(place, days, NOW)))) == sorted(
        map(str, dicts(L.with_badges(place, whole, NOW))))


def test_a_page_reads_its_bucket_and_the_tail_only(spark, tables, tmp_path):
    root = str(tmp_path)
    pages = [f"/place/{i}" for i in range(200)]
    R.take(tables("visits", [visit(i, p, NOW) for i, p in enumerate(pages)]), 0, root)
    R.merge(spark, root, buckets=16)
    R.take(tables("visits", [visit(900, "/place/7", NOW)]), 1, root)
    files = R.page_days(spark, root, ["/place/7"]).inputFiles()
    assert {f.split("/")[-2] for f in files if "/merged/" in f} <= {f"_bucket={b}" for b in range(16)}
    assert len({f.split("/")[-2] for f in files if "/merged/" in f}) == 1
    assert all("/counts/v2/" in f for f in files if "/merged/" not in f) and not any("arrived" in f for f in files)
    assert dicts(W.page_visits(R.page_days(spark, root, ["/place/7"]), "/place/7", NOW)) == [
        {"total_visits": 2, "today_visits": 2}]


def test_a_batch_looks_into_its_own_days_only(spark, tables, tmp_path):
    root = str(tmp_path)
    R.take(tables("visits", [visit(i, "/a", NOW - i * DAY) for i in range(6)]), 0, root)
    like = tables("visits", [])
    found = R.counted(spark, root, {str((NOW - 2 * DAY).date()), "1999-01-01"}, like, 1)
    assert [r["id"] for r in dicts(found)] == [2]
    assert {f.split("/day=")[1].split("/")[0] for f in found.inputFiles()} == {str((NOW - 2 * DAY).date())}
    assert dicts(R.counted(spark, root, {"1999-01-01"}, like, 1)) == []


def test_a_batch_that_runs_again_counts_once(spark, tables, tmp_path, monkeypatch):
    root, rows = str(tmp_path), tables("visits", some(40, 1))

    def stop(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(R, "log_entry", stop)
        R.take(rows, 0, root)
    assert counts(R.page_days(spark, root)) == {}
    for _ in range(2):
        R.take(rows, 0, root)
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(BU, "_enter", stop)
        R.merge(spark, root, buckets=4)
    assert counts(R.page_days(spark, root)) == plain(some(40, 1))
    for _ in range(2):
        assert R.merge(spark, root, buckets=4) == 1
    R.take(rows, 0, root)  # and after its merge
    assert counts(R.page_days(spark, root)) == plain(some(40, 1))


def test_empty_batches_and_rows_without_id(spark, tables, tmp_path):
    root = str(tmp_path)
    assert dicts(R.page_days(spark, root)) == [] and R.merge(spark, root) == 0
    R.take(tables("visits", []), 0, root)
    assert R.merge(spark, root, buckets=4) == 1 and counts(R.page_days(spark, root)) == {}
    assert dicts(W.site_visits(R.page_days(spark, root), NOW)) == [{"total_visits": 0, "today_visits": 0}]
    R.take(tables("visits", [visit(None, "/a", NOW), visit(None, "/a", NOW), visit(1, None, None),
                             visit(1, None, None)]), 1, root)
    R.merge(spark, root, buckets=4)
    assert counts(R.page_days(spark, root)) == {("/a", NOW.date()): 2, (None, None): 1}


def test_full_buckets_are_written_anew_and_stay_small(spark, tables, tmp_path):
    root = str(tmp_path)
    for n in range(5):
        R.take(tables("visits", [visit(n, "/a", NOW)]), n, root)
        R.merge(spark, root, buckets=2, most=2)
    table = BU.stored(spark, f"{root}/merged", R.TABLE)
    assert len(table.folders) <= 2 and table.rows().count() <= 2
    assert counts(R.page_days(spark, root)) == {("/a", NOW.date()): 5}
    assert os.path.isdir(f"{root}/merged/{R.TABLE}/v5")


def test_over_a_stream(spark, tables, tmp_path):
    rows = some(60, 2)
    for part in (rows[:30], rows[20:50], rows[40:]):
        tables("visits", part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema("visits")).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    R.stream(source, str(tmp_path / "r"), str(tmp_path / "progress"), every=2, buckets=4).awaitTermination()
    assert R.mark(spark, str(tmp_path / "r")) == 2
    assert counts(R.page_days(spark, str(tmp_path / "r"))) == plain(rows)
