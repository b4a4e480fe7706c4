import os

import pytest
from market_rows import NOW, by, dicts

from stallbook.operators.changes import base as B
from stallbook.sources import buckets as BU

ROWS = [{"id": i, "name": f"p{i}", "user_id": f"u{i % 7}", "city": "c"} for i in range(1, 401)]


@pytest.fixture
def root(tables, tmp_path):
    BU.create(tables("providers", ROWS), str(tmp_path), "providers", buckets=16)
    return str(tmp_path)


def folders(root, version):
    at = f"{root}/providers/v{version}"
    return {f for f in os.listdir(at) if f.startswith("_bucket")} if os.path.isdir(at) else set()


def files(root):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f))
            for d, _, names in os.walk(f"{root}/providers") for f in names if f.endswith(".parquet")}


def patches(tables, rows):
    return tables.rows("request_id long, id long, user_id string, name string", rows)


def patch(rows, requests):
    return B.patch_providers(rows, requests, NOW)


def test_a_patch_writes_only_the_buckets_it_touches(spark, tables, root):
    before = files(root)
    requests = patches(tables, [(1, 5, None, "five"), (2, 6, "u6", "six"), (3, 7, "nobody", "x"),
                                (4, 9999, None, "y"), (5, None, None, "z"), (6, 5, None, "last")])
    results = BU.change_rows(spark, root, "providers", requests, patch, version=2)
    assert {r["request_id"]: r["found"] for r in dicts(results)} == {
        1: True, 2: True, 3: False, 4: False, 5: False, 6: True}
    assert before.items() <= files(root).items()  # no file of the first snapshot was written again
    own = {f"_bucket={v}" for v in spark.range(1).select(
        *[BU.bucket_of(BU.F.lit(i), 16).alias(f"b{i}") for i in (5, 6, 7, 9999)]).first()}
    assert folders(root, 2) <= own and len(folders(root, 2)) <= 4 < len(folders(root, 1))
    now = by(BU.stored(spark, root, "providers").rows(), "id")
    assert len(now) == 400 and now[5]["name"] == "last" and now[6]["name"] == "six"
    assert now[7]["name"] == "p7" and now[8] == by(
        BU.stored(spark, root, "providers", 1).rows(), "id")[8]
    assert by(BU.stored(spark, root, "providers", 1).rows(), "id")[5]["name"] == "p5"


def test_the_result_is_that_of_the_whole_table(spark, tables, root):
    requests = patches(tables, [(i, i * 3 % 500, f"u{i % 5}" if i % 2 else None, f"n{i}") for i in range(120)])
    BU.change_rows(spark, root, "providers", requests, patch, version=2)
    whole = patch(tables("providers", ROWS), requests).state["table"]
    assert by(BU.stored(spark, root, "providers").rows(), "id") == by(whole, "id")


def test_readers_see_all_or_nothing(spark, tables, root, monkeypatch):
    def stop(*_):
        raise RuntimeError("lost")

    requests = patches(tables, [(1, 5, None, "five")])
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(BU, "log_entry", stop)  # everything is written but the entry that makes it count
        BU.change_rows(spark, root, "providers", requests, patch, version=2)
    assert BU.stored(spark, root, "providers").version == 1
    assert by(BU.stored(spark, root, "providers").rows(), "id")[5]["name"] == "p5"
    BU.change_rows(spark, root, "providers", requests, patch, version=2)  # the batch runs again
    assert by(BU.stored(spark, root, "providers").rows(), "id")[5]["name"] == "five"
    with pytest.raises(ValueError, match="not after"):
        BU.change_rows(spark, root, "providers", requests, patch, version=2)


def test_deletes_down_to_an_empty_table_and_rows_after_that(spark, tables, root):
    every = tables.rows("request_id long, id long, user_id string", [(i, i, None) for i in range(1, 401)])
    BU.change_rows(spark, root, "providers", every, B.delete_providers, version=2)
    empty = BU.stored(spark, root, "providers")
    assert empty.rows().count() == 0 and empty.paths() == [] and empty.highest == 0
    BU.add_rows(tables("providers", ROWS[:3]), root, "providers", version=3)
    assert BU.stored(spark, root, "providers").rows().count() == 3
    assert BU.stored(spark, root, "providers", 1).rows().count() == 400


def test_new_rows_stand_beside_their_buckets_until_compacted(spark, tables, root):
    before = files(root)
    for version in (2, 3):
        BU.add_rows(tables("providers", [{"id": 1000 * version + i, "name": "n"} for i in range(40)]),
                    root, "providers", version)
    assert before.items() <= files(root).items()
    grown = BU.stored(spark, root, "providers")
    assert grown.rows().count() == 480 and grown.highest == 3039 and len(grown.folders) > 20
    many = BU.compact(spark, root, "providers", version=4, most=2)
    done = BU.stored(spark, root, "providers")
    assert many > 0 and by(done.rows(), "id") == by(grown.rows(), "id")
    assert max(sum(f.bucket == b for f in done.folders) for b in range(16)) <= 2
    assert BU.compact(spark, root, "providers", version=5, most=2) == 0


def test_upserts_number_new_rows_after_the_highest_id(spark, tables, tmp_path):
    root = str(tmp_path)
    packages = tables("packages", [{"id": i, "name": f"k{i}", "duration_days": 1} for i in range(1, 31)])
    profiles = tables("user_profiles", [{"id": "root", "full_name": "r", "role": "admin"}])
    requests = tables.rows(
        "request_id long, actor_id string, id long, name string, is_active boolean, max_places int,"
        " priority_weight int", [(1, "root", None, "new", None, None, None), (2, "root", 3, "three", None, 2, None),
                                 (3, "u", 4, "no", None, None, None), (4, "root", None, "newer", False, 1, 1)])
    BU.create(packages, root, "packages", buckets=8)
    change = lambda rows, asked: B.upsert_packages(rows, profiles, asked, NOW)
    results = BU.change_rows(spark, root, "packages", requests, change, version=2, state="packages")
    whole = change(packages, requests)
    assert by(results, "request_id") == by(whole.results, "request_id")
    assert by(BU.stored(spark, root, "packages").rows(), "id") == by(whole.state["packages"], "id")
    assert BU.stored(spark, root, "packages").highest == 34


def test_tables_with_text_ids(spark, tables, tmp_path):
    root = str(tmp_path)
    people = tables("user_profiles", [{"id": f"u{i}", "full_name": "n", "role": "user"} for i in range(50)] + [
        {"id": "root", "full_name": "r", "role": "admin"}])
    BU.create(people, root, "people", buckets=8)
    asked = tables.rows("request_id long, actor_id string, id string, role string", [(1, "root", "u3", "admin")])
    BU.change_rows(spark, root, "people", asked, lambda rows, requests: B.set_field(
        rows, people, requests, "role", BU.F.col("role") == "admin"), version=2)
    now = by(BU.stored(spark, root, "people").rows(), "id")
    assert len(now) == 51 and now["u3"]["role"] == "admin" and len(BU.stored(spark, root, "people").paths()) <= 9


def test_no_snapshot_yet(spark, tmp_path):
    with pytest.raises(ValueError, match="no finished"):
        BU.stored(spark, str(tmp_path), "providers")
