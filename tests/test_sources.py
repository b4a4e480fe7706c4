import pytest
from market_rows import NOW, by, dicts

from stallbook.functions import fixed_values as V
from stallbook.schemas import TABLES, schema
from stallbook.sources import tables as T


def test_schemas_parse(spark):
    assert {"id"} <= set.intersection(*[set(schema(n).names) for n in TABLES])
    assert schema("subscriptions")["status"].nullable is False


def test_read_append_and_project(spark, tables, tmp_path):
    root = str(tmp_path)
    rows = tables("activities", [{"id": 1, "name": "b"}, {"id": 2, "name": "a"}])
    assert T.append_rows(rows, root, "activities").count() == 2
    T.append_rows(tables("activities", [{"id": 3, "name": "c"}]), root, "activities")
    got = T.read_table(spark, root, "activities", ["id", "name"])
    assert got.columns == ["id", "name"] and got.count() == 3


def test_overview_reports_missing_tables(spark, tables, tmp_path):
    root = str(tmp_path)
    T.append_rows(tables("visits", [{"id": 1}, {"id": 2}]), root, "visits")
    got = by(T.overview(spark, root), "table_name")
    assert set(got) == set(V.OVERVIEW_TABLES) and len(got) == 25
    assert got["visits"]["row_count"] == 2 and got["visits"]["exists"]
    assert got["malls"] == {"table_name": "malls", "exists": False, "row_count": 0}
    names = [r["table_name"] for r in dicts(T.overview(spark, root, ["visits", "ads"]))]
    assert names == ["ads", "visits"]


def test_preview_keeps_missing_values_and_clamps(spark, tables):
    rows = tables("favorites", [{"id": i} for i in range(600)])
    got = dicts(T.preview(rows, 501))
    assert len(got) == 500 and '"user_id":null' in got[0]["item"]
    assert T.preview(rows, -1).count() == 0
    assert T.preview(rows).count() == 100
    assert [r["item"][:7] for r in dicts(T.preview(rows, 2, "id"))] == ['{"id":0', '{"id":1']


def test_snapshots(spark, tables, tmp_path):
    root = str(tmp_path)
    first = tables("packages", [{"id": 1, "name": "a", "duration_days": 1}])
    T.publish({"packages": first}, root, 1)
    second = tables("packages", [{"id": 1, "name": "b", "duration_days": 1}])
    T.publish({"packages": second, "activities": tables("activities", [{"id": 1, "name": "x"}])}, root, 2)
    # a snapshot that was never finished is not in the log
    first.write.parquet(f"{root}/packages/v3")
    assert T.read_snapshot(spark, root, "activities", 5).count() == 1
    with pytest.raises(ValueError, match="no finished snapshot"):
        T.read_snapshot(spark, root, "activities", 1)
    assert dicts(T.read_snapshot(spark, root, "packages"), "name") == [{"name": "b"}]
    assert dicts(T.read_snapshot(spark, root, "packages", 1), "name") == [{"name": "a"}]


def test_row_counts(tables):
    got = dicts(T.row_counts({"b": tables("ads", [{"id": 1}]), "a": tables("ads", [])}))
    assert got == [{"table_name": "a", "row_count": 0}, {"table_name": "b", "row_count": 1}]


def test_settle_gives_the_same_rows(tables):
    from stallbook.config import settle

    df = tables("ads", [{"id": 1, "created_at": NOW}])
    assert dicts(settle(df)) == dicts(df)


def test_kept_tables_stay_until_forgotten(spark, tables):
    import os

    from stallbook.config import forget, keep, shared_folder

    kept = keep(tables("ads", [{"id": 1, "title": "t"}]), "ads")
    assert dicts(kept, "id") == [{"id": 1}]
    root = shared_folder(spark).removeprefix("file:")
    folder = os.path.join(root, f"stallbook-{spark.sparkContext.applicationId}")
    assert os.listdir(folder)
    forget(spark)
    assert not os.path.exists(folder)
    forget(spark)
