from datetime import datetime, timedelta

from market_rows import NOW, dicts
from pyspark.sql import functions as F

from stallbook.schemas import schema
from stallbook.streaming import expiry as X
from stallbook.streaming import visits as S

DAY = timedelta(days=1)


def drop(tables, folder, name, rows):
    """One file per call, so that each becomes its own micro-batch."""
    tables(name, rows).coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, counts_of):
    source = spark.readStream.schema(schema("visits")).option("maxFilesPerTrigger", 1).parquet(
        str(tmp_path / "in"))
    counts = counts_of(source)
    S.write_changes(counts, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    return lambda keys: dicts(S.current_counts(spark, str(tmp_path / "out"), counts.schema, keys))


def test_stream_equals_batch_over_several_batches(spark, tables, tmp_path):
    rows = [{"id": i, "page": f"/{i % 3}", "created_at": NOW + timedelta(hours=i)} for i in range(40)]
    for start in range(0, 40, 10):
        drop(tables, str(tmp_path / "in"), "visits", rows[start:start + 10])
    counts = run(spark, tmp_path, lambda v: S.daily_visits(v).select(
        S.utc_day().alias("day"), "page", "visits"))
    got = {(r["day"], r["page"]): r["visits"] for r in counts(["day", "page"])}
    want = {}
    for r in rows:
        key = (r["created_at"].date(), r["page"])
        want[key] = want.get(key, 0) + 1
    assert got == want


def test_totals_per_page_go_on_after_a_restart(spark, tables, tmp_path):
    folder = str(tmp_path / "in")
    drop(tables, folder, "visits", [{"id": 1, "page": "/a", "created_at": NOW}])
    run(spark, tmp_path, S.total_visits)
    drop(tables, folder, "visits", [{"id": 2, "page": "/a", "created_at": NOW},
                                    {"id": 3, "page": "/b", "created_at": NOW}])
    counts = run(spark, tmp_path, S.total_visits)
    got = {r["page"]: r["visits"] for r in counts(["page"])}
    assert got == {"/a": 2, "/b": 1}


def test_visits_beyond_the_watermark_are_not_counted(spark, tables, tmp_path):
    folder = str(tmp_path / "in")
    day = datetime(2024, 3, 10, 12)
    # late rows are judged by the watermark of the batch before, hence the batch in between
    for batch in ([day], [day + 5 * DAY], [day + 5 * DAY], [day, day + 5 * DAY]):
        drop(tables, folder, "visits", [{"id": 1, "page": "/a", "created_at": t} for t in batch])
    counts = run(spark, tmp_path, lambda v: S.daily_visits(v).select(
        S.utc_day().alias("day"), "page", "visits"))
    got = {r["day"]: r["visits"] for r in counts(["day", "page"])}
    assert got == {day.date(): 1, (day + 5 * DAY).date(): 3}


def test_utc_instant_ignores_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        got = spark.sql("select timestamp_ntz '2024-01-01 00:00:07.5' as ts").select(
            F.unix_millis(S.utc_instant(F.col("ts")))).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == 1704067207500


def test_a_later_trigger_expires_what_ran_out_meanwhile(spark, tables, tmp_path):
    """Two batches and a moving clock: the second sweeps a row that came with the first."""
    row = {"user_id": "u", "package_id": 1, "status": "active", "created_at": NOW, "updated_at": NOW}
    drop(tables, str(tmp_path / "in"), "subscriptions", [
        row | {"id": 1, "expires_at": NOW + DAY}, row | {"id": 2, "expires_at": NOW - DAY},
        row | {"id": 3, "expires_at": None}, row | {"id": 4, "expires_at": NOW + DAY},
        row | {"id": 5, "expires_at": NOW - DAY, "status": "pending"}])
    drop(tables, str(tmp_path / "in"), "subscriptions", [
        row | {"id": 4, "expires_at": NOW + 9 * DAY, "updated_at": NOW + DAY}])
    columns = schema("subscriptions")
    ticks = spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    times = iter([NOW, NOW + 3 * DAY])

    def snapshot():
        known = spark.read.schema(columns).parquet(str(tmp_path / "in"))
        done = tmp_path / "out"
        return X.latest_versions(known.unionByName(
            spark.read.schema(columns).parquet(str(done)).select(*known.columns)) if done.exists() else known)

    def save(df, batch_id):
        df.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={batch_id}"))

    X.sweep_stream(ticks, snapshot, lambda: next(times), save, str(tmp_path / "progress")).awaitTermination()
    got = dicts(spark.read.parquet(str(tmp_path / "out")), "batch", "id", "status", "updated_at")
    assert sorted((r["batch"], r["id"], r["status"], r["updated_at"]) for r in got) == [
        (0, 2, "expired", NOW), (1, 1, "expired", NOW + 3 * DAY)]


def test_streamed_counts_of_a_folder_table_equal_the_batch(spark, tmp_path):
    from stallbook.plans.queries import Market, queries

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    for folder in (str(tmp_path), "/root/testdata/sf0.001"):
        streamed = queries()["visits_stream_totals"](spark, folder)
        assert {(r["page"], r["visits"]) for r in dicts(streamed)} == {
            (r["page"], r["n"]) for r in dicts(Market(spark, folder).visits.groupBy("page").agg(
                F.count("*").alias("n")))}
        assert streamed.agg(F.sum("visits")).first()[0] == events.count()


def test_latest_versions(tables):
    rows = [{"id": 1, "status": "pending", "updated_at": NOW - DAY},
            {"id": 1, "status": "active", "updated_at": NOW}, {"id": 2, "status": "x", "updated_at": NOW}]
    got = {r["id"]: r["status"] for r in dicts(X.latest_versions(tables("subscriptions", rows)))}
    assert got == {1: "active", 2: "x"}
