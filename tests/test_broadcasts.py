"""Joins by size: written tables whose files are much smaller than their rows, rows without a key."""

import pytest
from pyspark.sql import functions as F

from stallbook import config
from stallbook.operators import reports as R
from stallbook.plans.queries import QUERIES
from stallbook.sources.adapters import Market


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def joined(spark, rows, cut):
    kept = cut(spark.range(rows).selectExpr("id", "'the same message for each of them' as error"))
    return spark.range(10 * rows).join(kept, "id", "left")


def test_many_small_rows_are_not_broadcast(spark):
    rows = config.BROADCAST_ROWS + 1
    assert "BroadcastHashJoin" in plan(joined(spark, rows, config.keep))  # what Spark makes of the files
    result = joined(spark, rows, config.keep_counted)
    assert "SortMergeJoin" in plan(result) and "BroadcastHashJoin" not in plan(result)
    assert result.where("error IS NOT NULL").count() == rows
    assert "BroadcastHashJoin" in plan(joined(spark, 1000, config.keep_counted))


@pytest.mark.parametrize("name", ["unique_activate_results", "cancel_results"])
def test_verdicts_are_not_broadcast(spark, monkeypatch, name):
    monkeypatch.setattr(config, "BROADCAST_ROWS", 100)
    found = plan(QUERIES[name](Market(spark, "/root/testdata/sf0.001")))
    verdicts = [line for line in found.splitlines() if "Join" in line and "request_id" in line]
    assert verdicts and all("SortMergeJoin" in line for line in verdicts)


def test_rows_without_a_key_are_spread_over_tasks(spark):
    rows = spark.range(2000).selectExpr("id", "case when id % 10 = 0 then id end as payment_id")
    bills = spark.range(0, 3000, 20).selectExpr("id", "concat('r', id) as receipt")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        found = R._lookup(rows, bills, "payment_id", [F.col("receipt")], False)
        got = [tuple(r) for r in found.select("id", "payment_id", "receipt", F.spark_partition_id()).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found.columns == ["payment_id", "id", "receipt"]
    assert sorted(r[0] for r in got) == list(range(2000))
    assert all(r[2] == (f"r{r[0]}" if r[0] % 20 == 0 else None) for r in got)
    assert len({r[3] for r in got if r[1] is None}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
