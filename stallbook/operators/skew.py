"""Joins and per-key picks that stay balanced when one key holds much of the data.

Counting aggregates need nothing special: Spark combines them before the
shuffle. Nor does a join of two plain tables, where Spark's adaptive skew
handling splits the big partitions. It does not act where one side was itself
grouped by the join key, because Spark then reuses that grouping, and every row
of a hot key lands in one task. Picking rows per key has the same problem. Both
are solved here by spreading rows over a salt that is a fixed hash of the row,
so a retried task gives the same rows again.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_SHARE = 0.001
HOT_MIN_ROWS = 1_000_000
PICK_SALTS = 1024


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE,
             min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """Keys holding more than `share` of the rows, with the number of `_salts` that
    brings each salt of a key back to that share.

    Whatever the data size there are fewer than `1 / share` such keys and fewer than
    `2 / share` salts in all; that bound makes the result safe to broadcast.
    """
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    limit = df.agg(F.greatest(F.count(key) * F.lit(share), F.lit(float(min_rows)))).scalar()
    return counts.withColumn("_limit", limit).filter("n > _limit").select(
        key, F.ceil(F.col("n") / F.col("_limit")).cast("int").alias("_salts"))


def join_unique(left: DataFrame, right: DataFrame, key: str, row_id: str,
                share: float = HOT_SHARE, min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """Left join to a frame with one row per key, spreading the hot keys of `left`.

    Rows of a hot key get a salt from `row_id`; only the hot rows of `right` are
    copied, once per salt. Rows with a NULL key never match and are spread too.
    """
    hot = F.broadcast(hot_keys(left, key, share, min_rows))
    spread = F.when(F.col(key).isNull(), F.lit(int(1 / share))).otherwise(F.col("_salts"))
    salted = left.join(hot, key, "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(F.col(row_id)), spread), F.lit(0).cast("bigint"))
    ).drop("_salts")
    last = F.coalesce(F.col("_salts"), F.lit(1)) - F.lit(1)
    copied = right.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint")))
    ).drop("_salts")
    return salted.join(copied, [key, "_salt"], "left").drop("_salt")


def first_per_key(df: DataFrame, key: str, wanted: str, order: list[Column], row_id: str,
                  salts: int = PICK_SALTS) -> DataFrame:
    """The first `wanted` rows of each key in `order`; `wanted` is a column of `df`.

    Two rounds give the exact result: each salt keeps its own first rows, and
    the global first rows are among those. The second round sees at most
    `salts * wanted` rows of a key, never the whole group.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(row_id)), F.lit(salts)))
    for part in ([key, "_salt"], [key]):
        rank = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
        salted = salted.withColumn("_rank", rank).filter(F.col("_rank") <= F.col(wanted))
    return salted.drop("_salt", "_rank")
