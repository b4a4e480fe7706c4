"""Bounded samples of labelled rows, the same at every run."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def per_class(rows: DataFrame, label: str, most: int, key: str = "doc_id") -> DataFrame:
    """At most `most` rows of each label, those with the smallest key hashes.

    The labels are counted first; then only rows whose hash is below their label's needed share
    of all hashes, about a fifth more than wanted, are ranked. Rows without label are left out.
    """
    rows = rows.where(F.col(label).isNotNull())
    counts = rows.groupBy(label).count().collect()  # one row per label
    bits = 1 << 30
    share = F.lit(bits)
    for r in counts:
        part = min(bits, int(bits * 1.2 * (most + 20) / r["count"]))
        share = F.when(F.col(label) == r[label], part).otherwise(share)
    hashed = F.pmod(F.xxhash64(F.col(key)), F.lit(bits))
    near = rows.withColumn("__hash", hashed).where(F.col("__hash") < share)
    rank = F.row_number().over(W.partitionBy(label).orderBy("__hash", F.col(key)))
    return near.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__hash", "__rank")
