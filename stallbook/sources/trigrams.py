"""Substring search by a table of trigrams.

Every run of three letters of a lower-cased name is a row (gram, id), stored in the order of the
gram, so a search opens the few row groups whose statistics span its grams. A gram that a third
of all names have is no list in one place: the table is cut into ranges of gram and id. The number
of rows of each gram stands beside it.

A search takes the letters between the pattern's wildcards. Names that match have all their trigrams,
so the ids of the rarest ones are met, and what is left is confirmed with the pattern itself,
which is what makes the result exact. A pattern without three letters in a row, or one whose rarest
gram is in more than `SCAN_SHARE` of the rows, scans: an index would read more than it saves.

Rows may be added. A renamed row is added with its new name; rows under an old or deleted name
do no harm, as every find is confirmed on the table.
"""

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P

SIZE = 3
RAREST = 4          # grams of a pattern whose rows are met; the rest is left to the confirmation
SCAN_SHARE = 0.1
FILES = 64


def _grams(name: Column) -> Column:
    """Distinct trigrams of a lower-cased name, by code points; none if it is shorter or NULL."""
    starts = F.sequence(F.lit(1), F.char_length(name) - (SIZE - 1))
    cut = F.transform(starts, lambda at: F.substring(name, at, F.lit(SIZE)))
    return F.when(F.char_length(name) >= SIZE, F.array_distinct(cut))


def add(rows: DataFrame, path: str, key: str = "id", name: str = "name", files: int = FILES) -> None:
    """Store the trigrams of `rows` beside what the index has."""
    part = f"{path}/{uuid.uuid4().hex}"
    found = rows.select(F.explode(_grams(F.lower(F.col(name)))).alias("gram"), F.col(key).alias("id"))
    found.repartitionByRange(files, "gram", "id").sortWithinPartitions("gram", "id").write.parquet(
        f"{part}/rows")
    spark = rows.sparkSession
    kept = spark.read.schema(found.schema).parquet(f"{part}/rows")
    counts = kept.groupBy("gram").agg(F.count("*").alias("n"))
    total = rows.agg(F.lit(None).cast("string").alias("gram"), F.count("*").alias("n"))
    counts.unionByName(total).repartitionByRange(max(1, files // 8), "gram").sortWithinPartitions(
        "gram").write.parquet(f"{part}/counts")


def letters(pattern: str) -> list[str]:
    """The plain runs of a search pattern: what stands between `%` and `_`, `\\` taken off."""
    runs, at = [""], 0
    while at < len(pattern):
        c = pattern[at]
        if c in "%_":
            runs.append("")
        else:
            at += c == "\\"
            runs[-1] += pattern[at:at + 1]
        at += 1
    return [r for r in runs if r]


def _cut(runs: list[str]) -> list[str]:
    """The distinct trigrams of lower-cased runs."""
    return sorted({r[at:at + SIZE] for r in runs for at in range(len(r) - SIZE + 1)})


def _ids(spark: SparkSession, path: str, kind: str, grams: list[str]) -> DataFrame | None:
    """Ids that have the rarest of the grams; None where a scan is cheaper."""
    if not grams:
        return None
    counts = spark.read.schema("gram string, n bigint").parquet(f"{path}/*/counts").filter(
        F.col("gram").isin(grams) | F.col("gram").isNull()).groupBy("gram").agg(F.sum("n").alias("n"))
    rows_of = {r["gram"]: r["n"] for r in counts.collect()}  # one row per gram of the pattern
    total = rows_of.pop(None, 0)
    rare = sorted(grams, key=lambda g: (rows_of.get(g, 0), g))[:RAREST]
    if rows_of.get(rare[0], 0) > SCAN_SHARE * total:
        return None
    rare = [g for g in rare if rows_of.get(g, 0) <= SCAN_SHARE * total]
    postings = spark.read.schema(f"gram string, id {kind}").parquet(f"{path}/*/rows")
    bit = reduce(lambda c, n: c.when(F.col("gram") == rare[n], 1 << n), range(1, len(rare)),
                 F.when(F.col("gram") == rare[0], 1))
    return postings.filter(F.col("gram").isin(rare)).groupBy("id").agg(
        F.bit_or(bit).alias("has")).filter(F.col("has") == (1 << len(rare)) - 1).select("id")


def _narrowed(rows: DataFrame, path: str, grams: list[str], key: str) -> DataFrame:
    found = _ids(rows.sparkSession, path, rows.schema[key].dataType.simpleString(), grams)
    return rows if found is None else rows.join(
        found.withColumnRenamed("id", key), key, "left_semi").select(*rows.columns)


def like(rows: DataFrame, path: str, text: str | None, key: str = "id",
         name: str = "name") -> DataFrame:
    """The rows that `predicates.name_like` keeps: `%` and `_` are wildcards, blank keeps all.

    Rows are told apart by `key`, which must not be NULL. The counts of the pattern's grams
    are read when called.
    """
    wanted = (text or "").strip()
    # Lower-cased whole, as the confirmation does it: a letter's form may depend on its neighbours.
    lower = rows.sparkSession.range(1).select(F.lower(F.lit(f"%{wanted}%")).alias("p")).first()["p"]
    return _narrowed(rows, path, _cut(letters(lower)), key).filter(P.name_like(text, name))


def containing(rows: DataFrame, path: str, text: str | None, key: str = "id",
               name: str = "full_name") -> DataFrame:
    """The rows that `predicates.name_contains` keeps: every letter stands for itself."""
    grams = _cut([(text or "").strip().lower()])
    return _narrowed(rows, path, grams, key).filter(P.name_contains(text, name))
