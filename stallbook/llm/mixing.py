"""Mix sources to target weights by capped water-filling.

The mix has as many words as all documents. Each source should have its weight's share,
but none more than `epochs` times its own size; what a capped source cannot take is shared
among the others by weight until no target is above its cap. A source's target is then
taken as whole repetitions of all its documents and a fraction of one more: its documents in
a seeded order, up to the words that are missing, the last one in part.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallbook.config import keep
from stallbook.llm.carry import Carried

_WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the order key that the narrowing steps of the seeded order have read, each three
#: more: two steps in the id's 32 digits, two in the text's.
_DIGITS = (3, 6, 35, 38)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def order_key(doc_id: Column, text: Column, seed: int) -> Column:
    """Where a document stands in the seeded order of its source: by its id, then its text."""
    by_id = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.concat(by_id, F.md5(F.coalesce(text, F.lit(""))))


def targets(sources: DataFrame, epochs: int = 3, cycle: int = 3) -> DataFrame:
    """Add weight and target to rows of source and source_size.

    The sources, by code point and null last, weigh 1 to `cycle`, repeating. In the order of
    cap per weight the capped sources come first, so one running sum finds the level at which
    the rest is shared. There is one row per source here: few, whatever the size of the corpus.
    """
    every = W.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    listed = sources.withColumn("weight", 1 + (F.row_number().over(by_name) - 1) % cycle)
    cap = F.col("source_size") * epochs
    by_level = every.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    upto = by_level.rowsBetween(W.unboundedPreceding, W.currentRow)
    left = (F.sum("source_size").over(every)
            - (F.sum(cap).over(upto) - cap)) / (
        F.sum("weight").over(every) - (F.sum("weight").over(upto) - F.col("weight")))
    return (listed.withColumn("level", left)
            .withColumn("capped", F.col("level") * F.col("weight") > cap)
            .withColumn("level", F.max(F.when(~F.col("capped"), F.col("level"))).over(every))
            .withColumn("target", F.when(F.col("capped"), cap.cast("double"))
                        .otherwise(F.col("level") * F.col("weight")))
            .drop("level", "capped"))


@dataclass
class Plan:
    """What each source takes: `whole` repetitions, and in the seeded order all documents
    before key `at` once more, which is `before` words; those at `at` as far as `rest` goes."""

    table: DataFrame


def plan(docs: DataFrame, seed: int = 1, epochs: int = 3, cycle: int = 3) -> Plan:
    """Sizes, targets and the place in the seeded order where each source's last words end.

    The sizes are written once. The place is found by four sums over key prefixes, of about
    4096 rows per source each at most, never by sorting a source. The last two tell the texts of
    one doc_id apart.
    """
    sized = keep(docs.select("source", word_count(F.col("text")).alias("size"),
                             F.substring(order_key(F.col("doc_id"), F.col("text"), seed), 1,
                                         _DIGITS[-1]).alias("key")), "sizes")
    found = keep(
        targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), epochs, cycle)
        .withColumn("words", F.round("target").cast("long"))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.expr("words div source_size"))
                    .otherwise(0).cast("long"))
        .withColumn("rest", F.col("words") - F.col("whole") * F.col("source_size"))
        .withColumn("at", F.lit("")).withColumn("before", F.lit(0).cast("long")), "targets")
    for done, digits in zip((0, *_DIGITS), _DIGITS):
        known = found.select(F.col("source").alias("of"), "rest", "at", "before")
        near = sized.join(known, F.col("source").eqNullSafe(F.col("of"))
                          & (F.substring("key", 1, done) == F.col("at")))
        sums = (near.groupBy("of", "rest", "before",
                             F.substring("key", 1, digits).alias("next"))
                .agg(F.sum("size").alias("size")))
        running = W.partitionBy("of").orderBy("next").rowsBetween(W.unboundedPreceding, -1)
        start = F.col("before") + F.coalesce(F.sum("size").over(running), F.lit(0))
        place = (sums.withColumn("start", start)
                 .where((F.col("start") <= F.col("rest"))
                        & (F.col("rest") < F.col("start") + F.col("size")))
                 .select("of", "next", "start"))
        found = keep(found.join(place, F.col("source").eqNullSafe(F.col("of")), "left").select(
            *[c for c in found.columns if c not in ("at", "before")],
            F.coalesce("next", "at").alias("at"), F.coalesce("start", "before").alias("before")),
            f"places_{digits}")
    return Plan(found)


def taken(docs: DataFrame, mix: Plan, seed: int = 1) -> DataFrame:
    """Add size, source_size, target, whole and part (words of the last repetition) to `docs`.

    Columns of these names are replaced. Only the documents at the place where a source's
    words end are sorted: one, and those with the same doc_id and text.
    """
    added = ("size", "source_size", "target", "whole", "part")
    own = [c for c in docs.columns if c not in added]
    known = mix.table.select(F.col("source").alias("__of"), "source_size", "target", "whole",
                             "rest", "at", "before")
    placed = (docs.select(*own, word_count(F.col("text")).alias("size"),
                          order_key(F.col("doc_id"), F.col("text"), seed).alias("__key"))
              .join(known, F.col("source").eqNullSafe(F.col("__of"))))
    digits = F.substring("__key", 1, _DIGITS[-1])
    clear = placed.where(digits != F.col("at")).withColumn(
        "part", F.when(digits < F.col("at"), F.col("size")).otherwise(0).cast("long"))
    order = W.partitionBy("__of").orderBy(
        "__key", "doc_id", F.md5("text")).rowsBetween(W.unboundedPreceding, -1)
    before = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    edge = placed.where(digits == F.col("at")).withColumn(
        "part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before)).cast("long"))
    return clear.unionByName(edge).select(*own, *added)


def mix_sources(docs: DataFrame, seed: int = 1, epochs: int = 3, cycle: int = 3) -> DataFrame:
    """Every row of `docs` with what the mix takes of it, `taken` words, repeats counted.

    Needs doc_id, text and source. A null source is a source of its own. Texts that are null or
    without words have size 0 and take nothing. Rows with the same doc_id stand together in
    the seeded order, by text; equal rows are taken one by one. A source without words has
    target 0; an empty table gives an empty one.
    """
    out = taken(docs, plan(docs, seed, epochs, cycle), seed)
    return out.withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))


def mixed(docs: DataFrame, seed: int = 1, epochs: int = 3, cycle: int = 3) -> DataFrame:
    """The mix itself: the rows of `docs`, each as often as it is taken.

    A document taken in part has its first words, joined by a space, as text; there is at most
    one per source. Documents without words are in no mix, and so are left out.
    """
    own = Carried(docs, "doc_id", "text", "source")
    rows = taken(own.rows, plan(docs, seed, epochs, cycle), seed)
    times = F.col("whole") + F.when(F.col("part") > 0, 1).otherwise(0)
    copies = rows.withColumn("__copy", F.explode(F.expr(
        "CASE WHEN size > 0 AND whole + int(part > 0) > 0 "
        "THEN sequence(1, whole + int(part > 0)) ELSE array() END")))
    cut = (F.col("__copy") == times) & (F.col("part") > 0) & (F.col("part") < F.col("size"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    first = F.array_join(F.slice(words, 1, F.greatest(F.lit(1), F.col("part")).cast("int")), " ")
    return own.back(copies.withColumn("text", F.when(cut, first).otherwise(F.col("text"))))
