"""Line dedup: delete later repeats of runs of lines, found by winnowing line hashes.

A window is a shortest run of lines, from some first line on or up to some last one, that
has `least` words or more. The smallest line hash in a window is its fingerprint. Two texts
that share a run of `least` words share all windows in it, and so their fingerprints: nothing
is missed. Fingerprints that occur once in the corpus are dropped at once, and with them
most windows. What is left is joined by position: windows of equal content match, the
first place (by doc_id, then line) keeps its lines, all later ones are repeats. A match
extends both ways as far as its neighbour windows match, because every line of a shared run
lies in one of the run's windows; the union of a text's repeated windows is deleted.

Lines are equal if their words are; whitespace in and around a line does not count. Lines
without words are in no window, but go if they stand inside a deleted run.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallbook.config import keep
from stallbook.llm.arrow import ready
from stallbook.llm.words import Slice, sequences, slices

LEAST = 40


def windows(part: Slice, least: int) -> tuple[np.ndarray, ...]:
    """Text, fingerprint, content hash, first and last line number of every window."""
    starts, ends, text, number = part.lines()
    n = len(text)
    first_word, end_word = np.searchsorted(part.starts, starts), np.searchsorted(part.starts, ends)
    line = sequences(part.words(), first_word, end_word)
    every = np.arange(n)
    to = np.searchsorted(end_word, first_word + least, "left")
    on = np.flatnonzero(to < n)
    on = on[text[to[on]] == text[on]]
    since = np.searchsorted(first_word, end_word - least, "right") - 1
    back = np.flatnonzero(since >= 0)
    back = back[text[since[back]] == text[back]]
    spans = np.unique(np.concatenate([every[on] * n + to[on], since[back] * n + every[back]])
                      if n else np.zeros(0, dtype=np.int64))
    i, j = spans // max(n, 1), spans % max(n, 1)
    least_hash = line[i] if n else np.zeros(0, dtype=np.uint64)
    for step in range(1, int((j - i).max(initial=0)) + 1):
        longer = np.flatnonzero(j - i >= step)
        least_hash[longer] = np.minimum(least_hash[longer], line[i[longer] + step])
    return text[i], least_hash, sequences(line, i, j + 1), number[i], number[j]


def _fingerprints(docs: DataFrame, least: int) -> DataFrame:
    def find(batches):
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(1)
            for part in slices(batch.column(2)):
                text, print_, content, first, last = windows(part, least)
                row = pa.array(text + part.first)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(row), hashes.take(row), pa.array(print_.view(np.int64)),
                     pa.array(content.view(np.int64)), pa.array(first.astype(np.int32)),
                     pa.array(last.astype(np.int32))],
                    ["doc_id", "text_hash", "print", "content", "first", "last"])

    ready(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.where(F.col("text").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        find, f"doc_id {kind}, text_hash long, print long, content long, first int, last int")


def repeated_spans(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per text with later repeats: doc_id, text_hash, `spans` of first and last line
    number, and `first_ids`, the documents that have the lines first.

    A very common line has many windows, but nothing gathers them: fingerprints are counted
    and first places found by sums and minima that are combined before their shuffle, and
    the joins are of written tables, which Spark splits where they are skewed.
    """
    prints = keep(_fingerprints(docs, least), "windows")
    common = keep(prints.groupBy("print").agg(F.count("*").alias("n")).where("n > 1")
                  .select("print"), "prints")
    place = F.struct("doc_id", "text_hash", "first")
    firsts = keep(prints.join(common, "print").groupBy("content").agg(
        F.min(place).alias("origin"), F.count("*").alias("n")).where("n > 1")
        .select("content", "origin"), "firsts")
    later = prints.join(firsts, "content").where(
        ~place.eqNullSafe(F.struct("origin.doc_id", "origin.text_hash", "origin.first")))
    return later.groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("first", "last")).alias("spans"),
        F.sort_array(F.collect_set("origin.doc_id")).alias("first_ids"))


def _without(text: pa.Array, spans: pa.Array) -> pa.StructArray:
    """Texts without the lines of their spans, and how many lines and words went."""
    out, lines, words = [], [], []
    for t, s in zip(text.to_pylist(), spans.to_pylist(), strict=True):
        if not s:
            out.append(t)
            lines.append(0)
            words.append(0)
            continue
        parts = t.split("\n")
        gone = np.zeros(len(parts) + 1, dtype=np.int64)
        for span in s:
            gone[span["first"]] += 1
            gone[span["last"] + 1] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        dropped = [p for p, g in zip(parts, gone, strict=True) if g]
        out.append("\n".join(p for p, g in zip(parts, gone, strict=True) if not g))
        lines.append(len(dropped))
        words.append(sum(len(p.encode().split()) for p in dropped))
    return pa.StructArray.from_arrays(
        [pa.array(out, pa.string()), pa.array(lines, pa.int64()), pa.array(words, pa.int64())],
        ["text", "removed_lines", "removed_words"])


def dedup_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """`docs` (doc_id, text and any other columns) with cleaned texts.

    Adds removed_lines, removed_words and first_ids (the documents that have the deleted lines
    first, null if nothing was deleted; a null id is not listed); columns of these names are replaced. Every row
    stays: a text of which all is repeated becomes empty. Null and empty texts stay as they are.

    Later means a larger doc_id (null is the smallest), then a later line; within a text,
    repeats after the first go too. Rows of one doc_id with different texts are told apart by the
    text's hash; equal rows count as one and keep the same lines.
    """
    added = ("removed_lines", "removed_words", "first_ids")
    own = [c for c in docs.columns if c not in added]
    found = repeated_spans(docs, least).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"),
        F.col("spans").alias("__spans"), "first_ids")

    def clean(text: pa.Array, spans: pa.Array) -> pa.Array:
        return _without(text, spans)

    cleaned = F.arrow_udf(clean, "text string, removed_lines long, removed_words long")
    rows = docs.select(*own).join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (
        F.xxhash64("text") == F.col("__hash")), "left")
    made = rows.withColumn("__clean", cleaned("text", "__spans"))
    return made.select(*[F.col("__clean.text").alias("text") if c == "text" else F.col(c)
                         for c in own], F.col("__clean.removed_lines").alias("removed_lines"),
                       F.col("__clean.removed_words").alias("removed_words"), "first_ids")
