"""Run dedup: delete later repeats of runs of words, wherever in a line they begin or end.

A window is `least` words in a row. All windows of a text that stand at an earlier place too
(by doc_id, then word) are deleted, so of every run of `least` words or more that an earlier
place has, nothing stays, and all else does. Line breaks count as any whitespace.

Windows are as many as words, so only those that can repeat are made into rows. The print of a
window is the smallest hash of the short grams in it (winnowing), the same wherever the window
stands. Prints that stand at two places or more are entered in a bitmap of fixed size, and
a window becomes a row if its print is in there. A bit set by another print costs a row that
finds no partner, never a result. Later copies of a whole text need no windows at all.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallbook.config import keep
from stallbook.llm.arrow import ready
from stallbook.llm.line_dedup import LEAST
from stallbook.llm.words import Slice, mix, sequences, slices

#: Bits of a bitmap, a power of two: 8 MB for the driver and each Python worker.
BITS = 1 << 26
#: Later copies that are known before windows are made; further ones only cost more rows.
COPIES = 1 << 20


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """The least or largest of every `width` values in a row."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = pick(values[:-step], values[step:])
        done += step
    return values


def _windows(part: Slice, least: int) -> tuple[np.ndarray, ...]:
    """First word and print of every window, and the hashes of all words and grams."""
    words, n = part.words(), len(part.text)
    gram = max(1, 3 * least // 10)
    if n < least:
        none = np.zeros(0, dtype=np.uint64)
        return np.zeros(0, dtype=np.int64), none, words, none
    at = np.arange(n - gram + 1)
    grams = sequences(words, at, at + gram)
    prints = _sliding(grams, least - gram + 1, np.minimum)
    first = np.flatnonzero(part.text[:n - least + 1] == part.text[least - 1:])
    return first, prints[first], words, grams


def selected(part: Slice, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The prints of the windows and the words at which they stand, each place once."""
    first, prints, _, grams = _windows(part, least)
    if not len(first):
        return prints, first
    width = len(part.text) - least + 1
    reach = least - (len(part.text) - len(grams) + 1) + 1
    most = np.zeros(width + 2 * (reach - 1), dtype=np.uint64)
    most[first + reach - 1] = prints
    at = np.flatnonzero(_sliding(most, reach, np.maximum) == grams)
    return grams[at], at


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("text").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("text_hash"), "text")


def _key(text_hash: str | Column) -> Column:
    return F.xxhash64("doc_id", text_hash)


def _bitmap(hashes: DataFrame) -> bytes:
    """A bit for each value of the column `hash`, packed."""
    bit = F.col("hash").bitwiseAND(F.lit(BITS - 1))
    rows = hashes.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("bits")).toArrow()
    out = np.zeros(BITS // 64, dtype=np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return zlib.compress(out.tobytes(), 1)


def _unpacked(bits: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(bits), dtype=np.uint64)


def _among(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    bit = hashes.view(np.uint64) & np.uint64(BITS - 1)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0


def _common(docs: DataFrame, least: int) -> bytes:
    """Bitmap of the prints that stand at several places; copies of a text are one place."""
    def find(batches):
        for batch in batches:
            texts = batch.column(0).to_numpy().view(np.uint64)
            for part in slices(batch.column(1)):
                prints, at = selected(part, least)
                text = part.text[at]
                place = mix(texts[text + part.first] + mix((at - part.spans()[text]).astype(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prints.view(np.int64)), pa.array(place.view(np.int64))],
                    ["hash", "place"])

    prints = _hashed(docs).select("text_hash", "text").mapInArrow(find, "hash long, place long")
    return _bitmap(prints.groupBy("hash").agg(F.min("place").alias("a"), F.max("place").alias("b"))
                   .where("a <> b").select("hash"))


def _repeatable(docs: DataFrame, least: int, copies: DataFrame) -> DataFrame:
    """doc_id, text_hash, content hash and first word of the windows whose print is common."""
    common = _common(docs, least)
    known = np.sort(copies.select(_key("text_hash").alias("key")).limit(COPIES).toArrow()
                    .column("key").to_numpy())

    def find(batches):
        bitmap = _unpacked(common)
        for batch in batches:
            keys = batch.column("key").to_numpy()
            new = ~np.isin(keys, known)
            batch = batch.filter(pa.array(new))
            if not batch.num_rows:
                continue
            for part in slices(batch.column("text")):
                first, prints, words, _ = _windows(part, least)
                first = first[_among(prints, bitmap)]
                text = part.text[first]
                row = pa.array(text + part.first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(row), batch.column("text_hash").take(row),
                     pa.array(sequences(words, first, first + least).view(np.int64)),
                     pa.array((first - part.spans()[text]).astype(np.int32))],
                    ["doc_id", "text_hash", "content", "first"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _hashed(docs).withColumn("key", _key("text_hash")).mapInArrow(
        find, f"doc_id {kind}, text_hash long, content long, first int")


def repeated_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per text with later repeats: doc_id, text_hash, `firsts` (the first words of
    its repeated windows; null for a later copy of a whole text) and `first_ids`.

    As with lines, nothing gathers the windows of a common content: first places are minima
    that are combined before their shuffle, and Spark splits the join of the written tables.
    """
    ready(docs.sparkSession)
    texts = keep(_hashed(docs).select("doc_id", "text_hash").distinct(), "texts")
    origins = keep(texts.groupBy("text_hash").agg(
        F.min(F.struct("doc_id")).alias("origin"), F.count("*").alias("n")).where("n > 1"), "origins")
    copies = keep(texts.join(origins, "text_hash").where(
        ~F.struct("doc_id").eqNullSafe(F.col("origin"))).select(
        "doc_id", "text_hash", F.col("origin.doc_id").alias("origin_id")), "copies")
    windows = keep(_repeatable(docs, least, copies), "windows")
    place = F.struct("doc_id", "text_hash", "first")
    firsts = keep(windows.groupBy("content").agg(
        F.min(place).alias("origin"), F.max(place).alias("last")).where("origin <> last")
        .select("content", "origin"), "firsts")
    later = windows.join(firsts, "content").where(
        ~place.eqNullSafe(F.struct("origin.doc_id", "origin.text_hash", "origin.first")))
    found = later.groupBy("doc_id", "text_hash").agg(
        F.collect_set("first").alias("firsts"),
        F.sort_array(F.collect_set("origin.doc_id")).alias("first_ids"))
    gone = copies.select(F.col("doc_id").alias("i"), F.col("text_hash").alias("h"))
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h"))
    whole = copies.select("doc_id", "text_hash", F.lit(None).cast("array<int>").alias("firsts"),
                          F.array_compact(F.array("origin_id")).alias("first_ids"))
    return found.join(gone, same, "left_anti").unionByName(whole)


def _without(text: str, firsts: np.ndarray | None, least: int) -> tuple[str, int, int]:
    """A text without its repeated windows, and how many lines and words went.

    Where words go, the whitespace before or after them stays, that with more line breaks.
    """
    part = next(slices(pa.array([text])))
    n, data = len(part.starts), part.data.tobytes()
    if n < least:
        return text, 0, 0
    gone = np.zeros(n + 1, dtype=np.int64)
    if firsts is None:
        gone[0] = 1
    else:
        gone[firsts] += 1
        np.subtract.at(gone, firsts + least, 1)
    gone = np.cumsum(gone)[:n] > 0
    line = np.searchsorted(np.flatnonzero(part.data == 10), part.starts)
    whole = len(np.setdiff1d(line[gone], line[~gone]))
    if gone.all():
        return "", whole, n
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    out, at = [], 0
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        if a:
            out.append(data[at:part.ends[a - 1]])
        at = part.starts[b] if b < n else len(data)
        if a and b < n:
            before, after = data[part.ends[a - 1]:part.starts[a]], data[part.ends[b - 1]:at]
            out.append(max(before, after, key=lambda s: s.count(b"\n")))
    return b"".join([*out, data[at:]]).decode(), whole, int(gone.sum())


def dedup_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """`docs` (doc_id, text and any other columns) with cleaned texts.

    Adds removed_lines (lines of which all words went), removed_words and first_ids (the
    documents that have the deleted words first, for a later copy of a whole text the first that
    has it; null if nothing was deleted; a null id is not listed); columns of these names are
    replaced. Every row stays, and a text of which all is repeated becomes empty.

    Later means a larger doc_id (null is the smallest), then a later word; rows of one doc_id
    with different texts are told apart by the text's hash; equal rows count as one. Rows that
    have no repeats, as a bitmap shows, are not joined and keep their place.
    """
    added = ("removed_lines", "removed_words", "first_ids")
    own = [c for c in docs.columns if c not in added]
    found = keep(repeated_runs(docs, least), "found")
    bits = _bitmap(found.select(_key("text_hash").alias("hash")))

    def touched(key: pa.Array) -> pa.Array:
        return pa.array(_among(key.to_numpy(), _unpacked(bits)))

    def clean(text: pa.Array, firsts: pa.Array, of: pa.Array) -> pa.Array:
        rows = [_without(t, None if f is None else np.array(f, dtype=np.int64), least)
                if o else (t, 0, 0) for t, f, o in zip(
                    text.to_pylist(), firsts.to_pylist(), of.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays(
            [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(
                (pa.string(), pa.int64(), pa.int64()))], ["text", "removed_lines", "removed_words"])

    made = "text string, removed_lines long, removed_words long"
    may = F.arrow_udf(touched, "boolean")(_key(F.xxhash64("text")))
    rows = docs.select(*own, may.alias("__may"))
    known = found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"),
                         F.col("firsts").alias("__firsts"), "first_ids")
    changed = rows.where("__may").join(known, F.col("doc_id").eqNullSafe(F.col("__id")) & (
        F.xxhash64("text") == F.col("__hash")), "left").withColumn(
        "__clean", F.arrow_udf(clean, made)("text", "__firsts", F.col("__hash").isNotNull()))
    result = [F.col("__clean.text").alias("text") if c == "text" else F.col(c) for c in own]
    lost = F.col("__clean.removed_words")
    changed = changed.select(*result, F.col("__clean.removed_lines").alias("removed_lines"),
                             lost.alias("removed_words"),
                             F.when(lost > 0, F.col("first_ids")).alias("first_ids"))
    return rows.where("NOT __may").select(
        *own, F.lit(0).cast("long").alias("removed_lines"),
        F.lit(0).cast("long").alias("removed_words"),
        F.lit(None).cast(changed.schema["first_ids"].dataType).alias("first_ids")).unionByName(changed)
