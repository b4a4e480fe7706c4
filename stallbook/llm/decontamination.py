"""Benchmark passages in documents, by a prefix-filtered set join.

Every run of `WINDOW` words of a benchmark item is a window, a set of shingles of `SHINGLE` words.
A place of a document holds the window only if it holds all of its shingles, so with the shingles
of each window put in one order it is necessary that the first one (the prefix, one shingle
where all have to be there) stands in the document. The order is by rarity: a first pass
counts how often each benchmark shingle occurs in all documents, so the shingle that the
windows are joined on is the one that the fewest places of the corpus have. A match says
where the window would have to begin; it is dropped if that is before the text or if its last word
is behind it (bounds of place and length). What is left is verified word by word over the window.

Windows are dealt in shards of at most `SHARD`, each broadcast to the tasks: a larger benchmark
takes more passes over the documents and no larger broadcast. Which items a window belongs to is
joined by Spark at the end, for the windows found only.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallbook.config import keep
from stallbook.llm.arrow import ready
from stallbook.llm.numbering import numbered
from stallbook.llm.words import Slice, runs, seeds, mix, slices

WINDOW, SHINGLE = 10, 5
#: Windows of a broadcast, and matches that are verified at a time.
SHARD, MATCHES = 1 << 17, 1 << 20

#: Words are runs of bytes other than these (fixed values): 0x00-0x2F, 0x3A-0x60, 0x7B-0x7F.
BLANK = np.zeros(256, dtype=bool)
BLANK[0x00:0x30] = BLANK[0x3A:0x61] = BLANK[0x7B:0x80] = True
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def windows_of(items: DataFrame, window: int, item_id: str, text: str) -> DataFrame:
    """item and words of every window of every item; of all words, where there are fewer."""
    lowered = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))
    firsts = F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1)))
    return items.select(F.col(item_id).cast("string").alias("item"), words.alias("words")).where(
        F.size("words") > 0).select("item", F.explode(F.transform(
            firsts, lambda i: F.slice("words", i, F.lit(window)))).alias("words"))


class _Index(NamedTuple):
    """A shard of windows, as numbers."""

    low: int  # windows are numbered from here
    words: tuple[np.ndarray, np.ndarray]  # sorted hashes of the words, and their second hashes
    ids: np.ndarray  # word numbers of each window, -1 beyond its end
    lengths: np.ndarray
    tokens: dict[int, np.ndarray]  # by words in a shingle: sorted hashes of the shingles
    places: dict[int, tuple]  # by words in a shingle: window, shingle and first word of each


def _word_hashes(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    return part.words(), part.twin_hashes(part.starts, part.ends)


def _token_hashes(ids: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first place of every run of `n` words of one text that are all known."""
    found, firsts = runs(mix(ids.astype(np.uint64) + np.uint64(1)), text, n)
    if not len(found):
        return found, firsts
    unknown = np.concatenate([[0], np.cumsum(ids < 0)])
    fine = unknown[firsts + n] == unknown[firsts]
    return found[fine], firsts[fine]


def _indexed(windows: list[list[str]], low: int) -> _Index:
    """Numbers of a shard's windows, without the order of their shingles."""
    lengths = np.array([len(w) for w in windows])
    flat = pa.array([word for w in windows for word in w], pa.string())
    one, two = (np.concatenate(x) for x in zip(*(
        _word_hashes(part) for part in slices(flat, blank=BLANK)), strict=True))
    order = np.lexsort((two, one))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    ids = np.full((len(windows), lengths.max()), -1, dtype=np.int64)
    ids[np.arange(ids.shape[1])[None, :] < lengths[:, None]] = number
    tokens, places = {}, {}
    for n in np.unique(np.minimum(lengths, SHINGLE)).tolist():
        own = np.flatnonzero(np.minimum(lengths, SHINGLE) == n)
        text = np.repeat(own, lengths[own])
        hashes, at = _token_hashes(ids[own][ids[own] >= 0], text, n)
        starts = np.concatenate([[0], np.cumsum(lengths[own])])[np.searchsorted(own, text[at])]
        tokens[n], which = np.unique(hashes, return_inverse=True)
        places[n] = (text[at], which, at - starts)
    return _Index(low, (one[order][new], two[order][new]), ids, lengths, tokens, places)


def _known(index: _Index, part: Slice) -> np.ndarray:
    """The number of each word among the benchmark's words, -1 for others."""
    one, two = _word_hashes(part)
    first, second = index.words
    at = np.searchsorted(first, one)
    at[at == len(first)] = 0
    return np.where((first[at] == one) & (second[at] == two), at, -1)


def _found(hashes: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are among the sorted tokens, and the tokens' numbers."""
    if not len(tokens):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.searchsorted(tokens, hashes)
    at[at == len(tokens)] = 0
    hit = np.flatnonzero(tokens[at] == hashes)
    return hit, at[hit]


def _rarity(texts: DataFrame, index) -> dict[int, np.ndarray]:
    """How often each shingle of a shard occurs in all texts."""
    def run(batches):
        total = None
        for batch in batches:
            own = index.value
            total = total or {n: np.zeros(len(t), dtype=np.int64) for n, t in own.tokens.items()}
            for part in slices(batch.column("text"), lower=True, blank=BLANK):
                ids = _known(own, part)
                for n, tokens in own.tokens.items():
                    _, which = _found(_token_hashes(ids, part.text, n)[0], tokens)
                    total[n] += np.bincount(which, minlength=len(tokens))
        for n, times in (total or {}).items():
            seen = np.flatnonzero(times)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(seen), n, np.int32)), pa.array(seen), pa.array(times[seen])],
                ["n", "token", "times"])

    out = {n: np.zeros(len(t), dtype=np.int64) for n, t in index.value.tokens.items()}
    summed = texts.select("text").mapInArrow(run, "n int, token long, times long").groupBy(
        "n", "token").agg(F.sum("times").alias("times")).toArrow()  # the shard's shingles at most
    for n in out:
        own = summed.column("n").to_numpy() == n
        out[n][summed.column("token").to_numpy()[own]] = summed.column("times").to_numpy()[own]
    return out


def _prefixes(index: _Index, rarity: dict[int, np.ndarray]) -> _Index:
    """The index with the rarest shingle of each window only; ties go to the smaller hash."""
    tokens, places = {}, {}
    for n, (window, token, first) in index.places.items():
        order = np.lexsort((token, rarity[n][token], window))
        best = np.ones(len(order), dtype=bool)
        best[1:] = window[order][1:] != window[order][:-1]
        chosen = order[best]
        chosen = chosen[np.argsort(token[chosen], kind="stable")]
        used, which = np.unique(token[chosen], return_inverse=True)
        tokens[n] = index.tokens[n][used]
        bounds = np.searchsorted(which, np.arange(len(used) + 1))
        places[n] = (window[chosen], bounds, first[chosen])
    return index._replace(tokens=tokens, places=places)


def _verified(index: _Index, ids: np.ndarray, window: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether the words from each start are those of its window."""
    right = np.ones(len(window), dtype=bool)
    for j in range(index.ids.shape[1]):
        own = np.flatnonzero(right & (index.lengths[window] > j))
        right[own] = ids[start[own] + j] == index.ids[window[own], j]
    return right


def _occurrences(index: _Index, part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Every place where a window of the shard stands: the window and its first word."""
    ids, spans = _known(index, part), part.spans()
    windows, starts = [], []
    for n, tokens in index.tokens.items():
        hashes, firsts = _token_hashes(ids, part.text, n)
        hit, which = _found(hashes, tokens)
        owner, bounds, offset = index.places[n]
        times = (bounds[1:] - bounds[:-1])[which]
        cuts = np.cumsum(times)
        for low, high in _blocks(cuts, MATCHES):
            k = times[low:high]
            row = np.repeat(np.arange(low, high), k)
            entry = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + bounds[which[row]]
            window, start = owner[entry], firsts[hit[row]] - offset[entry]
            text = part.text[firsts[hit[row]]]
            fits = (start >= spans[text]) & (start + index.lengths[window] <= spans[text + 1])
            window, start = window[fits], start[fits]
            right = _verified(index, ids, window, start)
            windows.append(window[right])
            starts.append(start[right])
    empty = np.zeros(0, dtype=np.int64)
    return np.concatenate([empty, *windows]), np.concatenate([empty, *starts])


def _blocks(cuts: np.ndarray, most: int):
    """Ranges of rows whose matches, `cuts` when added up, are about `most`."""
    low, done = 0, 0
    while low < len(cuts):
        high = max(low + 1, int(np.searchsorted(cuts, done + most, "right")))
        yield low, high
        low, done = high, int(cuts[high - 1])


def _covered(part: Slice, lengths: np.ndarray, starts: np.ndarray, before: list) -> list:
    """For each text, a bit per word: whether a window covers it, now or `before`."""
    edge = np.zeros(len(part.starts) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    inside, spans = np.cumsum(edge)[:-1] > 0, part.spans()
    out = [b if b is not None else None for b in before]
    touched = np.flatnonzero(np.bincount(part.text[inside], minlength=part.size))
    for t in touched.tolist():
        own = inside[spans[t]:spans[t + 1]]
        if out[t] is not None:
            own = own | np.unpackbits(np.frombuffer(out[t], np.uint8), count=len(own)).astype(bool)
        out[t] = np.packbits(own).tobytes()
    return out


def _passed(rows: DataFrame, index, last: bool) -> DataFrame:
    """`rows` (doc_id, text, hit, windows) after a look for the windows of one shard.

    After the last one n_words and n_hit take the place of text and hit.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            own = index.value
            for part in slices(batch.column("text"), lower=True, blank=BLANK):
                cut = [batch.column(c).slice(part.first, part.size) for c in batch.schema.names]
                window, start = _occurrences(own, part)
                hit = _covered(part, own.lengths[window], start, cut[2].to_pylist())
                pairs = np.unique(np.stack([part.text[start], window + own.low]), axis=1)
                bounds = np.searchsorted(pairs[0], np.arange(part.size + 1))
                held = cut[3].to_pylist()
                lists = [(held[t] or []) + pairs[1][a:b].tolist() for t, (a, b) in enumerate(
                    zip(bounds[:-1], bounds[1:], strict=True))]
                found = pa.array(lists, pa.list_(pa.int64()))
                if last:
                    n_hit = [0 if h is None else int(np.unpackbits(np.frombuffer(h, np.uint8)).sum())
                             for h in hit]
                    yield pa.RecordBatch.from_arrays(
                        [cut[0], pa.array(part.counts()), pa.array(n_hit, pa.int64()), found],
                        ["doc_id", "n_words", "n_hit", "windows"])
                else:
                    yield pa.RecordBatch.from_arrays(
                        [cut[0], cut[1], pa.array(hit, pa.binary()), found],
                        ["doc_id", "text", "hit", "windows"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, windows array<long>" if last else
                           f"doc_id {kind}, text string, hit binary, windows array<long>")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id",
                  text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids as strings) and contaminated of every
    document.

    Words are runs of 0-9, a-z (A-Z count as such) and characters beyond ASCII. A window is
    `window` words of an item one after the other, or all of an item that has fewer; a word is hit
    that lies in any occurrence of a window. `items` are those with a window in the document.

    A null or empty text has no words and is not contaminated; an item without words has no
    window. Rows of one item id are one item, rows without id are one item named `null`.
    Rows that repeat a doc_id are documents of their own, null ids too. Other columns are not
    read. With an empty benchmark nothing is contaminated, without documents there are no rows.
    """
    spark = docs.sparkSession
    ready(spark)
    pairs = keep(windows_of(benchmark, window, item_id, item_text).withColumn(
        "item", F.coalesce("item", F.lit("null"))).distinct(), "item_windows")
    windows, total = numbered(pairs.select("words").distinct(), "windows", "window")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = texts.select("*", F.lit(None).cast("binary").alias("hit"),
                        F.lit(None).cast("array<long>").alias("windows"))
    if not total:
        lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        n_words = F.coalesce(F.regexp_count(lowered, F.lit(WORD)), F.lit(0)).cast("long")
        rows = rows.select("doc_id", n_words.alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
                           "windows")
    for low in range(0, total, SHARD):
        own = windows.where(F.col("window").between(low + 1, low + SHARD)).orderBy(
            "window").toArrow()  # SHARD windows at most
        index = _indexed(own.column("words").to_pylist(), low + 1)
        counted = spark.sparkContext.broadcast(index)
        joined = spark.sparkContext.broadcast(_prefixes(index, _rarity(texts, counted)))
        rows = keep(_passed(rows, joined, low + SHARD >= total).withColumn(
            "row", F.monotonically_increasing_id()) if low + SHARD >= total
            else _passed(rows, joined, False), "found")
    if not total:
        none = F.array().cast("array<string>")
        return rows.select("doc_id", "n_words", "n_hit", F.lit(0).cast("long").alias("n_items"),
                           none.alias("items"), F.lit(False).alias("contaminated"))
    named = rows.select("row", F.explode("windows").alias("window")).join(
        windows, "window").join(pairs, "words").select("row", "item").distinct().groupBy("row").agg(
        F.sort_array(F.collect_list("item")).alias("items"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return rows.drop("windows").join(named, "row", "left").select(
        "doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
        items.alias("items"), (F.col("n_hit") > 0).alias("contaminated"))
