"""Collocations: phrases of two to five words that stand together more often than by chance.

1. Words are counted by language. Those below the threshold are in no phrase that reaches it;
   the others get a code, and texts become sequences of codes, in which a 0 stands for whatever
   no phrase goes over: rare words and the ends of pieces.
2. Level by level, the candidates of k words are those windows of the texts whose first and last
   k - 1 words both reach the threshold (Apriori: no other window can), less those of which all
   tasks together can't have enough (`_supported`). They go into double-array tries (`tries`),
   which are broadcast. In every task, numpy advances the states of all text positions together,
   level by level, and a bincount of the accepting states counts the candidates; Spark adds up
   the counts of the tasks.
3. After each level texts shrink to the runs of words in which the next candidates can stand.
4. Every cut of a phrase gives a score from counts of the levels before; the lowest one counts.

Tries and word tables are dealt in shards of at most `SHARD` phrases or `WORDS` words, so what a
broadcast holds does not grow with the corpus; more candidates mean more shards, each a pass over
the shrunken texts. A row of a table between passes has about `ROW` numbers of four bytes and is cut
after a 0 only: Parquet makes a page of 100 rows at least, and Spark reads and sends whole rows, so
what an executor holds goes by the size of a row. Each table goes when the next one is written.
Counting is exact: words are counted as strings, and codes are given by 128 bits of hash.
"""

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallbook.config import discard, keep
from stallbook.llm.arrow import ready, rows_per_batch
from stallbook.llm.numbering import numbered
from stallbook.llm.tries import Trie
from stallbook.llm.words import SPACE, Slice, mix, slices
from stallbook.operators.skew import first_per_key

LONGEST = 5
#: Words of a broadcast table of codes, and phrases of a broadcast trie.
WORDS, SHARD = 1 << 20, 1 << 18
#: Candidates whose counts make one row; a part of a shard.
BLOCK = 1 << 10
#: Pairs that a task adds up at a time, pairs that it holds before it sends them on, and bytes of
#: text worked on at a time.
MERGED, HELD, TEXT = 1 << 18, 1 << 19, 1 << 19
#: Codes of a row, more only where a run is longer, and rows that are read and go to Python at a time.
ROW, BATCH = 1 << 14, 32

#: Bytes that end a piece (fixed values): . , ; : ! ? and 0x0A to 0x0D.
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[*b".,;:!?", 10, 11, 12, 13]] = True
_BLANK = SPACE | _ENDS
_OTHER = np.uint64(0x9FB21C651E98DF25)


def _hashes(part: Slice, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each word together with its language; `lang` has a hash for each text."""
    own = lang.view(np.uint64)[part.first + part.text]
    return (mix(part.hash_spans(part.starts, part.ends) ^ own),
            mix(part.twin_hashes(part.starts, part.ends) ^ (own * _OTHER)))


def _distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of each distinct pair of hashes, and how often it occurs."""
    order = np.argsort(one)
    a, b = one[order], two[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = a[1:] != a[:-1]
    if (~new[1:] & (b[1:] != b[:-1])).any():  # equal first hashes of different words
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    firsts = np.flatnonzero(new)
    return order[firsts], np.diff(np.append(firsts, len(a)))


def _strings(part: Slice, places: np.ndarray) -> pa.Array:
    """The words at these places, as strings."""
    starts, lengths = part.starts[places], (part.ends - part.starts)[places]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], lengths)
    return pa.Array.from_buffers(pa.large_string(), len(places), [
        None, pa.py_buffer(bounds.astype(np.int64).tobytes()),
        pa.py_buffer(np.ascontiguousarray(part.data[at]).tobytes())]).cast(pa.string())


def _language(lang: str) -> Column:
    return F.coalesce(F.col(lang), F.lit("und"))


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(_language(lang).alias("lang"), F.xxhash64(_language(lang)).alias("own"),
                       F.col(text).alias("text"))


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word and n, over all texts. Tasks count by slice, Spark by word."""
    def run(batches):
        for batch in batches:
            own = batch.column("own").to_numpy()
            for part in slices(batch.column("text"), lower=True, blank=_BLANK, limit=TEXT):
                if len(part.starts):
                    places, times = _distinct(*_hashes(part, own))
                    langs = batch.column("lang").take(pa.array(part.first + part.text[places]))
                    yield pa.RecordBatch.from_arrays(
                        [langs, _strings(part, places), pa.array(times)], ["lang", "word", "n"])

    return texts.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(
        F.sum("n").alias("n"))


def _runs(codes: np.ndarray, marked: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of `codes` that stand in a run of at least `least` marked places, and the place
    after each run, which is to become 0."""
    edge = np.diff(np.concatenate([[0], marked.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= least
    cover = np.zeros(len(codes) + 1, dtype=np.int8)
    np.add.at(cover, starts[long], 1)
    np.add.at(cover, ends[long], -1)
    inside = np.cumsum(cover)[:len(codes)] > 0
    return inside, ends[long]


def _compact(codes: np.ndarray, marked: np.ndarray, least: int) -> np.ndarray:
    """The runs of at least `least` marked codes, a 0 after each."""
    inside, ends = _runs(codes, marked, least)
    spread = np.append(np.where(inside, codes, 0), 0)
    chosen = np.append(inside, False)
    chosen[ends] = True
    return spread[chosen]


@contextmanager
def _few_rows(spark: SparkSession) -> Iterator[None]:
    """What is planned and run inside reads and sends to Python `BATCH` rows at a time."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    given = spark.conf.get(key)
    spark.conf.set(key, BATCH)
    try:
        with rows_per_batch(spark, BATCH):
            yield
    finally:
        spark.conf.set(key, given)


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 as bytes, four for each where that is enough for all, with a byte that says so."""
    width = 4 if int(numbers.max(initial=0)) < 1 << 31 else 8
    return bytes([width]) + numbers.astype(f"<i{width}").tobytes()


def _unpacked(blob: pa.Buffer | bytes) -> np.ndarray:
    width = memoryview(blob)[0]
    return np.frombuffer(blob, dtype=f"<i{width}", offset=1).astype(np.int64)


def _numbers(batch: pa.RecordBatch, column: str, row: int) -> np.ndarray:
    return _unpacked(batch.column(column)[row].as_buffer())


def _cut(codes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """`codes`, which end with a 0, in rows of about `size`, each up to a 0."""
    zeros = np.flatnonzero(codes == 0)
    wanted = np.arange(size, len(codes) + 1, size) - 1
    ends = np.unique(np.append(zeros[np.searchsorted(zeros, wanted)] + 1, len(codes)))
    yield from (row for row in np.split(codes, ends[:-1]) if len(row))


def _coder(spark, vocabulary: DataFrame, low: int):
    """A broadcast of sorted hashes and codes of the words numbered low + 1 to low + WORDS."""
    def run(batches):
        for batch in batches:
            own = batch.column("own").to_numpy()
            for part in slices(batch.column("word"), blank=_BLANK):
                one, two = _hashes(part, own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                     batch.column("id").slice(part.first, part.size)], ["one", "two", "id"])

    own = vocabulary.where(F.col("id").between(low + 1, low + WORDS)).select(
        "id", F.xxhash64("lang").alias("own"), "word")
    got = own.mapInArrow(run, "one long, two long, id long").toArrow()  # WORDS rows at most
    one, two = (got.column(c).to_numpy().view(np.uint64) for c in ("one", "two"))
    order = np.argsort(one)
    return spark.sparkContext.broadcast((one[order], two[order], got.column("id").to_numpy()[order]))


def _code(table, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The code of each word, 0 for those not in the table."""
    first, second, ids = table
    if not len(first):
        return np.zeros(len(one), dtype=np.int64)
    at = np.searchsorted(first, one)
    at[at == len(first)] = 0
    return np.where((first[at] == one) & (second[at] == two), ids[at], 0)


def encoded(texts: DataFrame, vocabulary: DataFrame, total: int) -> DataFrame:
    """The texts as runs of codes: a written table of `codes`, `_packed`.

    Only runs of two coded words or more are left, each followed by a 0. With several word tables
    the texts pass them one by one and carry the codes that they have.
    """
    spark = texts.sparkSession
    rows = texts.select("own", "text", F.lit(None).cast("binary").alias("codes"))
    for low in range(0, max(total, 1), WORDS):
        table, last = _coder(spark, vocabulary, low), low + WORDS >= total

        def run(batches, table=table, last=last):
            for batch in batches:
                own = batch.column("own").to_numpy()
                for part in slices(batch.column("text"), lower=True, blank=_BLANK, limit=TEXT):
                    found = _code(table.value, *_hashes(part, own))
                    ended = np.concatenate([[0], np.cumsum(_ENDS[part.data])])
                    new = np.ones(len(found), dtype=bool)
                    new[1:] = (part.text[1:] != part.text[:-1]) | (
                        ended[part.starts[1:]] > ended[part.ends[:-1]])
                    codes = np.zeros(len(found) + int(new.sum()) + 1, dtype=np.int64)
                    places = np.arange(len(found)) + np.cumsum(new)
                    codes[places] = found
                    pieces = np.bincount(part.text[new], minlength=part.size)
                    bounds = np.concatenate([[0], np.cumsum(part.counts() + pieces)])
                    held = [_unpacked(x) for x in
                            batch.column("codes").slice(part.first, part.size).to_pylist() if x is not None]
                    if held:
                        codes[:-1] += np.concatenate(held)
                    if last:
                        for row in _cut(_compact(codes, codes > 0, 2), ROW):
                            yield pa.RecordBatch.from_arrays([pa.array([_packed(row)], pa.binary())], ["codes"])
                    else:
                        rest = [batch.column(c).slice(part.first, part.size) for c in ("own", "text")]
                        blobs = [_packed(codes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                        yield pa.RecordBatch.from_arrays([*rest, pa.array(blobs, pa.binary())],
                                                         ["own", "text", "codes"])

        kind = "codes binary" if last else "own long, text string, codes binary"
        before, rows = rows, keep(rows.mapInArrow(run, kind), "codes")
        table.destroy()
        if low:
            discard(before)
    return rows


def _total(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, weight = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(every)
    every, weight = every[order], weight[order]
    firsts = np.flatnonzero(np.diff(every, prepend=every[:1] - 1))
    return every[firsts], np.add.reduceat(weight, firsts) if len(firsts) else weight


def _seen(batches: Iterator[pa.RecordBatch], keys_of: Callable, enough: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, n, ended): how often each key occurs in what `keys_of` finds in a task's rows.

    A task that can hold all its keys names those that it has `enough` times, with ended = 1, and a
    row with key -1 counts it. One that has to send keys on before its end sends all, with
    ended = 0: it keeps nothing to itself.
    """
    keys, times, held, sent = [], [], 0, False

    def rows(found, ended):
        return pa.RecordBatch.from_arrays(
            [pa.array(found[0]), pa.array(found[1]), pa.array(np.full(len(found[0]), ended))],
            ["key", "n", "ended"])

    for batch in batches:
        for i in range(batch.num_rows):
            own = keys_of(batch, i)
            keys.append(own)
            times.append(np.ones(len(own), dtype=np.int64))
            held += len(own)
            if held > MERGED:
                found = _total(keys, times)
                keys, times, held = [found[0]], [found[1]], 0
                if len(found[0]) > HELD:
                    yield rows(found, 0)
                    keys, times, sent = [], [], True
    if keys:
        found = _total(keys, times)
        often = found[1] >= (1 if sent else enough)
        yield rows((found[0][often], found[1][often]), 0 if sent else 1)
    yield rows((np.array([-1]), np.array([0])), 0 if sent else 1)


def _supported(rows: DataFrame, column: str, factor: int, least: int, whole: bool) -> DataFrame:
    """Neighbours a, b > 0 in the numbers of `column` that may occur `least` times, as a * factor + b.

    Of T tasks at least one has such a pair least / T times, so a task names only those it has that
    often; if `whole`, all it has, for pairs of words, of which no task can hold all anyway. How
    often a pair can occur in all is then bounded by what tasks named and by what the others may
    have kept to themselves; a pair is left out when even that is too little.
    """
    def keys(batch, row):
        codes = _numbers(batch, column, row)
        a, b = codes[:-1], codes[1:]
        both = (a > 0) & (b > 0)
        return a[both] * factor + b[both]

    rows = rows.select(column)
    enough = 1 if whole else -(-least // max(1, rows.rdd.getNumPartitions()))
    with _few_rows(rows.sparkSession):
        named = keep(rows.mapInArrow(lambda batches: _seen(batches, keys, enough),
                                     "key long, n long, ended long").groupBy("key").agg(
            F.sum("n").alias("n"), F.sum("ended").alias("ended")), "supported")
    tasks = named.where("key = -1").agg(F.coalesce(F.sum("ended"), F.lit(0))).first()[0]
    most = F.col("n") + (F.lit(tasks) - F.col("ended")) * (enough - 1)
    return named.where((F.col("key") >= 0) & (most >= least)).select("key")


def _tries(phrases: DataFrame, total: int) -> Iterator[tuple]:
    """A broadcast trie and the lowest number of its phrases, for each shard of `phrases`."""
    context = phrases.sparkSession.sparkContext
    for low in range(0, total, SHARD):
        own = phrases.where(F.col("id").between(low + 1, low + SHARD)).select(
            "id", "codes").toArrow()  # SHARD rows at most
        ids = own.column("id").to_numpy()
        lists = own.column("codes").combine_chunks()
        codes = lists.flatten().to_numpy().reshape(len(ids), -1)[np.argsort(ids)]
        yield context.broadcast(Trie(codes)), low


def _marked(coded: DataFrame, frequent: DataFrame, total: int) -> DataFrame:
    """The runs of `coded` in which two frequent phrases begin one after the other: a written
    table of `codes` and `marks`, the number of the phrase that begins at each place, or 0.
    `coded` is discarded."""
    rows, written = coded.select("codes", F.lit(None).cast("binary").alias("marks")), coded
    for trie, low in _tries(frequent, total):
        last = low + SHARD >= total

        def run(batches, trie=trie, low=low, last=last):
            for batch in batches:
                for i in range(batch.num_rows):
                    codes = _numbers(batch, "codes", i)
                    found = trie.value.find(codes)
                    marks = np.where(found >= 0, found + low + 1, 0)
                    if batch.column("marks")[i].is_valid:
                        marks = marks + _numbers(batch, "marks", i)
                    if last:
                        codes, marks = _shrunk(codes, marks, trie.value.words)
                    if len(codes):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([_packed(x)], pa.binary()) for x in (codes, marks)], ["codes", "marks"])

        with _few_rows(rows.sparkSession):
            rows = keep(rows.mapInArrow(run, "codes binary, marks binary"), "marked")
        trie.destroy()
        discard(written)
        written = rows
    return rows


def _shrunk(codes: np.ndarray, marks: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of two marked places or more with the words of their last phrase, each with a 0."""
    inside, ends = _runs(codes, marks > 0, 2)
    begins = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8)])) == 1)
    out_codes, out_marks = [], []
    # runs of places may be so close that the words of one lie in the next: copy run by run
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        out_codes += [codes[a:b + words - 1], [0]]
        out_marks += [marks[a:b], np.zeros(words, dtype=np.int64)]
    if not out_codes:
        return codes[:0], marks[:0]
    return np.concatenate(out_codes).astype(np.int64), np.concatenate(out_marks)


def _summed(batches: Iterator[pa.RecordBatch], least: int, size: int) -> Iterator[pa.RecordBatch]:
    """id and n of the candidates of at least `least`, from rows of `block` and `counts`, sorted by
    block; holds one block's sum at a time."""
    block, total = None, None

    def rows():
        often = np.flatnonzero(total >= least)
        return pa.RecordBatch.from_arrays(
            [pa.array(block * size + often + 1), pa.array(total[often])], ["id", "n"])

    for batch in batches:
        for i, own in enumerate(batch.column("block").to_pylist()):
            if own != block:
                if block is not None:
                    yield rows()
                block, total = own, np.zeros(size, dtype=np.int64)
            total += _numbers(batch, "counts", i)
    if block is not None:
        yield rows()


def _counted(coded: DataFrame, candidates: DataFrame, total: int, least: int) -> DataFrame:
    """id and n of the candidates found at least `least` times in `coded`.

    A task's bincount of a trie's accepting states goes on in blocks of `BLOCK` numbers, those
    without any left out, and Spark brings the tasks' blocks together to be summed.
    """
    found, size = None, BLOCK
    for trie, low in _tries(candidates, total):
        def run(batches, trie=trie, low=low):
            times = np.zeros(-(-min(SHARD, total - low) // size) * size, dtype=np.int64)
            for batch in batches:
                for i in range(batch.num_rows):
                    own = trie.value.find(_numbers(batch, "codes", i))
                    counts = np.bincount(own[own >= 0], minlength=1)
                    times[:len(counts)] += counts
            blocks = times.reshape(-1, size)
            for i in np.flatnonzero(blocks.any(1)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([low // size + int(i)]), pa.array([_packed(blocks[i])], pa.binary())],
                    ["block", "counts"])

        with _few_rows(coded.sparkSession):
            part = keep(coded.select("codes").mapInArrow(run, "block long, counts binary").repartition(
                "block").sortWithinPartitions("block").mapInArrow(
                lambda batches: _summed(batches, least, size), "id long, n long"), "counts")
        trie.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = LONGEST, text: str = "text",
                     lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to `longest` words that occur at least `least` times in a language, with
    codes, lang, phrase and n; and n_words of each language."""
    spark = docs.sparkSession
    ready(spark)
    texts = _texts(docs, text, lang)
    counts = keep(word_counts(texts), "words")
    sizes = counts.groupBy("lang").agg(F.sum("n").alias("n_words"))
    vocabulary, total = numbered(counts.where(F.col("n") >= least), "vocabulary")
    found = vocabulary.select("id", F.array("id").alias("codes"), "lang", F.col("word").alias("phrase"),
                              F.col("word").alias("last"), "n")
    levels, frequent, coded = [found], found, None
    for words in range(2, longest + 1):
        if not total:
            break
        factor = total + 1
        if words == 2:
            coded = encoded(texts, vocabulary, total)
        else:
            coded = _marked(coded, frequent, total)
        seen = _supported(coded, "codes" if words == 2 else "marks", factor, least, words == 2)
        ends = F.expr(f"key div {factor}").alias("a"), (F.col("key") % factor).alias("b")
        first = frequent.select(F.col("id").alias("a"), F.col("codes").alias("head"), "lang", "phrase")
        second = frequent.select(F.col("id").alias("b"), F.element_at("codes", -1).alias("tail"), "last")
        windows = seen.select(*ends).join(first, "a").join(second, "b").select(
            F.concat("head", F.array("tail")).alias("codes"), "lang",
            F.concat_ws(" ", "phrase", "last").alias("phrase"), "last")
        candidates, total = numbered(windows, f"windows{words}")
        if total:
            times = _counted(coded, candidates, total, least)
            frequent, total = numbered(candidates.join(times, "id").drop("id"), f"phrases{words}")
        if total:
            levels.append(frequent.select(*found.columns))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return keep(every, "phrases"), sizes


def _scored(every: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each phrase of two words or more with its cut of the lowest score: a, l, r, n and score."""
    counts = every.select("codes", "n")
    whole = every.where(F.size("codes") > 1).select("codes", "lang", "phrase", F.col("n").alias("a"))
    places = F.sequence(F.lit(1), F.size("codes") - 1)
    cut = whole.select("codes", "a", "lang", F.explode(places).alias("k"))
    cut = cut.select("*", F.slice("codes", F.lit(1), F.col("k")).alias("head"),
                     F.slice("codes", F.col("k") + 1, F.size("codes") - F.col("k")).alias("rest"))
    cut = cut.join(counts.select(F.col("codes").alias("head"), F.col("n").alias("l")), "head").join(
        counts.select(F.col("codes").alias("rest"), F.col("n").alias("r")), "rest").join(
        sizes.select("lang", F.col("n_words").alias("n")), "lang")
    wide = "cast({} as decimal(38,0))"
    score = F.expr(f"({wide.format('1000')} * a * n) div ({wide.format('l')} * r)")
    best = cut.withColumn("score", score).groupBy("codes").agg(
        F.min(F.struct("score", "k", "l", "r", "n")).alias("cut"))
    return whole.join(best, "codes").select(
        "codes", "lang", "phrase", "a", "cut.l", "cut.r", "cut.n", "cut.score")


def collocations(docs: DataFrame, least: int = 100, longest: int = LONGEST, most: int = 2000,
                 swallow: int = 100, text: str = "text", lang: str = "lang") -> DataFrame:
    """Each language's `most` best phrases: lang, rank, phrase, a, l, r, n and score.

    A-Z count as a-z; texts end pieces at . , ; : ! ? and line breaks (0x0A to 0x0D), words are
    parted by spaces and tabs, and phrases stay within a piece. `a` is how often a phrase of 2 to
    `longest` words occurs (`least` at least, overlaps included), n the language's words, l and
    r the counts of both sides of the cut with the lowest score, floor(1000 * a * n / (l * r)),
    of several the one with the shortest first side. A phrase inside a longer one that occurs
    `swallow` percent as often or more is left out; it is enough to look one word further, as
    a count never grows with the phrase. Ranks go by score, then a, both falling, then phrase.

    A null lang is `und`, null and empty texts have no words, repeated rows count each time, other
    columns of `docs` are not read. A table without phrases gives no rows. Arithmetic is exact
    up to 38 digits, beyond which it raises an error.
    """
    every, sizes = frequent_phrases(docs, least, longest, text, lang)
    longer = every.where(F.size("codes") > 2).select("n", F.explode(F.array(
        F.slice("codes", F.lit(1), F.size("codes") - 1),
        F.slice("codes", F.lit(2), F.size("codes") - 1))).alias("codes"))
    around = longer.groupBy("codes").agg(F.max("n").alias("around"))
    lone = _scored(every, sizes).join(around, "codes", "left").where(
        F.col("around").isNull() | (F.col("around") * 100 < F.col("a") * swallow))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = first_per_key(lone.withColumn("most", F.lit(most)), "lang", "most", order, "phrase")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(*order))
    return best.select("lang", rank.cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
