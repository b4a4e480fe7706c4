import os
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stallbook.llm import phrases as p
from stallbook.llm.numbering import numbered
from stallbook.llm.tries import Trie


def brute(rows, least, longest=5, most=2000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    f = {x: c for x, c in f.items() if c >= least}
    out = []
    for (lang, x), a in f.items():
        if len(x) == 1:
            continue
        if any(g == lang and len(y) > len(x) and c >= a and any(
                y[i:i + len(x)] == x for i in range(len(y))) for (g, y), c in f.items()):
            continue
        cuts = [(Fraction(1000 * a * n[lang], f[lang, x[:k]] * f[lang, x[k:]]).__floor__(), k)
                for k in range(1, len(x))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(x).encode(), f[lang, x[:k]], f[lang, x[k:]], n[lang]))
    done = set()
    for lang in n:
        for rank, (_, s, a, x, l, r, total) in enumerate(sorted(o for o in out if o[0] == lang)[:most], 1):  # noqa: E741
            done.add((lang, rank, x.decode(), -a, l, r, total, -s))
    return done


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def texts(seed, n):
    draw = np.random.default_rng(seed)
    vocabulary = ["a", "b", "c", "É", "de", "x-y", "the", "Of", "rare1", "zz"]
    out = []
    for i in range(n):
        words = draw.choice(vocabulary, int(draw.integers(0, 30)),
                            p=[.3, .2, .15, .1, .08, .06, .05, .03, .02, .01])
        seps = draw.choice([" ", "  ", "\t", ", ", ".\n", "\r", " ! "], len(words), p=[.8, .05, .03, .05, .03, .02, .02])
        lang = [None, "en", "und", "fr"][int(draw.integers(0, 4))]
        out.append((i, "".join(w + s for w, s in zip(words, seps, strict=True)), lang))
    return out


ODD = [(1000, None, "en"), (1001, "", None), (1002, " \t .", "fr"), (1002, "a b. a b", "fr"),
       (None, "the the the the the the the the " * 6, None), (1003, "solo", "xx"), (1004, "…a b…", "")]
KIND = "doc_id long, text string, lang string"


@pytest.fixture
def small(monkeypatch):
    for name, value in (("WORDS", 3), ("SHARD", 8), ("BLOCK", 4), ("MERGED", 8), ("HELD", 16), ("TEXT", 64)):
        monkeypatch.setattr(p, name, value)


def test_phrases_are_those_of_brute_force(spark):
    rows = texts(1, 400) + ODD
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 AS n", "'x' AS phrase", "2 AS codes")
    got = found(p.collocations(df.repartition(3), least=6))
    assert got == brute(rows, 6) and len(got) > 50
    assert len({r[0] for r in got}) >= 3


def test_many_shards_give_the_same(spark, small):
    rows = texts(2, 60) + ODD
    assert found(p.collocations(spark.createDataFrame(rows, KIND), least=5)) == brute(rows, 5)


def test_the_best_are_cut_per_language(spark):
    rows = texts(3, 200)
    assert found(p.collocations(spark.createDataFrame(rows, KIND), least=4, most=7)) == brute(rows, 4, most=7)


def test_shorter_phrases_only(spark):
    rows = texts(4, 100)
    got = found(p.collocations(spark.createDataFrame(rows, KIND), least=4, longest=2))
    assert got == brute(rows, 4, longest=2)


def test_empty_tables_and_nothing_frequent(spark):
    assert found(p.collocations(spark.createDataFrame([], KIND))) == set()
    assert found(p.collocations(spark.createDataFrame(texts(5, 20), KIND), least=10 ** 6)) == set()
    assert found(p.collocations(spark.createDataFrame([(1, "a. a. a", "en")], KIND), least=2)) == set()


def test_scores_pass_64_bits_exactly(spark):
    every = spark.createDataFrame(
        [([1], "en", "a", 3_000_000_007), ([2], "en", "b", 2_000_000_011),
         ([1, 2], "en", "a b", 1_000_000_007)], "codes array<long>, lang string, phrase string, n long")
    sizes = spark.createDataFrame([("en", 10 ** 13 + 1)], "lang string, n_words long")
    score = p._scored(every, sizes).first().score
    assert score == 1000 * 1_000_000_007 * (10 ** 13 + 1) // (3_000_000_007 * 2_000_000_011)


@given(st.integers(1, 4), st.sampled_from([1, 3, 200, 70_000]), st.integers(1, 300), st.integers(0, 99))
@settings(max_examples=60, deadline=None)
def test_tries_find_what_a_dictionary_finds(words, vocabulary, rows, seed):
    draw = np.random.default_rng(seed)
    codes = np.unique(draw.zipf(1.3, (rows, words)) % vocabulary + 1, axis=0)
    codes = codes[draw.permutation(len(codes))]
    text = draw.zipf(1.2, 400) % (vocabulary + 3)
    known = {tuple(c): i for i, c in enumerate(codes.tolist())}
    plain = [known.get(tuple(text[i:i + words].tolist()), -1) for i in range(len(text))]
    assert Trie(codes).find(text).tolist() == plain


def test_a_trie_with_crowded_nodes():
    codes = np.stack(np.meshgrid(np.arange(1, 300), np.arange(1, 40)), -1).reshape(-1, 2)
    assert (Trie(codes).find(codes.ravel())[::2] == np.arange(len(codes))).all()


def coded(df, least):
    texts = p._texts(df, "text", "lang")
    return p.encoded(texts, *numbered(p.word_counts(texts).where(F.col("n") >= least), "vocabulary"))


def test_rows_between_passes_stay_small(spark):
    """A slice of text, which was a row, has some 100,000 words; Parquet takes 100 rows for a page."""
    rows = [(i, "an old stall, a new book. one more page " * 50, "en") for i in range(800)]
    sizes = [len(r.codes) for r in coded(spark.createDataFrame(rows, KIND).coalesce(1), 2).collect()]
    assert len(sizes) > 10 and max(sizes) < 80_000


def test_rows_cut_anywhere_give_the_same(spark, monkeypatch):
    rows = texts(6, 200) + ODD
    monkeypatch.setattr(p, "ROW", 7)
    monkeypatch.setattr(p, "BATCH", 3)
    assert found(p.collocations(spark.createDataFrame(rows, KIND), least=5)) == brute(rows, 5)


@given(st.lists(st.integers(0, 3)), st.integers(1, 9))
def test_rows_end_with_a_zero_and_hold_all(codes, size):
    codes = np.array([*codes, 0])
    got = list(p._cut(codes, size))
    assert np.concatenate(got).tolist() == codes.tolist()
    assert all(r[-1] == 0 and not (r[size - 1:-1] == 0).any() for r in got)


@pytest.mark.parametrize("numbers", [[], [0], [1, 2 ** 31 - 1], [0, 2 ** 31], [7, 2 ** 62]])
def test_packed_numbers_come_back(numbers):
    assert p._unpacked(p._packed(np.array(numbers, dtype=np.int64))).tolist() == numbers


def test_the_texts_of_earlier_passes_are_removed(spark, small, monkeypatch):
    written = []

    def keep(df, name):
        kept = p_keep(df, name)
        written.append((name, kept.inputFiles()))
        return kept

    p_keep = p.keep
    monkeypatch.setattr(p, "keep", keep)
    rows = texts(2, 60)
    assert found(p.collocations(spark.createDataFrame(rows, KIND), least=5)) == brute(rows, 5)
    left = [name for name, files in written if files and os.path.exists(files[0].removeprefix("file://"))]
    assert [name for name, _ in written].count("codes") > 1 < [name for name, _ in written].count("marked")
    assert left.count("codes") + left.count("marked") == 1 and "words" in left and "phrases" in left


def test_a_trie_is_little_longer_than_its_nodes():
    draw = np.random.default_rng(1)
    codes = np.unique(draw.integers(1, 60_000, (20_000, 5)), axis=0)
    trie = Trie(codes)
    nodes = 1 + int((trie.check >= 0).sum())
    assert len(trie.check) < 1.3 * nodes + 1000
    assert (trie.find(codes.ravel())[::5] == np.arange(len(codes))).all()
