import re

import numpy as np
import pytest

from stallbook.llm import decontamination as d

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, n_hit string, windows int", "item_id long, text string, item int"


def words(text):
    return WORD.findall((text or "").encode().lower())


def brute(docs, items, window=10):
    own = {}
    for i, text, *_ in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1)) if w else []:
            own.setdefault(tuple(w[k:k + window]), set()).add("null" if i is None else str(i))
    out = []
    for i, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in own}:
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in own:
                    hit |= set(range(k, k + size))
                    found |= own[tuple(w[k:k + size])]
        out.append((i, len(w), len(hit), len(found), tuple(sorted(found)), bool(hit)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r["items"]), r.contaminated)
                   for r in df.collect()), key=str)


def case(seed):
    """Few words, so that windows repeat, overlap and share shingles."""
    draw = np.random.default_rng(seed)
    vocabulary = ["a", "B", "c1", "é", "dog", "2"]
    text = lambda n: " ".join(draw.choice(vocabulary, n))
    items = [(i, text(int(draw.integers(4, 30))), i) for i in range(30)]
    items += [(30, items[0][1], 0), (30, text(6), 0), (None, text(5), 0), (31, None, 0), (32, "...", 0),
              (33, "dog a dog", 0), (34, "Zebra", 0), (35, text(12) + " lion", 0)]
    docs = [(i, text(int(draw.integers(0, 200))), "", i) for i in range(60)]
    for i in range(60, 120):
        item = items[int(draw.integers(0, 38))][1] or ""
        docs.append((i, text(20) + "\n- " + item.upper().replace(" ", ", ") + "; " + text(20), "", i))
    docs += [(200, None, "", 0), (201, "", "", 0), (202, "zebra", "", 0), (202, "zebra zebra!", "", 0),
             (None, items[0][1], "", 0), (203, " ".join(["dog", "a"] * 4000) + " zebra", "", 0),
             (204, items[-1][1] + " x", "", 0), (205, items[-1][1][:-4], "", 0)]
    return docs, items


@pytest.mark.parametrize("shard", [1 << 17, 50])
def test_hits_are_those_of_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(d, "SHARD", shard)
    monkeypatch.setattr(d, "MATCHES", 64)
    docs, items = case(1)
    result = d.contamination(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS))
    assert result.columns == ["doc_id", "n_words", "n_hit", "n_items", "items", "contaminated"]
    found = got(result)
    assert found == brute(docs, items) and 20 < sum(f[-1] for f in found) < len(found)


def test_other_window_sizes(spark):
    docs, items = case(2)
    for window in (1, 3):
        assert got(d.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS),
                                   window=window)) == brute(docs, items, window)


def test_empty_tables(spark):
    docs, items = case(3)
    every, none = spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS)
    assert got(d.contamination(every, none)) == brute(docs, [])
    assert got(d.contamination(every.limit(0), spark.createDataFrame(items, ITEMS))) == []


def test_windows_are_joined_on_their_rarest_shingle(spark):
    texts = spark.createDataFrame([("a b c d e",)] * 5 + [("b c d e f",)] * 2 + [("c d e f g",)], "text string")
    index = d._indexed([list("abcdefg"), list("xyz")], 1)
    rarity = d._rarity(texts, spark.sparkContext.broadcast(index))
    joined = d._prefixes(index, rarity)
    assert sorted(rarity[5].tolist()) == [1, 2, 5] and rarity[3].tolist() == [0]
    assert joined.places[5][2].tolist() == [2] and len(joined.tokens[5]) == len(joined.tokens[3]) == 1
