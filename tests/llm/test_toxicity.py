import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stallbook.llm import toxicity as t

FOLDER = "/root/testdata/sf0.01"


def tokens_of(texts):
    return next(t.tokens(pa.array(texts, pa.string())))[1]


def test_slopes_are_those_of_the_loss():
    draw = np.random.default_rng(0)
    texts = ["one two three four", "five six", "", "seven", "one six eight nine ten one"]
    tok, toxic = tokens_of(texts), np.array([1, 0, 1, 0, 1])
    model = t._initial(tok, toxic, 3)
    for p in (model.words, model.stems, model.filters, model.out, model.bias):
        p += draw.normal(0, 0.3, p.shape).astype(np.float32)
    for name in ("words", "stems", "filters", "bias", "out", "out_bias"):
        setattr(model, name, getattr(model, name).astype(np.float64))
    weight = np.full(5, 0.2)

    def loss():
        z = model.logits(tok)
        return float((weight * (np.logaddexp(0, z) - toxic * z)).sum())

    slopes = t._slopes(model, tok, weight, toxic)
    params = [model.words, model.stems, model.filters, model.bias, model.out, model.out_bias]
    places = [[(int(tok.words[0]), 1), (int(tok.words[5]), 4)], [(int(tok.stems[2]), 0)],
              [(0, 0), (3, 9), (5, 40)], [(2,), (17,)], [(1,), (20,)], [(0,)]]
    for p, g, at in zip(params, slopes, places, strict=True):
        for i in at:
            keep = p[i]
            p[i] = keep + 1e-3
            up = loss()
            p[i] = keep - 1e-3
            down = loss()
            p[i] = keep
            assert abs((up - down) / 2e-3 - g[i]) < 2e-3


def test_scores_do_not_depend_on_the_texts_around():
    texts = ["one two three", "", "four", None, "five six one two"]
    tok = tokens_of(texts)
    model = t._initial(tok, np.array([1, 0, 1, 0, 0]), 1)
    alone = [model.scores(tokens_of([x]))[0] for x in texts]
    assert np.allclose(alone, model.scores(tok), atol=1e-6)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_held_out_labels_are_found(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{x}.parquet") for x in ("documents", "labels"))
    got = t.held_out_scores(docs, labels).join(labels, "doc_id").where("held_out")
    rows = [(r.score, r.toxic) for r in got.select("score", "toxic").collect()]
    pairs = [(a > b) + 0.5 * (a == b) for a, x in rows for b, y in rows if x == 1 and y == 0]
    assert sum(pairs) / len(pairs) > 0.9
    assert np.mean([(s >= 0.5) == bool(x) for s, x in rows]) > 0.9


def test_odd_rows_columns_and_tables(spark, documents):
    rows = [(i, ("you are a scumbag " if i % 2 else "you are a friend ") + f"number {i}", "en", None)
            for i in range(80)]
    odd = [(100, None), (101, ""), (102, "!!! 123"), (None, "a scumbag"), (103, "nice words " * 30_000 + "scumbag"),
           (1, "scumbag"), (104, "hello there friend")]
    docs = documents(rows + odd).withColumn("score", F.lit("mine"))
    labels = spark.createDataFrame(
        [(i, i % 2, "x") for i in range(80)] + [(None, 1, "x"), (5, None, "x"), (999, 1, "x"), (104, 7, "x")],
        "doc_id long, toxic int, text string")
    got = {}
    for r in t.held_out_scores(docs, labels).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(len(x) for x in got.values()) == 87 and len(got[1]) == 2
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for x in got.values() for r in x)
    assert [got[i][0].predicted for i in (None, 103, 104, 3, 4)] == [1, 1, 0, 1, 0]
    assert got[None][0].held_out is False and got[100][0].score == got[101][0].score
    none = t.held_out_scores(docs, labels.limit(0)).select("score", "predicted").distinct().collect()
    assert [tuple(r) for r in none] == [(0.0, 0)]
    one = t.held_out_scores(docs, labels.where("toxic = 0")).agg(F.max("predicted"), F.count("*")).first()
    assert one[1] == 87
    assert t.held_out_scores(docs.limit(0), labels).collect() == []
