import random

import pytest

from stallbook.llm import queries, run_dedup as d
from test_line_dedup import some_docs


def plain(docs, least):
    """The words left of every text, and how many went."""
    first, out = {}, {}
    for i in sorted(docs, key=lambda i: (i is not None, i)):
        words = (docs[i] or "").encode().split()
        gone = set()
        for a in range(len(words) - least + 1):
            if first.setdefault(tuple(words[a:a + least]), (i, a)) != (i, a):
                gone.update(range(a, a + least))
        out[i] = [w for n, w in enumerate(words) if n not in gone], len(gone)
    return out


@pytest.mark.parametrize("least", [1, 6, 13, 40])
def test_texts_lose_what_plain_python_finds(spark, documents, least):
    docs = some_docs(least) | {80: "same " * 300, 81: "x y " * 45 + "\nend"}
    got = {r.doc_id: r for r in d.dedup_runs(documents(list(docs.items())), least).collect()}
    for i, (words, gone) in plain(docs, least).items():
        assert (got[i].text or "").encode().split() == words and got[i].removed_words == gone
        assert (got[i].first_ids is None) == (gone == 0)
        assert gone or got[i].text == docs[i]


def test_a_passage_goes_wherever_in_a_line_it_stands(spark, documents, monkeypatch):
    monkeypatch.setattr(d, "COPIES", 0)
    draw = random.Random(4)
    prose = lambda n: " ".join(draw.choice("abcdefghij") + str(draw.randint(0, 999)) for _ in range(n))
    passage, heads, tails = prose(51), [prose(9) for _ in range(4)], [prose(30) for _ in range(4)]
    broken = passage.replace(" ", "\n", 3)
    rows = [(1, f"{heads[0]} {passage} {tails[0]}"), (2, f"{heads[1]} {passage} {tails[1]}\nlast"),
            (3, f"{heads[2]}\n\n{broken}\n{tails[2]}"), (4, f"{heads[3]} {passage}"), (4, passage),
            (5, f"{heads[0]} {passage} {tails[0]}"), (6, " ".join(passage.split()[:39])), (7, None)]
    got = sorted(((r.doc_id, r.text, r.removed_lines, r.removed_words, r.first_ids)
                  for r in d.dedup_runs(documents(rows)).collect()), key=str)
    assert got == sorted([
        (1, rows[0][1], 0, 0, None), (2, f"{heads[1]} {tails[1]}\nlast", 0, 51, [1]),
        (3, f"{heads[2]}\n\n{tails[2]}", 4, 51, [1]), (4, heads[3], 0, 51, [1]), (4, "", 1, 51, [1]),
        (5, "", 1, 90, [1]), (6, rows[6][1], 0, 0, None), (7, None, 0, 0, None)], key=str)
    assert d.dedup_runs(documents([])).collect() == []


def test_the_registered_query_finds_a_passage_within_lines(spark, documents, tmp_path):
    passage = " ".join(f"p{i}" for i in range(51))
    rows = [(1, f"one head {passage} and its tail"), (2, f"another start {passage} other end")]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op9_line_dedup"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [rows[0], (2, "another start other end")]
