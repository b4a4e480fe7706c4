import re
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from stallbook.llm import quality_rules as q


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if count[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    out = {"n_words": len(words), "word_chars": sum(map(len, words)),
           "n_symbols": sum(c in "#*$%&|<>" for c in text),
           "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}
    out["base_failed"] = out["n_words"] < 50 or 100 * len(covered) > 50 * len(words)
    return out


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab# \n\té|\u2003", max_size=80)), max_size=6))
@settings(max_examples=150, deadline=None)
def test_base_measures_are_those_of_plain_python(texts):
    got = q.base_measures(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert {k: v[i] for k, v in got.items()} == plain(text)


def clean(n, seed=0):
    return " ".join(f"word{chr(97 + seed)}{chr(97 + i * 7 % 26)}{chr(97 + i // 26 % 26)}"
                    for i in range(n))


def test_cascade_covers_odd_rows_and_keeps_the_others(spark):
    rows = [(1, clean(80), "x"), (1, clean(80), "x"), (2, None, None), (3, "", "y"), (4, "a b c", "y"),
            (5, clean(80).upper(), "y"), (6, " ".join(f"w{i}x ##" for i in range(60)), "y"),
            (7, "same three words " * 40, "y"), (None, clean(60, 3), None),
            (8, clean(30_000), "z"), (9, "\n".join([clean(20), clean(20, 5), clean(20, 9)]), "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = q.cascade(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.kept for r in by[1]] == [True, True]
    assert {i: by[i][0].rejected_by for i in (2, 3, 4, 7)} == dict.fromkeys((2, 3, 4, 7), "base")
    assert by[5][0].rejected_by == "shouting" and by[6][0].rejected_by in ("symbols", "letters")
    assert by[None][0].kept and by[8][0].n_words == 30_000 and by[9][0].kept
    empty = q.cascade(docs.limit(0))
    assert empty.collect() == [] and "n_words" in empty.columns


def test_rules_run_by_rejection_per_cost_and_the_order_changes_no_verdict(spark):
    measured = [{"rule": 0, "cost": 2.0, "rejects": 0.2}, {"rule": 1, "cost": 1.0, "rejects": 0.5},
                {"rule": 2, "cost": 0.1, "rejects": 0.0}]
    assert [r.name for r in q.ordered(q.RULES[:3], measured)] == [
        q.RULES[1].name, q.RULES[0].name, q.RULES[2].name]
    docs = spark.createDataFrame(
        [(i, clean(60, i) + (" ##" * 30 if i % 3 else "")) for i in range(12)],
        "doc_id long, text string")
    one = {r.doc_id: r.kept for r in q.cascade(docs).collect()}
    other = {r.doc_id: r.kept for r in q.cascade(docs, rules=q.RULES[::-1]).collect()}
    assert one == other == {i: i % 3 == 0 for i in range(12)}


def test_rules_are_chosen_by_what_the_rules_before_let_through():
    measured = [{"rule": i, "cost": c, "rejects": r} for i, c, r in ((0, 1.0, 0.5), (1, 1.0, 0.4), (2, 1.0, 0.2))]
    # the second rule rejects only what the first does
    together = {"110": 40, "100": 10, "001": 20, "000": 30}
    names = [r.name for r in q.RULES[:3]]
    assert [r.name for r in q.ordered(q.RULES[:3], measured)] == names
    assert [r.name for r in q.ordered(q.RULES[:3], measured, together)] == [names[0], names[2], names[1]]


def test_selectivity_is_that_of_texts_that_pass_the_base(spark):
    rows = [(clean(60, i) + (" ##" * 30 if i % 4 == 0 else ""),) for i in range(12)]
    rows += [("same three words " * 40 + "## " * 90,)] * 50 + [("SHORT",)] * 50 + [(rows[0][0],)] * 20 + [(None,)]
    docs = spark.createDataFrame(rows, "text string")
    measured, together = q.costs(docs, rules=q.RULES)
    assert [m["rule"] for m in measured] == list(range(len(q.RULES)))
    symbols = [r.name for r in q.RULES].index("symbols")
    # 12 and 20 copies pass the base; every fourth of the 12, and the copies of the first, are rejected
    assert sum(together.values()) == 32 and measured[symbols]["rejects"] == 23 / 32
    assert q.costs(docs.where("text = 'SHORT'")) == ([], {})
    assert q.costs(docs.limit(0)) == ([], {})


def test_the_sample_does_not_grow_with_the_table(spark):
    docs = spark.range(40_000).selectExpr(
        "concat_ws(' ', transform(sequence(1, 60), x -> concat('w', x * 7919 + id * 31))) AS text")
    _, together = q.costs(docs, rules=q.RULES, sample_rows=20)
    assert 2 <= sum(together.values()) <= 60


def test_base_measures_are_looked_up_not_measured_again():
    column = pa.array([clean(80), clean(60) + " ##" * 30])
    passed = q._Passed(column, q.base_measures(column))
    plain_measured, asked = q._measured, []
    try:
        q._measured = lambda measures, texts: asked.append(list(measures)) or plain_measured(measures, texts)
        got = [passed.rejected(r).tolist() for r in q.RULES[:3]]
    finally:
        q._measured = plain_measured
    assert got == [[False, False], [False, True], [False, False]] and asked == [[], [], [q.lines]]
