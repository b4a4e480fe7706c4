"""Quality rules as a short-circuit cascade.

Every rule measures whole texts and rejects those outside its limits. On a sample of the texts that
pass the base measures, each rule's cost (seconds a byte) and which texts it rejects are
measured. The first rule is that with the most rejections per cost; the next one that with the most
per cost among what the first lets through, and so on, and each runs on that only. What the
base has measured is not measured again. The order changes the time and which rule a text is
rejected by, never the verdict: a text is kept if no rule rejects it.
"""

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallbook.llm.arrow import ready, with_text_columns
from stallbook.llm.words import Slice, mix, runs, slices

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_STARTS = np.ones(256, dtype=bool)  # bytes that begin a code point
_STARTS[0x80:0xC0] = False
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[65:91] = True
_SMALL = np.zeros(256, dtype=bool)
_SMALL[97:123] = True


def _within(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many bytes of each span the mask holds for."""
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[ends] - total[starts]


def _in_texts(part: Slice, mask: np.ndarray) -> np.ndarray:
    return _within(mask, part.bounds[:-1], part.bounds[1:])


def word_chars(part: Slice) -> np.ndarray:
    """Code points in words."""
    inside = _STARTS[part.data] & ~((part.data == 32) | ((part.data >= 9) & (part.data <= 13)))
    return _in_texts(part, inside)


def symbols(part: Slice) -> np.ndarray:
    """Characters of `#*$%&|<>`."""
    return _in_texts(part, _SYMBOL[part.data])


def lines(part: Slice) -> np.ndarray:
    """Lines with a word."""
    return np.bincount(part.lines()[2], minlength=part.size)


def duplicate_lines(part: Slice) -> np.ndarray:
    """Lines with a word that equal an earlier line of the text."""
    starts, ends, text, _ = part.lines()
    keys = mix(part.hash_spans(starts, ends) + text.astype(np.uint64))
    _, first = np.unique(keys, return_index=True)
    return (np.bincount(text, minlength=part.size)
            - np.bincount(text[first], minlength=part.size))


def repeated_words(part: Slice, n: int = 3) -> np.ndarray:
    """Words in `n`-word windows that the text has twice or more."""
    found, firsts = runs(part.words(), part.text, n)
    keys = mix(found + part.text[firsts].astype(np.uint64))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(part.starts) + 1, dtype=np.int64)
    at = firsts[twice]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(part.text[covered], minlength=part.size)


def words_with_letter(part: Slice) -> np.ndarray:
    """Words with an ASCII letter or any character beyond ASCII."""
    has = _within(_LETTER[part.data], part.starts, part.ends) > 0
    return np.bincount(part.text[has], minlength=part.size)


Measure = Callable[[Slice], np.ndarray]


@dataclass(frozen=True)
class Rule:
    """Reject a text unless low * base <= scale * value <= high * base."""

    name: str
    value: Measure
    base: Measure
    low: int = 0
    high: int | None = None
    scale: int = 100

    def outside(self, value: np.ndarray, base: np.ndarray) -> np.ndarray:
        value = self.scale * value
        out = value < self.low * base
        return out if self.high is None else out | (value > self.high * base)


#: Limits are per cent of the base, per word or line.
RULES = (
    Rule("word_length", word_chars, Slice.counts, 200, 1200),
    Rule("symbols", symbols, Slice.counts, high=40),
    Rule("duplicate_lines", duplicate_lines, lines, high=50),
    Rule("letters", words_with_letter, Slice.counts, 60),
    Rule("shouting", lambda p: _in_texts(p, _CAPITAL[p.data]),
         lambda p: _in_texts(p, _CAPITAL[p.data] | _SMALL[p.data]), high=60),
)


#: What every text is measured by.
BASE = {"n_words": Slice.counts, "word_chars": word_chars, "n_symbols": symbols,
        "n_dup_lines": duplicate_lines, "n_repeat_words": repeated_words}


def _measured(measures: Sequence[Measure], column: pa.Array) -> list[np.ndarray]:
    out = [np.zeros(len(column), dtype=np.int64) for _ in measures]
    for part in slices(column) if measures else ():
        for values, measure in zip(out, measures, strict=True):
            values[part.first:part.first + part.size] = measure(part)
    return out


def base_measures(column: pa.Array) -> dict[str, np.ndarray]:
    """The measures that every text gets, and whether it fails on them."""
    out = dict(zip(BASE, _measured(list(BASE.values()), column), strict=True))
    out["base_failed"] = (out["n_words"] < 50) | (
        100 * out["n_repeat_words"] > 50 * out["n_words"])
    return out


class _Passed:
    """The texts of a column that are not rejected yet, and what is known of them."""

    def __init__(self, column: pa.Array, base: dict[str, np.ndarray]):
        self.rows = np.flatnonzero(~base["base_failed"])
        self.texts = column.take(pa.array(self.rows))
        self.known = {measure: base[name][self.rows] for name, measure in BASE.items()}

    def rejected(self, rule: Rule) -> np.ndarray:
        """Which of the texts the rule rejects. Base measures are looked up."""
        new = [m for m in dict.fromkeys((rule.value, rule.base)) if m not in self.known]
        values = self.known | dict(zip(new, _measured(new, self.texts), strict=True))
        return rule.outside(values[rule.value], values[rule.base])

    def drop(self, bad: np.ndarray) -> None:
        if bad.any():
            self.rows, self.texts = self.rows[~bad], self.texts.filter(pa.array(~bad))
            self.known = {measure: values[~bad] for measure, values in self.known.items()}


#: Hashes of texts are spread over this many values.
_SPACE = 1 << 40


def costs(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES,
          sample_rows: int = 2000) -> tuple[list[dict], dict[str, int]]:
    """Each rule's seconds a byte and share rejected, and how many rows each set of rules rejects
    (one character a rule, 1 if it does), on about `sample_rows` rows or fewer, of which those
    that fail the base are left out.

    The sample is the texts whose hash falls in the needed share of all hashes, the same at every run
    and about as many at any size of the table. Equal texts are one, with their count. One row per
    rule and set, at most as many as sampled texts, comes back. No text that passes the base: nothing.
    """
    ready(docs.sparkSession)
    total = docs.count()
    if not total:
        return [], {}
    share = min(_SPACE, -(-_SPACE * sample_rows // total))
    sample = docs.where(F.pmod(F.xxhash64(F.col(text)), F.lit(_SPACE)) < share).groupBy(
        F.col(text).alias("text")).agg(F.count("*").alias("copies"))

    def measure(batches):
        for batch in batches:
            column, rows = batch.column(0), []
            passed = _Passed(column, base_measures(column))
            copies = batch.column(1).to_numpy()[passed.rows]
            marks = np.zeros((len(copies), len(rules)), dtype=bool)
            for i, rule in enumerate(rules if len(copies) else ()):
                began = time.perf_counter()
                marks[:, i] = passed.rejected(rule)
                rows.append((i, None, time.perf_counter() - began, passed.texts.nbytes, 0))
            rows += [(None, "".join("01"[x] for x in m), 0.0, 0, c)
                     for m, c in zip(marks.astype(int).tolist(), copies.tolist(), strict=True)]
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(columns, kinds, strict=True)],
                ["rule", "marks", "seconds", "bytes", "rows"])

    got = (sample.mapInArrow(measure, "rule long, marks string, seconds double, bytes long, rows long")
           .groupBy("rule", "marks").agg(*[F.sum(c).alias(c) for c in ("seconds", "bytes", "rows")])
           .collect())
    together = {r.marks: r.rows for r in got if r.marks is not None}
    every = max(1, sum(together.values()))
    return sorted(({"rule": r.rule, "cost": r.seconds / max(1, r.bytes),
                    "rejects": sum(n for m, n in together.items() if m[r.rule] == "1") / every}
                   for r in got if r.rule is not None), key=lambda m: m["rule"]), together


def ordered(rules: Sequence[Rule], measured: list[dict],
            together: dict[str, int] | None = None) -> list[Rule]:
    """The rules, each the best of those left by rejection per cost; equal ones in the given order.

    With `together`, the rejections that count are those among rows that the rules before let
    through; without it each rule rejects the same share of whatever is left. Rules that are not
    measured come last.
    """
    known = {m["rule"]: m for m in measured}
    left, alive, out = list(range(len(rules))), dict(together or {}), []
    while left:
        def worth(i: int) -> float:
            if i not in known:
                return -1.0
            share = known[i]["rejects"] if together is None else sum(
                n for m, n in alive.items() if m[i] == "1")
            return share / max(known[i]["cost"], 1e-15)

        best = max(left, key=lambda i: (worth(i), -i))
        left.remove(best)
        out.append(rules[best])
        alive = {m: n for m, n in alive.items() if m[best] == "0"}
    return out


def cascade(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES,
            sample_rows: int = 2000) -> DataFrame:
    """Add the base measures, `base_failed`, `kept` and `rejected_by` to every row.

    `rejected_by` is `base`, the first rule of the cascade that rejects the text, or null; it
    may differ from run to run if two rules reject the text, as costs are measured. `kept` does
    not. A null text counts as an empty one: no words, base failed. Columns that have the
    name of a new one are replaced; all others, and every row, stay as they are.
    """
    order = ordered(rules, *costs(docs, text, rules, sample_rows))

    def make():
        def run(column: pa.Array) -> dict[str, object]:
            out = base_measures(column)
            by = np.where(out["base_failed"], "base", "").astype(object)
            passed = _Passed(column, out)
            for rule in order:
                if not len(passed.rows):
                    break
                bad = passed.rejected(rule)
                by[passed.rows[bad]] = rule.name
                passed.drop(bad)
            out["kept"] = by == ""
            out["rejected_by"] = pa.array([b or None for b in by], type=pa.string())
            return out
        return run

    return with_text_columns(docs, text, {
        "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long",
        "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean",
        "rejected_by": "string"}, make)
