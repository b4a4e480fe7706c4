"""Toxicity by a small convolutional text classifier, trained in numpy.

A token is a run of letters, lower-cased; its embedding is the sum of two hashed ones, for the
whole token and for its first four bytes, so that words not seen before still have a known
stem. Filters of widths 1, 2 and 3 slide over the embeddings, each keeps its largest
response in the whole text (max pooling), and a logistic layer gives the score.

What counts as toxic is then calibrated by language. The language is guessed from the text,
by a word model learned along, never read from a column: each guessed language has the
threshold that separates its held-back sample rows best, and scores are shifted so that
every threshold becomes 0.5.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallbook.llm.arrow import ready, with_text_columns
from stallbook.llm.sampling import fold, per_class
from stallbook.llm.words import slices

#: Buckets of the word table; the last row of a table is the empty token.
WORDS, STEMS = 1 << 16, 1 << 14
DIM, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
_STEM_BYTES = 4

_NO_LETTER = np.ones(256, dtype=bool)
_NO_LETTER[65:91] = _NO_LETTER[97:123] = _NO_LETTER[128:] = False


@dataclass
class Tokens:
    """Tokens of some texts: word and stem buckets, text i has spans[i] to spans[i + 1]."""

    words: np.ndarray
    stems: np.ndarray
    spans: np.ndarray


def tokens(column: pa.Array) -> Iterator[tuple[int, Tokens]]:
    """First row and tokens of each slice of whole texts."""
    for part in slices(column, lower=True, blank=_NO_LETTER):
        stems = part.hash_spans(part.starts, np.minimum(part.ends, part.starts + _STEM_BYTES))
        yield part.first, Tokens((part.words() % np.uint64(WORDS)).astype(np.int32),
                                 (stems % np.uint64(STEMS)).astype(np.int32), part.spans())


def _blocks() -> list[tuple[int, int, slice]]:
    """Width, offset and columns of every filter block in the shared weight matrix."""
    out, at = [], 0
    for width in WIDTHS:
        for j in range(width):
            out.append((width, j, slice(at, at + FILTERS)))
            at += FILTERS
    return out


_BLOCKS = _blocks()


@dataclass
class Model:
    words: np.ndarray  # WORDS + 1 x DIM
    stems: np.ndarray
    filters: np.ndarray  # DIM x blocks
    bias: np.ndarray  # one per filter
    out: np.ndarray
    out_bias: np.ndarray
    languages: np.ndarray = field(default_factory=lambda: np.zeros((WORDS + 1, 1)))  # log shares
    shift: np.ndarray = field(default_factory=lambda: np.zeros(1))  # threshold by language

    def responses(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings of the tokens, and each filter's response at each position.

        A filter that reaches over the end of its text sees empty tokens there.
        """
        x = self.words[t.words] + self.stems[t.stems]
        flat = x @ self.filters
        n = len(x)
        ends = np.repeat(t.spans[1:], np.diff(t.spans))
        out = np.zeros((n, len(WIDTHS) * FILTERS), dtype=np.float32)
        for width, j, cols in _BLOCKS:
            i = WIDTHS.index(width) * FILTERS
            part = flat[j:, cols]
            if j:
                part = part * (np.arange(j, n) < ends[:n - j])[:, None]
            out[:n - j, i:i + FILTERS] += part
        return x, out + self.bias

    def pooled(self, responses: np.ndarray, spans: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each text, at least 0; 0 for an empty text."""
        out = np.zeros((len(spans) - 1, responses.shape[1]), dtype=np.float32)
        full = np.flatnonzero(np.diff(spans))
        if len(full):
            out[full] = np.maximum.reduceat(responses, spans[full], axis=0)
        return np.maximum(out, 0)

    def logits(self, t: Tokens) -> np.ndarray:
        return self.pooled(self.responses(t)[1], t.spans) @ self.out + self.out_bias[0]

    def language(self, t: Tokens) -> np.ndarray:
        """Number of the likeliest language by the words; 0 for an empty text."""
        total = np.zeros((len(t.spans) - 1, self.languages.shape[1]), dtype=np.float32)
        full = np.flatnonzero(np.diff(t.spans))
        if len(full):
            total[full] = np.add.reduceat(self.languages[t.words], t.spans[full], axis=0)
        return total.argmax(1)

    def scores(self, t: Tokens) -> np.ndarray:
        """Calibrated score of each text."""
        z = self.logits(t) - self.shift[self.language(t)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _some(t: Tokens, rows: np.ndarray) -> Tokens:
    at = [np.arange(t.spans[r], t.spans[r + 1]) for r in rows]
    spans = np.concatenate([[0], np.cumsum([len(a) for a in at])]).astype(np.int64)
    places = np.concatenate(at) if at else np.zeros(0, dtype=np.int64)
    return Tokens(t.words[places], t.stems[places], spans)


def _evidence(buckets: np.ndarray, size: int, t: Tokens, toxic: np.ndarray) -> np.ndarray:
    """Log odds of a text being toxic if it has a token of the bucket, small where few have it."""
    text = np.repeat(np.arange(len(toxic)), np.diff(t.spans))
    cell = np.unique(text.astype(np.int64) * size + buckets)
    seen = [np.bincount((cell % size)[toxic[cell // size] == c], minlength=size) for c in (0, 1)]
    n = [max(1, int((toxic == c).sum())) for c in (0, 1)]
    odds = np.log((seen[1] + 1) / (n[1] + 2)) - np.log((seen[0] + 1) / (n[0] + 2))
    both = seen[0] + seen[1]
    return (odds * both / (both + 4)).astype(np.float32)


def _initial(t: Tokens, toxic: np.ndarray, seed: int) -> Model:
    """Small random weights; one filter starts from the words' evidence, so that few rows do."""
    draw = np.random.default_rng(seed)
    normal = lambda *shape: draw.normal(0, 0.1, shape).astype(np.float32)
    count = len(WIDTHS) * FILTERS
    model = Model(normal(WORDS + 1, DIM), normal(STEMS + 1, DIM),
                  normal(DIM, FILTERS * sum(WIDTHS)), np.zeros(count, dtype=np.float32),
                  normal(count), np.zeros(1, dtype=np.float32))
    model.words *= 0.1
    model.stems *= 0.1
    model.words[:WORDS, 0] = _evidence(t.words, WORDS, t, toxic) / 2
    model.stems[:STEMS, 0] = _evidence(t.stems, STEMS, t, toxic) / 2
    model.filters[0, 0] = model.out[0] = 1.0
    return model


class _Adam:
    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = [np.zeros_like(p) for p in params]
        self.v = [np.zeros_like(p) for p in params]

    def step(self, slopes: list[np.ndarray]) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t)
        for p, g, m, v in zip(self.params, slopes, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= (scale * m / (np.sqrt(v) + 1e-8)).astype(np.float32)


def _slopes(model: Model, t: Tokens, weight: np.ndarray, toxic: np.ndarray) -> list[np.ndarray]:
    """Gradient of the weighted logistic loss by every parameter but the tables' sizes."""
    x, responses = model.responses(t)
    pooled = model.pooled(responses, t.spans)
    z = pooled @ model.out + model.out_bias[0]
    error = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic) * weight).astype(np.float32)
    down = error[:, None] * model.out * (pooled > 0)
    g_x, g_filters = np.zeros_like(x), np.zeros_like(model.filters)
    full = np.flatnonzero(np.diff(t.spans))
    peak = np.stack([responses[t.spans[r]:t.spans[r + 1]].argmax(0) + t.spans[r] for r in full])
    for width, j, cols in _BLOCKS:
        i = WIDTHS.index(width) * FILTERS
        at, grad = peak[:, i:i + FILTERS] + j, down[full, i:i + FILTERS]
        inside = at < t.spans[full + 1][:, None]
        text, f = np.nonzero(inside)
        place, grad = at[text, f], grad[text, f]
        np.add.at(g_x, place, grad[:, None] * model.filters[:, cols].T[f])
        np.add.at(g_filters.T, np.arange(cols.start, cols.stop)[f], grad[:, None] * x[place])
    g_words, g_stems = np.zeros_like(model.words), np.zeros_like(model.stems)
    np.add.at(g_words, t.words, g_x)
    np.add.at(g_stems, t.stems, g_x)
    return [g_words, g_stems, g_filters, down.sum(0), pooled.T @ error, error.sum(keepdims=True)]


def _threshold(z: np.ndarray, toxic: np.ndarray) -> float:
    """Logit that parts toxic from clean rows with the best F1, in the middle of the gap there."""
    order = np.argsort(-z, kind="stable")
    z, hit = z[order], np.cumsum(toxic[order])
    f1 = 2 * hit / (np.arange(1, len(z) + 1) + toxic.sum())
    f1[:-1][z[1:] == z[:-1]] = -1  # no cut between equal scores
    best = int(f1.argmax())
    return float((z[best] + z[best + 1]) / 2) if best + 1 < len(z) else float(z[best]) - 1


def fit(t: Tokens, toxic: np.ndarray, lang: np.ndarray, steps: int = 400, batch: int = 32,
        seed: int = 11) -> Model:
    """Train on four fifths of the rows, calibrate on the rest (on all if a class is rare there).

    `lang` holds a language number per row, or -1; it serves the word model of languages only.
    """
    toxic, draw = toxic.astype(np.int64), np.random.default_rng(seed)
    rows = draw.permutation(len(toxic))
    back = rows[:len(rows) // 5]
    used = rows[len(rows) // 5:]
    if min((toxic[back] == c).sum() for c in (0, 1)) < 5:
        back = used = rows
    model = _initial(_some(t, used), toxic[used], seed)
    adam = _Adam([model.words, model.stems, model.filters, model.bias, model.out, model.out_bias],
                 0.003)
    by_class = [used[toxic[used] == c] for c in (0, 1)]
    if all(len(c) for c in by_class):
        for _ in range(steps):
            pick = np.concatenate([draw.choice(c, batch // 2) for c in by_class])
            part = _some(t, pick)
            if len(part.words):
                adam.step(_slopes(model, part, np.full(len(pick), 1 / len(pick)), toxic[pick]))
    count = max(1, int(lang.max(initial=-1)) + 1)
    share = np.ones((WORDS + 1, count))
    known = np.repeat(lang, np.diff(t.spans))
    for k in range(count):
        share[:WORDS, k] += np.bincount(t.words[known == k], minlength=WORDS)
    model.languages = np.log(share / share.sum(0)).astype(np.float32)
    model.shift = np.zeros(count)
    test = _some(t, back)
    z, guess, truth = model.logits(test), model.language(test), toxic[back]
    common = _threshold(z, truth) if 0 < truth.sum() < len(truth) else 0.0
    for k in range(count):
        own = guess == k
        enough = min((truth[own] == c).sum() for c in (0, 1)) >= 5
        model.shift[k] = _threshold(z[own], truth[own]) if enough else common
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = 2000) -> Model | None:
    """Learn from at most `most` toxic and as many clean rows of `labels`, whole texts.

    `docs` has doc_id, text and lang; `labels` doc_id and toxic (0 or 1, null is left out). The
    sampled ids, at most twice `most`, are few enough to broadcast. The tasks make the tokens;
    the driver gets those of the sampled rows alone. None if there is nothing to learn from.
    """
    ready(docs.sparkSession)
    usable = labels.where(F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    sample = per_class(usable, "toxic", most)
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).join(
        F.broadcast(sample), "doc_id")

    def measure(batches):
        for batch in batches:
            words, stems = [], []
            for _, t in tokens(batch.column(0)):
                for a, b in zip(t.spans[:-1], t.spans[1:], strict=True):
                    words.append(t.words[a:b].tobytes())
                    stems.append(t.stems[a:b].tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(words, pa.binary()), pa.array(stems, pa.binary())],
                ["doc_id", "toxic", "lang", "words", "stems"])

    got = rows.select("text", F.col("doc_id").cast("string").alias("doc_id"),
                      F.col("toxic").cast("long").alias("toxic"), "lang").mapInArrow(
        measure, "doc_id string, toxic long, lang string, words binary, stems binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r.doc_id, r.toxic, r.lang or "", bytes(r.words)))
    arrays = [[np.frombuffer(r[c], dtype=np.int32) for r in got] for c in ("words", "stems")]
    spans = np.concatenate([[0], np.cumsum([len(a) for a in arrays[0]])]).astype(np.int64)
    names = sorted({r.lang for r in got if r.lang is not None})
    lang = np.array([names.index(r.lang) if r.lang is not None else -1 for r in got])
    t = Tokens(np.concatenate(arrays[0]), np.concatenate(arrays[1]), spans)
    return fit(t, np.array([r.toxic for r in got]), lang)


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add score (0 to 1) and predicted (1 if score >= 0.5) to every row.

    A null text counts as an empty one, whose score is that of no response at all. Without a
    model every score is 0. Columns of these names are replaced; every row stays.
    """
    def make():
        def run(column: pa.Array) -> dict[str, object]:
            out = np.zeros(len(column))
            if model:
                for first, t in tokens(column):
                    out[first:first + len(t.spans) - 1] = model.scores(t)
            return {"score": out, "predicted": (out >= 0.5).astype(np.int32)}
        return run

    return with_text_columns(docs, text, {"score": "double", "predicted": "int"}, make)


def held_out_scores(docs: DataFrame, labels: DataFrame, folds: int = 5,
                    held: int = 0) -> DataFrame:
    """Train on labels whose id's fold is not `held`, score all; a null id is in no fold."""
    model = train(docs, labels.where(fold(F.col("doc_id"), folds) != held))
    out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False))
    return score(docs, model).withColumn("held_out", out)
