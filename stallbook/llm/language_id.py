"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a logistic classifier over hashed byte
n-grams predicts it. A text's language is the one whose codeword has the least loss: the
logistic loss of each bit, weighted by how well that bit is learned. If the runner-up is
close, the text is flagged as ambiguous.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallbook.llm.arrow import ready, with_text_columns
from stallbook.llm.sampling import fold, per_class
from stallbook.llm.words import slices

UNKNOWN = "und"
#: Buckets of the two-byte and of the three-byte sequences.
BUCKETS = 4096
_ROWS = 256


def _grams(data: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """Counts of hashed `n`-byte sequences, one row per text; none spans two texts."""
    size = len(bounds) - 1
    if len(data) < n:
        return np.zeros((size, BUCKETS), dtype=np.float32)
    last = len(data) - n + 1
    code = np.zeros(last, dtype=np.uint32)
    for j in range(n):
        code = code * np.uint32(0x01000193) + data[j:last + j]
    code *= np.uint32(0x9E3779B1)
    code >>= np.uint32(20)
    text = np.repeat(np.arange(size, dtype=np.int32), np.diff(bounds))
    cell = text[:last].astype(np.int64) * BUCKETS + code
    cell = cell[text[:last] == text[n - 1:]]
    return np.bincount(cell, minlength=size * BUCKETS).reshape(size, BUCKETS).astype(np.float32)


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """First row and one feature row per text: roots of relative n-gram counts, of length 1."""
    for part in slices(column, lower=True, rows=_ROWS):
        found = []
        for n in (2, 3):
            counts = _grams(part.data, part.bounds, n)
            found.append(np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)))
        yield part.first, np.concatenate(found, axis=1) * np.float32(np.sqrt(0.5))


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """One row of +1 and -1 per language.

    Up to 5 languages every way to part them is a bit; beyond that, about 10 log2 n seeded
    random bits, redrawn until each parts the languages and no two languages are alike.
    """
    if languages < 2:
        return np.ones((languages, 0), dtype=np.float32)
    if languages <= 5:
        bits = [[1 if i == 0 or not (b >> (i - 1)) & 1 else -1 for i in range(languages)]
                for b in range(1, 2 ** (languages - 1))]
        return np.array(bits, dtype=np.float32).T
    draw, width = np.random.default_rng(seed), int(np.ceil(10 * np.log2(languages)))
    while True:
        code = draw.choice([-1.0, 1.0], size=(languages, width)).astype(np.float32)
        if (np.abs(code.sum(0)) < languages).all() and len(np.unique(code, axis=0)) == languages:
            return code


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit in the decoding, of sum 1

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its share and the margin to the runner-up (1 if there is none)."""
        if len(self.languages) < 2:
            n = len(x)
            return np.zeros(n, dtype=np.int64), np.ones(n), np.ones(n)
        out = x @ self.weights + self.bias
        loss = np.logaddexp(0, -out[:, None, :] * self.code[None]) @ self.trust
        order = np.argsort(loss, axis=1, kind="stable")
        rows = np.arange(len(x))
        share = np.exp(loss.min(1, keepdims=True) - loss)
        share /= share.sum(1, keepdims=True)
        gap = loss[rows, order[:, 1]] - loss[rows, order[:, 0]]
        return order[:, 0], share[rows, order[:, 0]], gap


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], steps: int = 120) -> Model:
    """Train all bits together by accelerated gradient descent on the logistic loss.

    Classes weigh the same however many rows each has. A bit is trusted by how far its
    training accuracy is above chance.
    """
    code = codewords(len(languages))
    weights = np.zeros((x.shape[1], code.shape[1]), dtype=np.float32)
    bias = np.zeros(code.shape[1], dtype=np.float32)
    if not code.shape[1]:
        return Model(languages, code, weights, bias, np.zeros(0))
    aim = code[y]
    each = 1 / np.bincount(y, minlength=len(languages))[y]
    each = (each / each.sum()).astype(np.float32)[:, None]
    rate, ridge = np.float32(20.0), np.float32(1e-5)
    ahead, ahead_bias, t = weights, bias, 1.0
    for _ in range(steps):
        slope = -aim * each / (1 + np.exp(aim * (x @ ahead + ahead_bias)))
        new = ahead - rate * (x.T @ slope + ridge * ahead)
        new_bias = ahead_bias - np.float32(2.0) * slope.sum(0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        pull = np.float32((before - 1) / t)
        ahead, ahead_bias = new + pull * (new - weights), new_bias + pull * (new_bias - bias)
        weights, bias = new, new_bias
    right = (((x @ weights + bias) * aim > 0) * each).sum(0)
    trust = np.maximum(right - 0.5, 0.01)
    return Model(languages, code, weights, bias, trust / trust.sum())


def train(docs: DataFrame, per_language: int = 300, most_rows: int = 4000) -> Model | None:
    """Learn from at most `per_language` rows of each language, `most_rows` in all.

    `docs` has doc_id, text and lang. The tasks make the features; the driver gets them for the
    sampled rows alone, so its memory is bounded by `most_rows` however large the corpus.
    """
    ready(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    languages = max(1, known.select("lang").distinct().count())
    sample = per_class(known, "lang", max(1, min(per_language, most_rows // languages)))

    def measure(batches):
        for batch in batches:
            text, lang = batch.column(0), batch.column(1)
            rows = [x for _, found in features(text) for x in found.astype(np.float16)]
            yield pa.RecordBatch.from_arrays(
                [lang, batch.column(2), pa.array([r.tobytes() for r in rows], pa.binary())],
                ["lang", "doc_id", "x"])

    rows = sample.select("text", "lang", F.col("doc_id").cast("string").alias("doc_id")).mapInArrow(
        measure, "lang string, doc_id string, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.lang, r.doc_id or "", bytes(r.x)))
    names = sorted({r.lang for r in rows})
    x = np.stack([np.frombuffer(r.x, dtype=np.float16) for r in rows]).astype(np.float32)
    return fit(x, np.array([names.index(r.lang) for r in rows]), names)


def predict(docs: DataFrame, model: Model | None, text: str = "text",
            close: float = 0.2) -> DataFrame:
    """Add lang_pred, score (0 to 1) and ambiguous to every row.

    A null text, or one without any letter, is `und` with score 0 and not ambiguous; so is every
    text if there is no model. A text is ambiguous when the losses of the two best languages
    differ by less than `close`. Columns of these names are replaced.
    """
    def make():
        def run(column: pa.Array) -> dict[str, object]:
            n = len(column)
            best, share, gap = np.zeros(n, dtype=np.int64), np.zeros(n), np.ones(n)
            known = np.zeros(n, dtype=bool)
            if model:
                known = pc.match_substring_regex(pc.fill_null(column, ""), r"\p{L}").to_numpy(
                    zero_copy_only=False)
                for first, x in features(column):
                    at = slice(first, first + len(x))
                    best[at], share[at], gap[at] = model.decode(x)
            names = model.languages if model else []
            return {"lang_pred": pa.array([names[b] if k else UNKNOWN
                                           for b, k in zip(best, known, strict=True)], pa.string()),
                    "score": np.where(known, np.clip(share, 0, 1), 0.0),
                    "ambiguous": known & (gap < close)}
        return run

    return with_text_columns(docs, text, {"lang_pred": "string", "score": "double",
                                          "ambiguous": "boolean"}, make)


def held_out_predictions(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Train on the rows whose id's fold is not `held`, predict all; a null id is in no fold."""
    out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False))
    training = docs.where(fold(F.col("doc_id"), folds) != held)
    return predict(docs, train(training)).withColumn("held_out", out)
