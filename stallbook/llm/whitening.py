"""Embedding whitening by the eigenvectors of a distributed covariance.

Components are whole numbers, floor(scale * c) + shift, so sums and products are exact. Two
passes over the vectors give n and the sums S, then the products of the vectors taken relative
to the whole number next to S/n; what that number misses of the mean is put right with
whole numbers too. Tasks add up their own rows and send one row per entry, which Spark adds as
decimals. So V is exact until it is rounded to the 64 bits that `eigen` works with, however
large n or the shift, and the same at every run.

The eigenvectors start in float32 and are corrected by matrix products (`eigen`). They come from
a matrix of the vectors' length squared, on the driver, whatever the number of vectors. Two more
passes project the vectors and measure what the whitened values' covariance really is.
"""

from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallbook.llm.arrow import ready
from stallbook.llm.eigen import WIDE, eigenvectors, times

#: Rows that are multiplied at a time, and bits of the pieces that whole numbers are cut into.
BLOCK, BITS = 2048, 20
_DECIMAL = pa.decimal128(38, 0)


class Space(NamedTuple):
    """What whitens the vectors of one length."""

    n: int
    sums: list[int]
    centre: list[int]  # the whole numbers next to the mean
    values: np.ndarray  # eigenvalues of the covariance, falling
    vectors: np.ndarray  # unit eigenvectors as columns
    trace: float

    def kept(self, components: int) -> int:
        return min(components, len(self.values))

    def scales(self, components: int) -> np.ndarray:
        """1 / sqrt(e) of each component; NaN where the covariance has no extent."""
        e = self.values[:components]
        real = e > len(self.values) * np.finfo(np.float64).eps * self.values[0]
        return np.where(real, 1 / np.sqrt(np.where(real, e, 1)), np.nan)


def whole(vector: Column, scale: int, shift: int) -> Column:
    """floor(scale * c) + shift of every component; null where the vector takes no part.

    Null and empty vectors, and those with a null, infinite or NaN component, take no part.
    Components of 2**61 and more raise an error.
    """
    as_double = F.transform(vector, lambda c: c.cast("double"))
    fine = F.forall(as_double, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    far = F.raise_error(F.lit("a component is too large for whole numbers")).cast("long")

    def number(c: Column) -> Column:
        scaled = c * F.lit(float(scale))
        return F.when(F.abs(scaled) < 2.0 ** 61, F.floor(scaled) + F.lit(shift)).otherwise(far)

    return F.when(fine & (F.size(vector) > 0), F.transform(as_double, number))


def _matrices(batch: pa.RecordBatch):
    """Each length in the batch, the rows that have it, and their numbers as a matrix."""
    lists = batch.column("x")
    starts = lists.offsets.to_numpy().astype(np.int64)
    sizes, flat = np.diff(starts), lists.values.to_numpy()
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        for part in np.array_split(rows, -(-len(rows) // BLOCK)):
            yield d, part, flat[starts[part][:, None] + np.arange(d)]


def _products(y: np.ndarray) -> np.ndarray:
    """y.T @ y, exact, as Python integers where 64 bits may not do.

    Numbers are cut into pieces of `BITS` bits; float64 products of these add up exactly.
    """
    y, out, parts = y.copy(), 0, []
    while True:
        low = y & ((1 << BITS) - 1) if np.abs(y).max(initial=0) >> BITS else y
        parts.append(low.astype(np.float64))
        y = (y - low) >> BITS
        if not y.any():
            break
    for i, a in enumerate(parts):
        for j, b in enumerate(parts):
            part = (a.T @ b).astype(np.int64)
            out = out + (part if len(parts) == 1 else part.astype(object) << (BITS * (i + j)))
    return out


def _entries(totals: dict[int, np.ndarray]) -> pa.RecordBatch:
    """Rows (dims, i, j, total) of each length's table of totals."""
    dims, i, j, total = [], [], [], []
    for d, table in totals.items():
        at = np.indices(table.shape).reshape(2, -1)
        dims += [d] * table.size
        i += at[0].tolist()
        j += at[1].tolist()
        total += [Decimal(int(v)) for v in table.ravel()]
    return pa.RecordBatch.from_arrays(
        [pa.array(dims, pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()),
         pa.array(total, _DECIMAL)], ["dims", "i", "j", "total"])


def _added(rows: DataFrame, of) -> dict[int, list[list[int]]]:
    """The sums over all rows of `of(d, x)`, a table of whole numbers per length.

    A task adds its own rows up; Spark adds the tasks' rows entry by entry.
    """
    def run(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in _matrices(batch):
                part = of(d, x).astype(object)
                totals[d] = totals[d] + part if d in totals else part
        yield _entries(totals)

    ready(rows.sparkSession)
    summed = rows.select("x").mapInArrow(run, "dims int, i int, j int, total decimal(38,0)").groupBy(
        "dims", "i", "j").agg(F.sum("total").alias("total"))
    out: dict[int, dict] = {}
    for r in summed.collect():  # the square of a vector's length, for each length
        out.setdefault(r.dims, {})[r.i, r.j] = int(r.total)
    return {d: [[cells[i, j] for j in range(1 + max(c[1] for c in cells))]
                for i in range(1 + max(c[0] for c in cells))] for d, cells in out.items()}


def _wide(numbers: list[list[int]]) -> np.ndarray:
    """Python integers in `WIDE`, correct to its last bits."""
    high = np.array(numbers, dtype=object).astype(np.float64)
    low = [[n - int(h) for n, h in zip(row, own, strict=True)]
           for row, own in zip(numbers, high.tolist(), strict=True)]
    return high.astype(WIDE) + np.array(low, dtype=object).astype(np.float64)


def fit(rows: DataFrame) -> dict[int, Space]:
    """A space for every length among the vectors of `rows` (x array<long>)."""
    counted = _added(rows, lambda d, x: np.concatenate(
        [np.full((1, 1), len(x), dtype=object), x.astype(object).sum(0)[None, :]], axis=1))
    known = {d: (t[0][0], t[0][1:]) for d, t in counted.items()}
    centres = {d: [(2 * s + n) // (2 * n) for s in sums] for d, (n, sums) in known.items()}
    held = {d: np.array(c, dtype=np.int64) for d, c in centres.items()}
    products = _added(rows, lambda d, x: _products(x - held[d]))
    out = {}
    for d, (n, sums) in known.items():
        rest = [s - n * c for s, c in zip(sums, centres[d], strict=True)]
        exact = [[n * q - a * b for q, b in zip(row, rest, strict=True)]
                 for row, a in zip(products[d], rest, strict=True)]
        covariance = _wide(exact) / (WIDE(n) * WIDE(n))
        values, vectors = eigenvectors(covariance)
        out[d] = Space(n, sums, centres[d], values, vectors, float(np.trace(covariance)))
    return out


def _projected(space: Space, x: np.ndarray, components: int) -> np.ndarray:
    """(x - S/n) projected on each component, over the root of its eigenvalue."""
    offset = np.array([(s - space.n * c) / space.n
                       for s, c in zip(space.sums, space.centre, strict=True)])
    centred = (x - np.array(space.centre, dtype=np.int64)).astype(np.float64) - offset
    vectors = space.vectors[:, :components]
    out = np.zeros((len(x), vectors.shape[1]), dtype=np.result_type(centred, vectors))
    for values, weights in zip(centred.T, vectors, strict=True):  # BLAS rounds by the number of rows
        out += values[:, None] * weights
    return out * space.scales(components)


def _deviations(space: Space, x: np.ndarray) -> list[int]:
    """The sum over dimensions of (n * x - S)**2, exact."""
    rest = np.array([s - space.n * c for s, c in zip(space.sums, space.centre, strict=True)],
                    dtype=object)
    near = x - np.array(space.centre, dtype=np.int64)
    reach = (space.n * int(np.abs(near).max(initial=0)) + max(map(abs, rest))) ** 2 * len(rest)
    if reach < 1 << 62:
        off = space.n * near - rest.astype(np.int64)
        return (off * off).sum(1).tolist()
    off = space.n * near.astype(object) - rest
    return (off * off).sum(1).tolist()


def _identity_error(rows: DataFrame, spaces: dict[int, Space], components: int) -> dict[int, float]:
    """For each length, how far the covariance of the whitened values is from the identity."""
    def run(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in _matrices(batch):
                w = _projected(spaces[d], x, components)
                part = np.concatenate([w.sum(0)[None, :], w.T @ w])
                totals[d] = totals[d] + part if d in totals else part
        for d, table in totals.items():
            at = np.indices(table.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(table.size, d, np.int32)), pa.array(at[0].astype(np.int32)),
                 pa.array(at[1].astype(np.int32)), pa.array(table.ravel())],
                ["dims", "i", "j", "total"])

    summed = rows.select("x").mapInArrow(run, "dims int, i int, j int, total double").groupBy(
        "dims", "i", "j").agg(F.sum("total").alias("total")).collect()
    tables = {d: np.zeros((s.kept(components) + 1, s.kept(components))) for d, s in spaces.items()}
    for r in summed:
        tables[r.dims][r.i, r.j] = r.total
    out = {}
    for d, table in tables.items():
        mean = table[0] / spaces[d].n
        off = table[1:] / spaces[d].n - np.outer(mean, mean) - np.eye(table.shape[1])
        real = ~np.isnan(spaces[d].scales(components))
        out[d] = float(np.abs(off[np.ix_(real, real)]).max(initial=0))
    return out


def whiten(vectors: DataFrame, components: int = 32, scale: int = 64, shift: int = 1_000_000,
           vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Whitened values of every vector: a row for each of the first `components` components.

    Returns vec_id, component (from 1, by falling eigenvalue), n, deviation (exact,
    decimal(38,0)), whitened, explained and identity_error, and no other column of `vectors`.

    Vectors that are null, empty, or hold a null, infinite or NaN component have no rows and are in
    no statistic. Rows without an id, with equal ids or with equal vectors all count and all have
    rows. Vectors of another length are a space of their own, with n, mean and components of
    their own. A component along which the vectors do not differ (an eigenvalue of zero, up to
    rounding) cannot be scaled: `whitened` is null, `explained` its share, or null where no vector
    differs from another, and it is in no `identity_error`. Components of equal eigenvalues may be
    any basis of their space. An empty table gives no rows. A vector's length squared must fit
    the driver. Numbers of 2**61 and more, and deviations beyond 38 digits, raise an error.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"),
                          whole(F.col(embedding), scale, shift).alias("x")).where("x IS NOT NULL")
    spaces = fit(rows)
    errors = _identity_error(rows, spaces, components)
    made = pa.struct([("n", pa.int64()), ("deviation", _DECIMAL), ("error", pa.float64()),
                      ("w", pa.list_(pa.struct([("whitened", pa.float64()),
                                                ("explained", pa.float64())])))])
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids = batch.column("vec_id")
            for d, part, x in _matrices(batch):
                space, m = spaces[d], spaces[d].kept(components)
                w = _projected(space, x, components).ravel()
                share = np.maximum(space.values[:m], 0) / space.trace if space.trace > 0 else np.full(m, np.nan)
                one = lambda v, k=len(part): pa.array(np.tile(v, k), from_pandas=True)
                cells = pa.StructArray.from_arrays(
                    [pa.array(w, from_pandas=True), one(share)], names=["whitened", "explained"])
                bounds = pa.array(np.arange(len(part) + 1, dtype=np.int32) * m)
                columns = [pa.array(np.full(len(part), space.n, np.int64)),
                           pa.array([Decimal(v) for v in _deviations(space, x)], _DECIMAL),
                           pa.array(np.full(len(part), errors[d])),
                           pa.ListArray.from_arrays(bounds, cells)]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(part)), *[c.cast(f.type) for c, f in zip(columns, made, strict=True)]],
                    ["vec_id", *[f.name for f in made]])

    found = rows.mapInArrow(
        run, f"vec_id {kind}, n long, deviation decimal(38,0), error double, "
             "w array<struct<whitened: double, explained: double>>")
    return found.select("vec_id", "n", "deviation", "error", F.posexplode("w").alias("at", "c")).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation",
        F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"),
        F.col("error").alias("identity_error"))
