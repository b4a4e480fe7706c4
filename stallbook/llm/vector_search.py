"""Exact top-k search by inner product with a vector-approximation file.

The file is written once. Its rows are blocks of vectors: for each component the number of one of
`CELLS` cells, the edges of the block's cells, the ids, and in a column of their own the exact
whole numbers. A query first scans the cells only, for which the exact column is not read: the
edges bound each component, so sums of products bound the score from below and above. A
vector whose upper bound is below the k-th best lower bound of its query, in its block and
then over all blocks, is out. Of the others the exact vectors are read in the order of the
bounds: first the `FIRST` * k best, whose k-th score is a new limit, then all whose upper bound
reaches that limit. Whatever is left cannot be among the k, so the result is certain.

Queries meet all cells in blocks: a block of queries is copied once per group of vectors,
never paired row by row. Only bounds that can still matter leave the task.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallbook.config import keep
from stallbook.llm.arrow import ready, rows_per_batch

CELLS = 256
#: Most rows of a block, of vectors and of queries, and vectors of a group.
BLOCK, QUERY_BLOCK, GROUP = 2000, 500, 20_000
#: Exact vectors read of each query before its limit is known, in multiples of k.
FIRST = 4
#: Whole components must be smaller than this.
LARGEST = 2.0**61


def integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, as long; null if there is nothing to search.

    Null vectors, empty ones, and those with a null, infinite or NaN component are null. A finite
    component beyond `LARGEST` is an error.
    """
    as_double = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(as_double, lambda x: x.isNotNull() & ~F.isnan(x)
                    & (F.abs(x) < float("inf")))
    return F.when(fine & (F.size(vector) > 0),
                  F.transform(as_double, lambda x: F.when(
                      F.abs(x * scale) < LARGEST, F.floor(x * scale)).otherwise(
                      F.raise_error(F.lit("a component is too large to search")).cast("long"))))


class _Block:
    """Vectors of one length, by id: exact numbers, and the cells with their edges."""

    def __init__(self, ids: np.ndarray, exact: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.exact = ids[order], exact[order]
        low, high = self.exact.min(0), self.exact.max(0)
        self.step = np.maximum(1, -(-(high - low + 1) // CELLS))
        self.low = low
        self.cells = ((self.exact - low) // self.step).astype(np.uint8)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return bounds(self.low, self.step, self.cells, queries)


def bounds(low: np.ndarray, step: np.ndarray, cells: np.ndarray,
           queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each query's score with each vector, from the cells alone.

    All numbers are whole. While no sum reaches 2**53 they are exact; beyond, the bounds are
    wider by what rounding can add.
    """
    floor = low + cells * step.astype(np.float64)
    width = (step - 1).astype(np.float64)
    q = queries.astype(np.float64)
    base = q @ floor.T
    up, down = np.maximum(q, 0) @ width, np.minimum(q, 0) @ width
    reach = np.abs(q) @ (np.abs(floor).max(0) + width)
    slack = np.where(reach < 2.0**53, 0.0, reach * (len(low) + 8) * 2.0**-51)
    return base + (down - slack)[:, None], base + (up + slack)[:, None]


def inner_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices. Where 64 bits might not hold
    a sum, Python's integers do; a result beyond 64 bits is an error."""
    reach = (np.abs(left.astype(np.float64)) * np.abs(right.astype(np.float64))).sum(1)
    out = (left * right).sum(1)
    for i in np.flatnonzero(reach >= 2.0**62):
        whole = sum(a * b for a, b in zip(left[i].tolist(), right[i].tolist(), strict=True))
        if not -2**63 <= whole < 2**63:
            raise OverflowError("an inner product does not fit into 64 bits")
        out[i] = whole
    return out


def _file(rows: DataFrame, block: int, name: str) -> DataFrame:
    """The approximation file of the distinct rows of vec_id and v, a written table.

    A row is a block: its number, the length d of its vectors, how many there are; ids and
    copies (how often each row is there) as 64-bit numbers; low and step, d numbers; cells, a byte
    each; exact, the vectors one by one.
    """
    ready(rows.sparkSession)

    def pack(batches):
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            dims, lists = batch.column("dims").to_numpy(), batch.column("v")
            ids, copies = batch.column("vec_id").to_numpy(), batch.column("copies").to_numpy()
            starts, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            out = []
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                own = own[np.argsort(ids[own], kind="stable")]
                for part in np.array_split(own, -(-len(own) // block)):
                    held = _Block(ids[part], flat[starts[part][:, None] + np.arange(d)])
                    out.append((number, d, len(part), held.ids.tobytes(), copies[part].tobytes(),
                                held.low.tobytes(), held.step.tobytes(), held.cells.tobytes(),
                                [x.tobytes() for x in held.exact]))
                    number += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 5, pa.list_(pa.binary())]
            names = ["block", "dims", "n", "ids", "copies", "low", "step", "cells", "exact"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    once = rows.groupBy("vec_id", "v").agg(F.count("*").alias("copies"))
    with rows_per_batch(rows.sparkSession, block):
        return keep(once.select("vec_id", "v", "copies", F.size("v").alias("dims")).mapInArrow(
            pack, "block long, dims int, n long, ids binary, copies binary, low binary, step binary, "
                  "cells binary, exact array<binary>"), name)


def _scan(batches, k: int):
    """Pairs of a query and a vector of a block that can be among the query's k best there."""
    names = ["query_id", "q_block", "q_slot", "block", "slot", "vec_id", "copies", "low", "high"]
    for batch in batches:
        for row in batch.to_pylist():
            d = row["dims"]
            ids = np.frombuffer(row["ids"], np.int64)
            copies = np.frombuffer(row["copies"], np.int64)
            own = np.frombuffer(row["q_ids"], np.int64)
            asked = np.frombuffer(b"".join(row["q"]), np.int64).reshape(-1, d)
            low, high = bounds(np.frombuffer(row["low"], np.int64), np.frombuffer(row["step"], np.int64),
                               np.frombuffer(row["cells"], np.uint8).reshape(-1, d), asked)
            mine = ids[None, :] == own[:, None]
            low[mine] = -np.inf
            sure = np.full(len(own), -np.inf)
            if len(ids) > k:
                sure = np.partition(low, -k, axis=1)[:, -k]
            q, v = np.nonzero((high >= sure[:, None]) & ~mine)
            whole = lambda x: pa.array(np.full(len(q), x, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[q]), whole(row["q_block"]), pa.array(q.astype(np.int32)),
                 whole(row["block"]), pa.array(v.astype(np.int32)), pa.array(ids[v]),
                 pa.array(copies[v]), pa.array(low[q, v]), pa.array(high[q, v])], names)


def _score(batches):
    """The exact scores of pairs from their vectors, as bytes."""
    for batch in batches:
        q, v = batch.column("q"), batch.column("v")
        sizes = pc.binary_length(q).to_numpy()
        score = np.zeros(batch.num_rows, dtype=np.int64)
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            left, right = (np.frombuffer(b"".join(c.take(pa.array(at)).to_pylist()), np.int64)
                           .reshape(len(at), -1) for c in (q, v))
            score[at] = inner_products(left, right)
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("query_id", "vec_id", "copies")] + [pa.array(score)],
            ["query_id", "vec_id", "copies", "score"])


def _best(rows: DataFrame, most: int, *order) -> DataFrame:
    """The first `most` rows of every query."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    return rows.withColumn("rank", rank.cast("int")).where(F.col("rank") <= most)


def _limit(rows: DataFrame, value: str, k: int) -> DataFrame:
    """query_id and the k-th highest value; minus infinity for queries with fewer rows."""
    low = F.when(F.count("*") == k, F.min(value)).otherwise(F.lit(float("-inf")))
    return _best(rows, k, F.desc(value)).groupBy("query_id").agg(low.alias("limit"))


def candidates(files: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """Pairs whose upper bound reaches the k-th lower bound of their query; a written table."""
    groups = max(1, -(-(files.agg(F.sum("n")).first()[0] or 0) // GROUP))
    dealt = F.pmod(F.xxhash64("block"), F.lit(groups))
    met = files.select(dealt.alias("g"), "dims", "block", "ids", "copies", "low", "step", "cells").join(
        sets.select("dims", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"),
                    F.col("exact").alias("q"),
                    F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
                    .alias("g")), ["g", "dims"])
    with rows_per_batch(files.sparkSession, 4):  # blocks, not vectors
        found = keep(met.mapInArrow(
            lambda batches: _scan(batches, k),
            "query_id long, q_block long, q_slot int, block long, slot int, vec_id long, copies long, "
            "low double, high double"), "bounds")
    return keep(found.join(_limit(found, "low", k), "query_id").where("high >= limit").drop("limit"),
                "candidates")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id",
          embedding: str = "embedding") -> DataFrame:
    """Each query's `k` vectors of the highest integer inner product, ties to the smaller id.

    Both frames have `vec_id` and `embedding`; a query's own id is no candidate for it.
    Several vectors of one query id are ranked together.
    Returns query_id, rank from 1, vec_id and score; fewer rows if there are fewer vectors.
    Null ids, and vectors that `integers` makes null, take no part; vectors of another length
    than the query are no candidates. Equal vectors rank by id; rows that repeat an id are rows
    of their own, and repeated queries have the same result once. Empty tables give no rows.
    Components must be whole numbers below 2**61 and scores must fit into 64 bits; else it fails.

    `GROUP` vectors share a copy of the queries, so the copies grow with vectors times
    queries, as the bounds do. Equal rows are one row of the file and are told apart by count,
    so no block and no group depends on how common a vector or an id is.
    """
    whole = lambda df: df.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        integers(F.col(embedding)).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    files, sets = _file(whole(vectors), BLOCK, "vectors"), _file(whole(queries), QUERY_BLOCK, "queries")
    near = candidates(files, sets, k)
    exact = files.select("block", F.posexplode("exact").alias("slot", "v"))
    asked = sets.select(F.col("block").alias("q_block"), F.posexplode("exact").alias("q_slot", "q"))

    def scored(pairs: DataFrame) -> DataFrame:
        ready(pairs.sparkSession)
        return pairs.join(exact, ["block", "slot"]).join(asked, ["q_block", "q_slot"]).select(
            "query_id", "vec_id", "copies", "q", "v").mapInArrow(
            _score, "query_id long, vec_id long, copies long, score long")

    first = _best(near, FIRST * k, F.desc("high"), "vec_id").drop("rank")
    limit = _limit(scored(first), "score", k)
    last = scored(near.join(limit, "query_id").where("high >= limit"))
    best = _best(last, k, F.desc("score"), "vec_id").withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))))
    return _best(best.drop("rank"), k, F.desc("score"), "vec_id", "copy").select(
        "query_id", "rank", "vec_id", "score")
