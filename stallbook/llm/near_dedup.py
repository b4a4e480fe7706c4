"""Near-duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets.

Two documents are linked if at least 75 % of the union of their five-word shingles is in
both. Steps:

1. Texts with the same words are one class; only one text per class goes on.
2. Every class has a MinHash signature. `TREES` sorted orders are made of it: in each tree
   the signature is read from another place on, and classes are sorted by what is read.
   Classes that share the first `DEPTH` values with another one in some tree go on; most
   end here.
3. In each order a class is compared with its next neighbours, those with the longest common
   prefix. How deep that prefix is depends on the region: where few classes share `DEPTH`
   values the neighbours are all of them, in a crowded region they share many more. A pair
   is a candidate if its signatures agree in `NEAR` of the values or more.
4. Candidates tie classes into clusters, and what two crowded neighbours hide from each other
   is found within these, on full sets. A cluster is cut into chunks of bounded size. All
   pairs of a chunk are compared; then the text with the most links in a chunk, its hub, is
   compared with a few other chunks, which ties what is dense into one component. What is
   left outside a cluster's largest component is compared with the whole cluster, block by
   block. Two texts of the largest component need no comparison: they are connected.

Links are exact. A link is missed only if its pair never comes into one cluster; two classes
that share 75 % of their shingles, alone in their regions, miss each other in all trees
with a probability of 5 in a million. Neighbours on the border of two sorted partitions are not
compared in that tree, only in the others.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallbook.config import keep
from stallbook.llm.arrow import ready
from stallbook.llm.graph import components
from stallbook.llm.words import mix, seeds, sequences, shingle_sets, slices

SHINGLE = 5
PERCENT = 75
TREES, DEPTH, DEEPEST = 32, 4, 12
VALUES = TREES * DEPTH
#: Next neighbours that a class is compared with in each tree, and the agreement they need.
NEIGHBOURS, NEAR = 2, 0.55
#: A chunk of a cluster has about so many texts or shingles.
CHUNK_TEXTS, CHUNK_SHINGLES = 400, 400_000

_MULTIPLY = (seeds(VALUES, 2) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_FLIP = (seeds(VALUES, 3) >> np.uint64(32)).astype(np.uint32)
_OTHER = np.uint64(0xD6E8FEB86659FD93)


def signatures(found: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """`VALUES` minimum hashes of each nonempty set found[bounds[i]:bounds[i + 1]]."""
    out = np.full((len(bounds) - 1, VALUES), np.iinfo(np.uint32).max, dtype=np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        short = (found >> np.uint64(32)).astype(np.uint32)
        for i in range(VALUES):
            out[full, i] = np.minimum.reduceat((short ^ _FLIP[i]) * _MULTIPLY[i], bounds[full])
    return out


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, class key (two hashes of the words), n_words, n_shingles and signature
    bytes."""
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for part in slices(batch.column(2), lower=True):
                words, spans, counts = part.words(), part.spans(), part.counts()
                found, bounds = shingle_sets(part, SHINGLE)
                signed = signatures(found, bounds)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(part.first, part.size), texts.slice(part.first, part.size),
                     pa.array(sequences(words, spans[:-1], spans[1:]).view(np.int64)),
                     pa.array(sequences(mix(words ^ _OTHER), spans[:-1], spans[1:]).view(np.int64)),
                     pa.array(counts), pa.array(np.diff(bounds)),
                     pa.array([row.tobytes() for row in signed], pa.binary())],
                    ["doc_id", "text_hash", "key", "key2", "n_words", "n_shingles", "signature"])

    ready(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        run, f"doc_id {kind}, text_hash long, key long, key2 long, n_words long, "
             "n_shingles long, signature binary")


def _signed(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("signature").to_pylist()),
                         dtype=np.uint32).reshape(-1, VALUES)


def _orders(signed: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each tree's number and the first `depth` values of its order."""
    for tree in range(TREES):
        yield tree, signed[:, (tree * DEPTH + np.arange(depth)) % VALUES]


def _regions(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        signed, node = _signed(batch), batch.column("node")
        for tree, values in _orders(signed, DEPTH):
            region = np.full(len(values), tree, dtype=np.uint64)
            for j in range(DEPTH):
                region = mix(region * np.uint64(0x9E3779B97F4A7C15) + values[:, j])
            yield pa.RecordBatch.from_arrays([pa.array(region.view(np.int64)), node],
                                             ["region", "node"])


def _places(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        signed, node = _signed(batch), batch.column("node")
        sketch = pa.array([row.tobytes() for row in signed.astype(np.uint8)], pa.binary())
        for tree, values in _orders(signed, DEEPEST):
            place = [bytes([tree]) + row.tobytes() for row in values.astype(">u4")]
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.binary()), node, sketch],
                                             ["place", "node", "sketch"])


def _neighbours(batches) -> Iterator[pa.RecordBatch]:
    """Pairs of next neighbours in sorted rows; the last rows of a batch are carried on."""
    prefix = 1 + 4 * DEPTH
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        n, carried = batch.num_rows, 0 if held is None else held.num_rows
        place = np.frombuffer(b"".join(p[:prefix] for p in batch.column("place").to_pylist()),
                              dtype=np.uint8).reshape(n, prefix)
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()),
                               dtype=np.uint8).reshape(n, VALUES)
        node = batch.column("node")
        for step in range(1, NEIGHBOURS + 1):
            later = np.arange(max(step, carried), n)
            later = later[(place[later] == place[later - step]).all(1)]
            agree = (sketch[later] == sketch[later - step]).mean(1)
            later = later[agree >= NEAR]
            yield pa.RecordBatch.from_arrays(
                [node.take(pa.array(later - step)), node.take(pa.array(later))], ["a", "b"])
        held = batch.slice(max(0, n - NEIGHBOURS))


def candidates(classes: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of `classes`, a written table of node and signature.

    Region keys are counted by a sum combined before its shuffle; the sort is one range
    partitioning by whole places, which splits crowded regions as it does any others.
    """
    kind = classes.schema["node"].dataType.simpleString()
    regions = classes.select("node", "signature").mapInArrow(_regions, f"region long, node {kind}")
    shared = keep(regions.groupBy("region").agg(F.count("*").alias("n")).where("n > 1")
                  .select("region"), "regions")
    near = keep(regions.join(shared, "region").select("node").distinct(), "near")
    places = classes.join(near, "node").select("node", "signature").mapInArrow(
        _places, f"place binary, node {kind}, sketch binary")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (places.repartitionByRange(parts, "place", "node")
            .sortWithinPartitions("place", "node")
            .mapInArrow(_neighbours, f"a {kind}, b {kind}")
            .where("a <> b").distinct())


def _linked(ids: list, found: list[np.ndarray]) -> tuple[list[tuple], object]:
    """A spanning forest of the links among some shingle sets, and the id with the most links.

    Shared shingles are counted for all pairs at once, by products of 0/1 matrices over a
    bounded number of columns at a time.
    """
    n, sizes = len(ids), np.array([len(s) for s in found])
    row = np.repeat(np.arange(n), sizes)
    _, column, times = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    row, column = row[shared], column[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    new = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]])) if len(column) else column
    common = np.zeros((n, n), dtype=np.float32)
    for low in range(0, int(new[-1]) + 1 if len(new) else 0, 2048):
        a, b = np.searchsorted(new, [low, low + 2048])
        part = np.zeros((n, min(2048, int(new[b - 1]) - low + 1)), dtype=np.float32)
        part[row[a:b], new[a:b] - low] = 1
        common += part @ part.T
    both = sizes[:, None] + sizes[None, :] - common
    link = 100 * common >= PERCENT * both
    hub = ids[int(link.sum(1).argmax())]
    link = np.triu(link, 1)
    root = list(range(n))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in zip(*np.nonzero(link), strict=True):
        x, y = top(i), top(j)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((ids[i], ids[j]))
    return out, hub


def _tiles(batches) -> Iterator[pa.RecordBatch]:
    """Links within each tile of rows sorted by tile, and the tile's hub, the text with the most
    links, beside a null. Holds one tile's sets at a time."""
    tile, ids, sets, kind = None, [], [], None

    def done():
        pairs, hub = _linked(ids, sets)
        return pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in pairs] + [hub], kind),
             pa.array([p[1] for p in pairs] + [None], kind)], ["a", "b"])

    for batch in batches:
        kind = batch.column("node").type
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("cluster", "i", "j")), strict=True))
        nodes = batch.column("node").to_pylist()
        for part in slices(batch.column("text"), lower=True):
            found, bounds = shingle_sets(part, SHINGLE)
            for t in range(part.size):
                row = part.first + t
                if keys[row] != tile:
                    if len(ids) > 1:
                        yield done()
                    tile, ids, sets = keys[row], [], []
                ids.append(nodes[row])
                sets.append(found[bounds[t]:bounds[t + 1]].copy())
    if len(ids) > 1:
        yield done()


def _compared(rows: DataFrame, i: str, j: str, name: str) -> DataFrame:
    """Links and hubs of the tiles (cluster, i, j), as a written table of a and b."""
    kind = rows.schema["node"].dataType.simpleString()
    tiles = rows.select("cluster", F.col(i).cast("long").alias("i"), F.col(j).cast("long").alias("j"),
                        "node", "text")
    return keep(tiles.repartition("cluster", "i", "j")
                .sortWithinPartitions("cluster", "i", "j", "node")
                .mapInArrow(_tiles, f"a {kind}, b {kind}"), name)


def _every(count: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))


def links(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links (a, b) that connect what is truly linked in the clusters that the pairs make."""
    clusters = keep(components(pairs).withColumnRenamed("component", "cluster").join(
        classes.select("node", "id", "n_shingles"), "node"), "clusters")
    chunks = F.ceil(F.greatest(F.count("*") / CHUNK_TEXTS, F.sum("n_shingles") / CHUNK_SHINGLES))
    sizes = keep(clusters.groupBy("cluster").agg(chunks.cast("long").alias("chunks")), "sizes")
    dealt = clusters.join(sizes, "cluster").withColumn(
        "own", F.pmod(F.xxhash64("node"), F.col("chunks"))).drop("n_shingles")
    fetched = docs.select("doc_id", F.xxhash64("text").alias("node"), "text").join(
        dealt, "node").where(F.col("doc_id").eqNullSafe(F.col("id"))).drop("id")
    texts = keep(fetched.where("doc_id IS NOT NULL").unionByName(
        fetched.where("doc_id IS NULL").dropDuplicates(["node"])).drop("doc_id"), "texts")
    found = _compared(texts, "own", "own", "links_in_chunks")
    large = texts.where("chunks > 1")
    if not large.isEmpty():
        found = found.unionByName(_across_chunks(large, found))
    return found.where("b IS NOT NULL AND a <> b")


def _across_chunks(large: DataFrame, found: DataFrame) -> DataFrame:
    """Links across the chunks of clusters that have several. `found`: links and hubs in chunks."""
    hubs = large.join(found.where("b IS NULL").select(F.col("a").alias("node")).distinct(), "node")
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.col("chunks").cast("double"))).cast("int"))
    sent = hubs.withColumn("step", F.explode(steps)).withColumn(
        "own", F.pmod(F.col("own") + F.pow(F.lit(2), "step").cast("long"), F.col("chunks")))
    met = _compared(large.unionByName(sent.drop("step")), "own", "own", "links_of_hubs")
    tied = components(found.unionByName(met).where("b IS NOT NULL"))
    placed = keep(large.drop("text").join(tied, "node", "left").withColumn(
        "component", F.coalesce("component", "node")), "tied")
    largest = placed.groupBy("cluster", "component").agg(F.count("*").alias("n")).groupBy(
        "cluster").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
    rest = keep(placed.join(largest, "cluster").where("component <> largest"), "rest")
    blocks = keep(rest.groupBy("cluster").agg(
        F.ceil(F.count("*") / CHUNK_TEXTS).cast("long").alias("blocks")), "blocks")
    left = rest.select("node", "chunks").join(large.drop("chunks"), "node").join(
        blocks, "cluster").select("cluster", "node", "text", F.pmod(
            F.xxhash64(F.lit(1), "node"), F.col("blocks")).alias("i"), _every("chunks").alias("j"))
    whole = large.join(blocks, "cluster").select(
        "cluster", "node", "text", _every("blocks").alias("i"), F.col("own").alias("j"))
    return met.unionByName(_compared(left.unionByName(whole), "i", "j", "links_of_rest"))


def _judged(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept, and for kept rows of a component
    without any id, `lone`, for every row of `docs`.

    A class is the node with the hash of one of its texts, that of the smallest id, or of none
    where no row of the class has an id. So texts of one doc_id are nodes of their own, and
    classes without id are compared as all others. Of a component the class with the smallest id
    is kept, of several the one with the smallest hash.
    """
    rows = keep(measure(docs), "measured")
    full = rows.where("n_words > 0")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"),
                          F.col("text_hash").alias("node")))
    classes = keep(full.groupBy("key", "key2").agg(best.alias("best")).select(
        "key", "key2", "best.id", "best.node"), "classes")
    signed = keep(full.where(f"n_words >= {SHINGLE}").join(classes, ["key", "key2"]).where(
        F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("node")))
        .select("node", "id", "n_shingles", "signature").dropDuplicates(["node"]), "signed")
    found = components(keep(links(docs, signed, candidates(signed)), "links"))
    tied = keep(classes.join(found, "node", "left").withColumn(
        "component", F.coalesce("component", "node")), "tied")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node"))
    firsts = keep(tied.groupBy("component").agg(first.alias("first")), "firsts")
    reached = keep(tied.join(firsts, "component").select(
        F.col("key").alias("k"), F.col("key2").alias("k2"), F.col("first.id").alias("reached"),
        F.col("first.node").alias("kept_node"),
        (F.col("first.node") == F.col("node")).alias("leads")), "reached")
    same = (F.col("key") == F.col("k")) & (F.col("key2") == F.col("k2")) & (F.col("n_words") > 0)
    worded = F.col("n_words") > 0
    kept = F.when(worded, F.col("leads") & F.col("doc_id").eqNullSafe(F.col("reached"))).otherwise(True)
    return (rows.drop("signature").join(reached, same, "left").select(
        "doc_id", "text_hash", "n_shingles",
        F.when(worded, F.col("reached")).otherwise(F.col("doc_id")).alias("component_id"),
        kept.alias("kept"), F.when(worded & F.col("reached").isNull() & F.col("leads"),
                                   F.col("kept_node")).alias("lone")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of `docs` (doc_id, text).

    A-Z count as a-z. component_id is the smallest doc_id that links reach, kept says whether
    the row's words are those that stay of it. A text of one to four words has its whole sequence
    as one shingle. Null texts and those without words have no shingle and link with nothing, not
    even with each other. Rows with the same doc_id and the same words are one document and are
    kept or dropped together; other texts of that doc_id are documents of their own. A row
    without doc_id reaches what its words reach; a component without any id is null, and its rows
    with the words that stay are all `kept`, of which `dedup` takes one. An empty table gives an
    empty one.
    """
    return _judged(docs).select("doc_id", "n_shingles", "component_id", "kept")


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose document is kept: one of every component.

    Where no row of a component has an id, one row of the text that stays, the same at every run.
    """
    kept = keep(_judged(docs).where("kept").select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "lone").distinct(), "kept")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    stay = docs.join(kept.where("lone IS NULL"), same, "left_semi")
    lone = kept.where("lone = __hash")
    row = F.struct(*docs.columns)
    one = (docs.where("doc_id IS NULL").join(lone.select("__hash"), F.xxhash64("text") == F.col("__hash"))
           .groupBy("__hash").agg(F.min_by(row, F.md5(F.to_json(row))).alias("row")).select("row.*"))
    return stay.unionByName(one)
