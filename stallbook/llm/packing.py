"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted, each at a cost. Pieces come in order of size,
the largest first. A piece goes into the open bin that it fills best; if none has room, a new
bin is opened. At the end every bin is downsized to the least-cost length that holds its contents.

Which length a new bin has is decided for all lengths together. A mix says for each class of
pieces, those that need the first length, the second and so on, which length they open. What a
mix costs is found by packing the shard with it and adding up the downsized bins. The search
starts from each length as the preferred one (classes that do not fit it open the shortest they
fit), then changes one class at a time as long as the shard gets cheaper. One more packing opens
the length of the least cost per word of what is left, which can be better at a shard's end. The
cheapest of all packs the shard: no single preferred length is cheaper, nor a change of one class.

Pieces are dealt into shards by a hash; every shard is packed by itself, with a sorted list of open
bins that is bounded by the shard. A shard leaves a few bins part empty, out of thousands.
"""

from bisect import bisect_left, insort
from collections.abc import Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallbook.config import keep
from stallbook.llm.arrow import ready

#: Permitted sequence lengths in words, and their costs: a part for every sequence, one that
#: grows with its length, and one for attention that grows with the square.
LENGTHS = {c: 128 + c + c * c / 8192 for c in (512, 1024, 2048, 4096)}
#: Pieces of a shard, on average.
SHARD = 4000


class Packed(NamedTuple):
    """A packed shard: bin and start of each piece, words of each bin, and the cost of all."""

    bins: list[int]
    starts: list[int]
    used: list[int]
    cost: float


class Packer:
    """Packs a shard's pieces, given by size in descending order, none of them 0."""

    def __init__(self, sizes: Sequence[int], costs: Mapping[int, float]):
        self.sizes, self.costs, self.lengths = sizes, costs, sorted(costs)
        self.kind = [bisect_left(self.lengths, s) for s in sizes]
        # The least-cost length that holds as many words as each length does.
        self.least = [min(self.lengths[i:], key=lambda c: (costs[c], c))
                      for i in range(len(self.lengths))]
        self.price = [costs[c] for c in self.least]

    def capacity(self, used: int) -> int:
        """The least-cost permitted length that holds `used` words."""
        return self.least[bisect_left(self.lengths, used)]

    def _cheapest(self, size: int, left: int) -> int:
        """The length of the least cost per word that can still come into it."""
        return min((c for c in self.lengths if c >= size),
                   key=lambda c: (self.costs[c] / min(c, left), c))

    def pack(self, mix: Sequence[int] | None = None) -> Packed:
        """Best fit; a piece of class k without a bin opens one of `mix[k]` words.

        Without a mix every new bin has the length of the least cost per word of what is left.
        """
        room: list[tuple[int, int]] = []  # of open bins, ascending, and their numbers
        bins, starts, used = [], [], []
        left = sum(self.sizes)
        for size, kind in zip(self.sizes, self.kind, strict=True):
            at = bisect_left(room, (size, -1))
            if at < len(room):
                free, number = room.pop(at)
            else:
                free = mix[kind] if mix else self._cheapest(size, left)
                number = len(used)
                used.append(0)
            bins.append(number)
            starts.append(used[number])
            used[number] += size
            left -= size
            if free > size:
                insort(room, (free - size, number))
        return Packed(bins, starts, used, sum(
            self.price[bisect_left(self.lengths, u)] for u in used))

    def best(self) -> Packed:
        """The cheapest packing: by the mix that the search finds, or by cost per word left."""
        tried: dict[tuple[int, ...], float] = {}

        def cost(mix: tuple[int, ...]) -> float:
            if mix not in tried:
                tried[mix] = self.pack(mix).cost
            return tried[mix]

        present = sorted(set(self.kind))  # a class without pieces opens nothing
        mix = min((tuple(max(c, p) for c in self.lengths) for p in self.lengths),
                  key=lambda m: (cost(m), m))
        while True:
            near = [(*mix[:k], c, *mix[k + 1:]) for k in present for c in self.lengths[k:]]
            step = min(near, key=lambda m: (cost(m), m), default=mix)
            if cost(step) >= cost(mix):
                return min(self.pack(mix), self.pack(), key=lambda p: p.cost)
            mix = step


def pieces(docs: DataFrame, size: Column, most: int) -> DataFrame:
    """doc_id, piece, start, n_words and row: every document in parts of at most `most` words.

    A document without words has one piece of 0 words. `row` is a hash of the row's columns, but for
    maps, that tells rows of one doc_id apart.
    """
    known = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    sized = docs.select("doc_id", size.cast("long").alias("size"), F.xxhash64(*known).alias("row"))
    numbers = F.sequence(F.lit(0).cast("long"), F.greatest(
        F.lit(0), F.expr(f"(size - 1) div {most}")).cast("long"))
    return sized.withColumn("piece", F.explode(numbers)).select(
        "doc_id", "piece", (F.col("piece") * most).alias("start"),
        F.least(F.lit(most), F.col("size") - F.col("piece") * most).alias("n_words"), "row")


def pack(docs: DataFrame, size: Column, costs: Mapping[int, float] = LENGTHS,
         shard: int = SHARD) -> DataFrame:
    """Every word of every document in a sequence.

    `size` is the number of words of a row (null: 0). Returns a row per piece: bin_id, capacity
    (the downsized length), used, position (where the piece starts in the sequence), doc_id,
    piece, start and n_words (the piece's span in its document). A document of more words than
    the longest length is cut into pieces of that length and a rest. One without words has
    n_words 0 and no bin: null bin_id, capacity, used and position.

    Rows with the same doc_id are packed each by itself; equal ones are interchangeable. A null
    doc_id is dealt by the rest of its row. An empty table gives an empty one.
    """
    ready(docs.sparkSession)
    parts = keep(pieces(docs, F.coalesce(size, F.lit(0)), max(costs)), "pieces")
    shards = max(1, -(-parts.where("n_words > 0").count() // shard))
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "n_words", "row"),
                                             F.lit(shards))).drop("row")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(a, b - a)
                if held and held[0].column("shard")[0] != part.column("shard")[0]:
                    yield packed(held)
                    held = []
                held.append(part)
        if held and held[0].num_rows:
            yield packed(held)

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        sizes = table.column("n_words").to_pylist()
        some = len(sizes) - sizes.count(0)  # pieces without words come last
        packer = Packer(sizes[:some], costs)
        best = packer.best()
        first = table.column("shard")[0].as_py() << 32
        none = [None] * (len(sizes) - some)
        pick = lambda values: pa.array(
            [values[n] for n in best.bins] + none, pa.int64())
        columns = [pick(range(first, first + len(best.used))),
                   pick([packer.capacity(u) for u in best.used]), pick(best.used),
                   pa.array(best.starts + none, pa.int64())]
        names = ["doc_id", "piece", "start", "n_words"]
        return pa.RecordBatch.from_arrays(
            [*columns, *(table.column(c).combine_chunks() for c in names)],
            ["bin_id", "capacity", "used", "position", *names])

    return (dealt.repartition(shards, "shard")
            .sortWithinPartitions("shard", F.desc("n_words"), "doc_id", "piece")
            .mapInArrow(run, "bin_id long, capacity long, used long, position long, "
                             f"doc_id {kind}, piece long, start long, n_words long"))
