import itertools
import random

from pyspark.sql import functions as F

from stallbook.llm import packing as p

COSTS = {8: 10.0, 16: 18.0, 32: 40.0}


def plain(sizes, costs, opens):
    """Best fit by looking at every bin for every piece; `opens` names a new bin's length by piece and words left."""
    bins, left = [], sum(sizes)
    for s in sizes:
        fits = [b for b in bins if b["cap"] - b["used"] >= s]
        if fits:
            best = min(fits, key=lambda b: (b["cap"] - b["used"], b["no"]))
        else:
            best = {"no": len(bins), "cap": opens(s, left), "used": 0, "in": []}
            bins.append(best)
        best["in"].append((best["used"], s))
        best["used"] += s
        left -= s
    for b in bins:
        b["cap"] = min((c for c in costs if c >= b["used"]), key=lambda c: (costs[c], c))
    return sum(costs[b["cap"]] for b in bins), sorted((b["cap"], sorted(b["in"])) for b in bins)


def opener(costs, mix):
    return lambda s, left: mix[min(i for i, c in enumerate(sorted(costs)) if c >= s)]


def mixes(costs):
    lengths = sorted(costs)
    return list(itertools.product(*[lengths[i:] for i in range(len(lengths))]))


def per_word(costs):
    """Opens the length of the least cost per word of what is left."""
    return lambda s, left: min((c for c in costs if c >= s), key=lambda c: (costs[c] / min(c, left), c))


def test_one_shard_is_a_plain_best_fit_of_the_cheapest_mix(spark):
    draw = random.Random(3)
    for n in (1, 2, 40, 400):
        sizes = sorted((draw.randint(1, 32) for _ in range(n)), reverse=True)
        docs = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "doc_id long, n long")
        got = {}
        for r in p.pack(docs, F.col("n"), COSTS, shard=10_000).collect():
            got.setdefault((r.bin_id, r.capacity), []).append((r.position, r.n_words))
        every = [plain(sizes, COSTS, opener(COSTS, m)) for m in mixes(COSTS)]
        every.append(plain(sizes, COSTS, per_word(COSTS)))
        mine = sorted((c, sorted(x)) for (_, c), x in got.items())
        assert mine in [bins for _, bins in every]
        assert sum(COSTS[c] for c, _ in mine) == min(cost for cost, _ in every)


def test_lengths_are_chosen_together():
    """Cheaper than one preferred length, and than the least cost per word for each piece."""
    draw, gains = random.Random(9), []
    costs = {8: 11.0, 16: 19.0, 32: 37.0, 64: 80.0}
    for trial in range(30):
        kinds = draw.choice([[5], [20, 11], [9, 7, 3], [33, 30, 1], [12, 5, 40]])
        sizes = sorted((max(1, draw.choice(kinds) + draw.randint(-2, 2)) for _ in range(150)), reverse=True)
        packer = p.Packer(sizes, costs)
        best = packer.best()
        every = {m: plain(sizes, costs, opener(costs, m)) for m in mixes(costs)}
        assert all(packer.pack(m).cost == cost for m, (cost, _) in every.items())
        assert best.cost <= min(every[tuple(max(c, q) for c in sorted(costs))][0] for q in costs)
        assert best.cost <= 1.01 * min(cost for cost, _ in every.values())
        greedy = plain(sizes, costs, per_word(costs))[0]
        assert packer.pack().cost == greedy >= best.cost
        gains.append(greedy - best.cost)
    assert sum(g > 0 for g in gains) >= 5


def test_every_word_is_in_one_sequence(spark):
    rows = [(i, (i * 7) % 45) for i in range(500)] + [
        (3, 5), (3, 5), (3, 70), (None, 9), (None, None), (600, 100_000), (601, 0), (602, None)]
    docs = spark.createDataFrame(rows, "doc_id long, n long").withColumn("bin_id", F.lit("mine"))
    got = p.pack(docs, F.col("n"), COSTS, shard=50).collect()
    assert sum(r.n_words for r in got) == sum(n or 0 for _, n in rows)
    bins = {}
    for r in got:
        if not r.n_words:
            assert r.bin_id is None and r.capacity is None and r.position is None
            continue
        assert r.n_words <= 32 and r.used <= r.capacity and r.capacity in COSTS
        assert not [c for c in COSTS if r.used <= c < r.capacity]
        bins.setdefault((r.bin_id, r.used), []).append((r.position, r.position + r.n_words))
    for (_, used), spans in bins.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == used
        assert all(a[1] == b[0] for a, b in zip(spans[:-1], spans[1:], strict=True))
    assert len({b for b, _ in bins}) == len(bins)
    long = sorted((r.start, r.n_words) for r in got if r.doc_id == 600)
    assert [s for s, _ in long] == list(range(0, 100_000, 32)) and sum(n for _, n in long) == 100_000
    again = p.pack(docs, F.col("n"), COSTS, shard=50).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert p.pack(docs.limit(0), F.col("n")).collect() == []


def test_shards_fill_their_sequences(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"),
                                      (F.pmod(F.xxhash64("id"), F.lit(900)) + 1).alias("n"))
    bins = p.pack(docs, F.col("n")).select("bin_id", "capacity", "used").distinct()
    r = bins.agg(F.sum("used").alias("u"), F.sum("capacity").alias("c")).first()
    assert r.u / r.c > 0.98


def test_rows_without_id_are_dealt_over_all_shards(spark):
    docs = spark.createDataFrame([(None, f"text {i}") for i in range(400)], "doc_id long, text string")
    got = p.pack(docs, F.lit(100), shard=100).collect()
    assert len(got) == 400 and len({r.bin_id >> 32 for r in got}) == 4
