"""Connected components of a graph given by its edges."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallbook.config import keep


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free hash of the edges: equal exactly if nothing changed."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 31)),
                           F.bit_xor(F.xxhash64("v", "u"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component, the smallest node it can reach, for every node of an edge.

    Alternates large-star and small-star steps (each node links its larger neighbours, then its
    smaller ones and itself, to its smallest) until the edges are stars; a few rounds for any
    shape. Edges with a null and loops count for nothing; repeated ones count once. A round is
    a written table. For the large star, which may have very many edges at one node, the smallest
    neighbour is found by a minimum that is combined before its shuffle and joined back as a
    written table, so Spark can split that node. In the small star a node has only as many
    rows as it has smaller neighbours.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    now = keep(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
               .select(u.alias("u"), v.alias("v")).distinct(), "edges")
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = keep(both.groupBy("u").agg(F.min("v").alias("v")).select(
            "u", F.least("u", "v").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        lowest = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        now = keep(lowest.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
                   .where("u <> v").distinct(), "edges")
        before, mark = mark, _mark(now)
        if before == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
