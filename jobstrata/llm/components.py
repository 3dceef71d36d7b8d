"""Connected components of an edge table by alternating star contractions."""

from pyspark.sql import functions as F

from jobstrata.llm.shared import saved

#: Edges that a task reads at least, where there are so many.
EDGES = 200_000


def _large_star(edges):
    """Links every larger neighbour of a node to the smallest node near it; edges may come repeatedly."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges):
    """Links the smaller neighbours of a node, and the node, to the smallest of them."""
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    return (edges.join(low, "a").where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
            .union(low.select("a", F.col("low").alias("b"))).distinct())


def components(edges):
    """node, component: every node of the edges (a, b) with the smallest node that it reaches.

    Minima are aggregated before they are joined back, so a node with many neighbours is not gathered. The rounds
    end when the edges are stars; their number grows with the logarithm of the diameter. Edges with a null
    or from a node to itself say nothing.
    """
    edges = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), EDGES)
    state = None
    while True:
        check = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).head()
        if state == check:
            break
        state = check
        edges = saved(_small_star(_large_star(edges)), EDGES)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
