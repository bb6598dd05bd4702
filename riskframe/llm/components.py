"""Connected components of a large graph by alternating star contractions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.tables import written


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    Each round links every larger neighbour of a node to the node's smallest
    neighbour (large star), then every smaller neighbour likewise (small star).
    The rounds, logarithmic in practice, end when no edge changes.  A node is
    aggregated with a map-side minimum and joined back, so a hub with many links is
    a skewed join, which adaptive execution splits, and never one group in a task.
    Rows with a null end or equal ends are ignored; no links give no rows.
    """
    ends = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), "a", "b")
    edges = written(ends.filter("a is not null and b is not null and a != b").select("u", "v").distinct())
    seen = _fingerprint(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m"))
        near = both.join(smallest.select("u", F.least("u", "m").alias("m")), "u").filter("v > u")
        large = near.select(F.col("v").alias("u"), F.col("m").alias("v"))
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(smallest, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(moved.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct())
        now = _fingerprint(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
