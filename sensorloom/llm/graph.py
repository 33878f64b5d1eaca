"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.lineage import cut_lineage


def _star(pairs: DataFrame) -> DataFrame:
    """(a, b) -> (b, least of a's side) for each pair, where each ``a`` is joined with its least partner or itself."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return pairs.join(least, "a")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (columns a, b of one integer type), component being its least node.

    Alternates large-star and small-star steps until the links are stars around the least nodes. Each step is one
    aggregation and one join on a node; a node with very many links is pre-aggregated and its join side can be split.
    Links with a null end or from a node to itself are left out.
    """
    links = cut_lineage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        stars = _star(large)
        small = stars.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(stars.select("a", F.col("m").alias("b")))
        links = cut_lineage(small.filter("a <> b").distinct())
        state = links.agg(F.count("*"), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = links.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
