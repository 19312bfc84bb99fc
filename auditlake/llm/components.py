"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize


def _star(neighbours: DataFrame, keep: F.Column) -> DataFrame:
    """Each node's neighbours (only those with ``keep``) are tied to the least node of its neighbourhood."""
    least = neighbours.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return neighbours.where(keep).join(least, "u")


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours (v) are tied to the least of them; many links of a node become one."""
    tied = _star(edges, F.lit(True))
    pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
    return tied.select(F.explode(pairs).alias("e")).select("e.*").where("u <> v").distinct()


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _settled(edges: DataFrame) -> bool:
    """Whether every id is tied to one smaller id at most, and that one to none: then no round changes a thing."""
    nodes = _both_ways(edges).groupBy("u").agg(F.max("v").alias("hi"), F.count_if(F.col("v") < F.col("u")).alias("smaller"))
    return nodes.where("smaller > 1 or (smaller = 1 and hi > u)").limit(1).count() == 0


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id in the links; component: the least id reachable. Nulls and self-links are ignored."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a) != F.col(b)).distinct()
    edges = materialize(_small_star(edges), "links")
    while not _settled(edges):
        large = _star(_both_ways(edges), F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = materialize(_small_star(large), "links")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
