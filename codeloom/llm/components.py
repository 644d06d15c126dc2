"""Connected components of an edge table: alternating large-star and small-star steps."""

from pyspark.sql import DataFrame, functions as F

from codeloom.session import cut_lineage, tidy


def _toward_smallest(edges: DataFrame) -> DataFrame:
    """(u, v) with v the smallest neighbour of u, itself included, joined to every row of u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _round(edges: DataFrame) -> DataFrame:
    """Canonical edges with the same components, nearer to stars around the smallest nodes."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _toward_smallest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    down = _toward_smallest(large)
    small = down.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(down.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is the smaller end of its edges, or the larger end of a single one; a round leaves those as they are."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("above"), F.lit(0).alias("below")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("above"), F.lit(1).alias("below")))
    nodes = ends.groupBy("node").agg(F.sum("above").alias("above"), F.max("below").alias("below"))
    return nodes.filter("above > 1 OR above = 1 AND below = 1").count() == 0


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of numbers -> (node, component) for every node that has an edge; component is the smallest node.

    Each round is joins and folded groupings only; a hub's neighbours stay rows. Ends when only stars are left.
    """
    edges = cut_lineage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                        .distinct())
    tidy(edges.sparkSession)
    while not _are_stars(edges):
        edges = cut_lineage(_round(edges))
        tidy(edges.sparkSession)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
