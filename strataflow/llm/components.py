"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.session import forget, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours (the larger ones, or the smaller ones and itself) to the least of them all.

    The least neighbour comes from a grouped minimum, so a node with many links stays in no single task.
    """
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if large else edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = both.groupBy("src").agg(F.min("dst").alias("low"))
    if large:
        least = least.select("src", F.least("src", "low").alias("low"))
        out = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    else:
        out = both.join(least, "src").select(F.explode(F.array("src", "dst")).alias("src"), F.col("low").alias("dst"))
    return out.where("src <> dst").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes that have a link; root is the least node of the component.

    edges has long columns src and dst, in either direction, with repeats and loops allowed; links with a null end
    are left out. Each round is written to the shared folder, so nothing is recomputed when an executor is lost;
    the round before goes, and so do the shuffles of rounds that are over.
    """
    spark, told = edges.sparkSession, None
    edges, path = written(edges.select("src", "dst").where("src <> dst").distinct(), "components")
    while True:
        edges, new = written(_star(_star(edges, True), False), "components")
        forget(spark, path)
        path, now = new, edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if now == told:
            break
        told = now
    roots = edges.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct()
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(roots)
