"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a join and an aggregate with map-side combine, so a node with very many neighbours is
split by Spark's skew join and never gathered in one task. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges(a, b); component is the smallest node reachable.

    Nodes may be of any type with an order. Edges with a null end and loops are ignored; an empty
    table gives an empty result.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a is not null and b is not null and a != b")
    e = stored(e.distinct(), "edges")
    seen = None
    while True:
        both = e.union(e.select("v", "u").toDF("u", "v"))
        nearest = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(nearest, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(lowest, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        e = stored(small.union(lowest).toDF("u", "v").distinct(), "edges")
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.toDF("node", "component").union(roots.select("node", F.col("node").alias("component")))
