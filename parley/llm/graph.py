"""Connected components by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.core import free, join_back, shared_checkpoint


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the undirected edges; the component is its smallest node.

    Each round points all neighbours to the smallest one they can see. A node's neighbours are never gathered: the smallest
    is an aggregation, and a join hands it to each, by broadcast where a node has very many. Rounds end
    when the edges no longer change; their number grows with the logarithm of the longest path. Written to the shared
    folder after each round.

    Defined results: an edge from a node to itself, or one with a null end, says nothing; repeated edges count once; no edges
    give no rows; of equal nodes there is one row.
    """
    now = shared_checkpoint(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    mark = _mark(now)
    while True:
        now = shared_checkpoint(_stars(now, mark[0]))
        free(now.sparkSession)
        last, mark = mark, _mark(now)
        if mark == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(now: DataFrame, edges: int) -> DataFrame:
    # large star: of each node, larger neighbours go to the smallest of node and neighbours
    both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = shared_checkpoint(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")))
    large = join_back(both.where("v > u"), low, ["u"], 2 * edges).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    # small star: of each node, smaller neighbours and itself go to the smallest of them
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    return large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _mark(edges: DataFrame):
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]
