"""Connected components by repeated contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, comp) for every node of links(u, v); comp is the smallest node of its component.

    Each round every node points to the neighbour (or itself) of least pseudo-random rank, and the
    graph is contracted along the pointers. A round shrinks the graph by a constant factor in
    expectation, so chains take logarithmically many rounds. Only a row count reaches the driver.
    The minimum by neighbour is combined before its shuffle; a hub's links are split by AQE's skew join.
    Null ends and self links are ignored; repeated links count once; no links give an empty table.
    """
    edges = stored(links.select("u", "v").where("u is not null and v is not null and u <> v").distinct(), "edges0")
    labels, nodes = None, 0
    for i in range(max_rounds):
        n = edges.count()
        if not n:
            break
        nodes = nodes or 2 * n
        rank = F.xxhash64("b", F.lit(i))
        both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(rank.alias("r"), F.col("b"))).alias("m"))
        own = F.struct(F.xxhash64("a", F.lit(i)).alias("r"), F.col("a").alias("b"))
        step = stored(best.select("a", F.least(F.col("m"), own)["b"].alias("to")), f"step{i}", 2 * n)
        if labels is None:
            labels = step.select(F.col("a").alias("node"), F.col("to").alias("at"))
        else:
            labels = labels.join(step, labels["at"] == step["a"], "left").select("node", F.coalesce("to", "at").alias("at"))
            labels = stored(labels, f"labels{i}", nodes)
        left = edges.join(step, edges["u"] == step["a"]).select(F.col("to").alias("u"), "v")
        right = left.join(step, left["v"] == step["a"]).select("u", F.col("to").alias("v"))
        edges = stored(right.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"edges{i + 1}", n)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if labels is None:
        return links.select(F.col("u").alias("node"), F.col("v").alias("comp")).limit(0)
    least = labels.groupBy("at").agg(F.min("node").alias("comp"))
    return labels.join(least, "at").select("node", "comp")
