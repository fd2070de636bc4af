"""Connected components of a distributed edge list by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import drop, written


def _edges(pairs: DataFrame) -> DataFrame:
    low, high = F.least("u", "v"), F.greatest("u", "v")
    return pairs.select(low.alias("u"), high.alias("v")).where("u < v").distinct()


def _followed(parents: DataFrame) -> DataFrame:
    above = parents.select(F.col("node").alias("up"), F.col("up").alias("top"))
    return parents.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"))


def connected_components(pairs: DataFrame, rows: int | None = None) -> DataFrame:
    """Rows (node, component) for every node that is not the smallest of its component.

    pairs has long columns u and v; order, repeats and loops do not matter, and no rows give no rows. rows, about how many
    pairs there are, only decides over how many files small tables are spread.
    In each round every node with a smaller neighbour takes the smallest as its parent, parents are followed by
    doubling to the roots, and the edges are relabelled; every node with a smaller neighbour goes, so the rounds are
    few. Only aggregations that combine before the shuffle and joins on one side's unique key are used, so a
    node with very many neighbours is neither gathered nor sent to the driver.
    """
    edges = written(_edges(pairs), "edges", rows)
    rows = edges.count()
    labels = None
    while not edges.isEmpty():
        parents = _followed(_followed(edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("up"))))
        parents = written(parents, "parents", rows)
        while not parents.join(parents.select(F.col("node").alias("up")), "up", "left_semi").isEmpty():
            old, parents = parents, written(_followed(_followed(parents)), "parents", rows)
            drop(old)
        new = parents.select("node", F.col("up").alias("component"))
        if labels is None:
            labels = parents.withColumnRenamed("up", "component")
            labels._quarry_path = parents._quarry_path
        else:
            above = parents.select(F.col("node").alias("component"), F.col("up").alias("top"))
            moved = labels.join(above, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
            old, labels = labels, written(moved.unionByName(new), "labels", rows)
            drop(old)
        p, q = (parents.select(F.col("node").alias(end), F.col("up").alias(f"{end}_up")) for end in "uv")
        moved = edges.join(p, "u", "left").join(q, "v", "left").select(F.coalesce("u_up", "u").alias("u"), F.coalesce("v_up", "v").alias("v"))
        old, edges = edges, written(_edges(moved), "edges", rows)
        drop(old)
    if labels is None:
        labels = edges.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return labels
