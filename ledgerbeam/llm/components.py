"""Connected components of a graph given as edges to a local root."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerbeam.llm.common import join_groups, stored


def _pairs(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Each edge once, the smaller node first, without loops."""
    return (
        edges.filter(F.col(a) != F.col(b))
        .select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .distinct()
    )


def connected(edges: DataFrame) -> DataFrame:
    """``edges`` (node, root) of longs; returned: node, label, the least node it reaches.

    The graph is contracted: each node goes to the least of itself and its neighbours, and
    edges between the images are what is left to do. The least node of a component stays
    itself, so in the end all of it has gone there. A round removes a share of the nodes,
    in chains, too, whatever the order of their numbers. Minima are summed partially, hot
    nodes are looked up by broadcast (``join_groups``), and each round's tables are written,
    which cuts the lineage; a checkpoint would hand on the constraints of all rounds before,
    whose number doubles with each. Only sizes and the end come to the driver.
    """
    pairs = stored(_pairs(edges, "node", "root"))
    rounds = []
    while not pairs.isEmpty():
        both = pairs.union(pairs.select("b", "a"))
        moved = stored(
            both.groupBy(F.col("a").alias("node"))
            .agg(F.min("b").alias("near"), F.count("*").alias("degree"))
            .select("node", F.least("node", "near").alias("label"), "degree")
        )
        rounds.append(moved.select("node", "label"))
        ends = pairs
        for end in ("a", "b"):
            image = moved.select(F.col("node").alias(end), F.col("label").alias(f"to_{end}"), "degree")
            ends = join_groups(ends, image, [end], "degree").drop("degree")
        pairs = stored(_pairs(ends, "to_a", "to_b"))
    if not rounds:
        return edges.select("node", F.col("root").alias("label")).limit(0)
    labels = rounds.pop()
    while rounds:
        further = labels.select(F.col("node").alias("label"), F.col("label").alias("last"))
        labels = stored(
            rounds.pop()
            .join(further, "label", "left")
            .select("node", F.coalesce("last", "label").alias("label"))
        )
    return labels
