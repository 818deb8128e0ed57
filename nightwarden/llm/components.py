"""Connected components of a link table, with joins and minima only.

Alternating star contraction: every node hands its larger neighbours to its smallest
neighbour, then its smaller ones, until each component is a star around its smallest node.
Both steps are a partially aggregated minimum and an equality join, so a node with very many
links is split by adaptive skew handling. Every round is written to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from nightwarden.session import checkpointed


def _stars(links: DataFrame) -> DataFrame:
    """One round over links (node, root) with root < node."""
    both = links.union(links.select("root", "node")).toDF("u", "v")
    smallest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.join(smallest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    smallest = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(smallest, "u")
    moved = small.filter("v <> m").select(F.col("v").alias("node"), F.col("m").alias("root"))
    return moved.union(smallest.select("u", "m")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every linked node but the smallest of its component, which is the root.

    `links` has two columns of one orderable type; order, repeats and links of a node to
    itself do not matter, links with a NULL end are left out. No links give no rows.
    """
    a, b = links.columns
    state = checkpointed(links.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("node"), F.least(a, b).alias("root")).distinct())

    def mark(table: DataFrame):
        return table.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38)"))).first()

    before = mark(state)
    while before[0]:
        state = checkpointed(_stars(state))
        after = mark(state)
        if after == before:
            break
        before = after
    return state
