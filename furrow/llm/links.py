"""Connected components of a table of links, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.lineage import cut, release


def _jumped(parents: DataFrame) -> DataFrame:
    """(node, parent) with every parent replaced by its own parent."""
    onward = parents.select(F.col("node").alias("_n"), F.col("parent").alias("_p"))
    return parents.join(onward, parents.parent == F.col("_n"), "left").select("node", F.coalesce("_p", "parent").alias("parent"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): for each linked node one node that its component shares. NULL ends are no links.

    Each round hangs every node on its least neighbour that is less than itself, follows those parents twice, and
    goes on with the links between different parents only, so the links shrink from round to round.
    """
    ends = links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter(F.col(a) != F.col(b))
    edges = cut(ends.distinct())
    labels = cut(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("label", F.col("node")))
    while edges.limit(1).count():
        hung = edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("parent"))
        parents = cut(_jumped(_jumped(hung)))
        p = parents.select(F.col("node").alias("_n"), F.col("parent").alias("_p"))
        moved = labels.join(p, labels.label == F.col("_n"), "left").select("node", F.coalesce("_p", "label").alias("label"))
        new_labels = cut(moved)
        left = edges.join(p, edges.u == F.col("_n"), "left").select(F.coalesce("_p", "u").alias("u"), "v")
        both = left.join(p, left.v == F.col("_n")).select("u", F.col("_p").alias("v"))
        new_edges = cut(both.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        for old in (labels, edges, parents):
            release(old)
        labels, edges = new_labels, new_edges
    release(edges)
    return labels
