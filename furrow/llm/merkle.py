"""Merkle manifest of a table: one tree per group of rows, one tree over the groups, proofs and versions for rows.

A tree has runs of 16: every 16 consecutive nodes become the hash of their digests until one remains. The leaves of a
group are cut into aligned blocks of 16 ** 3, so a block holds whole runs of three levels and is one task's work; the
nodes above are the leaves of the next tier, in blocks again. Changing a leaf copies its path: the version shares every
node but the ancestors, which are made inside the leaf's block and carried on through the tiers above with the
siblings that the block was handed, one row a block. No task sees more than one block, however large a group is.
"""

from __future__ import annotations

from collections.abc import Mapping
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from furrow.lineage import cut
from furrow.operators.ordering import place

ARITY, LEVELS = 16, 3
BLOCK = ARITY**LEVELS
#: Siblings left and right of each step, one after the other.
PATH = "array<string>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field_text(value: Column) -> Column:
    """``-`` for NULL, else UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field_text(f) for f in fields]), 256)


def hashed(text: str) -> str:
    return sha256(text.encode("ascii")).hexdigest()


class Tree:
    """The nodes of one block, level by level, as joined hex digests. ``size`` counts the leaves of the whole tree that
    the block is a part of: a block of a larger tree always has all its levels."""

    def __init__(self, leaves: list[str], size: int):
        self.levels = [leaves]
        while len(self.levels) <= LEVELS if size > BLOCK else len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append([hashed("".join(below[i : i + ARITY])) for i in range(0, len(below), ARITY)])

    @property
    def top(self) -> str:
        return self.levels[-1][0]

    def siblings(self, i: int) -> list[tuple[str, str]]:
        """Digests left and right of the path in each run, from leaf ``i`` upwards."""
        steps = []
        for nodes in self.levels[:-1]:
            first = i - i % ARITY
            steps.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + ARITY])))
            i //= ARITY
        return steps


def version(leaf: str, steps: list[tuple[str, str]]) -> list[str]:
    """The copied nodes of the version in which the leaf is ``leaf``: itself and its ancestors up to the root."""
    path = [leaf]
    for left, right in steps:
        path.append(hashed(left + path[-1] + right))
    return path


def _tops(nodes: DataFrame) -> DataFrame:
    """One row per block: the node that ends it, placed in the tier above."""

    def top(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_at")
        size, block = int(rows["_size"].iloc[0]), int(rows["_at"].iloc[0]) // BLOCK
        made = Tree(rows["_digest"].tolist(), size).top
        return pd.DataFrame({"_group": [rows["_group"].iloc[0]], "_at": [block], "_size": [-(-size // BLOCK)], "_digest": [made]})

    blocks = nodes.select("_group", "_at", "_size", "_digest", F.floor(F.col("_at") / BLOCK).alias("_block"))
    return cut(blocks.groupBy("_group", "_block").applyInPandas(top, "_group string, _at long, _size long, _digest string"))


def _paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """(_group, _at, _path): the siblings of every node up to its tree's root. ``above`` has those of its block."""

    def paths(rows: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_at")
        tree, tail = Tree(rows["_digest"].tolist(), int(rows["_size"].iloc[0])), list(up["_path"].iloc[0])
        steps = [[side for step in tree.siblings(i) for side in step] + tail for i in range(len(rows))]
        return pd.DataFrame({"_group": rows["_group"], "_at": rows["_at"], "_path": steps})

    blocks = nodes.withColumn("_block", F.floor(F.col("_at") / BLOCK)).groupBy("_group", "_block")
    made = blocks.cogroup(above.groupBy("_group", "_block")).applyInPandas(paths, f"_group string, _at long, _path {PATH}")
    return cut(made)


def _climb(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(_group, _root) of every tree; (_group, _block, _path) with the siblings above each block. ``nodes`` is stored."""
    tops = _tops(nodes)
    if (tops.agg(F.max("_size")).first()[0] or 0) <= 1:
        return tops.select("_group", F.col("_digest").alias("_root")), tops.select(
            "_group", F.col("_at").alias("_block"), F.array().cast(PATH).alias("_path")
        )
    roots, above = _climb(tops)
    return roots, _paths(tops, above).withColumnRenamed("_at", "_block")


def manifest(
    docs: DataFrame,
    fields: list[str],
    key: str,
    group: str,
    changed: Mapping[str, Column] | None = None,
    where: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``leaf``, ``subroot`` of its group's tree, ``root`` over all groups, ``proof_sha256`` of all
    its siblings from leaf to root, ``folded_root`` of the version in which rows under ``where`` have ``changed`` fields (the
    others: as they are), ``copied`` (that version's own nodes, leaf to root; all others are shared) and ``verified``.

    NULL fields are ``-``; a NULL group is a group, the first one; a NULL key comes first; equal keys follow by leaf, and
    equal leaves are interchangeable. An empty table gives no rows. Other columns, whatever their names, are not read.
    The texts are read once, into one digest or two a row. Starts jobs.
    """
    plain, other = [F.col(f"`{f}`") for f in fields], [(changed or {}).get(f, F.col(f"`{f}`")) for f in fields]
    group_key = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    tampered = F.when(F.coalesce(where, F.lit(False)), leaf_digest(other)) if where is not None else F.lit(None).cast("string")
    leaves = cut(docs.select(F.col(f"`{key}`").alias("_key"), group_key.alias("_group"), leaf_digest(plain).alias("_digest"), tampered.alias("_other")))
    order = [F.col("_key").asc_nulls_first(), F.col("_digest")]
    placed = cut(place(leaves, order, "_at", by=["_group"], total="_size").withColumn("_block", F.floor(F.col("_at") / BLOCK)))

    subroots, in_group = _climb(placed)
    tops = cut(place(subroots, [F.col("_group")], "_at", total="_size").select(F.col("_group").alias("_name"), "_at", "_size", F.col("_root").alias("_digest")))
    nodes = tops.select(F.lit("").alias("_group"), "_at", "_size", "_digest")
    root, over = _climb(nodes)
    last = _paths(nodes, over)
    at_top = root.first()
    whole = tops.join(last.select("_at", F.col("_path").alias("_last")), "_at").select(
        F.col("_name").alias("_group"), "_last", F.col("_digest").alias("_subroot"), F.lit(at_top and at_top["_root"]).alias("_root")
    )
    above = cut(in_group.join(whole, "_group").select("_group", "_block", F.concat("_path", "_last").alias("_path"), "_subroot", "_root"))

    def prove(rows: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_at").reset_index(drop=True)
        own = up.iloc[0]
        leaf, other = rows["_digest"].tolist(), rows["_other"].tolist()
        tree, tail = Tree(leaf, int(rows["_size"].iloc[0])), list(zip(own["_path"][::2], own["_path"][1::2], strict=True))
        proofs, copied = [], []
        for i, now in enumerate(other):
            steps = tree.siblings(i) + tail
            proofs.append(hashed("".join(a + b for a, b in steps)))
            copied.append(version(leaf[i] if now is None else now, steps))
        ends = [c[-1] for c in copied]
        made = {"_key": rows["_key"], "leaf": leaf, "subroot": own["_subroot"], "root": own["_root"], "proof_sha256": proofs}
        return pd.DataFrame(made | {"folded_root": ends, "copied": copied, "verified": [e == own["_root"] for e in ends]})

    texts = ", ".join(f"{c} string" for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root"))
    made = StructType([StructField("_key", placed.schema["_key"].dataType), *StructType.fromDDL(f"{texts}, copied array<string>, verified boolean")])
    proved = placed.groupBy("_group", "_block").cogroup(above.groupBy("_group", "_block")).applyInPandas(prove, made)
    return proved.withColumnRenamed("_key", key)
