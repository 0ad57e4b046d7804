"""Histogram sort: shards of near-equal bytes from exact counts below refined key boundaries, then one exchange.

The sort key of a document is (hash of its text, doc_id), so equal texts lie side by side. Each round counts the
exact bytes per candidate interval across all partitions, and only the intervals that hold a wanted boundary are
probed again, ``PROBES`` to an interval. What reaches the driver is at most boundaries x ``PROBES`` sums a round.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.lineage import cut, release

PROBES = 256
OVERHEAD = 16
RUN_BYTES = 256 << 20
RUN_ROWS = 1 << 20


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def _keys(docs: DataFrame, id_col: str, text: str) -> dict[str, Column]:
    return {
        "_hi": F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 1),
        "_lo": F.coalesce(F.col(id_col).cast("long"), F.lit(0)),
        "size": text_bytes(F.col(text)) + OVERHEAD,
    }


def splitters(rows: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """Keys (hi, lo): shard i ends before the i-th. ``rows`` has _hi, _lo, size.

    A boundary is first sought between texts; only where a group of equal texts is larger than the tolerance (a
    share of a shard's bytes) the group is cut by doc_id.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    allowed = tolerance * total / shards
    found: dict[int, tuple[int, int]] = {}
    # an interval: (fixed hi or None, first key, last key, bytes below it) and the boundaries sought in it
    open_ = {(None, 0, 2**63 - 1, 0): list(range(1, shards))} if total else {}
    while open_:
        probed = list(open_)
        which, probe = F.lit(None).cast("int"), F.lit(None).cast("long")
        steps = []
        for i, (fixed, a, b, _) in enumerate(probed):
            step = max(1, -(-(b - a + 1) // PROBES))
            steps.append(step)
            key = F.col("_hi") if fixed is None else F.col("_lo")
            inside = key.between(F.lit(a), F.lit(b)) if fixed is None else (F.col("_hi") == fixed) & key.between(F.lit(a), F.lit(b))
            which = F.when(inside, F.lit(i)).otherwise(which)
            probe = F.when(inside, F.expr(f"({'_hi' if fixed is None else '_lo'} - {a}L) div {step}L")).otherwise(probe)
        counted = (
            rows.select(which.alias("w"), probe.alias("p"), "_hi", "_lo", "size").filter("w IS NOT NULL").groupBy("w", "p")
            .agg(F.sum("size").alias("n"), F.min("_hi").alias("h0"), F.max("_hi").alias("h1"), F.min("_lo").alias("l0"), F.max("_lo").alias("l1"))
        )
        by = {}
        for r in counted.collect():
            by.setdefault(r["w"], []).append(r)
        nxt: dict = {}
        for i, (fixed, a, b, below) in enumerate(probed):
            cells = sorted(by.get(i, []), key=lambda r: r["p"])
            ends = list(accumulate((r["n"] for r in cells), initial=below))
            edge = lambda p: (p, -(2**63)) if fixed is None else (fixed, p)  # noqa: B023, E731
            for t in open_[probed[i]]:
                want = t * total / shards
                j = min(max(bisect_left(ends, want) - 1, 0), len(cells) - 1)
                r, at = cells[j], a + cells[j]["p"] * steps[i]
                gaps = (want - ends[j], ends[j + 1] - want)
                single = fixed is not None and steps[i] == 1
                if min(gaps) <= allowed or single:
                    found[t] = edge(at) if gaps[0] <= gaps[1] else edge(min(at + steps[i], b + 1))
                elif fixed is None and r["h0"] == r["h1"]:
                    nxt.setdefault((r["h0"], r["l0"], r["l1"], ends[j]), []).append(t)
                else:
                    nxt.setdefault((fixed, at, min(at + steps[i] - 1, b), ends[j]), []).append(t)
        open_ = nxt
    return [found[t] for t in sorted(found)]


def shard(docs: DataFrame, shards: int = 40, tolerance: float = 0.005, id_col: str = "doc_id", text: str = "text", run_bytes: int = RUN_BYTES, run_rows: int = RUN_ROWS) -> DataFrame:
    """All columns of ``docs`` and ``size``, ``law`` ('bytes'), ``shard``, ``slot``.

    Size is UTF-8 bytes plus 16; NULL and empty texts have none. Shards differ from the mean by about
    ``tolerance`` of a shard, or by one row where that is more. A slot is a row's place in its shard, gapless from 0.
    A shard is written as runs sorted by key; their number grows with the data (``run_bytes``, ``run_rows``), so no
    task holds a whole shard. A NULL doc_id sorts as 0; rows that repeat both text and doc_id have the same key and
    are not parted, all others can be. An empty table gives no rows. Columns of ``docs`` named as the new ones are replaced.
    """
    keys = _keys(docs, id_col, text)
    rows = cut(docs.select(*(c.alias(n) for n, c in keys.items())))
    cuts = splitters(rows, shards, tolerance)
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    release(rows)
    runs = max(1, -(-(total or 0) // (shards * run_bytes)), -(-n // (shards * run_rows)))
    place = F.lit(0)
    for hi, lo in cuts:
        after = F.col("_hi") > hi if lo > -(2**63) else F.col("_hi") >= hi
        if lo > -(2**63):
            after = after | ((F.col("_hi") == hi) & (F.col("_lo") >= lo))
        place = place + after.cast("int")
    made = docs.drop("size", "law", "shard", "slot").withColumns(keys)
    made = made.withColumns({"shard": place, "_run": F.pmod(F.xxhash64("_lo", "_hi"), F.lit(runs)).cast("int")})
    ordered = made.withColumn("_rank", F.row_number().over(Window.partitionBy("shard", "_run").orderBy("_hi", "_lo")).cast("long"))
    if runs == 1:
        numbered = ordered.withColumn("slot", F.col("_rank") - 1)
    else:
        size = made.groupBy("shard", "_run").count()
        before = Window.partitionBy("shard").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
        starts = size.select("shard", "_run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
        numbered = ordered.join(starts, ["shard", "_run"]).withColumn("slot", F.col("_start") + F.col("_rank") - 1).drop("_start")
    return numbered.withColumn("law", F.lit("bytes")).drop("_hi", "_lo", "_run", "_rank")
