"""Orders, ordinals and folds without a single-task sort.

The trick throughout: a frame is stored once, range-partitioned in the wanted order, and each stored row carries
its range and its place in the range. Rows are counted per range, the counts give offsets, and offset plus place is
the position. The order may be any list of sort columns of any types; a key that a third of all rows share is cut
into several ranges by the order in which the rows were read.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.nulls import _col
from furrow.lineage import cut, release

AT = "__at"
_INSIDE = 33  # bits of the place in a range, as ``monotonically_increasing_id`` has them
#: Rows a range holds at most on average, however few partitions the session asks for.
RANGE_ROWS = 2_000_000


def same(left: list[str], right: list[str]) -> Column:
    """Null-safe equality of two lists of columns."""
    cond = F.lit(True)
    for a, b in zip(left, right, strict=True):
        cond = cond & F.col(a).eqNullSafe(F.col(b))
    return cond


def range_of(at: Column | str = AT) -> Column:
    return F.shiftright(_col(at), _INSIDE).cast("int")


def ranged(df: DataFrame, order: list[Column | str], buckets: int | None = None) -> DataFrame:
    """``df`` stored in ranges of ``order``, sorted inside each; ``__at`` holds range and place in it.

    The frame is computed once: it is stored as it comes unless it already is (``lineage.cut``), and the split points
    are sampled from that store. Without ``buckets`` there are as many ranges as the session has shuffle partitions,
    more if a range would hold over ``RANGE_ROWS`` rows. Rows equal in ``order`` lie in the order of the store, so
    that many equal rows do not meet in one task.
    """
    own = getattr(df, "stored_path", None) is None
    source = cut(df) if own else df
    if buckets is None:
        buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), source.count() // RANGE_ROWS + 1)
    keys = [*order, F.col("__tie")]
    spread = source.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(buckets, *keys)
    stored = cut(spread.sortWithinPartitions(*keys).drop("__tie").withColumn(AT, F.monotonically_increasing_id()))
    if own:
        release(source)
    return stored


def _sort(cols: list[str], descending: tuple[str, ...]) -> list[Column]:
    return [F.col(c).desc_nulls_last() if c in descending else F.col(c).asc_nulls_last() for c in cols]


def positions(stored: DataFrame) -> tuple[Callable[[str], Column], int]:
    """What turns an ``__at`` of this stored frame into a 0-based position, and the row count. One count per range
    comes to the driver."""
    sizes = {r[0]: r[1] for r in stored.groupBy(range_of()).count().collect()}
    counts = [sizes.get(i, 0) for i in range(max(sizes, default=0) + 1)]
    before = F.split(F.lit(",".join(map(str, accumulate([0, *counts])))), ",").cast("array<bigint>")
    return lambda at: F.get(before, range_of(at)) + F.col(at).bitwiseAND((1 << _INSIDE) - 1), sum(counts)


def numbered(df: DataFrame, name: str = "ordinal") -> tuple[DataFrame, int]:
    """``df`` stored with gapless 0-based numbers in the order it was read, and its row count. No shuffle."""
    stored = cut(df.withColumn(AT, F.monotonically_increasing_id()))
    position, n = positions(stored)
    return stored.withColumn(name, position(AT)).drop(AT), n


def place(
    df: DataFrame,
    order: list[Column | str],
    name: str = "ordinal",
    by: list[str] | None = None,
    total: str | None = None,
    buckets: int | None = None,
    descending: tuple[str, ...] = (),
) -> DataFrame:
    """0-based position of every row in ``order``, inside its group of ``by``; ``total`` adds the group's row count.

    Starts jobs. Positions are fixed by what is stored, equal rows included. The driver sees one count per range.
    A group is found by one aggregate and one join, and may hold any share of the rows.
    """
    by = by or []
    stored = ranged(df, [*_sort(by, descending), *order], buckets)
    position, n = positions(stored)
    out = {name: position(AT)}
    if by:
        keys = [f"__b{i}" for i in range(len(by))]
        groups = stored.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]).agg(
            F.min(AT).alias("__pl_first"), F.count(F.lit(1)).alias("__pl_rows")
        )
        stored = stored.join(groups, same(by, keys), "inner")
        out[name] = position(AT) - position("__pl_first")
    if total:
        out[total] = F.col("__pl_rows") if by else F.lit(n).cast("bigint")
    return stored.withColumns(out).drop(AT, "__pl_first", "__pl_rows", *[f"__b{i}" for i in range(len(by))])


def ordinal(
    df: DataFrame,
    key: str,
    lead: list[str] | None = None,
    name: str = "ordinal",
    total: str | None = None,
    buckets: int | None = None,
    descending: tuple[str, ...] = (),
) -> DataFrame:
    """0-based position in the order of ``lead``, then ``key``; ``total`` also adds the row count."""
    return place(df, [*_sort(lead or [], descending), F.col(key)], name, total=total, buckets=buckets)


def fold_of(position: Column | str, n: Column | str, k: int) -> Column:
    """Contiguous fold of a 0-based position: the first ``n mod k`` folds hold one row more."""
    i, n = _col(position).cast("bigint"), _col(n).cast("bigint")
    kk = F.lit(k).cast("bigint")
    size, extra = F.floor(n / kk), n % kk
    head = extra * (size + 1)
    early = F.floor(i / (size + 1))
    late = extra + F.floor((i - head) / F.nullif(size, F.lit(0)))
    return F.when(i < head, early).otherwise(late).cast("int")


def kfold(df: DataFrame, k: int, key: str, lead: list[str] | None = None, name: str = "fold", **kwargs) -> DataFrame:
    """Contiguous folds in the order of ``lead``, ``key``; sizes differ by at most one row."""
    placed = ordinal(df, key, lead, name="__i", total="__rows", **kwargs)
    return placed.withColumn(name, fold_of("__i", "__rows", k)).drop("__i", "__rows")


def stratified_kfold(df: DataFrame, k: int, key: str, label: str, name: str = "fold", **kwargs) -> DataFrame:
    """Contiguous folds inside each class: every fold keeps the class shares."""
    placed = place(df, [F.col(key)], "__i", by=[label], total="__rows", **kwargs)
    return placed.withColumn(name, fold_of("__i", "__rows", k)).drop("__i", "__rows")


def hash_key(col: Column | str, seed: int) -> Column:
    """Repeatable random-looking key of an id: md5 of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _col(col).cast("string")))


def hash_bucket(col: Column | str, seed: int, buckets: int) -> Column:
    """Repeatable bucket 0..buckets-1 from the first seven hex digits of the key."""
    return F.conv(F.substring(hash_key(col, seed), 1, 7), 16, 10).cast("bigint") % F.lit(buckets)


def shuffle_rows(df: DataFrame, seed: int, key: str) -> DataFrame:
    """Repeatable random row order; a range-partitioned sort."""
    return df.orderBy(hash_key(key, seed), F.col(key))


def split_rows(df: DataFrame, key: str, test: float = 0.25, seed: int = 0, method: str = "hash", **kwargs) -> DataFrame:
    """Add ``is_test``. ``'hash'`` needs no shuffle; ``'exact'`` gives exactly ceil(n * test) test rows."""
    if method == "hash":
        scale = 1_000_000
        return df.withColumn("is_test", hash_bucket(key, seed, scale) < int(test * scale))
    if method != "exact":
        raise ValueError(f"method must be 'hash' or 'exact', not {method!r}")
    # 52 bits of the hash: unique in practice; the key settles any tie
    placed = place(df, [F.substring(hash_key(key, seed), 1, 13), F.col(key)], "__i", total="__rows", **kwargs)
    return placed.withColumn("is_test", F.col("__i") < F.ceil(F.col("__rows") * test)).drop("__i", "__rows")


def category_order(df: DataFrame, category: str, by: Column, name: str = "category_ord") -> DataFrame:
    """Attach the 1-based rank of each category, highest aggregate first, name as tie-break.

    The categories, one row each, are placed like any other frame, so there may be any number of them.
    """
    totals = df.groupBy(F.col(category).alias("__cat")).agg(by.alias("__by"))
    placed = place(totals, [F.col("__by").desc_nulls_last(), F.col("__cat").asc_nulls_last()], "__place")
    ranked = placed.select("__cat", (F.col("__place") + 1).cast("int").alias(name))
    return df.join(ranked, F.col(category).eqNullSafe(F.col("__cat")), "left").drop("__cat")


def fixed_order(col: Column | str, levels: list) -> Column:
    """1-based place in a given list of levels; NULL outside it."""
    place = F.array_position(F.array(*[F.lit(v) for v in levels]), _col(col))
    return F.nullif(place, F.lit(0)).cast("int")


def reverse_index(df: DataFrame, order: list[Column], first: int | None = None, name: str = "ix") -> DataFrame:
    """The rows in the given order, numbered n, n-1, ... 1; with ``first`` only that many from the top.

    With ``first`` the cut is a distributed top-k, so the numbering sees ``first`` rows; n is a scalar subquery.
    Without it the rows are placed by ranges. ``order`` must settle every tie.
    """
    if first is None:
        placed = place(df, order, "__place", total="__rows")
        return placed.withColumn(name, (F.col("__rows") - F.col("__place")).cast("bigint")).drop("__place", "__rows")
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.orderBy(*order).limit(first).withColumn(name, n - F.row_number().over(Window.orderBy(*order)) + 1)
