"""Projections, filters, joins and unions.

No join carries a broadcast hint: a lookup that is a small file goes out by its file size, and AQE
turns a sort-merge join into a broadcast join once a shuffled side has been measured as small.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, mul, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.nulls import _col
from furrow.lineage import cut

#: Distinct values of one side of a key that ``full_distinct`` brings together.
BLOCK = 10_000


def select_from(df: DataFrame, position: int) -> DataFrame:
    """Columns from the 1-based ``position`` to the end."""
    return df.select(df.columns[position - 1 :])


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    """Drop columns whose name holds ``pattern``, in any case."""
    found = re.compile(pattern, re.IGNORECASE)
    return df.drop(*[c for c in df.columns if found.search(c)])


def rename(df: DataFrame, names: list[str] | dict[str, str]) -> DataFrame:
    """Rename all columns by position (list) or some by name (dict)."""
    return df.withColumnsRenamed(names) if isinstance(names, dict) else df.toDF(*names)


def tag(df: DataFrame, **values) -> DataFrame:
    """Add constant columns."""
    return df.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()})


def between_dates(df: DataFrame, col: str, start: str, end: str) -> DataFrame:
    """Keep dates from ``start`` to ``end``, both included. Prunes when ``col`` is a partition column."""
    return df.filter(F.col(col).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def merge(
    left: DataFrame,
    right: DataFrame,
    on: str | list[str] | None = None,
    left_on: str | list[str] | None = None,
    right_on: str | list[str] | None = None,
    how: str = "left",
    null_keys: str = "match",
) -> DataFrame:
    """Equi join whose NULL keys match each other (``'match'``) or nothing (``'drop'``).

    The result holds the left key names once, then the other left columns, then the other right
    columns. A full join is written as the left join plus the right rows without a partner: AQE can
    split a hot key in those two joins and cannot in a full outer join.
    """
    as_list = lambda v: [v] if isinstance(v, str) else list(v)
    lkeys = as_list(on if left_on is None else left_on)
    rkeys = as_list(on if right_on is None else right_on)
    rest = [c for c in right.columns if c not in rkeys]
    clash = set(left.columns) & set(rest)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}; rename one")
    temp = [f"__r{i}" for i in range(len(rkeys))]
    r = right.withColumnsRenamed(dict(zip(rkeys, temp)))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b)) if null_keys == "match" else F.col(a) == F.col(b)
    cond = reduce(and_, [same(a, b) for a, b in zip(lkeys, temp)])
    out = left.columns + rest
    if how in ("left", "inner"):
        return left.join(r, cond, how).select(out)
    if how != "full":
        raise ValueError(f"how must be left, inner or full, not {how!r}")
    lone = r.join(left.select(lkeys).distinct(), cond, "left_anti").withColumnsRenamed(dict(zip(temp, lkeys)))
    return left.join(r, cond, "left").select(out).unionByName(lone, allowMissingColumns=True)


def full_distinct(frames: list[DataFrame], on: str | list[str], null_keys: str = "match", block: int = BLOCK) -> DataFrame:
    """The distinct rows of a full join of several frames on the same keys; many-to-many, each frame computed once.

    The frames are stacked, each in a column of its own, and repeated rows go while they are spread by all
    their columns; that is stored. A key's rows are then its values of each side multiplied out, a side without the key giving
    NULL. NULL keys match each other (``'match'``) or nothing (``'drop'``); frames without rows are sides without keys.

    A side with over ``block`` values of one key is dealt by their hash into blocks, and the key's rows into
    one cell for each choice of blocks; every cell holds the values of its blocks, so no task meets a whole hot key.
    """
    if null_keys not in ("match", "drop"):
        raise ValueError(f"null_keys must be match or drop, not {null_keys!r}")
    keys = [on] if isinstance(on, str) else list(on)
    sides = [[c for c in f.columns if c not in keys] for f in frames]
    names = [c for s in sides for c in s]
    if len(names) != len(set(names)):
        raise ValueError(f"columns on several sides: {sorted({c for c in names if names.count(c) > 1})}; rename one")
    held, blocks = [f"__v{i}" for i in range(len(frames))], [f"__b{i}" for i in range(len(frames))]
    lone = F.when(reduce(or_, [F.col(f"`{k}`").isNull() for k in keys]), F.col("__side")) if null_keys == "drop" else F.lit(None)

    def tagged(i: int) -> DataFrame:
        value = F.struct(*[F.col(f"`{c}`") for c in sides[i]]) if sides[i] else F.struct(F.lit(True).alias("__in"))
        return frames[i].select(*[F.col(f"`{k}`") for k in keys], F.lit(i).alias("__side"), value.alias(held[i]))

    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [tagged(i) for i in range(len(frames))])
    stored = cut(stacked.distinct().withColumn("__lone", F.coalesce(lone.cast("int"), F.lit(-1))))

    group = [*keys, "__lone"]
    many = stored.groupBy(*[F.col(f"`{k}`") for k in group], "__side").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > block)
    parts = F.ceil(F.col("__n") / F.lit(block))
    hot = many.groupBy(*[F.col(f"`{k}`").alias(f"__g{j}") for j, k in enumerate(group)]).agg(
        *[F.max(F.when(F.col("__side") == i, parts)).alias(b) for i, b in enumerate(blocks)]
    )
    same = reduce(and_, [F.col(f"`{k}`").eqNullSafe(F.col(f"__g{j}")) for j, k in enumerate(group)])
    sized = stored.join(hot, same, "left").withColumns({b: F.coalesce(b, F.lit(1).cast("bigint")) for b in blocks})

    def cells(i: int) -> Column:
        """The cells of a value of side ``i``: its own block with every block of the other sides."""
        below = reduce(mul, [F.col(b) for b in blocks[:i]], F.lit(1).cast("bigint"))
        others = reduce(mul, [F.col(b) for j, b in enumerate(blocks) if j != i], F.lit(1).cast("bigint"))
        own = F.pmod(F.xxhash64(held[i]), F.col(blocks[i]))
        place = lambda r: (F.floor(r / below) * F.col(blocks[i]) + own) * below + F.pmod(r, below)
        return F.transform(F.sequence(F.lit(0).cast("bigint"), others - 1), place)

    cell = F.explode(reduce(lambda rest, i: F.when(F.col("__side") == i, cells(i)).otherwise(rest), range(1, len(frames)), cells(0)))
    dealt = sized.select(*[F.col(f"`{k}`") for k in group], *blocks, *held, cell.alias("__cell"))
    met = dealt.groupBy(*[F.col(f"`{k}`") for k in group], "__cell", *blocks).agg(*[F.collect_list(v).alias(v) for v in held])
    # a side that has the key but no value in this block of it meets the others in its other blocks
    out = met.filter(reduce(and_, [(F.col(b) == 1) | (F.size(v) > 0) for b, v in zip(blocks, held)]))
    for i, v in enumerate(held):
        done = [f"__x{j}" for j in range(i)]
        out = out.select(*[F.col(f"`{k}`") for k in keys], *held[i + 1 :], *done, F.explode_outer(v).alias(f"__x{i}"))
    return out.select(*[F.col(f"`{k}`") for k in keys], *[F.col(f"__x{i}")[c].alias(c) for i, s in enumerate(sides) for c in s])


def lookup_first(
    df: DataFrame, lookup: DataFrame, left_on: str, right_on: str, order: str, cols: list[str]
) -> DataFrame:
    """Attach ``cols`` of the first lookup row (by ``order``) for each key; never fans out.

    First-per-key is an aggregate, so it combines before the shuffle.
    """
    first = lookup.groupBy(F.col(right_on).alias("__key")).agg(
        F.min_by(F.struct(*cols), F.col(order)).alias("__hit")
    )
    joined = df.join(first, F.col(left_on).eqNullSafe(F.col("__key")), "left")
    return joined.select(*df.columns, *[F.col("__hit")[c].alias(c) for c in cols])


def union_tagged(frames: dict[str, DataFrame], name: str) -> DataFrame:
    """Stack frames by column name, each tagged with its key; duplicates stay."""
    return reduce(DataFrame.unionByName, [tag(df, **{name: k}) for k, df in frames.items()])


def group_stat(df: DataFrame, by: list[str], **aggs: Column) -> DataFrame:
    """Put group aggregates on every row.

    Aggregate and join back rather than a window: the aggregate combines before its shuffle and the
    rows of a hot group are never brought to one task.
    """
    keys = [f"__g{i}" for i in range(len(by))]
    stats = df.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys)]).agg(*[a.alias(n) for n, a in aggs.items()])
    cond = reduce(and_, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys)])
    return df.join(stats, cond, "left").drop(*keys)


def group_total(df: DataFrame, col: Column | str, by: list[str], name: str) -> DataFrame:
    return group_stat(df, by, **{name: F.sum(_col(col))})


def group_max(df: DataFrame, col: Column | str, by: list[str], name: str) -> DataFrame:
    return group_stat(df, by, **{name: F.max(_col(col))})


def group_min(df: DataFrame, col: Column | str, by: list[str], name: str) -> DataFrame:
    return group_stat(df, by, **{name: F.min(_col(col))})
