import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import table
from furrow.operators import aggregates, relational, reshape


def frames(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (None, "n")], "k int, r string")
    return left, right


def test_merge_null_keys(spark):
    left, right = frames(spark)
    matched = table(relational.merge(left, right, on="k"))
    assert (None, "d", "n") in matched and (2, "c", None) in matched and len(matched) == 6
    dropped = table(relational.merge(left, right, on="k", null_keys="drop"))
    assert (None, "d", None) in dropped
    assert len(table(relational.merge(left, right, on="k", how="inner"))) == 5
    assert len(table(relational.merge(left, right, on="k", how="inner", null_keys="drop"))) == 4


def test_merge_full(spark):
    left, right = frames(spark)
    matched = table(relational.merge(left, right, on="k", how="full"))
    assert len(matched) == 7 and (3, None, "z") in matched and (None, "d", "n") in matched
    dropped = table(relational.merge(left, right, on="k", how="full", null_keys="drop"))
    assert len(dropped) == 8 and (None, None, "n") in dropped and (None, "d", None) in dropped
    native = left.join(right, "k", "full").select("k", "l", "r")
    assert dropped == table(native)


def three_sides(spark, rows, seed):
    draw = random.Random(seed)
    key = lambda: draw.choice([None, 1, 1, 1, 2, 3, 4, draw.randrange(20)])
    return [
        spark.createDataFrame([(key(), draw.choice([None, *"abcdefgh"])) for _ in range(rows)], f"k int, c{i} string")
        for i in range(3)
    ]


@pytest.mark.parametrize("null_keys", ["match", "drop"])
def test_full_distinct_is_the_chain_of_full_joins(spark, null_keys):
    sides = three_sides(spark, 60, 5)
    pairs = relational.merge(sides[0], sides[1], on="k", how="full", null_keys=null_keys)
    want = table(relational.merge(pairs, sides[2], on="k", how="full", null_keys=null_keys).distinct())
    assert len(want) > 300
    for block in (1, 2, 3, 10_000):
        assert table(relational.full_distinct(sides, "k", null_keys, block)) == want


def test_full_distinct_edges(spark):
    left, right = frames(spark)
    none = spark.createDataFrame([], "k int, z string")
    bare = left.select("k")
    got = table(relational.full_distinct([left, none, right], "k"))
    assert len(got) == 7 and (3, None, None, "z") in got and (None, "d", None, "n") in got
    assert relational.full_distinct([none, none.withColumnRenamed("z", "y")], "k").count() == 0
    assert table(relational.full_distinct([bare, right], "k")) == [(1, "x"), (1, "y"), (2, None), (3, "z"), (None, "n")]
    with pytest.raises(ValueError, match="rename one"):
        relational.full_distinct([left, left], "k")
    two = spark.createDataFrame([(1, None, "a"), (1, "p", "b")], "k int, m string, x string")
    far = spark.createDataFrame([(1, None, "c"), (1, "q", "d")], "k int, m string, y string")
    assert table(relational.full_distinct([two, far], ["k", "m"])) == [(1, "p", "b", None), (1, "q", None, "d"), (1, None, "a", "c")]
    dropped = table(relational.full_distinct([two, far], ["k", "m"], "drop"))
    assert len(dropped) == 4 and (1, None, "a", None) in dropped and (1, None, None, "c") in dropped


def test_merge_names(spark):
    left, right = frames(spark)
    other = right.withColumnRenamed("k", "key")
    assert relational.merge(left, other, left_on="k", right_on="key").columns == ["k", "l", "r"]
    with pytest.raises(ValueError):
        relational.merge(left, right.withColumnRenamed("r", "l"), on="k")


def test_lookup_first_never_fans_out(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    lookup = spark.createDataFrame([(1, 5, "late"), (1, 2, None), (None, 1, "none")], "id int, seq int, v string")
    assert table(relational.lookup_first(left, lookup, "k", "id", "seq", ["v"])) == [(1, None), (1, None), (2, None), (None, "none")]


def test_projection_helpers(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, some_Text int, d int")
    assert relational.drop_matching(relational.select_from(df, 2), "text|topic").columns == ["b", "d"]
    assert relational.rename(df, {"a": "z"}).columns[0] == "z"
    assert relational.tag(df, kind="k").first()["kind"] == "k"


def test_group_stat_on_every_row(spark):
    df = spark.createDataFrame([("a", 1), ("a", 4), (None, 2), (None, 3)], "g string, x int")
    assert table(relational.group_total(df, "x", ["g"], "t")) == [("a", 1, 5), ("a", 4, 5), (None, 2, 5), (None, 3, 5)]
    assert {r.m for r in relational.group_max(df, "x", ["g"], "m").collect()} == {4, 3}
    assert {r.m for r in relational.group_min(df, "x", ["g"], "m").collect()} == {1, 2}


def test_with_total_keeps_null_detail(spark):
    df = spark.createDataFrame([("r", "s", 1.0), (None, "s", 2.0), ("r", "s", None)], "d string, k string, x double")
    got = table(aggregates.with_total(df, "d", ["k"], {"x": "x"}, "All"))
    assert got == [("All", "s", 3.0, True), ("r", "s", 1.0, False), (None, "s", 2.0, False)]


def test_share_of_total(spark):
    rows = [("s", "w", 1.0), ("s", "w", 2.0), ("s", "d", 1.0), ("t", "w", None), ("t", "d", 2.0)]
    df = spark.createDataFrame(rows, "size string, scarce string, x double")
    got = table(aggregates.share_of_total(df, ["size"], ["scarce"], {"p": "x"}))
    assert got == [("s", "d", 25.0), ("s", "w", 75.0), ("t", "d", 100.0), ("t", "w", None)]


def test_distinct_counts_null_as_value(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), ("b", 2)], "g string, x int")
    assert table(aggregates.n_distinct(df, ["g"], "x")) == [("a", 2), ("b", 1)]
    assert table(aggregates.n_distinct(df, ["g"], "x", approximate=0.05)) == table(aggregates.n_distinct(df, ["g"], "x"))


def test_top_n_with_ties(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 2.0), ("a", 2.0), ("a", 1.0), ("a", None), ("b", None)], "g string, x double")
    assert table(reshape.top_n(df, ["g"], "x", 2)) == [("a", 2.0), ("a", 2.0), ("a", 3.0)]


def test_top_n_with_mass_ties(spark):
    df = spark.range(4000).selectExpr("if(id % 5 = 0, null, id % 3) as g", "cast(if(id % 2 = 0, 7, id % 101) as double) as x", "id")
    want = df.filter("x is not null").withColumn("place", F.rank().over(Window.partitionBy("g").orderBy(F.desc("x")))).filter("place <= 4")
    got = reshape.top_n(df, ["g"], "x", 4, "place")
    assert table(got) == table(want) and got.columns == ["g", "x", "id", "place"]
    ranks = df.filter("x is not null").withColumn("place", F.rank().over(Window.partitionBy("g").orderBy(F.desc("x"))))
    many = reshape.top_n(df, ["g"], "x", 1500, "place")
    assert table(many) == table(ranks.filter("place <= 1500")) and many.filter("x = 7").count() >= 2000
    assert many.schema["place"].dataType == want.schema["place"].dataType
    # the windows rank counted values: nothing below them but the counts
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window [" in line or "WindowGroupLimit" in line]
    assert windows and all("id#" not in line and "x#" not in line.replace("__x#", "") for line in windows)
    whole = reshape.top_n(df, [], "x", 2)
    assert {r.x for r in whole.collect()} == {100.0}


def test_explode_multivalue(spark):
    df = spark.createDataFrame([(1, "x, y,z", "", "n"), (2, None, ",b", "n"), (3, "a,", "c", "n")], "id int, p string, q string, o string")
    got = reshape.explode_multivalue(df, ["id"], {"P": "p", "Q": "q"}, protect={"P": {"x, y": "x y"}}, empty={"Q": "No"})
    assert table(got) == [(1, "P", "x y"), (1, "P", "z"), (1, "Q", "No"), (2, "Q", "No"), (2, "Q", "b"), (3, "P", "a"), (3, "Q", "c")]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_cumulative_series_properties(spark):
    rows = [("a", 2000, 2), ("a", 2003, 1), ("b", 2001, 5), ("b", None, 7), ("c", 2005, 1)]
    counts = spark.createDataFrame(rows, "k string, year int, n int")
    got = reshape.cumulative_by(counts.filter("k != 'c'"), ["k"], "year", "n", bounds=counts)
    rows = table(got.select("k", "year", "n", "cumulative"))
    assert len(rows) == 12 and rows[0] == ("a", 2000, 2, 2) and ("b", 2005, 0, 5) in rows and ("a", 2002, 0, 2) in rows
    shares = reshape.pct_of(got, "cumulative", ["year"], "pc").groupBy("year").agg(F.sum("pc").alias("s"))
    assert all(abs(r.s - 100) < 1e-9 for r in shares.collect())


def test_crosstab_zero_for_unseen(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "r string, c string")
    assert table(aggregates.crosstab(df, ["r"], "c", ["x", "y"])) == [("a", 2, 0), ("b", 0, 1)]
    assert table(aggregates.crosstab(df, ["r"], "c")) == [("a", 2, 0), ("b", 0, 1)]


def test_crosstab_fails_on_a_value_outside_the_list(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("b", "other")], "r string, c string")
    assert table(aggregates.crosstab(df.filter("r = 'a'"), ["r"], "c", ["x", "y"])) == [("a", 1, 0)]
    with pytest.raises(Exception, match="c has a value outside the given ones: other"):
        aggregates.crosstab(df, ["r"], "c", ["x", "y"]).collect()
