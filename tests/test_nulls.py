import math

from pyspark.sql import functions as F

from conftest import table
from furrow.functions import nulls

NAN, INF = float("nan"), float("inf")


def one(spark, column, schema="a double, b double, f boolean", row=(None, None, None)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


def test_conditional_keeps_null(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "f boolean")
    assert [r[0] for r in df.select(nulls.if3(F.col("f"), F.lit("a"), F.lit("b"))).collect()] == ["a", "b", None]


def test_ratio(spark):
    rows = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (1.0, None), (6.0, 3.0), (NAN, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    plain = [r[0] for r in df.select(nulls.ratio("a", "b")).collect()]
    assert plain == [None, None, None, None, None, 2.0, None]
    ieee = [r[0] for r in df.select(nulls.ratio("a", "b", "ieee")).collect()]
    assert ieee[:2] == [INF, -INF] and math.isnan(ieee[2]) and ieee[3:6] == [None, None, 2.0] and math.isnan(ieee[6])


def test_sums(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None), ("c", 2.0)], "g string, x double")
    got = table(df.groupBy("g").agg(nulls.sum_skip("x").alias("skip"), nulls.sum_strict("x").alias("strict")))
    assert got == [("a", 1.0, None), ("b", 0.0, None), ("c", 2.0, 2.0)]


def test_row_sum_and_zero(spark):
    assert one(spark, nulls.row_sum("a", "b")) == 0.0
    assert one(spark, nulls.row_sum("a", "b"), row=(2.0, None, None)) == 2.0
    assert one(spark, nulls.null_if_zero("a"), row=(0.0, None, None)) is None


def test_finite_and_complete(spark):
    df = spark.createDataFrame([(1, 1.0), (2, NAN), (3, INF), (4, -INF), (5, None)], "i int, x double")
    assert [r.i for r in df.filter(nulls.is_finite("x")).collect()] == [1]
    assert [r.i for r in df.filter(~nulls.is_finite("x")).collect()] == [2, 3, 4, 5]
    assert [r.i for r in nulls.complete_cases(df).collect()] == [1, 3, 4]
    assert [r.i for r in nulls.complete_cases(df, ["i"]).collect()] == [1, 2, 3, 4, 5]


def test_membership_never_null(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    assert [r[0] for r in df.select(nulls.is_member("c", ["a"])).collect()] == [True, False, False]


def test_recode_override_band(spark):
    df = spark.createDataFrame([("x", 0.5), ("y", 0.549), ("z", 0.9), (None, NAN), ("x", None)], "c string, v double")
    label, order = nulls.band("v", [0.549, 0.699], ["low", "mid", "high"])
    got = [tuple(r) for r in df.select(nulls.recode("c", {"x": "X"}), nulls.override("c", "c", {"y": "Y"}), label, order).collect()]
    assert got == [
        ("X", "x", "low", 1),
        ("y", "Y", "low", 1),
        ("z", "z", "high", 3),
        (None, None, None, None),
        ("X", "x", None, None),
    ]


def test_null_groups_stay(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, x int")
    assert table(df.groupBy("g").agg(F.sum("x"))) == [("a", 3), (None, 3)]
