import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import table
from furrow.operators import ordering
from furrow.operators.quantile import flag_below_quantile, median_strict, mode_first, weighted_quantile


def test_ordinal_equals_global_row_number(spark):
    df = spark.range(0, 997).select(((F.col("id") * 7919) % 1009).alias("k"), (F.col("id") % 3).alias("g"))
    got = ordering.ordinal(df, "k", ["g"], total="n", buckets=16, descending=("g",))
    want = F.row_number().over(Window.orderBy(F.col("g").desc(), "k")) - 1
    assert got.withColumn("w", want).filter((F.col("w") != F.col("ordinal")) | (F.col("n") != 997)).count() == 0


@pytest.mark.parametrize("n", [10, 11, 19, 97, 3])
def test_contiguous_folds(spark, n):
    df = spark.range(n).select("id", (F.col("id") % 2).alias("label"))
    rows = sorted(ordering.kfold(df, 10, "id", ["label"]).collect(), key=lambda r: (r.label, r.id))
    folds = [r.fold for r in rows]
    assert folds == sorted(folds) and len(folds) == n
    sizes = [folds.count(f) for f in range(10)]
    assert max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)


def test_stratified_folds_keep_shares(spark):
    df = spark.range(103).select("id", (F.col("id") % 4 == 0).cast("int").alias("label"))
    sizes = ordering.stratified_kfold(df, 5, "id", "label").groupBy("label", "fold").count().collect()
    for label in (0, 1):
        counts = [r["count"] for r in sizes if r.label == label]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1


def test_splits(spark):
    df = spark.range(1000)
    exact = ordering.split_rows(df, "id", 0.25, seed=3, method="exact")
    assert exact.filter("is_test").count() == 250
    hashed = ordering.split_rows(df, "id", 0.25, seed=3)
    assert 200 < hashed.filter("is_test").count() < 300
    assert table(hashed) == table(ordering.split_rows(df, "id", 0.25, seed=3))


def test_orders(spark):
    df = spark.createDataFrame([("a", 1), ("b", 5), ("a", 1), ("c", 5), (None, 9)], "c string, n int")
    got = {r.c: r.category_ord for r in ordering.category_order(df, "c", F.sum("n")).collect()}
    assert got == {None: 1, "b": 2, "c": 3, "a": 4}
    fixed = [r[0] for r in df.orderBy("n", "c").select(ordering.fixed_order("c", ["b", "a"])).collect()]
    assert sorted(fixed, key=str) == [1, 2, 2, None, None]
    assert [(r.c, r.ix) for r in ordering.reverse_index(df.filter("c is not null"), [F.col("c"), F.col("n")], 3).collect()] == [("a", 4), ("a", 3), ("b", 2)]


def brute_quantile(pairs, q):
    pairs = sorted((x, w) for x, w in pairs if x is not None and x == x and w)
    total, run = sum(w for _, w in pairs), 0.0
    for x, w in pairs:
        run += w
        if run / total >= q:
            return x
    return None


@pytest.mark.parametrize("buckets", [1, 4, 64])
def test_weighted_quantile_with_hot_group(spark, buckets):
    rows = []
    for i in range(3000):
        group = "hot" if i % 3 else (None if i % 2 else f"g{i % 7}")
        x = None if i % 50 == 0 else float("nan") if i % 51 == 0 else float((i * 37) % 211)
        w = None if i % 40 == 0 else float((i * 13) % 5)
        rows.append((group, x, w))
    df = spark.createDataFrame(rows, "g string, x double, w double")
    for q in (0.0, 0.4, 0.9):
        got = {r.g: r.threshold for r in weighted_quantile(df, "x", "w", q, ["g"], buckets=buckets).collect()}
        groups = {}
        for g, x, w in rows:
            groups.setdefault(g, []).append((x, w))
        assert got == {g: brute_quantile(p, q) for g, p in groups.items()}


def test_quantile_of_equal_weights_is_percentile_disc(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), ((F.col("id") * 31) % 97).cast("double").alias("x"), F.lit(1.0).alias("w"))
    got = table(weighted_quantile(df, "x", "w", 0.4, ["g"], buckets=8))
    want = table(df.groupBy("g").agg(F.expr("percentile_disc(0.4) within group (order by x)")))
    assert got == want


def test_flag_and_group_without_weight(spark):
    rows = [("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 3.0, 1.0), ("a", None, 1.0), ("b", 1.0, None)]
    df = spark.createDataFrame(rows, "g string, x double, w double")
    got = table(flag_below_quantile(df, "x", "w", 0.4, ["g"], "t", "f").select("g", "x", "t", "f"))
    assert got == [("a", 1.0, 2.0, 1), ("a", 2.0, 2.0, 1), ("a", 3.0, 2.0, 0), ("a", None, 2.0, None), ("b", 1.0, None, None)]


def test_median_strict(spark):
    rows = [("a", 1.0), ("a", 3.0), ("a", 3.0), ("a", 10.0), ("b", 1.0), ("b", None), ("c", None), ("d", 5.0), ("d", 7.0), ("d", 6.0),
            ("e", float("nan")), ("e", 1.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    for buckets in (1, 3):
        got = table(median_strict(df, "x", ["g"], buckets=buckets))
        assert got == [("a", 3.0), ("b", None), ("c", None), ("d", 6.0), ("e", None)]


def test_mode_first_seen_wins_ties(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "y"), ("a", 4, "x"), ("b", 1, None), ("b", 2, None), ("b", 3, "z"), ("c", 2, "q"), ("c", 1, "p")]
    df = spark.createDataFrame(rows, "k string, layer int, v string")
    assert table(mode_first(df, ["k"], "v", "layer")) == [("a", "x"), ("b", None), ("c", "p")]


@pytest.mark.parametrize("buckets", [2, 7, 512])
def test_place_in_composite_orders_is_the_same_for_any_number_of_ranges(spark, buckets):
    rows = [(f"k{i * 7919 % 13}" if i % 11 else None, float(i % 5) if i % 3 else float("nan"), i) for i in range(600)]
    df = spark.createDataFrame(rows, "s string, x double, i int")
    order = [F.col("x").desc_nulls_last(), F.col("s").asc_nulls_first(), F.col("i")]
    got = ordering.place(df, order, "p", buckets=buckets, total="n")
    want = F.row_number().over(Window.orderBy(*order)) - 1
    assert got.withColumn("w", want).filter("w <> p or n <> 600").count() == 0
    inside = ordering.place(df, order, "p", by=["s"], total="n", buckets=buckets)
    groups = Window.partitionBy("s")
    checked = inside.withColumns({"w": F.row_number().over(groups.orderBy(*order)) - 1, "m": F.count(F.lit(1)).over(groups)})
    assert checked.filter("w <> p or n <> m").count() == 0 and checked.count() == 600


def test_equal_rows_are_spread_over_the_ranges(spark):
    df = spark.range(0, 4000, 1, 8).select(F.lit("hot").alias("k"), F.lit(1).alias("v"))
    stored = ordering.ranged(df, [F.col("k")], 8)
    sizes = [r["count"] for r in stored.groupBy(ordering.range_of()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 900
    assert sorted(r[0] for r in ordering.place(df, [F.col("k")], "p", buckets=8).select("p").collect()) == list(range(4000))


def test_place_of_nothing_and_one_row(spark):
    empty = spark.createDataFrame([], "k string, v int")
    assert ordering.place(empty, [F.col("v")], "p", by=["k"], total="n").collect() == []
    assert ordering.place(empty, [F.col("v")], "p", total="n").collect() == []
    assert [tuple(r) for r in ordering.place(empty.unionAll(spark.sql("select null, 3")), [F.col("v")], "p", by=["k"], total="n").collect()] == [(None, 3, 0, 1)]


def test_folds_and_splits_are_the_same_for_any_number_of_ranges(spark):
    df = spark.range(200).select("id", (F.col("id") % 3).cast("int").alias("label"))
    for make in (
        lambda n: ordering.kfold(df, 7, "id", ["label"], buckets=n, descending=("label",)),
        lambda n: ordering.stratified_kfold(df, 4, "id", "label", buckets=n),
        lambda n: ordering.split_rows(df, "id", 0.3, seed=1, method="exact", buckets=n),
    ):
        assert table(make(2)) == table(make(7)) == table(make(512))


def test_no_row_is_numbered_in_one_task(spark):
    df = spark.range(300).select("id", (F.col("id") % 3).alias("g"))
    for made in (ordering.place(df, [F.col("id")], by=["g"]), ordering.reverse_index(df, [F.col("id")]), ordering.kfold(df, 3, "id", ["g"])):
        text = made._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in text and "SinglePartition" not in text


class Reads:
    """Rows that a frame yields each time it is computed."""

    def __init__(self, spark, df):
        self.count = spark.sparkContext.accumulator(0)
        seen = self.count

        def tell(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        self.df = df.mapInArrow(tell, df.schema)


def test_inputs_are_computed_once(spark):
    base = spark.range(0, 500, 1, 4).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 37).cast("double").alias("x"), F.lit(1.0).alias("w"))
    for use in (
        lambda df: weighted_quantile(df, "x", "w", 0.4, ["g"]),
        lambda df: median_strict(df, "x", ["g"]),
        lambda df: flag_below_quantile(df, "x", "w", 0.4, ["g"], "t", "f"),
        lambda df: ordering.kfold(df, 5, "id", ["g"]),
    ):
        reads = Reads(spark, base)
        use(reads.df).collect()
        assert reads.count.value == 500


def test_quantiles_are_the_same_for_any_number_of_ranges(spark):
    df = spark.range(900).select((F.col("id") % 4).alias("g"), ((F.col("id") * 31) % 97).cast("double").alias("x"), ((F.col("id") * 7) % 5).cast("double").alias("w"))
    assert table(weighted_quantile(df, "x", "w", 0.4, ["g"], buckets=2)) == table(weighted_quantile(df, "x", "w", 0.4, ["g"], buckets=7)) == table(weighted_quantile(df, "x", "w", 0.4, ["g"], buckets=512))
    assert table(median_strict(df, "x", ["g"], buckets=2)) == table(median_strict(df, "x", ["g"], buckets=512))
