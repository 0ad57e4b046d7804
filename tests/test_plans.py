"""End to end: a small study through every product."""

import pytest
from pyspark.sql import functions as F

from conftest import table
from furrow.operators.grid import GridSpec
from furrow.operators.polygons import edges_of
from furrow.plans import classifier, irrigation, review
from furrow.sources import tables
from test_farms import SCHEMA, cells
from test_sources import HEADER, survey_row, write_survey


@pytest.fixture(scope="module")
def study(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("study")
    (folder / "in").mkdir()
    write_survey(folder / "in" / "s.csv", [
        survey_row("IP", "1", country="India, Laos", crops="Crop", types="Observational, primary data", inter="Conservation,Labor",
                   out="Crop yield,Income/expenditure", impacts="Climate change,Other"),
        survey_row("IP", "2", country=" india", crops="Mixed,Crop", types="Experimental, primary data,Review", inter="Seeds", out="Productivity",
                   gender="Gender"),
        survey_row("IP", "3.7", crops="Livestock", inter="Seeds", impacts=",Water quantity", gender="No"),
        survey_row("IP", "4", "No", country="Kenya", crops="Crop"),
        survey_row("IP", "abc", country="Kenya", inter="Seeds", out="Income/expenditure", crops="Crop"),
        survey_row("Survey Preview", "5", country="Kenya"),
        survey_row("IP", "6", out="Other", inter="Other"),
    ])
    survey = tables.read_survey(spark, str(folder / "in"), HEADER, "Response Type")
    long = tables.hand_off(review.keyword_long(survey), str(folder), "long")
    metadata = spark.createDataFrame([(1, 2001), (2, 2004), (3, None), (6, 2001)], "study_id int, year int")
    classes = spark.createDataFrame(
        [("IND", "India", "South Asia"), ("IND", "India", "World"), ("KEN", "Kenya", "Sub-Saharan Africa"), ("LAO", "Lao PDR", "East Asia & Pacific")],
        "country_code string, country_name string, group_name string",
    )
    return survey, long, metadata, classes


def test_keyword_long(spark, study):
    _, long, _, _ = study
    got = table(long)
    assert (1, "type of study", "observational primary data") in got and (2, "type of study", "experimental primary data") in got
    assert (3, "environmental impacts", "water quantity") in got and (3, "environmental impacts", "no") not in got
    assert (None, "interventions", "seeds") in got and not [r for r in got if r[0] == 4]
    assert (1, "country", " laos") in got


def test_countries_and_needs(spark, study):
    _, long, _, classes = study
    counts = review.country_counts(long, classes)
    assert table(counts) == [("India", 2, "IND"), ("Kenya", 1, "KEN"), ("Laos", 1, "LAO")]
    rows = [("Water Scarce", "IND", "India", "Low income", "Small-scale", 2e6), ("Water Scarce", "LAO", "Laos", "Low income", "Small-scale", 2e6),
            ("Water Scarce", "XXX", "United Republic of Tanzania", "Low income", "Small-scale", 1e6), ("Water Scarce", "YYY", "Y", "Low income", "Small-scale", None),
            ("Not Water Scarce", "ZZZ", "Z", "Low income", "Small-scale", 9e6), ("Water Scarce", None, "N", "Upper middle income", "Small-scale", 5.0)]
    farms = spark.createDataFrame(rows, "water_scarce string, iso3_usable string, country string, income_group string, size string, tot_fs double")
    got = [(r.country, r.n, r.ix, r.income_group, r["size"]) for r in review.funding_needs(farms, counts, n=1).collect()]
    assert got == [("India", 2, 3, "Low Income", "Small-Scale Farms"), ("Laos", 1, 2, "Low Income", "Small-Scale Farms"), ("N", 0, 1, "Upper Middle Income", "Small-Scale Farms")]
    assert {r.country for r in review.funding_needs(farms, counts).collect()} == {"India", "Laos", "Tanzania", "N"}


def test_matrix(spark, study):
    got = {(r.outcome, r.intervention, r.studytype): r.value for r in review.outcome_matrix(study[1]).collect()}
    assert got == {
        ("Yield", "Natural Resource\nProtection", "Observational"): 1,
        ("Income/Expenditure", "Natural Resource\nProtection", "Observational"): 1,
        ("Yield", "Seeds", "Experimental"): 1,
        ("Yield", "Seeds", "Review"): 1,
    }


def test_series(spark, study):
    survey, long, metadata, _ = study
    systems = {(r.system, r.year): r.cumulative for r in review.system_series(long, metadata).collect()}
    assert systems[("Crop", 2003)] == 1 and systems[("Crop", 2004)] == 2 and systems[("Mixed", 2001)] == 0
    assert systems[("Livestock", 2004)] == 0 and len(systems) == 12
    themes = review.theme_series(long, review.included_studies(survey), metadata)
    got = {(r.theme, r.year): (r.cumulative, r.theme_ord) for r in themes.collect()}
    assert got[("No Cross-Cutting Theme", 2001)] == (1, 2) and got[("Environmental Impacts", 2004)] == (1, 1) and got[("Gender", 2004)] == (1, 3)
    impacts = review.impact_series(long, metadata)
    assert {r.impact for r in impacts.collect()} == {"GHG Emissions", "Water Quantity"}
    shares = review.intervention_shares(long, metadata)
    assert {(r.intervention, r.year): r.pc for r in shares.collect()}[("Natural-Resource Protection", 2001)] == pytest.approx(100 / 3)
    sums = shares.groupBy("year").agg(F.sum("pc").alias("s")).collect()
    assert all(r.s == pytest.approx(100) for r in sums)
    assert table(review.outcome_counts(long, metadata)) == [(2001, "Income/Expenditure", 1), (2001, "Yield", 1), (2004, "Yield", 1), (None, "Income/Expenditure", 1)]


def test_irrigation_products(spark, study):
    classes = study[3]
    rows = [
        ("Water Scarce", "IND", "India", "Low income", "Small-scale", 1.0, 1.0, 10.0, 5.0, 10.0, 20.0),
        ("Water Scarce", "KEN", "Kenya", "Low income", "Small-scale", 3.0, 1.0, 30.0, 5.0, 10.0, 20.0),
        ("Not Water Scarce", "KEN", "Kenya", "Low income", "Small-scale", 0.0, 1.0, 0.0, 5.0, 20.0, 10.0),
        ("Water Scarce", "LAO", "Laos", "Low income", "Not small-scale", 1.0, 1.0, float("inf"), 5.0, 0.0, 20.0),
        ("Water Scarce", None, "Laos", "Low income", None, 1.0, 1.0, 1.0, 5.0, 1.0, None),
        ("Water Scarce", "IND", "India", "Low income", "Not small-scale", 1.0, 1.0, float("nan"), 5.0, 0.0, 20.0),
    ]
    farms = spark.createDataFrame(rows, "water_scarce string, iso3_usable string, country string, income_group string, size string, t_irr_fs double, t_irr_ag double, p_irr_fs double, p_irr_ag double, tot_fs double, tot_ag double")
    by_region = review.farms_by_region(farms, classes)
    got = {(r.group_name, r.water_scarce): (r.p_irr_fs, r.group_ord) for r in review.region_shares(by_region).collect()}
    assert got == {
        ("All LMIC Countries", "Water Scarce"): (20.0, 1), ("All LMIC Countries", "Not Water Scarce"): (0.0, 1),
        ("South Asia", "Water Scarce"): (10.0, 2), ("Sub-Saharan Africa", "Water Scarce"): (30.0, 3), ("Sub-Saharan Africa", "Not Water Scarce"): (0.0, 3),
    }
    assert review.country_shares(by_region).count() == 3
    assert table(review.size_shares(by_region)) == [("Small-scale", 10.0)]
    assert ("Small-scale", "Water Scarce", 50.0, 80.0) in table(review.scarce_shares(by_region))


def test_overlay(spark):
    src = GridSpec.degrees(1)
    every = src.cells(spark)
    layer = lambda c: (every.select("cell_id", c.cast("double").alias("value")), src)
    layers = {
        "fs": layer(F.col("col") % 5 + 1), "months": layer(F.col("row") % 2), "world": layer(F.col("col") % 3), "rain": layer(F.lit(30.0)),
        "gdp_pc": layer(F.col("row") + 1), "irri_area": layer(F.lit(2.0)), "paddy_area": layer(F.lit(1.0)), "rainfed_area": layer(F.lit(4.0)),
    }
    lookup = spark.createDataFrame([(0, 2, "X", "later"), (0, 1, "AAA", "Aa"), (1, 3, "BBB", "Bb")], "id int, seq int, iso3 string, country string")
    incomes = spark.createDataFrame([("AAA", "Low income"), ("BBB", "High income")], "code string, income_group string")
    target = GridSpec.equal_area(500_000.0, dx=137.0, dy=-211.0)
    frame = irrigation.overlay_frame(layers, target, lookup, incomes).cache()
    assert frame.count() == target.nrow * target.ncol
    assert frame.filter("iso3 = 'AAA' and income_group = 'Low income'").count() > 100
    assert frame.filter("country = 'later'").count() == 0
    country, whole = irrigation.summaries(frame)
    assert {r["size"] for r in country.collect()} >= {"Small-scale", "Not small-scale"}
    assert irrigation.paddy_sensitivity(frame).select("allocation").distinct().count() == 3


def test_layers_of_the_frame(spark):
    cube = spark.createDataFrame([(0, "2000-01-01", 1.0), (0, "2000-02-01", 3.0)], "cell_id bigint, ts string, value double").withColumn("ts", F.to_date("ts"))
    rain, spec = irrigation.rain_layer(cube, GridSpec(0.0, 90.0, 1.0, 180, 360))
    assert table(rain) == [(180, 2.0)] and spec.xmin == -180.0
    pop = spark.createDataFrame([(1, 0.5, 0.5, 2.0)], "gID bigint, px double, py double, p double")
    gdp = spark.createDataFrame([(1, 0.5, 0.5, 8.0)], "gID bigint, px double, py double, g double")
    corners = [{"x": x, "y": y} for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))]
    rings = spark.createDataFrame([(1, corners)], "feature_id bigint, points array<struct<x: double, y: double>>")
    got = irrigation.product_layer(pop, gdp, edges_of(rings), GridSpec(0.0, 2.0, 0.5, 4, 4), "p", "g")
    assert table(got) == [(8, 4.0), (9, 4.0), (12, 4.0), (13, 4.0)]


def test_paddy_from_cell_frame(spark):
    frame = spark.createDataFrame(cells(3), SCHEMA)
    assert irrigation.classified_cells(frame).count() == frame.count()


def test_classifier_comparison(spark):
    make = lambda words, start: spark.createDataFrame(
        [(start + i, "Abstract: " + (words + " ") * 40 + f"extra{i % 3} #tail") for i in range(24)], "doc_id bigint, text string"
    )
    got = classifier.compare_classifiers(
        make("water soil crop", 0), make("metal engine noise", 100), "doc_id", folds=3, inner=2,
        svm_grid={"C": [1.0], "kernel": ["rbf"], "gamma": [1.0]}, stratified=True, features=64, max_iter=12,
    )
    rows = {r.model: r for r in got.collect()}
    assert set(rows) == {"svm", "nb", "neural"} and rows["nb"].mean_accuracy == 1.0 and rows["nb"].std_f1 == 0.0
