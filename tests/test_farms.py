import random

from pyspark.sql import functions as F

from conftest import table
from furrow.operators import farms

SCHEMA = (
    "cell_id bigint, iso3 string, country string, income_group string, fs double, months double, rain double, gdp_pc double, "
    "irri_area double, paddy_area double, rainfed_area double"
)


def test_scarcity_is_three_valued(spark):
    rows = [(None, 1.0, "Water Scarce"), (0.0, 1.0, "Water Scarce"), (None, 30.0, None), (0.0, None, None), (1.0, None, "Water Scarce"),
            (0.0, 20.8333, "Water Scarce"), (0.0, 20.84, "Not Water Scarce"), (float("nan"), 30.0, None)]
    df = spark.createDataFrame(rows, "m double, r double, want string").withColumn("got", farms.scarcity("m", "r"))
    assert df.filter(~F.col("got").eqNullSafe(F.col("want"))).count() == 0


def test_areas_and_counts(spark):
    rows = [(1, None, None, None, 2.0), (2, 0.0, 0.0, 0.0, 2.0), (3, 4.0, None, 2.0, 2.0), (4, None, 3.0, 5.0, None), (5, 1.0, 1.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "i int, irri_area double, paddy_area double, rainfed_area double, fs double")
    got = {r.i: (r.irri_area, r.rainfed_area, r.tot_area, r.tot_farms) for r in farms.farm_counts(farms.areas(df)).collect()}
    assert got == {1: (0.0, None, None, None), 2: (0.0, 0.0, None, None), 3: (4.0, 2.0, 6.0, 3.0), 4: (3.0, 5.0, 8.0, 0.0), 5: (2.0, 1.0, 3.0, 0.0)}
    none = farms.areas(df, "none").filter("i = 4").first()
    assert (none.irri_area, none.rainfed_area, none.tot_area) == (None, 5.0, 5.0)
    rain = farms.areas(df, "rainfed").filter("i = 4").first()
    assert (rain.irri_area, rain.rainfed_area, rain.tot_area) == (None, 8.0, 8.0)


def cells(seed=1, n=400):
    rng = random.Random(seed)
    out = []
    incomes = {"AAA": "Low income", "BBB": "High income", "CCC": "Upper middle income", "DDD": None, "EEE": "Lower middle income", None: None}
    for i in range(n):
        iso = rng.choice(["AAA"] * 8 + ["BBB", "CCC", "DDD", None])
        out.append((
            i, iso, iso and iso.title(), incomes[iso], rng.choice([None, 1.0, 2.0, 3.0, 5.0]), rng.choice([None, 0.0, 2.0]),
            rng.choice([None, 10.0, 50.0]), rng.choice([None, 100.0, 200.0, 300.0]), rng.choice([None, 0.0, 4.0]),
            rng.choice([None, 0.0, 2.0]), rng.choice([None, 0.0, 8.0]),
        ))
    # a country with two farm-size cells pools, one with three stands alone, at its own minimum
    for j, iso in enumerate(["EEE"] * 3 + ["FFF"] * 2):
        out.append((n + j, iso, iso, "Low income", 2.0, 0.0, 50.0, 100.0, 4.0, 0.0, 8.0))
    return out


def quantile(pairs):
    pairs = sorted((x, w) for x, w in pairs if x is not None and w)
    total, run = sum(w for _, w in pairs), 0.0
    for x, w in pairs:
        run += w
        if run / total >= 0.4:
            return x
    return None


def brute(rows):
    recs = []
    for (i, iso, _, income, fs, _, _, gdp, irri, paddy, rain) in rows:
        irri = (irri or 0) + (paddy or 0)
        area = irri + (rain or 0) or None
        farm = None if area is None else (irri / fs if fs else 0) + ((rain or 0) / fs if fs else 0)
        recs.append(dict(i=i, iso=iso, income=income, fs=fs, gdp=gdp, area=area, farm=farm))
    usable = {iso for iso in {r["iso"] for r in recs} if sum(r["iso"] == iso and r["fs"] is not None for r in recs) > 2}
    sizes = {}
    for group in {r["iso"] if r["iso"] in usable else None for r in recs}:
        mine = [r for r in recs if (r["iso"] if r["iso"] in usable else None) == group]
        t = quantile([(r["fs"], r["farm"]) for r in mine])
        for r in mine:
            r["b"] = None if r["fs"] is None or t is None else int(r["fs"] <= t)
            r["ga"] = r["gdp"] if r["b"] is not None else None
        tg = quantile([(r["ga"], r["farm"]) for r in mine])
        for r in mine:
            score = (r["b"] or 0) + (0 if r["ga"] is None or tg is None else int(r["ga"] <= tg))
            low = min((x["fs"] for x in mine if x["fs"] is not None), default=None)
            low_g = min((x["ga"] for x in mine if x["ga"] is not None), default=None)
            if t is None or tg is None:
                score = None
            else:
                score += (low == t) + (low_g == tg)
            ok = r["area"] is not None and r["fs"] is not None and r["income"] in ("Low income", "Lower middle income", "Upper middle income")
            sizes[r["i"]] = None if not ok or score is None else "Small-scale" if score >= 2 else "Not small-scale"
    return sizes


def test_small_scale_against_brute_force(spark):
    rows = cells()
    frame = spark.createDataFrame(rows, SCHEMA)
    got = farms.classify_small_scale(farms.prepare_cells(frame), buckets=4)
    assert {r.cell_id: r["size"] for r in got.collect()} == brute(rows)
    assert {r.iso3_usable for r in got.filter("iso3 in ('EEE', 'FFF')").collect()} == {"EEE", None}
    assert set(brute(rows).values()) == {"Small-scale", "Not small-scale", None}


def test_summaries_and_scenarios(spark):
    frame = spark.createDataFrame(cells(2), SCHEMA)
    classed = farms.classify_small_scale(farms.prepare_cells(frame))
    country, whole = farms.country_summary(classed), farms.global_summary(classed)
    assert country.columns[5:] == ["t_irr_fs", "t_irr_ag", "p_irr_fs", "p_irr_ag", "tot_fs", "tot_ag"]
    assert whole.filter("water_scarce is null or size is null").count() == 0
    scarce = frame.withColumn("water_scarce", farms.scarcity("months", "rain"))
    three = farms.global_summary(farms.classify_small_scale(farms.scenarios(scarce), by=["allocation"]), ["allocation"])
    same = three.filter("allocation = 'irrigation'").drop("allocation")
    rounded = lambda d: table(d.select("water_scarce", "size", *[F.round(c, 9) for c in d.columns[2:]]))
    assert rounded(same) == rounded(whole)
    assert three.select("allocation").distinct().count() == 3


def test_scenarios_share_one_profile(spark, monkeypatch):
    """The same rows as with the scenarios as groups, NaN included, and no profile of every cell three times over."""
    nan = float("nan")
    odd = [(900 + i, iso, iso, "Low income", fs, 0.0, 50.0, g, 4.0, None, nan if i == 3 else 2.0) for i, (iso, fs, g) in
           enumerate([("AAA", nan, 100.0), ("AAA", 0.0, nan), (None, 2.0, None), ("EEE", 1.0, 1.0), ("GGG", None, 5.0)])]
    rows = cells(3) + odd + cells(3)[:9]
    scarce = spark.createDataFrame(rows, SCHEMA).withColumn("water_scarce", farms.scarcity("months", "rain"))
    want = farms.classify_small_scale(farms.scenarios(scarce), by=["allocation"])
    read = []
    monkeypatch.setattr(farms, "cut", lambda df, keep=farms.cut: read.append(keep(df)) or read[-1])
    monkeypatch.setattr(farms, "release", lambda df: None)
    got = farms.classify_scenarios(scarce)
    assert str(table(got.select(want.columns))) == str(table(want))  # NaN as text
    profile = next(f for f in read if "__x" in f.columns)
    assert "allocation" not in profile.columns and profile.count() == profile.select("iso3", "measure", "__x").distinct().count()
