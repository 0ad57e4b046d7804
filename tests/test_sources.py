import json

import pytest

from pyspark.sql import functions as F

from conftest import table
from furrow.operators.grid import GridSpec
from furrow.operators.polygons import edges_of
from furrow.sources import layers, tables

HEADER = [f"Lead {i}" for i in range(16)] + ["Response Type"] + [
    "Enumerator", "Study", "Title", "Inclusion", "Scale", "Region", "Country", "Crops", "Type", "Interventions", "Sentiment score",
    "Outcomes", "Full design", "Full design other", "Impacts", "Gender", "Topic 1", "Some text",
]


def survey_row(kind, study, inclusion="Yes", country="", crops="", types="", inter="", out="", impacts="", gender="", title="t"):
    return ["x"] * 16 + [kind, "me", study, title, inclusion, "s", "r", country, crops, types, inter, "0.1", out, "d", "o", impacts, gender, "q", "w"]


def write_survey(path, rows):
    quote = lambda v: '"' + v.replace('"', '""') + '"'
    head = [[f"Q{i}" for i in range(len(HEADER))], HEADER, ["meta"] * len(HEADER)]
    path.write_text("\n".join(",".join(quote(v) for v in r) for r in head + rows) + "\n")


def test_survey(spark, tmp_path):
    folder = tmp_path / "survey"
    folder.mkdir()
    write_survey(folder / "one.csv", [
        survey_row("IP Address", "7", title='two\nlines, "quoted"'), survey_row("Survey Preview", "8"), survey_row("", "9"),
    ])
    write_survey(folder / "two.csv", [survey_row("Anonymous", "abc", "No")])
    got = tables.read_survey(spark, str(folder), HEADER, "Response Type")
    assert [r.study_id for r in got.orderBy("study_id").collect()] == ["7", "9", "abc"]
    assert got.filter("study_id = '7'").first().title == 'two\nlines, "quoted"'
    assert got.columns[:4] == ["enumerator", "study_id", "title", "inclusion"] and len(got.columns) == 15


QUOTED = (
    'i,s,x\n1,"two\nlines, ""quoted""",1.5\n\n2,"",\n3,plain,bad\n4,"a\n\n\n"",b""\n",2\n5,"ünï\ncödé",NA\r\n'
    '6,NA,7\r\n"7","' + "long\n" * 30 + '",8\n8,last,9'
)


@pytest.mark.parametrize("bytes_a_block", [1, 2, 3, 7, 16, 61, 128 << 20])
def test_split_scan_of_quoted_line_breaks(spark, tmp_path, bytes_a_block):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes(QUOTED.encode())
    (tmp_path / "in" / "b.csv").write_bytes(b'i,s,x\n9,"z\n",1\n')
    (tmp_path / "in" / "c.csv").write_bytes(b"")
    schema = "i int, s string, x double"
    want = table(tables.read_table(spark, str(tmp_path / "in"), schema, multiline=True))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(bytes_a_block))
    try:
        records = tables.quoted_records(spark, str(tmp_path / "in"))
        got = table(tables.read_table(spark, str(tmp_path / "in"), schema, multiline="split"))
        places = sorted((r.file[-5:], r.place) for r in records.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(want) == 9 and got == want
    assert places == [("a.csv", i) for i in range(9)] + [("b.csv", i) for i in range(2)]


def test_survey_split_is_the_reader_of_one_task(spark, tmp_path):
    (tmp_path / "s").mkdir()
    for name in "ab":
        rows = [survey_row("IP Address", f"{name}{i}", title="t\n" * (i % 4) + '"q"') for i in range(12)]
        write_survey(tmp_path / "s" / f"{name}.csv", rows)
    whole = table(tables.read_survey(spark, str(tmp_path / "s"), HEADER, "Response Type", split=False))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        assert table(tables.read_survey(spark, str(tmp_path / "s"), HEADER, "Response Type")) == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(whole) == 24


def test_csv_round_trip_and_handoff(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', 1.5), (2, None, None), (3, "", 0.0)], "i int, s string, x double")
    path = str(tmp_path / "csv")
    tables.write_table(df, path, "csv")
    assert table(tables.read_table(spark, path, df.schema)) == table(df)
    assert table(tables.hand_off(df, str(tmp_path))) == table(df)
    meta = spark.createDataFrame([(1, 2001), (None, 2002)], "id int, year int")
    tables.write_table(meta, str(tmp_path / "meta"), "csv")
    assert tables.read_metadata(spark, str(tmp_path / "meta")).columns == ["study_id", "year"]


def test_layers_and_cube(spark, tmp_path):
    grid = GridSpec(0.0, 2.0, 1.0, 2, 2)
    one = spark.createDataFrame([(0, 1.0), (3, 2.0), (9, 5.0)], "cell_id bigint, value double")
    one.write.parquet(str(tmp_path / "layer"))
    assert table(layers.read_layer(spark, str(tmp_path / "layer"), grid, on_outside="drop")) == [(0, 1.0, 0, 0), (3, 2.0, 1, 1)]
    with pytest.raises(Exception, match="cell id outside the grid"):
        layers.read_layer(spark, str(tmp_path / "layer"), grid).collect()
    cube = spark.createDataFrame([(0, "1995-12-31", 1.0), (0, "1996-01-01", 2.0), (1, "2005-12-31", 3.0), (1, "2006-01-01", 4.0)], "cell_id bigint, ts string, value double")
    layers.write_cube(cube.withColumn("ts", F.to_date("ts")), str(tmp_path / "cube"))
    got = layers.read_cube(spark, str(tmp_path / "cube"), grid, "1996-01-01", "2005-12-31")
    assert [r.value for r in got.orderBy("value").collect()] == [2.0, 3.0]
    assert "PartitionFilters: [isnotnull(year" in got._jdf.queryExecution().executedPlan().toString()


def test_many_layer_files(spark, tmp_path):
    for i, name in enumerate(["b_size", "a_size"]):
        df = spark.createDataFrame([(0, float(i))], "cell_id bigint, value double").coalesce(1)
        df.write.parquet(str(tmp_path / f"w{i}"))
        part = next((tmp_path / f"w{i}").glob("part-*.parquet"))
        (tmp_path / "all").mkdir(exist_ok=True)
        (tmp_path / "all" / f"{name}.parquet").write_bytes(part.read_bytes())
    (tmp_path / "all" / "note.txt").write_text("no layer")
    assert table(layers.read_layers(spark, str(tmp_path / "all"), "*.parquet")) == [(1, 0, 1.0), (2, 0, 0.0)]


def test_polygons(spark, tmp_path):
    square = [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]
    features = [
        {"type": "Feature", "properties": {"feature_id": 1, "iso": "A"}, "geometry": {"type": "Polygon", "coordinates": square}},
        {"type": "Feature", "properties": {"feature_id": 2, "iso": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [square, square]}},
    ]
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    (tmp_path / "b.json").write_text("\n".join(json.dumps(f) for f in features))
    schema = "feature_id bigint, iso string"
    rings, attributes = layers.read_polygons(spark, str(tmp_path / "a.json"), schema, multiline=True)
    lines = layers.read_polygons(spark, str(tmp_path / "b.json"), schema, multiline=False)
    assert table(attributes) == [(1, "A"), (2, "B")] == table(lines[1])
    assert table(rings.select("feature_id", "ring")) == [(1, 0), (2, 0), (2, 1)]
    assert table(layers.vertices(rings)) == table(layers.vertices(lines[0])) and layers.vertices(rings).count() == 15
    assert edges_of(rings).filter("y1 != y2").count() == 6
