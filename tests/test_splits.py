"""GeoJSON files cut into byte ranges at any place."""

import json
import random

import pytest

from milepost.sources.tables import read_events

ODD = ["plain", "}{", '"', '\\"}', "{\\", "a\\\\", "é}\u2028{", "", "]}", '{"type":"Feature"}']


def feature(n, text):
    return {"type": "Feature", "properties": {"n": n, "text": text, "deep": {"a": [{"b": text}]}}, "geometry": {"type": "LineString", "coordinates": [[n, 0], [n, 1]]}}


@pytest.mark.parametrize("split", [37, 256, 1 << 20])
@pytest.mark.parametrize("indent", [None, 1])
def test_each_feature_once_wherever_the_file_is_cut(spark, tmp_path, split, indent):
    r = random.Random(split)
    texts = [r.choice(ODD) for _ in range(40)]
    top = {"name": 'x{"}', "type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "EPSG:4326"}}, "features": [feature(n, t) for n, t in enumerate(texts)], "after": {"type": "none"}}
    (tmp_path / "a b+%.geojson").write_text(json.dumps(top, indent=indent, ensure_ascii=bool(split % 2)))
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        found = read_events(spark, f"{tmp_path}/a b+%.geojson").collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert sorted(x["n"] for x in found) == list(range(40))
    assert {int(x["n"]): x["text"] or "" for x in found} == dict(enumerate(texts))
    assert all(x["geometry"]["parts"][0][0]["x"] == x["n"] and json.loads(x["deep"]) == {"a": [{"b": texts[int(x["n"])]}]} for x in found)


def test_folders_of_collections_features_and_geometries(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    point = {"type": "Point", "coordinates": [5, 6]}
    for name, top in (("a b", {"type": "FeatureCollection", "features": [feature(1, "x"), feature(2, "y")]}), ("one", feature(3, "}")), ("bare", point), ("none", {"type": "FeatureCollection", "features": []}), ("null", {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": None, "geometry": None}]})):
        (folder / f"{name}.geojson").write_text("\ufeff" * (name == "a b") + json.dumps(top) + "\n")
    from milepost.sources.tables import read_geojson

    found = read_geojson(spark, str(folder)).collect()
    assert sorted((x["n"] or 0, (x["geometry"] or {"type": "-"})["type"]) for x in found) == [(0, "-"), (0, "Point"), (1, "LineString"), (2, "LineString"), (3, "LineString")]


CELLS = ["plain", "a,b", "two\nlines", "\n\n", 'say "x"', '"\n"', ",\n\",", "é ", " ", "a\r\nb", '"', "\n"]


def cut_small(spark, split):
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    return before


@pytest.mark.parametrize("split", [23, 200, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_each_record_once_wherever_the_csv_is_cut(spark, tmp_path, split, end):
    import csv

    r = random.Random(split)
    rows = [[str(n), r.choice(CELLS), r.choice(CELLS)] for n in range(60)]
    with open(tmp_path / "t.csv", "w", newline="", encoding="utf-8-sig") as f:
        out = csv.writer(f, lineterminator=end)
        out.writerow(["n", 'the "text"\nof it', "c"])
        out.writerows(rows[:30])
        # quotes within a field without quotes are text
        f.write(f'100,5" pipe,"6"" pipe"{end}{end}101,a"b"c,x"{end}')
        out.writerows(rows[30:])
    from milepost.sources.tables import read_csv

    before = cut_small(spark, split)
    try:
        df = read_csv(spark, f"{tmp_path}/t.csv", numbers=False)
        assert df.columns == ["n", 'the "text"\nof it', "c"]
        found = sorted((int(x[0]), x[1], x[2]) for x in df.collect())
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert found == sorted([(int(a), b, c) for a, b, c in rows] + [(100, '5" pipe', '6" pipe'), (101, 'a"b"c', 'x"')])


def test_csv_files_without_line_breaks_in_fields_and_old_line_ends(spark, tmp_path):
    from milepost.sources.tables import read_csv

    (tmp_path / "a.csv").write_text('n, t \n1,"x, ""y"""\n\n2,5" pipe\n3,\n4,"z"\n')
    plain = read_csv(spark, f"{tmp_path}/a.csv")
    assert plain.columns == ["n", "t"]
    assert sorted((x["n"], x["t"] or "") for x in plain.collect()) == [(1.0, 'x, "y"'), (2.0, '5" pipe'), (3.0, ""), (4.0, "z")]
    (tmp_path / "old.csv").write_bytes(b'n,t\r1,"a\rb"\r2,c\r')
    assert sorted((x["n"], x["t"]) for x in read_csv(spark, f"{tmp_path}/old.csv").collect())[1] == (2.0, "c")
    (tmp_path / "head.csv").write_text("n,t\n")
    assert read_csv(spark, f"{tmp_path}/head.csv").count() == 0
    (tmp_path / "open.csv").write_text('n,t\n1,"a\n2,b\n')
    assert [(x["n"], x["t"]) for x in read_csv(spark, f"{tmp_path}/open.csv", numbers=False).collect()] == [("1", "a\n2,b")]


@pytest.mark.parametrize("range_bytes", [1, 700, 1 << 20])
def test_each_shape_once_wherever_the_layer_is_cut(spark, tmp_path, range_bytes):
    import zipfile

    from pyspark.sql import types as T

    from milepost.functions.geometry import GEOMETRY
    from milepost.sources import formats
    from milepost.sources.shapes import ShapefileSource
    from milepost.sources.tables import read_shape

    line = lambda n: {"type": "LineString", "parts": [[{"x": float(n + k), "y": float(k), "z": None, "m": None} for k in range(2 + n % 5)]]}
    schema = T.StructType([T.StructField("N", T.DoubleType()), T.StructField("NOTE", T.StringType()), T.StructField("geometry", GEOMETRY)])
    formats.write_shapefile(f"{tmp_path}/a.zip", schema, [{"N": float(n), "NOTE": f"é{n}" if n % 3 else None, "geometry": line(n)} for n in range(50)], "")
    (tmp_path / "a b%").mkdir()
    with zipfile.ZipFile(f"{tmp_path}/a.zip") as z:
        z.extractall(tmp_path / "a b%")
    shp = f"{tmp_path}/a b%/a.shp"
    dbf = bytearray((tmp_path / "a b%" / "a.dbf").read_bytes())
    fields, count, header, width = formats._dbf_fields(bytes(dbf))
    dbf[header + 7 * width] = ord("*")
    # two records more than shapes
    dbf[4:8] = (52).to_bytes(4, "little")
    dbf = dbf[: header + 50 * width] + dbf[header : header + 2 * width]
    (tmp_path / "a b%" / "a.dbf").write_bytes(dbf)
    spark.dataSource.register(ShapefileSource)
    found = spark.read.format("shapefile").option("rangeBytes", range_bytes).load(shp)
    tasks = found.rdd.getNumPartitions()
    assert tasks == {1: 52, 700: -(-((tmp_path / "a b%" / "a.shp").stat().st_size + len(dbf)) // 700), 1 << 20: 1}[range_bytes]
    key = lambda r: (r["N"], r["NOTE"] or "", str(r["geometry"]))
    want = list(formats.shape_rows((tmp_path / "a b%" / "a.shp").read_bytes(), bytes(dbf)))
    rows = [r.asDict(True) for r in found.collect()]
    assert len(rows) == 51 and sorted(map(key, rows)) == sorted(map(key, want))
    assert sorted(key(r.asDict(True)) for r in read_shape(spark, shp).collect()) == sorted(map(key, want))
    few = spark.read.format("shapefile").schema("NOTE string, missing double").load(shp)
    assert few.columns == ["NOTE", "missing"] and sorted(r["NOTE"] or "" for r in few.collect()) == sorted(r["NOTE"] or "" for r in want)
    bare = spark.read.format("shapefile").options(dbf="").load(shp)
    assert bare.columns == ["geometry"] and bare.count() == 50
    (tmp_path / "a b%" / "a.shx").unlink()
    assert sorted(key(r.asDict(True)) for r in read_shape(spark, shp).collect()) == sorted(map(key, want))


def test_layers_written_by_many_tasks_hold_each_row_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from milepost.functions.geometry import line_of, vertex
    from milepost.sources.tables import read_shapefiles, to_shapefiles

    rows = spark.range(0, 300, 1, 5).select(
        F.col("id").alias("n"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("é"), "id")).alias("note"), F.array("id").alias("listed"),
        F.when(F.col("id") % 10 > 0, line_of(F.array(vertex(F.col("id"), F.lit(0)), vertex(F.lit(-1), F.col("id"))))).alias("geometry"),
    )
    path = f"file://{tmp_path}/out"
    to_shapefiles(rows, path, "GEOGCS[]", range_bytes=2000)
    files = sorted(f.name for f in (tmp_path / "out").iterdir())
    assert len(files) == 5 * len([f for f in files if f.endswith(".shp")]) > 25 and not any(f.startswith("_") for f in files)
    found = read_shapefiles(spark, path).collect()
    want = [n for n in range(300) if n % 10]
    assert sorted(r["n"] for r in found) == want
    assert all(r["note"] == (f"é{int(r['n'])}" if r["n"] % 3 else None) and r["listed"] == f"[{int(r['n'])}]" and r["geometry"]["parts"][0][1]["y"] == r["n"] for r in found)
    # a second write adds its layers
    to_shapefiles(rows.where("n = 1"), path, "")
    assert read_shapefiles(spark, path).count() == len(want) + 1
    with pytest.raises(ValueError, match="254 bytes in note"):
        to_shapefiles(rows.withColumn("note", F.repeat(F.lit("é"), 128)), f"{tmp_path}/long", "")
    with pytest.raises(ValueError, match="no row has a line"):
        to_shapefiles(rows.where("n % 10 = 0"), f"{tmp_path}/none", "")
    with pytest.raises(Exception, match="no .shp"):
        (tmp_path / "empty").mkdir()
        read_shapefiles(spark, f"{tmp_path}/empty").count()
