import os
import sqlite3
import struct
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from milepost.functions.crs import PRJ, parse_projection, project, to_wgs84
from milepost.functions.geometry import GEOMETRY, line_of, vertex
from milepost.jobs import parser, run_job
from milepost.sources.formats import short_names
from milepost.sources.tables import read_events, to_shapefile, write_events
from milepost.streaming.locate import locate_stream


def lonlat(spark, x, y, p):
    lon, lat = project(F.lit(float(x)), F.lit(float(y)), p)
    return spark.range(1).select(lon, lat).first()


def test_projections(spark):
    close = lambda got, want, tol=1e-3: all(abs(a - b) < tol for a, b in zip(got, want))
    assert close(lonlat(spark, 500000, 0, parse_projection(crs="EPSG:26917")), (-81, 0))
    assert close(lonlat(spark, 500000, 0, parse_projection(PRJ["EPSG:26916"])), (-87, 0))
    assert close(lonlat(spark, 656166.667, 0, parse_projection(crs="EPSG:2236")), (-81, 24.3333))
    assert close(lonlat(spark, 6378137, 0, parse_projection(crs="EPSG:3857")), (57.29578, 0))
    cone = 'PROJCS["x",GEOGCS["g"],PROJECTION["Lambert_Conformal_Conic"],PARAMETER["False_Easting",0.0],PARAMETER["False_Northing",0.0],PARAMETER["Central_Meridian",-96.0],PARAMETER["Standard_Parallel_1",33.0],PARAMETER["Standard_Parallel_2",45.0],PARAMETER["Latitude_Of_Origin",23.0],UNIT["Meter",1.0]]'
    # a worked example on the ellipsoid of 1866, so within its difference
    assert close(lonlat(spark, 1894410.9, 1564649.5, parse_projection(cone)), (-75, 35), 0.01)
    assert parse_projection(first_xy=(-81.0, 28.0)).kind == "geographic" and not parse_projection(first_xy=(5e5, 3e6)).convertible
    with pytest.raises(ValueError):
        project(F.lit(1.0), F.lit(1.0), parse_projection(first_xy=(5e5, 3e6)))
    g = spark.range(1).select(to_wgs84(line_of(F.array(vertex(F.lit(500000), F.lit(0), F.lit(1), F.lit(7)))), parse_projection(crs="EPSG:26917")).alias("g")).first()["g"]
    assert g["parts"][0][0]["m"] == 7.0


def table(spark):
    line = line_of(F.array(vertex(F.lit(0), F.lit(0)), vertex(F.lit(10), F.lit(0))))
    return spark.createDataFrame([("008", 0.0, 10.0, 'a "b", c')], "ROADWAY string, BEGIN_POST double, END_POST double, NOTE string").withColumn("geometry", line)


def test_csv_and_geojson_round_trip(spark, tmp_path):
    write_events(table(spark), f"{tmp_path}/t.csv")
    back = read_events(spark, f"{tmp_path}/t.csv")
    assert back.first().asDict() == dict(ROADWAY="008", BEGIN_POST=0.0, END_POST=10.0, NOTE='a "b", c')
    write_events(table(spark), f"{tmp_path}/t.geojson")
    row = read_events(spark, f"{tmp_path}/t.geojson").first()
    assert row["ROADWAY"] == "008" and row["END_POST"] == 10.0 and [v["x"] for v in row["geometry"]["parts"][0]] == [0.0, 10.0]
    (tmp_path / "g.geojson").write_text('{"type":"GeometryCollection","geometries":[{"type":"LineString","coordinates":[[0,0],[1,1]]},{"type":"Point","coordinates":[5,5]}]}')
    bare = read_events(spark, f"{tmp_path}/g.geojson").first()["geometry"]
    assert bare["type"] == "MultiLineString" and len(bare["parts"]) == 1
    with pytest.raises(ValueError):
        write_events(table(spark).drop("geometry"), f"{tmp_path}/x.geojson")
    with pytest.raises(ValueError):
        read_events(spark, f"{tmp_path}/x.xls")


def test_shapefile_round_trip(spark, tmp_path):
    to_shapefile(table(spark), f"{tmp_path}/roads.zip", PRJ["EPSG:26917"])
    row = read_events(spark, f"{tmp_path}/roads.zip").first()
    assert row["ROADWAY"] == "008" and row["END_POST"] == 10.0 and row["geometry"]["type"] == "LineString"
    assert "UTM" in zipfile.ZipFile(f"{tmp_path}/roads.zip").read("roads.prj").decode()
    assert short_names(["Intersecting A", "intersecting b"]) == {"Intersecting A": "Intersecti", "intersecting b": "intersect1"}
    with pytest.raises(ValueError):
        to_shapefile(table(spark).withColumn("geometry", F.lit(None).cast(table(spark).schema["geometry"].dataType)), f"{tmp_path}/none.zip", "")


def test_excel_and_geopackage(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = '<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>MP</t></is></c></row><row/><row><c r="A2" t="s"><v>1</v></c><c r="B2" t="b"><v>1</v></c><c r="C2"><v>2.5</v></c></row>'
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>ROADWAY</t></si><si><r><t>00</t></r><r><t>7</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{cells}</sheetData></worksheet>")
    assert read_events(spark, f"{tmp_path}/t.xlsx").first().asDict() == {"ROADWAY": "007", "COL_2": "true", "MP": 2.5}
    con = sqlite3.connect(tmp_path / "t.gpkg")
    con.execute("CREATE TABLE gpkg_geometry_columns (table_name, column_name)")
    con.execute("INSERT INTO gpkg_geometry_columns VALUES ('roads', 'geom')")
    con.execute("CREATE TABLE roads (fid INTEGER, ROADWAY TEXT, geom BLOB)")
    wkb = struct.pack("<BII4d", 1, 2, 2, 0.0, 0.0, 10.0, 0.0)
    con.execute("INSERT INTO roads VALUES (1, '008', ?)", (b"GP\0\1" + struct.pack("<i", 4326) + wkb,))
    con.commit()
    con.close()
    row = read_events(spark, f"{tmp_path}/t.gpkg").first()
    assert row["fid"] == 1 and row["ROADWAY"] == "008" and row["geometry"]["parts"][0][1]["x"] == 10.0


def test_jobs(spark, tmp_path):
    write_events(table(spark).drop("geometry"), f"{tmp_path}/a.csv")
    other = spark.createDataFrame([("8", 2.0, 4.0, "x")], "ROADWAY string, BEGIN_POST double, END_POST double, FLAG string")
    write_events(other, f"{tmp_path}/b.csv")
    run = lambda *a: run_job(spark, parser().parse_args([*a, "--input", f"{tmp_path}/a.csv"]))
    assert run("overlay", "--other", f"{tmp_path}/b.csv").count() == 3
    assert run("validate").count() == 0 and run("dissolve").count() == 1 and run("inspect").first()["usable"] == 1


def test_stream_of_points(spark, tmp_path):
    pts = spark.createDataFrame([("8", 3.0, 1), ("8", 30.0, 2)], "ROADWAY string, LOCATION double, ID int")
    pts.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(pts.schema).parquet(f"{tmp_path}/in")
    out = locate_stream(stream, table(spark).drop("geometry"))
    q = out.writeStream.format("memory").queryName("located").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
    try:
        q.processAllAvailable()
        assert [r["ID"] for r in spark.table("located").collect()] == [1]
    finally:
        q.stop()
    assert os.path.isdir(f"{tmp_path}/cp")


def test_nothing_is_lost_between_files(spark, tmp_path, monkeypatch):
    from milepost.sources import formats
    from milepost.sources.tables import read_shapefile, to_shapefile, write_events

    line = {"type": "LineString", "parts": [[{"x": 0.0, "y": 0.0, "z": None, "m": None}, {"x": 1.0, "y": 1.0, "z": None, "m": None}]]}
    shape = lambda names: T.StructType([*(T.StructField(n, T.StringType()) for n in names), T.StructField("geometry", GEOMETRY)])
    for k, names in enumerate((["A"], ["A", "B"])):
        formats.write_shapefile(f"{tmp_path}/in/f{k}.zip", shape(names), [{n: f"{n}{k}" for n in names} | {"geometry": line}], PRJ["EPSG:4326"])
    got = sorted((r["A"], r["B"]) for r in read_shapefile(spark, f"file://{tmp_path}/in").collect())
    assert got == [("A0", None), ("A1", "B1")]
    # a record beyond the last shape
    members = {".dbf": "f1.dbf", ".shp": "f1.shp"}
    with zipfile.ZipFile(f"{tmp_path}/in/f1.zip") as z:
        held = {end: z.read(n) for end, n in members.items()}
    short = held[".shp"][:100]
    monkeypatch.setattr(formats, "_one", lambda data, ending, needed=True: {".dbf": held[".dbf"], ".shp": short}[ending])
    assert [r["geometry"] for r in formats.shapefile_rows(b"", None)] == [None]
    monkeypatch.undo()
    # rows without a line do not count against the limit, rows beyond it are not dropped
    rows = spark.createDataFrame([("a", None)] * 5 + [("b", line)] * 3, shape(["A"]))
    monkeypatch.setattr(formats, "MOST_ROWS", 3)
    to_shapefile(rows, f"{tmp_path}/out.zip", PRJ["EPSG:4326"])
    assert read_shapefile(spark, f"file://{tmp_path}/out.zip").count() == 3
    with pytest.raises(ValueError, match="more than 3 rows"):
        to_shapefile(rows.unionAll(rows), f"{tmp_path}/out2.zip", PRJ["EPSG:4326"])
    monkeypatch.undo()
    # written in WGS 84
    metres = spark.createDataFrame([("a", {"type": "LineString", "parts": [[{"x": 500000.0, "y": 0.0, "z": None, "m": None}, {"x": 500000.0, "y": 10.0, "z": None, "m": None}]]})], shape(["A"]))
    write_events(metres, f"{tmp_path}/utm.zip", "EPSG:26917")
    first = read_shapefile(spark, f"file://{tmp_path}/utm.zip").first()["geometry"]["parts"][0][0]
    assert abs(first["x"] + 81) < 1e-9 and abs(first["y"]) < 1e-9
    write_events(metres, f"{tmp_path}/utm2.zip", "EPSG:26917", output_crs="source")
    assert read_shapefile(spark, f"file://{tmp_path}/utm2.zip").first()["geometry"]["parts"][0][0]["x"] == 500000.0


def test_ids_in_read_order_are_numbered_without_gaps(spark):
    from milepost.operators.routes import calibrate_routes

    rows = spark.range(0, 40, 1, 5).select(F.col("id").alias("n"), line_of(F.array(vertex(F.lit(0), F.lit(0)), vertex(F.col("id"), F.lit(1)))).alias("geometry"))
    rows = rows.withColumn("ROADWAY", F.when(F.col("n") % 3 == 0, F.concat(F.lit("X"), F.col("n"))))
    got = {r["n"]: r["ROADWAY"] for r in calibrate_routes(rows, "EPSG:3857").collect()}
    free = [n for n in range(40) if n % 3]
    assert [got[n] for n in free] == [f"R{k + 1:06d}" for k in range(len(free))] and got[3] == "X3"


def test_excel_and_geopackage_are_written(spark, tmp_path):
    from milepost.sources import formats
    from milepost.sources.tables import source_crs

    odd = table(spark).withColumn("NOTE", F.lit("<a> & 'b'\x07")).withColumn("N", F.lit(7)).withColumn("DAY", F.lit("2024-02-03").cast("date")).withColumn("L", F.array(F.lit(1)))
    both = odd.unionByName(odd.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in odd.schema]))
    write_events(both, f"{tmp_path}/new/t.xlsx")
    first = read_events(spark, f"{tmp_path}/new/t.xlsx").first().asDict()
    assert first == dict(ROADWAY="008", BEGIN_POST=0.0, END_POST=10.0, NOTE="<a> & 'b'", N=7.0, DAY="2024-02-03", L="[1]")
    write_events(both, f"{tmp_path}/new/t.gpkg")
    write_events(both, f"{tmp_path}/new/t.gpkg")
    got = sorted(read_events(spark, f"{tmp_path}/new/t.gpkg").collect(), key=lambda r: r["fid"])
    assert [r["ROADWAY"] for r in got] == ["008", None] and got[0]["N"] == 7 and got[1]["geometry"] is None
    assert [v["x"] for v in got[0]["geometry"]["parts"][0]] == [0.0, 10.0] and source_crs(spark, f"{tmp_path}/new/t.gpkg") == "EPSG:4326"
    write_events(table(spark), f"{tmp_path}/utm.gpkg", "EPSG:26917", output_crs="source")
    assert source_crs(spark, f"{tmp_path}/utm.gpkg") == "EPSG:26917"
    write_events(table(spark).where("false"), f"{tmp_path}/none.xlsx")
    assert read_events(spark, f"{tmp_path}/none.xlsx").count() == 0
    with pytest.raises(ValueError):
        write_events(table(spark).drop("geometry"), f"{tmp_path}/x.gpkg")
    for z, m in ((None, None), (5.0, None), (0.0, 2.0), (5.0, 2.0)):
        p = [{"x": float(k), "y": 1.0, "z": z, "m": m} for k in range(4)]
        for kind, parts in (("Point", [p[:1]]), ("LineString", [p]), ("MultiLineString", [p, p[:2]]), ("Polygon", [p]), ("MultiPoint", [p]), ("MultiPolygon", [p])):
            assert formats._wkb(formats.to_wkb({"type": kind, "parts": parts})) == {"type": kind, "parts": parts}, (kind, z, m)


def test_bare_shapefiles_and_folders(spark, tmp_path):
    from milepost.sources.tables import source_crs

    for name, x in (("b", 1), ("a", 2)):
        to_shapefile(table(spark).withColumn("NOTE", F.lit(name)), f"{tmp_path}/z/{name}.zip", PRJ["EPSG:26917"])
        with zipfile.ZipFile(f"{tmp_path}/z/{name}.zip") as z:
            z.extractall(tmp_path / "bare")
    (tmp_path / "bare" / "a.dbf").rename(tmp_path / "bare" / "a.DBF")
    assert [r["NOTE"] for r in read_events(spark, f"{tmp_path}/bare").collect()] == ["a"]
    assert [r["NOTE"] for r in read_events(spark, f"{tmp_path}/bare/b.shp").collect()] == ["b"]
    (tmp_path / "bare" / "b.dbf").unlink()
    assert read_events(spark, f"{tmp_path}/bare/b.shp").columns == ["geometry"]
    assert all(source_crs(spark, f"{tmp_path}/{p}") == PRJ["EPSG:26917"] for p in ("bare", "bare/b.shp", "z/a.zip"))
    with pytest.raises(FileNotFoundError):
        read_events(spark, f"{tmp_path}/z")
    assert source_crs(spark, f"{tmp_path}/t.csv") is None


def test_what_cannot_be_projected_is_not_called_wgs84(spark, tmp_path):
    from milepost.functions.crs import PRJ
    from milepost.sources.tables import layer_projection, source_crs, spatial_output

    feet = table(spark).withColumn("geometry", F.expr("named_struct('type', geometry.type, 'parts', transform(geometry.parts, p -> transform(p, v -> named_struct('x', v.x + 656166.0, 'y', v.y + 9e5, 'z', v.z, 'm', v.m))))"))
    assert layer_projection(table(spark)).kind == "geographic" and layer_projection(feet).kind == "unknown" and layer_projection(feet, "EPSG:2236").kind == "tmerc"
    for path, crs in (("a.geojson", None), ("a.zip", None), ("a.gpkg", "EPSG:9999")):
        with pytest.raises(ValueError):
            write_events(feet, f"{tmp_path}/{path}", crs)
    write_events(feet, f"{tmp_path}/kept.zip", output_crs="source")
    assert not source_crs(spark, f"{tmp_path}/kept.zip")
    write_events(feet, f"{tmp_path}/feet.geojson", PRJ["EPSG:2236"])
    assert abs(read_events(spark, f"{tmp_path}/feet.geojson").first()["geometry"]["parts"][0][0]["x"] + 81) < 0.1
    assert [spatial_output(*a) for a in (("x", "shapefile"), ("d/x.csv", "geojson"), ("x.gpkg",), ("x.shp", "json"))] == ["x.shp", "d/x.geojson", "x.gpkg", "x.shp"]
    with pytest.raises(ValueError):
        spatial_output("x.csv")


def test_archives_and_several_files(spark, tmp_path):
    import zipfile

    from milepost.sources.tables import main_file

    line = '{"type":"Feature","properties":{"ROADWAY":"1","N":2},"geometry":{"type":"LineString","coordinates":[[0,0],[1,1]]}}'
    inside = {"a": {"t.csv": 'ROADWAY,"N"\n007,"1,5"\n"0""8",\n'}, "b": {"x.geojson": line, "t.csv": "A\n1\n"}, "c": {"t.txt": "﻿ROADWAY,NOTE\n1,\"two\nlines\"\n"}, "d": {"readme.md": "none"}}
    for name, members in inside.items():
        with zipfile.ZipFile(f"{tmp_path}/{name}.zip", "w") as z:
            for member, text in members.items():
                z.writestr(member, text)
    with zipfile.ZipFile(f"{tmp_path}/e.zip", "w") as z:
        z.write(f"{tmp_path}/a.zip", "deep/a.zip")
    read = lambda n: [r.asDict() for r in read_events(spark, f"{tmp_path}/{n}.zip").drop("geometry").collect()]
    assert read("a") == read("e") == [{"ROADWAY": "007", "N": 15.0}, {"ROADWAY": '0"8', "N": None}]
    assert read("b") == [{"N": 2.0, "ROADWAY": "1"}] and read("c") == [{"ROADWAY": "1", "NOTE": "two\nlines"}]
    with pytest.raises(Exception, match="no shapefile"):
        read("d")
    (tmp_path / "t.txt").write_text("ROADWAY,N\n1,2\n")
    assert read_events(spark, [f"{tmp_path}/z.xlsx", f"{tmp_path}/t.txt"]).first()["N"] == 2.0
    assert main_file(["a.dbf", "a.shp", "a.csv"]) == "a.csv" and main_file(["a.dbf", "a.shp"]) == "a.shp"
    with pytest.raises(ValueError):
        main_file(["a.shp", "b.shp"])
