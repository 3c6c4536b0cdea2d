"""Work that grows no faster than the input: what a plan evaluates, gathers and moves."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from milepost.functions.keys import measure_text, to_number
from milepost.operators import packed, report
from milepost.operators.dissolve import dissolve
from milepost.operators.locate import locate_points
from milepost.plans.schema import LrsSchema


def optimised(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_combine_gathers_no_columns_that_go(spark):
    df = spark.createDataFrame([("7", "a = 1 | b = 2.5", "text that stays")], "LocationID string, `Intersecting Roadway Id Milepoints` string, note string")
    lined = packed.explode_routes(df, row_col="LocationID")
    back = packed.combine_routes(lined)
    assert [tuple(r) for r in back.select("LocationID", "note", "Intersecting Roadway Id Milepoints").collect()] == [("7", "text that stays", "a = 1|b = 2.5")]
    # the packed text is written anew: the old one isn't carried by every approach
    plan = optimised(packed.combine_routes(lined.withColumn("Intersecting Roadway Id Milepoints", F.concat("Intersecting Roadway Id Milepoints", F.lit("not carried")))))
    assert "not carried" not in plan


def test_measure_text_is_that_of_ten_places(spark):
    values = [0.0, -0.0, 5.0, 0.125, 1e-3, 9.99e-4, 1e-11, 1 / 3, -2 / 3, 9e6, 9e6 + 1, 1e7, 1.5e22, 123456.123456789, 100.0, -1e300, math.nan, math.inf, None]
    long = F.format_string("%.10f", F.col("x"))
    old = F.when(F.col("x").isNotNull(), F.regexp_replace(F.regexp_replace(long, "0+$", ""), "\\.$", ""))
    for new, was in spark.createDataFrame([(v,) for v in values], "x double").select(measure_text(F.col("x")), old).collect():
        assert new == was


def test_extract_counts_reads_a_list_once(spark):
    df = spark.createDataFrame([("a = 1 | b",), (None,), ("c",), ("d = 2 | e = 3",)], "packed string")
    out = report.extract_counts(df, "packed")
    assert tuple(out.first()) == (4, 3, 2)
    assert optimised(out).count("split(packed") == 1


def test_approaches_of_odd_texts(spark):
    text = "a = 1 – 2|b=4,5| = 3|c = nan|d = 1e400|e = 7 - nan|f = x|g 8|h = - 9|i == 1|  j = 1 - 2 - 3 |k =|l = , 6"
    found = spark.createDataFrame([(text,)], "packed string").select(F.explode(packed.approaches(F.col("packed"))).alias("x")).select("x.*")
    rows = [tuple(r) for r in found.collect()]
    assert rows == [("a", 1.0, 1.0, 2.0), ("b", 4.0, 4.0, 5.0), ("e", 7.0, 7.0, 7.0), ("h", 9.0, 9.0, 9.0), ("j", 1.0, 1.0, 2.0), ("l", 6.0, 6.0, 6.0)]
    # a text is cut at its signs once
    assert optimised(found).count("split(translate(") == 1


def test_geojson_text_is_parsed_once(spark, tmp_path):
    from milepost.sources.tables import read_geojson

    line = '{"type":"LineString","coordinates":[[0,1],[2,3.5]]}'
    texts = [f'{{"type":"Feature","properties":{{"n":"{n}","t":"x{n}"}},"geometry":{line}}}' for n in range(3)]
    (tmp_path / "a.geojson").write_text('{"type":"FeatureCollection","features":[' + ",".join(texts) + "]}")
    out = read_geojson(spark, str(tmp_path)).select("n", "t", F.size(F.col("geometry.parts")[0]).alias("many"), F.col("geometry.type"))
    assert sorted(map(tuple, out.collect())) == [(float(n), f"x{n}", 2, "LineString") for n in range(3)]
    # the geometry's own text; features are parsed before, and kept
    assert optimised(out).count("from_json(StructField(type,") == 1


def test_numbers_in_text(spark):
    texts = [" 1,000 ", "-5", "+.5", "1e3", "\t7", "7d", "0x1p3", "x1", "", "nan", "Infinity", "-inf", "} 5", None, "1 2"]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    was = F.replace(F.trim("t"), F.lit(","), F.lit("")).try_cast("double")
    was = F.when(~F.isnan(was) & (F.abs(was) != math.inf), was)
    got = rows.select("t", to_number(F.col("t")), was).collect()
    assert [r[1] for r in got] == [r[2] for r in got] and [r[1] for r in got[:4]] == [1000.0, -5.0, 0.5, 1000.0]


def test_dissolve_moves_each_column_once(spark):
    rows = spark.createDataFrame([("1", 0.0, 1.0, None, "a"), ("1", 0.0, 1.0, 2, "b"), ("1", 1.0, 2.0, 1, "c")], "road string, bmp double, emp double, n int, note string")
    line = LrsSchema(roadway="road", bmp="bmp", emp="emp")
    for hot in (None, 1):
        out = dissolve(rows, line, ["road"], require_contiguous=False, seq_cols=["n", "note"], hot_rows=hot)
        # null orders first, as within a struct
        assert [tuple(r) for r in out.collect()] == [("1", 0.0, 2.0, None, "a")]
    plan = dissolve(rows, line, ["road"], seq_cols=["n", "note"])._jdf.queryExecution().sparkPlan().toString()
    # beside what is looked back at, nothing is made for a window: its order is columns
    assert "AS _w1#" not in plan
    assert "AS row#" not in plan and "AS seq#" not in plan


def test_locate_hands_on_without_a_join_of_the_segments(spark):
    cols = "ROADWAY string, BEGIN_POST double, END_POST double, FLAG string"
    ev = spark.createDataFrame([("1", 0.0, 2.0, "a"), ("1", 2.0, 3.0, "b"), ("2", 0.0, 2.0, "c"), ("2", 2.0, None, "no end"), ("3", 0.0, 2.0, "d"), ("3", 2.0, 1.0, "inverted"), ("4", 0.0, 2.0, "e"), (None, 1.0, 2.0, "null"), ("5", None, 2.0, "no start")], cols)
    pts = spark.createDataFrame([(r, 2.0) for r in ("1", "2", "3", "4", "5", "6", None)] + [("1", 2.5), ("1", None)], "ROADWAY string, LOCATION double")
    for hot in (None, 0, 1):
        found = locate_points(pts, ev, hot_rows=hot)
        assert sorted(map(str, (tuple(r) for r in found.located.select("ROADWAY", "LOCATION", "FLAG").collect()))) == ["('1', 2.0, 'b')", "('1', 2.5, 'b')", "('4', 2.0, 'e')", "(None, 2.0, 'null')"]
        left = sorted(map(str, (tuple(r) for r in found.unmatched.select("ROADWAY", "LOCATION", "FLAG").collect())))
        assert left == ["('1', None, None)", "('2', 2.0, None)", "('3', 2.0, None)", "('5', 2.0, None)", "('6', 2.0, None)"]
    # segments meet points, not one another
    plan = optimised(locate_points(pts, ev).located)
    assert "[distinct" not in plan and plan.count("Join Inner") + plan.count("Join LeftOuter") <= 4


def test_union_moves_a_vertex_with_its_line(spark):
    from milepost.functions.geometry import GEOMETRY
    from milepost.operators.planar import union_lines

    vertices = lambda *xy: ("LineString", [[(float(x), float(y), float(n), None) for n, (x, y) in enumerate(xy)]])
    data = [
        # there and back, crossed on the way: both passes are cut, and what they share stays once
        ("spike", vertices((0, 0), (4, 0), (0, 0))), ("spike", vertices((2, -1), (2, 1))),
        # a segment of three lines, one of them against the others, cut by a fourth
        ("shared", vertices((0, 0), (4, 0), (5, 1))), ("shared", vertices((4, 0), (0, 0), (0, 7))), ("shared", vertices((-3, 2), (0, 0), (4, 0))), ("shared", vertices((1, -1), (1, 1))),
        # an end within a segment, at the vertex of a third line; the other vertices stay inside
        ("plain", vertices((0, 0), (1, 1), (2, 0), (3, 1), (5, 1), (7, 1))), ("plain", vertices((4, 3), (4, 2), (4, 1))), ("plain", vertices((9, 9), (4, 1), (9, 8))),
    ]
    out = union_lines(spark.createDataFrame(data, f"g string, geometry {GEOMETRY.simpleString()}"), ["g"])
    found = {}
    for r in out.collect():
        found.setdefault(r["g"], []).append([(v.x, v.y) for v in r["part"]])
    way = lambda parts: sorted(min(p, p[::-1]) for p in parts)
    assert way(found["spike"]) == way([[(0, 0), (2, 0)], [(2, 0), (4, 0), (2, 0)], [(2, -1), (2, 0)], [(2, 0), (2, 1)]])
    assert way(found["shared"]) == way([[(0, 0), (1, 0)], [(1, 0), (4, 0)], [(4, 0), (5, 1)], [(0, 0), (0, 7)], [(-3, 2), (0, 0)], [(1, -1), (1, 0)], [(1, 0), (1, 1)]])
    assert way(found["plain"]) == way([[(0, 0), (1, 1), (2, 0), (3, 1), (4, 1)], [(4, 1), (5, 1), (7, 1)], [(4, 3), (4, 2), (4, 1)], [(9, 9), (4, 1)], [(4, 1), (9, 8)]])
    # a line is cut as it is: its pieces aren't brought together again, and nodes aren't joined with them
    plan = optimised(out)
    assert "Window" not in plan and plan.count("Join Inner") == 1 and plan.count("Join LeftOuter") == 1


def test_union_of_straight_lines_keeps_and_moves_little(spark):
    import os

    from milepost.functions.geometry import line_of, vertex
    from milepost.operators import numbering
    from milepost.operators.routes import dissolve_lines

    folder = numbering.shared_folder(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)
    n = 20_000
    b = F.col("id") % 3 + F.floor(F.col("id") / 4) * 4.0
    zero = F.lit(0.0)
    rows = spark.range(n).select((F.col("id") % 3).cast("string").alias("ROADWAY"), b.alias("BEGIN_POST"), (b + 2).alias("END_POST"), F.lit("a").alias("FLAG"))
    rows = rows.withColumn("geometry", line_of(F.array(vertex(F.col("BEGIN_POST"), zero), vertex(F.col("END_POST"), zero))))
    removal = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = size(), spark.conf.get(removal, "false")
    blocks, lines = dissolve_lines(rows, group_cols=["FLAG"], require_contiguous=False)
    # segments and cuts are all that is kept, and as packed columns
    assert size() - before < 40 * n
    assert spark.conf.get(removal, "false") == was
    plan = optimised(lines)
    # cuts are gathered by line and met by the segments; parts are not compared
    assert "Window" not in plan and plan.count("Join") == 1 and plan.count("Aggregate [") == 1
    # a block that only its group ends is found without looking at neighbours
    assert "Window" not in optimised(blocks) and "Join" not in optimised(blocks)
    found = lines.groupBy("__block").agg(F.sum(F.col("part")[1]["x"] - F.col("part")[0]["x"]).alias("length")).select("__block.g0", "length").collect()
    covered = {}
    for k in range(n):
        at = k % 3 + k // 4 * 4
        covered.setdefault(str(k % 3), set()).update((at, at + 1))
    assert {r[0]: r[1] for r in found} == {g: float(len(c)) for g, c in covered.items()}
