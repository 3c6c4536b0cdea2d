"""Small tables with exact expected values, one behaviour per test."""

import pytest
from pyspark.sql import functions as F

from milepost.functions.geometry import line_of, vertex
from milepost.functions.keys import PadRule, pad_route_id, parse_date, to_number
from milepost.operators import packed, qc, report
from milepost.operators.dissolve import collapse_longest, dissolve
from milepost.operators.locate import locate_points
from milepost.operators.overlay import overlay_events
from milepost.operators.routes import calibrate_routes, display_events, dissolve_geometries, locate_events_on_routes
from milepost.plans.schema import LrsSchema, as_of, find_column, pick_profile, resolve_roles

T = "ROADWAY string, BEGIN_POST double, END_POST double"


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def same(df, names, expected):
    assert rows(df, *names) == sorted(map(tuple, expected), key=repr)


@pytest.fixture
def target(spark):
    return spark.createDataFrame([("100", 0.0, 10.0, 5000)], T + ", SECTADT int")


def over(spark, *data, extra="FLAG string"):
    return spark.createDataFrame(list(data), f"{T}, {extra}")


S = ["BEGIN_POST", "END_POST", "FLAG"]


@pytest.mark.parametrize("method", ["edges", "cursor"])
def test_overlay_keeps_gaps_around_and_between(spark, target, method):
    same(overlay_events(target, over(spark, ("100", 2.0, 6.0, "a")), method=method), S, [(0.0, 2.0, None), (2.0, 6.0, "a"), (6.0, 10.0, None)])
    o = over(spark, ("100", 0.0, 3.0, "a"), ("100", 7.0, 10.0, "b"))
    same(overlay_events(target, o, method=method), S, [(0.0, 3.0, "a"), (3.0, 7.0, None), (7.0, 10.0, "b")])
    same(overlay_events(target, over(spark, ("999", 0.0, 5.0, "a")), method=method), S, [(0.0, 10.0, None)])
    same(overlay_events(target, over(spark, ("100", 4.0, 6.0, "a")), how="inner", method=method), S, [(4.0, 6.0, "a")])
    assert overlay_events(target, over(spark, ("999", 4.0, 6.0, "a")), how="inner", method=method).columns == [*T.replace(" string", "").replace(" double", "").split(", "), "SECTADT", "FLAG"]


def test_overlay_methods_differ_on_overlapping_and_inverted_rows(spark, target):
    o = over(spark, ("100", 0.0, 6.0, "A"), ("100", 4.0, 10.0, "B"))
    same(overlay_events(target, o), S, [(0.0, 4.0, "A"), (4.0, 6.0, "A"), (4.0, 6.0, "B"), (6.0, 10.0, "B")])
    same(overlay_events(target, o, method="cursor"), S, [(0.0, 6.0, "A"), (6.0, 10.0, "B")])
    back = over(spark, ("100", 5.0, 1.0, "x"))
    same(overlay_events(target, back), S, [(0.0, 1.0, None), (1.0, 5.0, None), (5.0, 10.0, None)])
    same(overlay_events(target, back, method="cursor"), S, [(0.0, 5.0, None), (1.0, 10.0, None)])
    inverted = spark.createDataFrame([("100", 10.0, 2.0, 1)], T + ", SECTADT int")
    whole = over(spark, ("100", 0.0, 20.0, "w"))
    same(overlay_events(inverted, whole), S, [(2.0, 10.0, "w")])
    assert overlay_events(inverted, whole, method="cursor").count() == 0
    assert overlay_events(inverted, over(spark, ("7", 0.0, 1.0, "w"))).count() == 0


def test_overlay_keys_nulls_and_options(spark, target):
    number = spark.createDataFrame([(100, 2.0, 4.0, "n")], "ROADWAY int, BEGIN_POST double, END_POST double, FLAG string")
    assert (2.0, 4.0, "n") in rows(overlay_events(target, number), *S)
    odd = spark.createDataFrame([(None, 0.0, 5.0, 1), ("1", None, 5.0, 2), ("1", 3.0, 3.0, 3)], T + ", N int")
    none = over(spark, (None, 1.0, 2.0, "z"))
    same(overlay_events(odd, none), ["N", *S], [(1, 0.0, 1.0, None), (1, 1.0, 2.0, "z"), (1, 2.0, 5.0, None), (2, None, 5.0, None)])
    same(overlay_events(odd, none, null_keys_match=False), ["N", *S], [(1, 0.0, 5.0, None), (2, None, 5.0, None)])
    same(overlay_events(odd, none, how="inner"), ["N", *S], [(1, 1.0, 2.0, "z")])
    sided = target.withColumn("SIDE", F.lit("L"))
    o = spark.createDataFrame([("100", 0.0, 10.0, "R", "right"), ("100", 2.0, 4.0, "L", "left")], T + ", SIDE string, FLAG string")
    out = overlay_events(sided, o, match_pairs=[("SIDE", "SIDE")])
    assert [r for r in rows(out, *S) if r[2]] == [(2.0, 4.0, "left")]
    named = overlay_events(target, over(spark, ("100", 0.0, 10.0, 3), extra="OLD int"), target_rename={"ROADWAY": "ROADWAY_new", "SECTADT": "SECTADT_new"})
    same(named, ["ROADWAY_new", "SECTADT_new", "OLD"], [("100", 5000, 3)])
    long = over(spark, ("100", 0.0, 1.0, "short", "g"), ("100", 1.0, 10.0, "long", "g"), extra="FLAG string, GROUP string")
    same(overlay_events(target, long, collapse="longest", collapse_group_cols=["ROADWAY", "GROUP"]), S, [(0.0, 10.0, "long")])
    clash = over(spark, ("100", 0.0, 4.0, 7), extra="SECTADT int")
    same(overlay_events(target, clash), ["BEGIN_POST", "SECTADT"], [(0.0, 7), (4.0, None)])
    with pytest.raises(ValueError):
        overlay_events(target, clash, how="outer")
    with pytest.raises(KeyError):
        overlay_events(target.drop("END_POST"), clash)


def test_dissolve_and_collapse(spark):
    d = over(spark, ("1", 0.0, 2.0, "a"), ("1", 2.0, 5.0, "a"), ("1", 5.0, 8.0, "b"))
    same(dissolve(d), S, [(0.0, 5.0, "a"), (5.0, 8.0, "b")])
    gap = over(spark, ("1", 0.0, 2.0, "a"), ("1", 4.0, 6.0, "a"))
    assert dissolve(gap).count() == 2
    same(dissolve(gap, require_contiguous=False), S, [(0.0, 6.0, "a")])
    assert dissolve(over(spark, ("1", 0.0, 2.0, "a"), ("1", 2.00005, 4.0, "a"))).count() == 1
    assert dissolve(over(spark, ("1", 0.0, 5.0, "a"), ("1", 2.0, 6.0, "a"))).count() == 2
    assert dissolve(over(spark, ("1", None, 2.0, "a"))).count() == 0
    sides = over(spark, ("1", 0.0, 5.0, "L"), ("1", 0.0, 5.0, "R"), ("1", 5.0, 10.0, "L"), ("1", 5.0, 10.0, "R"))
    same(dissolve(sides), S, [(0.0, 10.0, "L"), (0.0, 10.0, "R")])
    assert dissolve(sides, group_cols=["FLAG"], run_order="route").count() == 4
    agg = dissolve(over(spark, ("1", 0.0, 2.0, 3), ("1", 2.0, 5.0, 4), extra="N int"), group_cols=[], agg={"N": "sum"})
    same(agg, ["BEGIN_POST", "END_POST", "N"], [(0.0, 5.0, 7)])
    first = dissolve(over(spark, ("1", 0.0, 2.0, None), ("1", 2.0, 5.0, 4), extra="N int"), group_cols=["ROADWAY"], run_order="route")
    same(first, ["N"], [(4,)])
    c = over(spark, ("1", 0.0, 1.0, "short"), ("1", 1.0, 10.0, "long"))
    same(collapse_longest(c, group_cols=["ROADWAY"]), S, [(0.0, 10.0, "long")])
    two = over(spark, ("1", 0.0, 1.0, "x"), ("2", 1.0, 2.0, "x"))
    assert collapse_longest(two, group_cols=["FLAG"]).count() == 2


def test_locate(spark):
    pts = spark.createDataFrame([("100", 1.5, "A"), ("100", 9.0, "B"), ("200", 0.5, "C"), ("100", None, "D")], "ROADWAY string, LOCATION double, SITE string")
    ev = spark.createDataFrame([("100", 0.0, 5.0, 111)], "roadway string, begin_post double, end_post double, sectadt int")
    found = locate_points(pts, ev)
    same(found.located, ["SITE", "sectadt"], [("A", 111)])
    same(found.unmatched, ["SITE", "sectadt"], [("B", None), ("C", None), ("D", None)])
    end = spark.createDataFrame([("100", 5.0)], "ROADWAY string, LOCATION double")
    both = over(spark, ("100", 0.0, 5.0, "first"), ("100", 5.0, 10.0, "second"))
    same(locate_points(end, both).located, ["FLAG"], [("second",)])
    same(locate_points(end, both, boundary="both").located, ["FLAG"], [("first",), ("second",)])
    same(locate_points(end, both.where("FLAG = 'first'")).located, ["FLAG"], [("first",)])
    pairs = locate_points(pts, both, boundary="both", unmatched="pairs")
    same(pairs.unmatched, ["SITE", "FLAG"], [("A", "second"), ("B", "first"), ("C", None), ("D", "first"), ("D", "second")])
    kept = locate_points(spark.createDataFrame([("1", 3.0)], "ROADWAY string, LOCATION double"), over(spark, ("1", 0.0, 9.0, 3.2), extra="LOCATION double"))
    same(kept.located, ["LOCATION"], [(3.0,)])
    drawn = spark.createDataFrame([("1", 0.0, 5.0)], T).withColumn("geometry", line_of(F.array(vertex(F.lit(0), F.lit(0)), vertex(F.lit(10), F.lit(0)))))
    at = locate_points(spark.createDataFrame([("1", 2.5)], "ROADWAY string, LOCATION double"), drawn).located.first()["geometry"]
    assert at["type"] == "Point" and at["parts"][0][0]["x"] == 5.0
    with pytest.raises(ValueError):
        locate_points(pts, ev, how="outer")


def test_checks(spark):
    q = spark.createDataFrame([("1", 0.0, 2.0), ("1", 1.5, 3.0), ("1", 5.0, 6.0)], T)
    same(qc.find_gaps(q), ["GAP_BMP", "GAP_EMP", "GAP_LENGTH"], [(3.0, 5.0, 2.0)])
    same(qc.find_overlaps(q), ["ROADWAY", "LEFT_BMP", "RIGHT_BMP"], [("00000001", 0.0, 1.5)])
    nested = spark.createDataFrame([("1", 0.0, 10.0), ("1", 2.0, 4.0), ("1", 6.0, 8.0)], T)
    same(qc.find_gaps(nested), ["GAP_BMP", "GAP_EMP"], [(4.0, 6.0)])
    sides = over(spark, ("1", 0.0, 2.0, "L"), ("1", 0.0, 2.0, "R"))
    assert qc.find_overlaps(sides).count() == 1 and qc.find_overlaps(sides, group_cols=["FLAG"]).count() == 0
    bad = spark.createDataFrame([("1", 0.0, 2.0), ("1", 4.0, 6.0), ("2", 3.0, 3.0), (None, 1.0, 0.0)], T)
    v = qc.validate(bad)
    assert v.summary().first().asDict() == dict(inverted_bounds=1, zero_length=1, null_key=1, overlap=0, gap=1, ok=False)
    loose = qc.validate(bad, strict=False).summary().first()
    assert loose["inverted_bounds"] == 2 and not loose["ok"]
    assert qc.validate(q.limit(0)).summary().first()["ok"]
    assert ("warn", "1 gaps") in report.report_lines(v.summary())
    n = spark.createDataFrame([("1", 0.0, 1.0, 100.0), ("1", 1.0, 2.0, 200.0), ("1", 2.0, 3.0, 0.0)], T + ", AADT double")
    same(qc.neighbors_along_route(n, "AADT"), ["Upstream_Value", "Downstream_Value", "Upstream_Diff_pct", "Downstream_Diff_pct"],
         [(None, 200.0, None, -0.5), (100.0, 0.0, 1.0, None), (200.0, None, -1.0, None)])


def test_keys_and_roles(spark):
    ids = spark.createDataFrame([("123",), ("84.0",), ("8470001.0",), (None,), (" ",), ("nan",), ("I-95",), ("008._P",), ("123456789",)], "id string")
    got = [r[0] for r in ids.select(pad_route_id(F.col("id"))).collect()]
    assert got == ["00000123", "00000084", "08470001", None, None, None, "I-95", "008._P", "123456789"]
    every = [r[0] for r in ids.select(pad_route_id(F.col("id"), PadRule("all"))).collect()]
    assert every[6] == "0000I-95" and every[8] == "123456789"
    assert ids.select(pad_route_id(F.col("id"), PadRule("off"))).first()[0] == "123"
    reals = spark.createDataFrame([(84.0,), (12345678.0,), (float("nan"),)], "id double")
    assert [r[0] for r in reals.select(pad_route_id(F.col("id"))).collect()] == ["00000084", "12345678", None]
    texts = spark.createDataFrame([("1,234.5",), (" 7 ",), ("x",), ("",), ("inf",)], "t string")
    assert [r[0] for r in texts.select(to_number(F.col("t"))).collect()] == [1234.5, 7.0, None, None, None]
    dates = spark.createDataFrame([("2020-01-02",), ("01/02/2020",), ("soon",)], "t string")
    assert [r[0] and r[0].day for r in dates.select(parse_date(F.col("t"))).collect()] == [2, 2, None]
    assert resolve_roles(["RTE_ID", "BEG_MP", "END_MP"])["bmp"] == "BEG_MP"
    assert find_column(["roadway", "x"], ("ROADWAY",)) == "roadway" and find_column(["a"], ("b",), "zz") is None
    assert pick_profile(["ROUTE_ID", "FROM_MEASURE", "TO_MEASURE"], "esri")["emp"] == "TO_MEASURE"
    with pytest.raises(KeyError):
        resolve_roles(["a"], require=("roadway",))
    periods = spark.createDataFrame([("1", "2020-01-01", "2021-01-01"), ("2", "2021-01-01", None)], "ROADWAY string, FROM_DATE string, TO_DATE string")
    same(as_of(periods, "2021-06-01", "FROM_DATE", "TO_DATE"), ["ROADWAY"], [("2",)])
    assert as_of(periods, "whenever", "FROM_DATE", "TO_DATE").count() == 2 and as_of(periods, "2021-06-01").count() == 2


P = "Intersecting Roadway Id Milepoints"


def test_packed_round_trip(spark):
    df = spark.createDataFrame([("LPI-02352", 3010000, "03010000 = 8.837|03A05476 = .496", "A St|B St"), ("X", 1, "nothing here", None)], f"LocationID string, ROADWAY int, `{P}` string, `Intersecting Road Names` string")
    out = packed.explode_routes(df)
    same(out, ["LRS_PARENT_ID", "LRS_SUB_ID", "ROADWAY", "LRS_ROAD_NAME"], [("LPI-02352", 1, "03010000", "A St"), ("LPI-02352", 2, "03A05476", "B St")])
    assert abs(out.where("LRS_SUB_ID = 1").first()["BEGIN_POST"] - 8.827) < 1e-9
    lined = out.withColumn("geometry", line_of(F.array(vertex(F.lit(0), F.lit(0)), vertex(F.col("LRS_SUB_ID"), F.lit(0)))))
    back = packed.combine_routes(lined)
    row = back.first()
    assert row[P] == "03010000 = 8.837|03A05476 = 0.496" and row["ROADWAY"] == "3010000" and row["geometry"]["type"] == "MultiLineString"
    assert "BEGIN_POST" not in back.columns and "LRS_SUB_ID" not in back.columns
    spans = spark.createDataFrame([("a = 1 - 2|b=3,4|=5|c = x",)], f"`{P}` string")
    same(packed.explode_routes(spans), ["ROADWAY", "BEGIN_POST", "END_POST"], [("a", 1.0, 2.0), ("b", 3.0, 4.0)])
    seen = packed.inspect_keys(df).first()
    assert seen["recommended"] == "extract" and seen["approach_count"] == 2
    posts = spark.createDataFrame([("1", 0.0, 1.0)], T)
    assert packed.inspect_keys(posts).first()["recommended"] == "lrs"
    with pytest.raises(KeyError):
        packed.explode_routes(posts.select("END_POST"))


def straight(spark, m=None):
    v = [vertex(F.lit(0), F.lit(0), F.lit(0), F.lit(0) if m else None), vertex(F.lit(10), F.lit(0), F.lit(0), F.lit(m) if m else None)]
    return spark.createDataFrame([("1", 0.0, m or 10.0)], T).withColumn("geometry", line_of(F.array(*v)))


def xs(row):
    return [v["x"] for p in row["geometry"]["parts"] for v in p]


def test_route_geometry(spark):
    ev = over(spark, ("1", 2.0, 5.0, "a"), ("1", 50.0, 60.0, "off"), ("9", 0.0, 1.0, "other"), ("1", None, 4.0, "null"))
    out = {r["FLAG"]: r for r in locate_events_on_routes(ev, straight(spark)).collect()}
    assert xs(out["a"]) == [2.0, 5.0] and all(out[k]["geometry"] is None for k in ("off", "other", "null"))
    measured = locate_events_on_routes(over(spark, ("1", 5.0, 15.0, "m")), straight(spark, 20.0)).first()
    assert xs(measured) == [2.5, 7.5] and [v["m"] for v in measured["geometry"]["parts"][0]] == [5.0, 15.0]
    shown = display_events(straight(spark), over(spark, ("1", 0.0, 5.0, "a"), ("1", 5.0, 10.0, "a"), ("8", 0.0, 1.0, "a")))
    assert shown.count() == 2
    joined = dissolve_geometries(shown, group_cols=["FLAG"]).first()
    assert joined["END_POST"] == 10.0 and joined["geometry"]["type"] == "MultiLineString"
    made = calibrate_routes(straight(spark).select("geometry"), "EPSG:3857").first()
    assert made["LRS_UID"] == "R000001" and made["LRS_BMP"] == 0.0 and abs(made["LRS_EMP"] - 10 / 1609.344) < 1e-12
    assert [v["m"] for v in made["geometry"]["parts"][0]] == [0.0, made["LRS_EMP"]]
    kept = calibrate_routes(straight(spark, 20.0)).first()
    assert kept["END_POST"] == 20.0 and kept["geometry"]["parts"][0][1]["m"] == 20.0


def test_overlaps_meet_once_whatever_their_lengths(spark):
    from random import Random

    r = Random(5)
    rows = []
    for k in range(260):
        b = r.choice((r.uniform(-40, 40), float(r.randint(-8, 8)), -1e308, 0.0, 1e12))
        e = r.choice((b, b + r.choice((1e-9, 0.25, 1.0, 30.0, 4000.0, 1e9)), r.uniform(-40, 40), 1e308, None))
        rows.append((str(k % 2), b, e, k))
    rows += rows[:5]
    df = spark.createDataFrame(rows, "ROADWAY string, BEGIN_POST double, END_POST double, SEQ int")
    found = lambda n: sorted((x["ROADWAY"][-1], *x[1:]) for x in qc.find_overlaps(df, hot_rows=n).collect())
    known = [x for x in rows if x[2] is not None]
    order = lambda n: (known[n][1], known[n][2], n)
    pairs = [(x, y) for n, x in enumerate(known) for m, y in enumerate(known) if order(n) < order(m)]
    want = sorted((x[0], x[1], x[2], y[1], y[2]) for x, y in pairs if x[0] == y[0] and x[1] < y[2] and x[2] > y[1])
    assert found(0) == want == found(1000) and len(want) > 1000
    assert qc.find_overlaps(df.where("false"), hot_rows=0).count() == 0


def test_cells_do_not_change_overlay_and_locate(spark):
    from random import Random

    r = Random(7)
    spans = lambda n, name: spark.createDataFrame(
        [
            (r.choice(("1", "1", "2", None)), b, r.choice((b, (b or 0) + r.choice((1e-9, 0.25, 3.0, 500.0)), r.uniform(-9, 9), None)), k)
            for k in range(n)
            for b in [r.choice((r.uniform(-40, 40), float(r.randint(-8, 8)), None, 1e6))]
        ],
        f"ROADWAY string, BEGIN_POST double, END_POST double, {name} int",
    ).cache()
    target, over = spans(150, "T"), spans(170, "O")
    rows = lambda df: sorted(map(repr, df.collect()))
    for kw in ({}, {"how": "inner"}, {"method": "cursor"}):
        plain, cut = (rows(overlay_events(target, over, seq_cols=["O"], hot_rows=n, **kw)) for n in (10**9, 0))
        assert plain == cut and len(cut) > 100
    points = target.select("ROADWAY", F.col("BEGIN_POST").alias("LOCATION"), F.col("T").alias("P"))
    for kw in ({}, {"boundary": "both"}):
        plain, cut = (locate_points(points, over, hot_rows=n, **kw) for n in (10**9, 0))
        assert rows(plain.located) == rows(cut.located) and rows(plain.unmatched) == rows(cut.unmatched)
        assert plain.located.count() > 100 and plain.unmatched.count() > 5


def test_segments_do_not_change_scans(spark):
    from random import Random

    r = Random(9)
    rows, at = [], 0.0
    for k in range(240):
        at = r.choice((at, at + 1.0, at + 1.0, at + 2.5, 0.0))
        rows.append((r.choice(("1", "1", "2", None)), r.choice((at, at, None)), r.choice((at + 1.0, at + 1.0, at, None)), r.choice(("a", "a", "b", None)), k))
    df = spark.createDataFrame(rows, "ROADWAY string, BEGIN_POST double, END_POST double, FLAG string, N int").cache()
    listed = lambda t: sorted(map(repr, t.select(sorted(t.columns)).collect()))
    for job in (
        lambda n: dissolve(df, group_cols=["FLAG"], agg={"N": "sum"}, seq_cols=["N"], hot_rows=n),
        lambda n: dissolve(df, group_cols=["ROADWAY", "FLAG"], run_order="route", seq_cols=["N"], hot_rows=n),
        lambda n: collapse_longest(df, group_cols=[], seq_cols=["N"], hot_rows=n),
        lambda n: qc.find_gaps(df, group_cols=["FLAG"], hot_rows=n),
        lambda n: qc.neighbors_along_route(df, "N", seq_cols=["N"], hot_rows=n),
    ):
        whole, cut = listed(job(10**9)), listed(job(4))
        assert whole == cut and len(cut) > 20


def test_rows_of_a_hot_key_are_not_dealt_by_key(spark):
    rows = spark.range(9000).selectExpr("string(IF(id % 3 = 0, 0, id)) AS ROADWAY", "double(id) AS BEGIN_POST", "id + 1.5D AS END_POST", "double(id) AS MEASURE", "id AS N")
    over = rows.select("ROADWAY", "BEGIN_POST", "END_POST", F.col("N").alias("O"))
    jobs = {
        "gaps": qc.find_gaps(rows, hot_rows=1000), "neighbors": qc.neighbors_along_route(rows, "N", hot_rows=1000, seq_cols=["N"]), "overlaps": qc.find_overlaps(rows),
        "overlay": overlay_events(rows.drop("MEASURE"), over, seq_cols=["O"]), "locate": locate_points(rows.select("ROADWAY", "MEASURE", "N"), over).located,
        "dissolve": dissolve(rows.drop("MEASURE"), group_cols=["ROADWAY"], hot_rows=1000),
    }
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, job in jobs.items():
            plan = job._jdf.queryExecution().sparkPlan().toString().split("\n")
            away = [x for x in plan if "LeftAnti" in x]
            assert away and all("BroadcastHashJoin" in x for x in away), name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_overlaps_in_cells_alone_count_no_keys(spark):
    rows = spark.range(300).selectExpr("string(id % 4) AS ROADWAY", "double(id % 37) AS BEGIN_POST", "id % 37 + double(id % 5) AS END_POST")
    job = qc.find_overlaps(rows, hot_rows=0)
    assert "LeftAnti" not in job._jdf.queryExecution().optimizedPlan().toString()
    listed = [sorted(qc.find_overlaps(rows, hot_rows=n).collect()) for n in (0, 70, 10**9)]
    assert listed[0] == listed[1] == listed[2] and listed[0]
