"""Planar union and numbering against brute force."""

import random
from collections import Counter
from fractions import Fraction as Q
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from milepost.functions.geometry import GEOMETRY
from milepost.operators.numbering import numbered
from milepost.operators.planar import union_lines, united
from milepost.operators.routes import calibrate_routes, dissolve_geometries, dissolve_lines

SCHEMA = f"g string, geometry {GEOMETRY.simpleString()}"


def line(*points):
    vertices = [(None if x is None else float(x), None if y is None else float(y), *((None if v is None else float(v)) for v in (*rest, None, None)[:2])) for x, y, *rest in points]
    return "LineString", [vertices]


def shapes(parts):
    """Parts whichever way they run."""
    return Counter(min(p, p[::-1]) for p in parts)


def got(df, keys=("g",)):
    found = {}
    for r in union_lines(df, list(keys)).collect():
        found.setdefault(r[keys[0]], []).append(tuple((v.x, v.y) for v in r["part"]))
    return {k: shapes(v) for k, v in found.items()}


def met(s, t):
    """Points that two segments share: the crossing, or the ends of an overlap."""
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = *s, *t
    on = lambda p, a, b: (b[0] - a[0]) * (p[1] - a[1]) == (b[1] - a[1]) * (p[0] - a[0]) and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])
    points = {p for p, o in ((s[0], t), (s[1], t), (t[0], s), (t[1], s)) if on(p, *o)}
    whole = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    if whole:
        u = Q((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx), whole)
        v = Q((cx - ax) * (by - ay) - (cy - ay) * (bx - ax), whole)
        if 0 <= u <= 1 and 0 <= v <= 1:
            points.add((ax + u * (bx - ax), ay + u * (by - ay)))
    return points


def brute(lines):
    lines = [[p for n, p in enumerate(ps) if n == 0 or p != ps[n - 1]] for ps in lines]
    lines = [ps for ps in lines if len(ps) > 1]
    segments = [(n, k, ps[k], ps[k + 1]) for n, ps in enumerate(lines) for k in range(len(ps) - 1)]
    cuts = {(n, k): {p, q} for n, k, p, q in segments}
    for (n, k, *s), (m, j, *t) in combinations(segments, 2):
        points = met(s, t)
        cuts[n, k] |= points
        cuts[m, j] |= points
    walks = []
    for n, ps in enumerate(lines):
        walk = [ps[0]]
        for k in range(len(ps) - 1):
            near = lambda c: (c[0] - ps[k][0]) ** 2 + (c[1] - ps[k][1]) ** 2
            walk += sorted(cuts[n, k], key=near)[1:]
        walks.append(walk)
    passed = Counter(p for w in walks for p in w)
    nodes = {p for p, n in passed.items() if n > 1} | {w[e] for w in walks for e in (0, -1)}
    parts = set()
    for w in walks:
        run = [w[0]]
        for p in w[1:]:
            run.append(p)
            if p in nodes:
                parts.add(min(tuple(run), tuple(run[::-1])))
                run = [p]
    return Counter(min(t, t[::-1]) for t in (tuple((float(x), float(y)) for x, y in p) for p in parts))


def test_crossings_overlaps_touches_and_copies(spark):
    cases = {
        "cross": [[(0, 0), (4, 4)], [(0, 4), (4, 0)]],
        "overlap": [[(0, 0), (4, 0)], [(6, 0), (2, 0)]],
        "inside": [[(0, 0), (9, 0)], [(3, 0), (5, 0)]],
        "touch": [[(0, 0), (4, 0)], [(2, 0), (2, 5)]],
        "end to end": [[(0, 0), (1, 0)], [(1, 0), (2, 0)]],
        "copies": [[(0, 0), (1, 1), (2, 0)]] * 3,
        "back": [[(2, 0), (1, 1), (0, 0)], [(0, 0), (1, 1), (2, 0)]],
        "itself": [[(0, 0), (4, 4), (4, 0), (0, 4)]],
        "ring": [[(0, 0), (2, 0), (2, 2), (0, 0)]],
        "there and back": [[(0, 0), (3, 0), (0, 0)]],
        "bend": [[(0, 0), (1, 1), (2, 0), (3, 3)]],
    }
    df = spark.createDataFrame([(g, line(*ps)) for g, lines in cases.items() for ps in lines], SCHEMA)
    found = got(df)
    assert found == {g: brute(lines) for g, lines in cases.items()}
    assert {g: sum(c.values()) for g, c in found.items()} == {
        "cross": 4, "overlap": 3, "inside": 3, "touch": 3, "end to end": 2, "copies": 2, "back": 2, "itself": 3, "ring": 1, "there and back": 1, "bend": 1,
    }


@pytest.mark.parametrize("seed", range(3))
def test_random_networks_of_all_sizes(spark, seed):
    r = random.Random(seed)
    cases = {}
    for g in ("small", "mixed", "far", "grid"):
        lines = []
        for _ in range(30):
            size = {"small": 8, "mixed": r.choice([2, 20, 1000]), "far": 30, "grid": 4}[g]
            x, y = r.randint(-20, 20), r.randint(-20, 20)
            if g == "far":
                x, y = x + 4096, y - 4096
            points = [(x, y)]
            for _ in range(r.randint(1, 5)):
                points.append((points[-1][0] + r.randint(-size, size), points[-1][1] + (0 if g == "grid" and r.random() < 0.5 else r.randint(-size, size))))
            lines.append(points)
        cases[g] = lines
    df = spark.createDataFrame([(g, line(*ps)) for g, lines in cases.items() for ps in lines], SCHEMA)
    assert got(df) == {g: brute(lines) for g, lines in cases.items()}


@pytest.mark.parametrize("bent", [False, True])
def test_straight_lines_along_each_other(spark, bent):
    r = random.Random(7)
    cases = {}
    for g, (dx, dy) in {"level": (1, 0), "upright": (0, 1), "aslant": (1, 2), "down": (2, -1), "mixed": (0, 0)}.items():
        lines = []
        for n in range(40):
            ux, uy = (dx, dy) if g != "mixed" else r.choice([(1, 0), (0, 1), (1, 1), (1, -1)])
            a, b = r.sample(range(-12, 12), 2)
            shift = r.choice([0, 0, 0, 1])
            # whole steps of one direction, run either way: nested, lapping, end to end and equal ones
            lines.append([(ux * a + shift * uy, uy * a - shift * ux), (ux * b + shift * uy, uy * b - shift * ux)])
            if bent and n % 5 == 0:
                lines.append([lines[-1][1], lines[-1][0], (n, 30 + n)])
        cases[g] = lines + lines[:3]
    cases["one in all"] = [[(0, 0), (9, 0)], [(0, 0), (3, 0)], [(6, 0), (9, 0)], [(2, 0), (7, 0)], [(9, 0), (0, 0)], [(3, -1), (3, 1)]]
    cases["wide and narrow"] = [[(0, 0), (4096, 0)], *[[(64 * n, 0), (64 * n + 3, 0)] for n in range(30)], [(100, -50), (100, 50)]]
    df = spark.createDataFrame([(g, line(*ps)) for g, lines in cases.items() for ps in lines], SCHEMA)
    assert got(df) == {g: brute(lines) for g, lines in cases.items()}


def test_z_and_m_of_straight_lines(spark):
    data = [("a", line((4, 0, 8, 30), (0, 0, 0, 10))), ("a", line((1, -1), (1, 1))), ("b", line((0, 0, 5, 1), (2, 0, None, 3))), ("b", line((1, 0), (3, 0, 7)))]
    out = union_lines(spark.createDataFrame(data, SCHEMA), ["g"]).collect()
    found = {(r["g"], tuple((v.x, v.z, v.m) for v in r["part"])) for r in out if all(v.y == 0 for v in r["part"])}
    # as the lines run, in order along them
    assert found == {("a", ((4.0, 8.0, 30.0), (1.0, 2.0, 15.0))), ("a", ((1.0, 2.0, 15.0), (0.0, 0.0, 10.0))), ("b", ((0.0, 5.0, 1.0), (1.0, None, 2.0))), ("b", ((1.0, None, 2.0), (2.0, None, 3.0))), ("b", ((2.0, None, None), (3.0, 7.0, None)))}
    run = {r["part"][0].x: r["n_part"]["run"] for r in out if r["g"] == "a" and r["part"][0].y == 0 and r["part"][1].y == 0}
    assert run == {4.0: 1, 1.0: 2}
    # too short for its square to be told from zero
    short = union_lines(spark.createDataFrame([("a", line((0, 0, 1, 2), (1e-200, 0, 3, 4)))], SCHEMA), ["g"]).first()["part"]
    assert [tuple(v) for v in short] == [(0.0, 0.0, 1.0, 2.0), (1e-200, 0.0, 3.0, 4.0)]


def test_cut_vertices_have_z_and_m(spark):
    df = spark.createDataFrame([("a", line((0, 0, 0, 10), (4, 0, 8, 30))), ("a", line((1, -1), (1, 1)))], SCHEMA)
    cut = {(v.x, v.z, v.m) for r in union_lines(df, ["g"]).collect() for v in r["part"] if v.y == 0}
    assert cut == {(0.0, 0.0, 10.0), (1.0, 2.0, 15.0), (4.0, 8.0, 30.0), (1.0, None, None)}


def test_odd_geometries_and_null_keys(spark):
    nan = float("nan")
    data = [
        (None, line((0, 0), (2, 0))), (None, line((1, -1), (1, 1))), ("null", None), ("point", ("Point", [[(1.0, 1.0, None, None)]])),
        ("empty", ("LineString", [])), ("still", line((1, 1), (1, 1))), ("short", line((1, 1))), ("gap", line((0, 0), (nan, 3), (None, 3), (2, 0))),
        ("zero", line((-0.0, 0), (1, 1))), ("zero", line((0, -0.0), (1, 1))), ("parts", ("MultiLineString", [line((0, 0), (2, 2))[1][0], line((0, 2), (2, 0))[1][0]])),
    ]
    found = got(spark.createDataFrame(data, SCHEMA))
    assert {k: sum(c.values()) for k, c in found.items()} == {None: 4, "gap": 1, "zero": 1, "parts": 4}
    assert union_lines(spark.createDataFrame([], SCHEMA), ["g"]).collect() == []
    many = united(spark.createDataFrame(data, SCHEMA), ["g"]).where("g = 'parts'").first()
    assert many["geometry"]["type"] == "MultiLineString" and len(many["geometry"]["parts"]) == 4


def test_dissolve_with_a_true_union(spark):
    kind = "ROADWAY string, BEGIN_POST double, END_POST double, FLAG string, " + SCHEMA.split(", ", 1)[1]
    data = [("1", 0.0, 1.0, "a", line((0, 0), (2, 0))), ("1", 1.0, 2.0, "a", line((1, 0), (3, 0))), ("1", 2.0, 3.0, "a", line((1, -1), (1, 1))), ("2", 0.0, 1.0, "a", None)]
    df = spark.createDataFrame(data, kind)
    found = {r["ROADWAY"]: r for r in dissolve_geometries(df, group_cols=["FLAG"], union="true").collect()}
    assert found["2"]["geometry"] is None
    assert (found["1"]["BEGIN_POST"], found["1"]["END_POST"], len(found["1"]["geometry"]["parts"])) == (0.0, 3.0, 5)
    assert len(dissolve_geometries(df, group_cols=["FLAG"]).where("ROADWAY = '1'").first()["geometry"]["parts"]) == 3
    with pytest.raises(ValueError):
        dissolve_geometries(df, union="other")


def test_a_block_of_a_true_union_need_not_be_one_value(spark):
    line = lambda *xs: ("LineString", [[(float(x), 0.0, None, None) for x in xs]])
    rows = [(("1", None)[k % 2], k * 1.0, k + 1.5, ("a", "b", None)[k % 3], line(k, k + 1.5) if k % 5 else None) for k in range(40)]
    df = spark.createDataFrame(rows, "ROADWAY string, BEGIN_POST double, END_POST double, FLAG string, geometry struct<type:string,parts:array<array<struct<x:double,y:double,z:double,m:double>>>>")
    whole = dissolve_geometries(df, group_cols=["FLAG"], union="true", require_contiguous=False)
    blocks, lines = dissolve_lines(df, group_cols=["FLAG"], require_contiguous=False)
    assert not any("LIST" in x.upper() and "n_part" in x for x in lines._jdf.queryExecution().optimizedPlan().toString().split("\n"))
    apart = blocks.join(lines, "__block", "left").groupBy("ROADWAY", "FLAG", "BEGIN_POST", "END_POST").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    listed = lambda t, parts: sorted(repr(tuple(r)) for r in t.select("ROADWAY", "FLAG", "BEGIN_POST", "END_POST", F.array_sort(F.coalesce(parts, F.array())).alias("parts")).collect())
    assert listed(whole, F.col("geometry.parts")) == listed(apart, F.col("parts")) and whole.count() == 6


def test_numbers_are_whole_and_in_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), (F.col("id") % 3 == 0).alias("hot")).repartition(7)
    df = df.withColumn("w", F.when(~F.col("hot"), F.col("v")))
    out = numbered(df, "n", [F.col("w"), F.col("v")]).toPandas().sort_values("n")
    assert list(out["n"]) == list(range(1, 5001))
    rank = list(zip(out["w"].fillna(-1), out["v"]))
    assert rank == sorted(rank)
    some = numbered(df, "n", [F.col("v")], F.col("hot"))
    kept = some.where("hot").orderBy("v").toPandas()["n"]
    assert list(kept) == list(range(1, len(kept) + 1)) and some.where("NOT hot AND n IS NOT NULL").count() == 0
    assert sorted(r["n"] for r in numbered(df, "n").collect()) == list(range(1, 5001))
    assert numbered(df.limit(0), "n", [F.col("v")]).collect() == []


def test_equal_rows_spread_over_ranges(spark):
    out = numbered(spark.range(4000).select(F.lit("same").alias("v")).repartition(4), "n", [F.col("v")])
    sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sorted(r["n"] for r in out.collect()) == list(range(1, 4001)) and max(sizes) < 2500


def test_calibrate_numbers_in_the_order_given(spark):
    kind = "ROADWAY string, n int, " + SCHEMA.split(", ", 1)[1]
    data = [("x" if n % 10 == 0 else None, n, line((0, 0), (n + 1, 0))) for n in range(200)]
    out = calibrate_routes(spark.createDataFrame(data, kind).repartition(5), "EPSG:3857", seq_cols=["n"])
    lacking = [n for n in range(200) if n % 10]
    assert {r["n"]: r["ROADWAY"] for r in out.collect()} == {n: "x" if n % 10 == 0 else f"R{lacking.index(n) + 1:06d}" for n in range(200)}
