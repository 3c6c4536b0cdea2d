"""True union of lines: split where they meet, every stretch once.

The lines of a group are cut at their ends, where two of them cross or touch,
and where one runs along another; a stretch that several lines share is kept
once.  A point is a node if a line ends there or if it is passed more than once;
the result is the lines between nodes.  So a vertex that is no node is passed by
one line only, and counting points tells which.

Pairs of segments are sought in the cells of square grids.  A segment is at home
on the finest grid on which it touches four cells at most, and visits the coarser
grids in use; a pair meets once, in the cell that holds the lower left corner of
what their boxes share.  So a group that holds a third of all rows is spread over
its cells.  Equal segments are compared once, and shared vertices are found by
counting, not by pairs.

A line of two vertices is its segment: it is cut where its segment is, and of the
equal ones one is cut.  Where such segments run along each other the one that
begins first has the stretch, so each of the others goes without all up to where
the last of those that began before it ends.  Only bent lines are put together
from their vertices and compared part by part.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import is_line
from .cells import GRID_STEP, GRIDS, _grid
from .numbering import stored

#: A segment: its lower end (by x, then y) and its upper one.
ENDS = ["ax", "ay", "bx", "by"]
#: Of a straight line: its number, whether it runs from a to b, z and M there.
OF_LINE = ["line", "on", "az", "am", "bz", "bm"]


def _same(a: Column, b: Column) -> Column:
    """Equality that is no key of a join: the hash of both is, and is what rows are
    sorted by."""
    return (a <= b) & (a >= b)


def _vertices(df: DataFrame, keys: list[str], geometry: str) -> DataFrame:
    """The lines of all groups: their vertices as they are."""
    return df.select(F.struct(*keys).alias("k"), F.explode(F.when(is_line(F.col(geometry)), F.col(f"{geometry}.parts"))).alias("v"))


def _cleaned(rows: DataFrame) -> DataFrame:
    """Without vertices that are none or repeat the one before."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.withColumn("v", F.filter("v", lambda v: finite(v["x"]) & finite(v["y"])))
    before = lambda i: F.get(F.col("v"), i - 1)
    moved = F.filter("v", lambda v, i: (i == 0) | (v["x"] != before(i)["x"]) | (v["y"] != before(i)["y"]))
    return rows.withColumn("v", moved)


def _bent(rows: DataFrame) -> DataFrame:
    """Lines of three vertices or more, with a number."""
    # dealt in turn: tasks don't depend on how the table is cut, nor on copies of a line
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _cleaned(rows.where(F.size("v") > 2).repartition(tasks))
    return stored(rows.select("k", (F.monotonically_increasing_id() * 2 + 1).alias("line"), "v")).where(F.size("v") > 2)


def _straight(rows: DataFrame) -> DataFrame:
    """Lines of two vertices, as segments with a number and z and M at both ends."""
    rows = _cleaned(rows).select("k", (F.monotonically_increasing_id() * 2).alias("line"), "v").where(F.size("v") == 2)
    rows = rows.select("k", "line", F.get("v", F.lit(0)).alias("p"), F.get("v", F.lit(1)).alias("q"))
    rows = rows.select("k", "line", "p", "q", *[(F.coalesce(F.col(e)[c], F.lit(0.0)) + 0.0).alias(f"{e}{c}") for e in "pq" for c in "xy"])
    pick = lambda n, e, o, c: F.when(F.col("on"), F.col(e)[c]).otherwise(F.col(o)[c]).alias(f"{n}{c}")
    return _placed(rows, "line", "p", "q").select("k", "line", "on", *ENDS, *[pick(*n, c) for n in ("apq", "bqp") for c in "zm"])


def _segments(lines: DataFrame) -> DataFrame:
    """The lines' segments without z and M, from (px, py) to (qx, qy)."""
    rows = lines.select("k", "line", "v", F.posexplode(F.slice("v", 2, F.size("v") - 1)).alias("at", "q")).withColumn("p", F.get("v", F.col("at")))
    # none is null: said here, it need not be asked of each; adding zero makes one of the two zeros
    return rows.select("k", "line", "at", *[(F.coalesce(F.col(e)[c], F.lit(0.0)) + 0.0).alias(f"{e}{c}") for e in "pq" for c in "xy"])


def _placed(segments: DataFrame, *more: str | Column) -> DataFrame:
    """Segments by their ends, whichever way they run (``on``: from a to b)."""
    on = (F.col("px") < F.col("qx")) | ((F.col("px") == F.col("qx")) & (F.col("py") < F.col("qy")))
    rows = segments.withColumn("on", on)
    pick = lambda n, x, y: F.when(F.col("on"), F.col(x)).otherwise(F.col(y)).alias(n)
    return rows.select("k", "on", *more, *[pick(*n) for n in zip(ENDS, ("px", "py", "qx", "qy"), ("qx", "qy", "px", "py"))])


def _per(grid: Column) -> Column:
    return F.when(grid == GRIDS - 1, 0.0).otherwise(F.pow(F.lit(2.0), (GRIDS // 2 - grid) * GRID_STEP))


def _cell_hash(k: Column, grid: Column, cx: Column, cy: Column) -> Column:
    return F.xxhash64(k, grid.cast("int"), cx, cy)


def _cells(rows: DataFrame, *more: str) -> DataFrame:
    """A row for each cell that a segment touches on the grid ``g``: the hash of
    group and cell, whose place is in steps of ``1 / per``."""
    rows = rows.withColumn("per", _per(F.col("g")))
    place = lambda v: F.floor(v * F.col("per"))
    rows = rows.withColumns({"x0": place(F.col("ax")), "x1": place(F.col("bx")), "y0": place(F.least("ay", "by")), "y1": place(F.greatest("ay", "by"))})
    wide, high = F.col("x0") != F.col("x1"), F.col("y0") != F.col("y1")
    cell = lambda x, y: F.struct(F.col(x).alias("cx"), F.col(y).alias("cy"))
    touched = F.array(cell("x0", "y0"), F.when(wide, cell("x1", "y0")), F.when(high, cell("x0", "y1")), F.when(wide & high, cell("x1", "y1")))
    rows = rows.withColumn("c", F.explode(touched)).where("c IS NOT NULL")
    return rows.select(_cell_hash(F.col("k"), F.col("g"), F.col("c.cx"), F.col("c.cy")).alias("h"), "k", *ENDS, *more)


def _different(straight: DataFrame, bent: DataFrame) -> DataFrame:
    """Each different segment once, with the number of its grid.  A straight line has
    what one of those that equal it has (``OF_LINE``), a bent line's segment nulls."""
    names = ["k", *ENDS]
    grid = lambda p, q: F.greatest(F.lit(0), _grid(F.col(f"{p}x"), F.col(f"{q}x")), _grid(F.col(f"{p}y"), F.col(f"{q}y")))
    # all are of one row
    rows = straight.groupBy(*names).agg(*[F.first(c).alias(c) for c in OF_LINE])
    kinds = dict(straight.select(*OF_LINE).dtypes)
    rest = bent.select(*names).distinct().select(*names, *[F.lit(None).cast(kinds[c]).alias(c) for c in OF_LINE])
    return stored(rows.unionAll(rest).withColumn("grid", grid("a", "b")))


def _cuts(one: DataFrame, used: int, bent: bool) -> DataFrame:
    """The inner points at which each segment is cut, a row a point; a point may
    come more than once.  ``lap``: so far, which may be to its end, others have
    what the segment runs along.  A straight line is told by its number, a segment
    that may be one of bent lines by its group and ends (``bent``)."""
    # what is read from files might be null: said here, it need not be asked of each pair
    one = one.select("k", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in ENDS], "line", F.coalesce("grid", F.lit(0)).alias("grid"))
    # under the same names, so that rows at home are moved once, whichever side they are
    home = _cells(one.withColumn("g", F.col("grid")), "grid", "line")
    grids = [g for g in range(GRIDS) if used >> g & 1]
    coarser = F.array(*[F.when(F.col("grid") < g, F.lit(g)) for g in grids[1:]])
    visits = _cells(one.withColumn("g", F.explode(coarser)).where("g IS NOT NULL"), "grid", "line") if grids[1:] else None

    x, y = (lambda n: F.col(f"{n[0]}.{n[1]}x")), (lambda n: F.col(f"{n[0]}.{n[1]}y"))
    sa, sb, ta, tb = "sa", "sb", "ta", "tb"
    low, high = (lambda o: F.least(f"{o}.ay", f"{o}.by")), (lambda o: F.greatest(f"{o}.ay", f"{o}.by"))
    first = F.lit(False)
    for n in reversed(ENDS):
        first = (F.col(f"s.{n}") < F.col(f"t.{n}")) | ((F.col(f"s.{n}") == F.col(f"t.{n}")) & first)
    boxes = (x(sa) <= x(tb)) & (x(ta) <= x(sb)) & (low("s") <= high("t")) & (low("t") <= high("s"))
    # on which side of the line from p to q the point r lies
    turn = lambda p, q, r: (x(q) - x(p)) * (y(r) - y(p)) - (y(q) - y(p)) * (x(r) - x(p))
    turns = [turn(sa, sb, ta), turn(sa, sb, tb), turn(ta, tb, sa), turn(ta, tb, sb)]
    opposite = lambda d, e: F.signum(d) * F.signum(e) < 0
    meet = (opposite(*turns[:2]) & opposite(*turns[2:])) | reduce(or_, [d == 0 for d in turns])
    near = (F.col("s.h") == F.col("t.h")) & (F.col("t.grid") <= F.col("s.grid")) & boxes & _same(F.col("s.k"), F.col("t.k")) & meet
    met = lambda others, on: home.alias("s").hint("merge").join(others.alias("t"), on)
    found_in = [met(home, near & first), *([met(visits, near)] if visits is not None else [])]
    pairs = reduce(DataFrame.unionAll, [p.select("s.k", "s.h", "s.grid", *[F.struct(*[F.col(f"{o}.{n}") for n in [*ENDS, "line"]]).alias(o) for o in "st"], first.alias("first"), *[d.alias(f"d{n}") for n, d in enumerate(turns, 1)]) for p in found_in])
    per = _per(F.col("grid"))
    where = _cell_hash(F.col("k"), F.col("grid"), F.floor(F.greatest(x(sa), x(ta)) * per), F.floor(F.greatest(low("s"), low("t")) * per))
    # with a lambda it is no code of one piece with the join's, of which so much would never be compiled
    corner = F.exists(F.array("h"), lambda h: h == where)
    ends = lambda o, px, py: ((px == F.col(f"{o}.ax")) & (py == F.col(f"{o}.ay"))) | ((px == F.col(f"{o}.bx")) & (py == F.col(f"{o}.by")))
    box = lambda r, o: x(r).between(F.col(f"{o}.ax"), F.col(f"{o}.bx")) & y(r).between(low(o), high(o))
    inside = lambda r, o: box(r, o) & ~ends(o, x(r), y(r))
    point = lambda o, px, py, lap=False: F.struct(F.lit(o == "s").alias("s"), px.alias("x"), py.alias("y"), F.lit(lap).alias("lap"))
    touch = lambda d, r, o: F.when((F.col(d) == 0) & inside(r, o), point(o, x(r), y(r)))
    crossed = opposite("d1", "d2") & opposite("d3", "d4")
    # one division at the end: small whole coordinates give the nearest double, whichever pair meets there
    whole = F.col("d3") - F.col("d4")
    at = lambda a, b: F.try_divide(a * whole + (b - a) * F.col("d3"), whole) + 0.0
    px, py = at(x(sa), x(sb)), at(y(sa), y(sb))
    cross = lambda o: F.when(crossed & ~ends(o, px, py), point(o, px, py))
    # whichever of two straight lines along each other begins first has all that both have
    along = F.col("s.line").isNotNull() & F.col("t.line").isNotNull() & reduce(and_, [F.col(f"d{n}") == 0 for n in (1, 2, 3, 4)])
    less = lambda p, q: (x(p) < x(q)) | ((x(p) == x(q)) & (y(p) < y(q)))

    def lapped(o: str, a: str, b: str, oa: str, ob: str) -> Column:
        """The segment ``o`` from oa to ob is lapped from its start on by the other, from a to b."""
        other = a[0]
        shared = box(oa, other) & less(oa, b)
        return F.when(shared & less(b, ob) & box(b, o), point(o, x(b), y(b), True)).when(shared & ~less(b, ob) & box(ob, other), point(o, x(ob), y(ob), True))

    on_t = F.coalesce(F.when(along & F.col("first"), lapped("t", sa, sb, ta, tb)), touch("d4", sb, "t"))
    on_s = F.coalesce(F.when(along & ~F.col("first"), lapped("s", ta, tb, sa, sb)), touch("d2", tb, "s"))
    found = F.array(cross("s"), cross("t"), touch("d1", ta, "s"), on_s, touch("d3", sa, "t"), on_t)
    cut = pairs.select("k", "s", "t", found.alias("found"), corner.alias("corner"))
    cut = cut.withColumn("f", F.explode(F.when(F.col("corner"), F.col("found")))).where("f IS NOT NULL")
    of = [F.when(F.col("f.s"), F.col(f"s.{n}")).otherwise(F.col(f"t.{n}")).alias(n) for n in ["line", *(ENDS if bent else [])]]
    return stored(cut.select(*(["k"] if bent else []), *of, "f.x", "f.y", "f.lap"))


def _straight_parts(one: DataFrame, cuts: DataFrame) -> DataFrame:
    """The straight lines between nodes, each stretch once."""
    marks = cuts.where("line IS NOT NULL").groupBy(F.col("line").alias("of")).agg(F.collect_set(F.struct("x", "y", "lap")).alias("marks"))
    rows = one.where("line IS NOT NULL").select("k", *ENDS, *OF_LINE).hint("merge").join(marks, F.col("line") == F.col("of"), "left")
    wx, wy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    # how far along, told by the longer side
    far = lambda px, py: F.when(F.abs(wx) >= F.abs(wy), px).otherwise(py * F.signum(wy))
    stop = lambda px, py: F.struct(far(px, py).alias("u"), px.alias("x"), py.alias("y"))
    a, b = stop(F.col("ax"), F.col("ay")), stop(F.col("bx"), F.col("by"))
    stops = lambda keep: F.transform(F.filter("marks", keep), lambda c: stop(c["x"], c["y"]))
    inner = stops(lambda c: ~((c["x"] == F.col("bx")) & (c["y"] == F.col("by"))))
    listed = F.when(F.col("marks").isNull(), F.array(a, b)).otherwise(F.concat(F.array(a), F.sort_array(F.array_distinct(inner)), F.array(b)))
    rows = rows.withColumns({"stops": listed, "reach": F.array_max(stops(lambda c: c["lap"]))})
    # as the line runs: where it starts, and from there on
    side = lambda e, o, c: F.when(F.col("on"), F.col(f"{e}{c}")).otherwise(F.col(f"{o}{c}"))
    way = [c for n in "xyzm" for c in (side("a", "b", n).alias(f"p{n}"), side("b", "a", n).alias(f"q{n}"), (side("b", "a", n) - side("a", "b", n)).alias(f"d{n}"))]
    rows = rows.select("k", "line", "on", *way, "stops", F.size("stops").alias("n"), "reach.u", F.posexplode(F.slice("stops", 1, F.size("stops") - 1)).alias("run", "a"))
    rows = rows.withColumn("b", F.get("stops", F.col("run") + 1)).where("u IS NULL OR a.u >= u")
    along = lambda e: F.try_divide((F.col(f"{e}.x") - F.col("px")) * F.col("dx") + (F.col(f"{e}.y") - F.col("py")) * F.col("dy"), F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    rows = rows.withColumns({"ta": along("a"), "tb": along("b")})
    is_at = lambda e, p: (F.col(f"{e}.x") == F.col(f"{p}x")) & (F.col(f"{e}.y") == F.col(f"{p}y"))
    between = lambda e, c: F.when(is_at(e, "p"), F.col(f"p{c}")).when(is_at(e, "q"), F.col(f"q{c}")).otherwise(F.col(f"p{c}") + F.col(f"d{c}") * F.col(f"t{e}"))
    vertex = lambda e: F.struct(f"{e}.x", f"{e}.y", between(e, "z").alias("z"), between(e, "m").alias("m"))
    run = F.when(F.col("on"), F.col("run") + 1).otherwise(F.col("n") - 1 - F.col("run")).cast("long")
    rows = rows.select("k", F.struct("line", run.alias("run")).alias("n_part"), "on", vertex("a").alias("a"), vertex("b").alias("b"))
    return rows.select("k", "n_part", F.when(F.col("on"), F.array("a", "b")).otherwise(F.array("b", "a")).alias("part"))


def _marks(lines: DataFrame, segments: DataFrame, cuts: DataFrame, straight: DataFrame) -> DataFrame:
    """By line: the points at which its segments are cut (``t``: how far along), and
    its vertices that are no nodes (these without t, x and y); ``straight`` ends at
    nodes."""
    ends = F.xxhash64("k", *ENDS)
    cuts = cuts.where("NOT (x = bx AND y = by)")
    c = cuts.select(ends.alias("c_h"), F.col("k").alias("c_k"), *[F.col(n).alias(f"c_{n}") for n in ENDS], "x", "y")
    exact = reduce(and_, [_same(F.col(n), F.col(f"c_{n}")) for n in ["k", *ENDS]])
    met = _placed(segments, "line", "at").withColumn("h", ends).hint("merge").join(c, (F.col("h") == F.col("c_h")) & exact)
    start = lambda c: F.when(F.col("on"), F.col(f"a{c}")).otherwise(F.col(f"b{c}"))
    to = lambda c: F.when(F.col("on"), F.col(f"b{c}")).otherwise(F.col(f"a{c}"))
    met = met.select("line", "at", "x", "y", *[start(c).alias(f"p{c}") for c in "xy"], *[(to(c) - start(c)).alias(f"d{c}") for c in "xy"])
    along = ((F.col("x") - F.col("px")) * F.col("dx") + (F.col("y") - F.col("py")) * F.col("dy")) / (F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    inner = met.select("line", "at", along.alias("t"), "x", "y")
    passed = lines.select("k", "line", F.size("v").alias("n"), F.posexplode("v").alias("at", "p"))
    passed = passed.select("k", (F.col("p.x") + 0.0).alias("x"), (F.col("p.y") + 0.0).alias("y"), "line", "at", ((F.col("at") == 0) | (F.col("at") == F.col("n") - 1)).alias("node"))
    nothing = [F.lit(None).cast("long").alias("line"), F.lit(None).cast("int").alias("at"), F.lit(True).alias("node")]
    # who passes where nobody else does is the only one there, so no join has to find the line
    points = passed.unionAll(cuts.select("k", "x", "y", *nothing))
    for e in "ab":
        points = points.unionAll(straight.select("k", f"{e}x", f"{e}y", *nothing))
    points = points.groupBy("k", "x", "y")
    plain = points.agg(F.count(F.lit(1)).alias("times"), F.bool_or("node").alias("node"), F.min("line").alias("line"), F.min("at").alias("at")).where("times = 1 AND NOT node")
    marks = inner.unionAll(plain.select("line", "at", *[F.lit(None).cast("double").alias(n) for n in ("t", "x", "y")]))
    return marks.groupBy("line").agg(F.collect_set(F.struct("at", "t", "x", "y")).alias("marks"))


def _parts(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """The lines between nodes, in order, by line."""
    mark = "struct<at:int,t:double,x:double,y:double>"
    rows = lines.hint("merge").join(marks, "line", "left").withColumn("marks", F.coalesce("marks", F.array().cast(f"array<{mark}>")))
    plain = F.transform(F.filter("marks", lambda c: c["x"].isNull()), lambda c: c["at"])
    nothing = F.lit(None).cast("double")
    nodes = F.transform(F.array_except(F.sequence(F.lit(0), F.size("v") - 1), plain), lambda i: F.struct(i.alias("at"), nothing.alias("t"), nothing.alias("x"), nothing.alias("y")))
    # nulls come first: a vertex before the cuts of its segment
    stops = F.sort_array(F.concat(nodes, F.filter("marks", lambda c: c["x"].isNotNull())))
    rows = rows.select("k", "line", "v", stops.alias("stops"))
    rows = rows.select("k", "line", "v", "stops", F.posexplode(F.slice("stops", 1, F.size("stops") - 1)).alias("run", "a")).withColumn("b", F.get("stops", F.col("run") + 1))

    def vertex(c: str) -> Column:
        p, q, t = F.get("v", F.col(f"{c}.at")), F.get("v", F.col(f"{c}.at") + 1), F.col(f"{c}.t")
        between = lambda n: (p[n] + (q[n] - p[n]) * t).alias(n)
        return F.when(F.col(f"{c}.x").isNull(), p).otherwise(F.struct(F.col(f"{c}.x").alias("x"), F.col(f"{c}.y").alias("y"), between("z"), between("m")))

    # between two stops lie the vertices that are no nodes
    many = F.col("b.at") - F.col("a.at") - F.when(F.col("b.x").isNull(), 1).otherwise(0)
    rows = rows.select("k", F.struct("line", (F.col("run") + 1).cast("long").alias("run")).alias("n_part"), "v", F.col("a.at").alias("at"), many.alias("many"), vertex("a").alias("a"), vertex("b").alias("b"))
    part = F.when(F.col("many") == 0, F.array("a", "b")).otherwise(F.concat(F.array("a"), F.slice("v", F.col("at") + 2, F.col("many")), F.array("b")))
    xy = [(F.col(e)[c] + 0.0).alias(f"{n}{c}") for e, n in (("a", "p"), ("b", "q")) for c in "xy"]
    return rows.select("k", "n_part", *xy, (F.col("many") == 0).alias("single"), part.alias("part"))


def union_lines(df: DataFrame, keys: list[str], geometry: str = "geometry") -> DataFrame:
    """One row per line between nodes: the keys, ``part`` (an array of vertices),
    ``n_part`` (orders the parts of a group).

    z and M are interpolated at cuts; a stretch that several lines share has those
    of one of them.  Whether a point lies on a segment is told in doubles: what
    misses by rounding does not touch.  Crossings are rounded once, for both
    lines.  The vertices of one line are cut in one task, as a line is one value.

    Keys may be null; equal nulls are one group.  Geometries that are null, empty or
    no lines, vertices without finite x and y, and lines that stay at one point
    give no rows; an empty table gives none.  Runs jobs while it is built.
    """
    rows = _vertices(df, keys, geometry)
    lines = _bent(rows)
    segments = _segments(lines)
    one = _different(_straight(rows), _placed(segments))
    found = one.agg(F.bit_or(F.expr("shiftleft(1L, grid)")), F.bool_or(F.col("line").isNotNull()), F.bool_or(F.col("line").isNull())).first()
    used, straight, bent = found[0] or 0, bool(found[1]), bool(found[2])
    cuts = _cuts(one, used, bent)
    name = lambda parts: parts.select(*[F.col(f"k.{c}").alias(c) for c in keys], "n_part", "part")
    if not bent:
        return name(_straight_parts(one, cuts))
    parts = _parts(lines, _marks(lines, segments, cuts, one.where("line IS NOT NULL")))
    if straight:
        ends = [F.col("part")[n][c].alias(f"{e}{c}") for n, e in enumerate("pq") for c in "xy"]
        parts = parts.unionByName(stored(_straight_parts(one, cuts)).select("*", *ends, F.lit(True).alias("single")))
    # only parts of one piece can be shared: an inner vertex of a part is passed once
    same = ["k", *ENDS, "own"]
    rows = _placed(parts, F.when(~F.col("single"), F.col("n_part")).alias("own"), F.struct("n_part", "part").alias("p"))
    # rows are sorted by the hash first, which is quick to compare
    once = rows.groupBy(F.xxhash64(*same).alias("h"), *same).agg(F.min("p").alias("p"))
    return name(once.select("k", "p.*"))


def united(df: DataFrame, keys: list[str], geometry: str = "geometry") -> DataFrame:
    """One row per group that has lines: its keys and their union as one line of
    many parts, which is one value; ``union_lines`` has a row a part."""
    listed = union_lines(df, keys, geometry).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n_part", "part"))).alias("l"))
    parts = F.transform("l", lambda x: x["part"])
    kind = F.when(F.size("l") > 1, "MultiLineString").otherwise("LineString")
    return listed.select(*keys, F.struct(kind.alias("type"), parts.alias("parts")).alias(geometry))
