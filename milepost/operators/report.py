"""Run reports: one row of counts, and lines of text made from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import has_m, is_empty, is_line, is_point
from ..functions.keys import is_missing
from ..plans.schema import LrsSchema, col
from .cells import meet
from .overlay import route_coverage
from .packed import approaches
from .routes import locate_events_on_routes


def _one(*tables: DataFrame) -> DataFrame:
    """One-row tables side by side."""
    first, *rest = tables
    for t in rest:
        first = first.crossJoin(t)
    return first


def overlay_counts(target: DataFrame, overlay: DataFrame, result: DataFrame, target_schema: LrsSchema, overlay_schema: LrsSchema) -> DataFrame:
    """Rows, routes (own, shared, on one side only), slices without overlay
    attributes (judged by the first overlay column), null and inverted keys."""
    t, o = target_schema, overlay_schema
    nulls = t.key.isNull() | t.begin.isNull() | t.end.isNull()
    a = target.agg(F.count(F.lit(1)).alias("target_rows"), F.count_distinct(t.key).alias("target_routes"), F.count_if(nulls).alias("null_keys"), F.count_if(~nulls & (t.begin > t.end)).alias("inverted"))
    b = overlay.agg(F.count(F.lit(1)).alias("overlay_rows"), F.count_distinct(o.key).alias("overlay_routes"))
    flag = next((c for c in overlay.columns if c not in (o.roadway, o.bmp, o.emp, "geometry")), None)
    c = result.agg(F.count(F.lit(1)).alias("result_rows"), (F.count_if(col(flag).isNull()) if flag else F.lit(0).cast("long")).alias("unmatched_slices"))
    where = lambda w: F.count_if(F.col("found_in") == w)
    d = route_coverage(target, overlay, t, o).agg(where("both").alias("shared_routes"), where("target").alias("only_target"), where("overlay").alias("only_overlay"))
    return _one(a, b, c, d)


def locate_counts(points: DataFrame, events: DataFrame, point_schema: LrsSchema, event_schema: LrsSchema) -> DataFrame:
    """Points by outcome: on a segment, route unknown, off all segments, no
    measure."""
    p = points.select(point_schema.key.alias("k"), point_schema.at.alias("m"))
    e = events.select(event_schema.key.alias("ek"), event_schema.begin.alias("b"), event_schema.end.alias("e"))
    # equal points stand for each other; a segment is met once or not at all
    p = p.groupBy("k", "m").agg(F.count(F.lit(1)).alias("n")).withColumn("m2", F.col("m"))
    plain, hot = meet(p, e, [("k", "ek")], ("m", "m2"), ("b", "e"), F.col("m").between(F.col("b"), F.col("e")))
    on = plain.unionAll(hot).select(F.col("k").alias("ok"), F.col("m").alias("om")).distinct().withColumn("on", F.lit(True))
    routes = e.select(F.col("ek").alias("rk")).distinct().withColumn("route", F.lit(True))
    met = p.join(on, (F.col("k") == F.col("ok")) & (F.col("m") == F.col("om")), "left").join(routes, F.col("k") == F.col("rk"), "left")
    known, on, route = F.col("m").isNotNull(), F.col("on").isNotNull(), F.col("route").isNotNull()
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")
    return met.agg(
        total(F.lit(True)).alias("points"), total(known & on).alias("on_segment"), total(known & ~route).alias("no_roadway"),
        total(known & route & ~on).alias("off_measure"), total(~known).alias("null_measure"),
    )


def clip_counts(events: DataFrame, routes: DataFrame, event_schema: LrsSchema, route_schema: LrsSchema) -> DataFrame:
    """Events by outcome of cutting them from route geometry."""
    done = locate_events_on_routes(events, routes, event_schema, route_schema).withColumn("__k", event_schema.key)
    have = routes.where(route_schema.key.isNotNull()).groupBy(route_schema.key.alias("__r")).agg(F.bool_or(is_line(col("geometry"))).alias("__g"))
    done = done.join(have, F.col("__k") == F.col("__r"), "left")
    drawn = is_line(col("geometry"))
    e = event_schema
    return done.agg(
        F.count(F.lit(1)).alias("events"), F.count_if(drawn).alias("with_geometry"), F.count_if(~drawn).alias("no_geometry"), F.count_if(F.col("__r").isNull()).alias("no_route"),
        F.count_if(~drawn & F.col("__r").isNotNull() & ~F.col("__g")).alias("no_route_geometry"), F.count_if(F.coalesce(e.begin >= e.end, F.lit(False))).alias("inverted"),
    )


#: Wording of each count: level if it is not zero, and text.
LINES = {
    "target_rows": ("info", "{} target rows"), "overlay_rows": ("info", "{} overlay rows"), "result_rows": ("ok", "{} slices"),
    "shared_routes": ("ok", "{} routes on both sides"), "only_target": ("warn", "{} routes only in the target: they keep target attributes only"),
    "only_overlay": ("warn", "{} routes only in the overlay: not used"), "unmatched_slices": ("warn", "{} slices without overlay attributes"),
    "null_keys": ("warn", "{} rows without a route id or measure"), "inverted": ("err", "{} rows begin at or after their end"),
    "points": ("info", "{} points"), "on_segment": ("ok", "{} points located"), "no_roadway": ("warn", "{} points on no known route"),
    "off_measure": ("warn", "{} points outside all segments of their route"), "null_measure": ("warn", "{} points without a measure"),
    "source_rows": ("info", "{} source rows"), "approaches": ("ok", "{} approaches"), "skipped": ("warn", "{} rows without a readable approach"),
    "events": ("info", "{} events"), "with_geometry": ("ok", "{} geometries written"), "no_geometry": ("warn", "{} events without a line"),
    "no_route": ("warn", "{} events on routes not in the layer"), "no_route_geometry": ("err", "{} events on routes without line geometry"),
    "inverted_bounds": ("err", "{} rows with inverted bounds"), "zero_length": ("warn", "{} rows of no length"), "null_key": ("err", "{} rows without a key"),
    "overlap": ("err", "{} overlapping pairs"), "gap": ("warn", "{} gaps"), "usable": ("ok", "{} rows with usable keys"), "missing": ("warn", "{} rows without keys"),
    "packed_hits": ("info", "{} rows with packed approaches"), "approach_count": ("info", "{} packed approaches"),
}


def report_lines(counts: DataFrame) -> list[tuple[str, str]]:
    """(level, text) of a one-row table of counts; warnings only if not zero."""
    row = counts.first().asDict()
    return [(LINES[k][0], LINES[k][1].format(n)) for k, n in row.items() if k in LINES and (n or LINES[k][0] in ("info", "ok"))]


def extract_counts(df: DataFrame, packed_col: str) -> DataFrame:
    """One row: source rows, readable approaches, rows without one."""
    # counted once a row, before the sums name it
    n, rows = F.col("n"), df.select(F.size(approaches(col(packed_col))).alias("n"))
    return rows.agg(F.count(F.lit(1)).alias("source_rows"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("approaches"), F.count_if(n == 0).alias("skipped"))


def geometry_bounds(df: DataFrame) -> DataFrame:
    """One row: the least and greatest x and y of all vertices."""
    vertex = df.select(F.explode(F.flatten(col("geometry")["parts"])).alias("v"))
    return vertex.agg(F.min("v.x").alias("min_x"), F.min("v.y").alias("min_y"), F.max("v.x").alias("max_x"), F.max("v.y").alias("max_y"))


def geometry_counts(df: DataFrame) -> DataFrame:
    """One row: rows, rows with a line, with a point, with M, with nothing."""
    g = col("geometry")
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(is_line(g)).alias("lines"), F.count_if(is_point(g)).alias("points"),
        F.count_if(has_m(g)).alias("with_m"), F.count_if(is_empty(g)).alias("empty"),
    )


def unique_values(df: DataFrame, column: str, n: int = 8) -> DataFrame:
    """The first ``n`` distinct values in order, as text; missing ones left out."""
    value = col(column)
    return df.where(~is_missing(value)).select(value.cast("string").alias("value")).distinct().orderBy("value").limit(n)


def sample_values(df: DataFrame, column: str, n: int = 8) -> DataFrame:
    """One row: the first ``n`` distinct values as ``text``, with how many more
    there are.  Only those values are gathered."""
    distinct = df.select(col(column).cast("string").alias("v")).where("v IS NOT NULL").distinct()
    first = distinct.orderBy("v").limit(n).agg(F.array_join(F.array_sort(F.collect_list("v")), ", ").alias("text"))
    many = distinct.agg(F.count(F.lit(1)).alias("n"))
    more = F.col("n") - n
    return _one(first, many).select(F.when(more > 0, F.concat("text", F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(F.col("text")).alias("text"))
