"""Route geometry: cut events out of it, dissolve it, calibrate it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import is_empty, is_line, line_length, split_line_by_measure, with_measures
from ..functions.keys import is_missing, to_number
from ..plans.schema import LrsSchema, col, resolve_roles
from .dissolve import dissolve, dissolve_apart
from .numbering import numbered
from .planar import union_lines, united


def locate_events_on_routes(events: DataFrame, routes: DataFrame, event_schema: LrsSchema | None = None, route_schema: LrsSchema | None = None, null_keys_match: bool = True) -> DataFrame:
    """Each event with the stretch of route geometry between its measures, the
    pieces of all matching route rows joined; events without one stay, with a
    null geometry."""
    e_schema = event_schema or LrsSchema.of(events, require_line=True)
    r_schema = route_schema or LrsSchema.of(routes, require_line=True)
    e_schema.check_line(events)
    r_schema.check_line(routes)
    kept = [c for c in events.columns if c != "geometry"]
    value = lambda c: e_schema.begin if c == e_schema.bmp else e_schema.end if c == e_schema.emp else col(c)
    keys = lambda s: [F.coalesce(s.key, F.lit("")), s.key.isNull()]
    ek, rk = keys(e_schema), keys(r_schema)
    e = events.select(ek[0].alias("k"), ek[1].alias("z"), F.monotonically_increasing_id().alias("id"), e_schema.begin.alias("cb"), e_schema.end.alias("ce"), F.struct(*[value(c).alias(f"c{n}") for n, c in enumerate(kept)]).alias("row"))
    r = routes.select(rk[0].alias("rk"), rk[1].alias("rz"), F.monotonically_increasing_id().alias("piece"), r_schema.begin.alias("rb"), r_schema.end.alias("re"), col("geometry").alias("g"))
    if not null_keys_match:
        r = r.where("NOT rz")
    # rows of the route that cannot give a piece never reach the kernel
    gives = is_line(F.col("g")) & (F.col("rb") < F.col("re")) & F.col("cb").isNotNull() & F.col("ce").isNotNull() & (F.least("re", "ce") > F.greatest("rb", "cb"))
    met = e.join(r, (F.col("k") == F.col("rk")) & (F.col("z") == F.col("rz")) & gives, "left")
    met = met.withColumn("p", split_line_by_measure(F.col("g"), F.col("rb"), F.col("re"), F.col("cb"), F.col("ce")))
    done = met.groupBy("k", "z", "id").agg(
        F.any_value("row").alias("row"), F.array_sort(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("piece", F.col("p.parts").alias("parts"))))).alias("l")
    )
    parts = F.flatten(F.transform("l", lambda x: x["parts"]))
    kind = F.when(F.size(parts) > 1, "MultiLineString").otherwise("LineString")
    geometry = F.when(F.size(parts) > 0, F.struct(kind.alias("type"), parts.alias("parts")))
    return done.select(*[F.col(f"row.c{n}").alias(c) for n, c in enumerate(kept)], geometry.alias("geometry"))


def dissolve_geometries(df: DataFrame, schema: LrsSchema | None = None, group_cols: list[str] | None = None, seq_cols: list[str] | None = None, union: str = "parts", require_contiguous: bool = True) -> DataFrame:
    """``dissolve`` of a table with geometry: a block's lines become one, of all
    their parts (``union="parts"``) or split at nodes with every stretch once
    (``"true"``; ``dissolve_lines`` has a row a line).  Blocks without a line stay,
    with a null geometry in a true union."""
    if union not in ("parts", "true"):
        raise ValueError("union: parts or true")
    if union == "parts":
        return dissolve(df, schema, group_cols, require_contiguous, seq_cols=seq_cols)
    blocks, lines = dissolve_apart(df, schema, group_cols, require_contiguous, seq_cols)
    return blocks.join(united(lines, ["__block"]), "__block", "left").select(df.columns)


def dissolve_lines(df: DataFrame, schema: LrsSchema | None = None, group_cols: list[str] | None = None, seq_cols: list[str] | None = None, require_contiguous: bool = True) -> tuple[DataFrame, DataFrame]:
    """``dissolve_geometries`` in a true union with a row a line, for blocks of
    more lines than one value can hold: the blocks without geometry, and their
    lines between nodes as ``union_lines`` gives them, both with ``__block``."""
    blocks, lines = dissolve_apart(df, schema, group_cols, require_contiguous, seq_cols)
    return blocks, union_lines(lines, ["__block"])


def display_events(routes: DataFrame, events: DataFrame | None = None, drop_empty: bool = True, **schemas: LrsSchema | None) -> DataFrame:
    """What to draw: events cut from the routes, or the routes themselves."""
    shown = routes if events is None else locate_events_on_routes(events, routes, **schemas)
    return shown.where(~is_empty(col("geometry"))) if drop_empty else shown


def calibrate_routes(routes: DataFrame, crs: str = "EPSG:4326", seq_cols: list[str] | None = None, **wanted: str | None) -> DataFrame:
    """Routes with ids, bounds and M values filled in where they lack.

    Missing ids become R000001 ... in row order (``seq_cols``, else read
    order); bounds that are missing or have no length become 0 and the line's
    length; lines without M get it along their length.  Absent columns are
    added as LRS_UID, LRS_BMP and LRS_EMP.  Rows are numbered in ranges kept in
    the shared folder (``numbering``), which runs a job while the query is built.
    """
    found = resolve_roles(routes.columns, wanted)
    road, bmp, emp = found["roadway"] or "LRS_UID", found["bmp"] or "LRS_BMP", found["emp"] or "LRS_EMP"
    rows = routes
    for name, kind in ((road, "string"), (bmp, "double"), (emp, "double")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    lacks = is_missing(col(road))
    # read order, or that of seq_cols; rows that have an id are not counted
    rows = numbered(rows, "__n", [col(c) for c in seq_cols or []], lacks)
    name = F.concat(F.lit("R"), F.when(F.length(F.col("__n").cast("string")) >= 6, F.col("__n").cast("string")).otherwise(F.lpad(F.col("__n").cast("string"), 6, "0")))
    rows = rows.withColumn(road, F.when(F.col("__n").isNull(), col(road).cast("string")).otherwise(name)).drop("__n")
    b, e = to_number(col(bmp)), to_number(col(emp))
    sound: Column = F.coalesce(e > b, F.lit(False))
    rows = rows.withColumns({"__b": F.when(sound, b).otherwise(F.lit(0.0)), "__e": F.when(sound, e).otherwise(F.coalesce(line_length(col("geometry"), crs), F.lit(0.0)))})
    filled = {bmp: F.when(sound, b).otherwise(F.col("__b")), emp: F.when(sound, e).otherwise(F.col("__e"))}
    rows = rows.withColumn("geometry", with_measures(col("geometry"), F.col("__b"), F.col("__e"), crs)).withColumns(filled)
    return rows.drop("__b", "__e")
