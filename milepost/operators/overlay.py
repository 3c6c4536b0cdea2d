"""Overlay of two line-event tables (dynamic segmentation).

Each target is broken at the bounds of the overlays on its route; each slice
carries the target's attributes and those of an overlay that covers it.  One
equi-join on the route key (the range test is its residual) and one
aggregation over the same partitioning do the work: the overlays of a target
are collected next to it, sliced with array functions, and exploded.  On routes
of very many rows targets and overlays meet in cells along the route instead
(see ``cells``), so what one task holds is the overlays of single targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.schema import LrsSchema, col, dates_overlap
from .cells import meet
from .dissolve import collapse_longest
from .scan import NEVER


def match_columns(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]] | None) -> list[tuple[Column, Column]]:
    """Extra keys, compared as text, null equal to null: two non-null columns
    per pair on each side, so that the join stays a plain equi-join."""
    out = []
    for a, b in pairs or []:
        a, b = col(a).cast("string"), col(b).cast("string")
        out += [(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))), (a.isNull(), b.isNull())]
    return out


def keyed(df: DataFrame, schema: LrsSchema, extra: list[Column], prefix: str) -> list[Column]:
    """The join key: route id without nulls, whether it was null, extra keys."""
    keys = [F.coalesce(schema.key, F.lit("")), schema.key.isNull(), *extra]
    return [k.alias(f"{prefix}k{n}") for n, k in enumerate(keys)]


def overlay_events(
    target: DataFrame,
    overlay: DataFrame,
    target_schema: LrsSchema | None = None,
    overlay_schema: LrsSchema | None = None,
    how: str = "left",
    overlay_cols: list[str] | None = None,
    collapse: str = "none",
    collapse_group_cols: list[str] | None = None,
    target_rename: dict[str, str] | None = None,
    match_pairs: list[tuple[str, str]] | None = None,
    date_columns: tuple[str | None, str | None, str | None, str | None] | None = None,
    method: str = "edges",
    null_keys_match: bool | None = None,
    seq_cols: list[str] | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Slices of ``target`` with the attributes of ``overlay``.

    ``method="edges"`` breaks at every bound and gives each covering overlay a
    row of its own; ``"cursor"`` sweeps from left to right, where a later
    overlay loses what an earlier one covered.  ``how="inner"`` drops slices
    without an overlay.  Overlay columns replace target columns of their name.
    ``match_pairs``: (target column, overlay column) that must agree as text;
    ``date_columns``: target from/to, overlay from/to of periods that must
    meet.  ``seq_cols`` order overlays that begin together (cursor).  Routes of
    more than ``hot_rows`` rows are cut into cells.

    Defined results: targets with a null bound survive a left overlay as they
    are, without overlay attributes; overlays with a null bound are left out;
    null route ids meet each other with ``edges`` (not with ``cursor``).
    """
    if how not in ("left", "inner"):
        raise ValueError("how: left or inner")
    if collapse not in ("none", "longest"):
        raise ValueError("collapse: none or longest")
    if method not in ("edges", "cursor"):
        raise ValueError("method: edges or cursor")
    t_schema = target_schema or LrsSchema.of(target, require_line=True)
    o_schema = overlay_schema or LrsSchema.of(overlay, require_line=True)
    t_schema.check_line(target)
    o_schema.check_line(overlay)
    if null_keys_match is None:
        null_keys_match = method == "edges"

    rename = target_rename or {}
    base = [c for c in target.columns if c not in (t_schema.bmp, t_schema.emp, "geometry")]
    excluded = (o_schema.roadway, o_schema.bmp, o_schema.emp, "geometry")
    chosen = [c for c in overlay.columns if c not in excluded] if overlay_cols is None else [c for c in overlay_cols if c in overlay.columns]

    pairs = match_columns(target, overlay, match_pairs)
    dates = date_columns or (None, None, None, None)
    period = [col(c) if c else F.lit(None).cast("string") for c in dates]
    t = target.select(
        *keyed(target, t_schema, [a for a, _ in pairs], "t"), F.monotonically_increasing_id().alias("tid"), t_schema.begin.alias("tb"), t_schema.end.alias("te"),
        F.struct(*[col(c).alias(f"c{n}") for n, c in enumerate(base)]).alias("row"), period[0].alias("tf"), period[1].alias("tt"),
    )
    order = F.struct(*[col(c) for c in seq_cols]) if seq_cols else F.monotonically_increasing_id()
    o = overlay.select(
        *keyed(overlay, o_schema, [b for _, b in pairs], "o"), o_schema.begin.alias("ob"), o_schema.end.alias("oe"), order.alias("os"),
        F.struct(F.lit(True).alias("hit"), *[col(c).alias(f"c{n}") for n, c in enumerate(chosen)]).alias("o"), period[2].alias("of"), period[3].alias("ot"),
    ).where("ob IS NOT NULL AND oe IS NOT NULL")
    if not null_keys_match:
        o = o.where("NOT ok1")
    keys = [f"k{n}" for n in range(2 + len(pairs))]
    on = (F.col("ob") < F.col("te")) & (F.col("oe") > F.col("tb"))
    if dates[0] and dates[2]:
        on = on & dates_overlap(F.col("tf"), F.col("tt"), F.col("of"), F.col("ot"))
    met = meet(t, o, [(f"t{k}", f"o{k}") for k in keys], ("tb", "te"), ("ob", "oe"), on, "left", [*[f"t{k}" for k in keys], "tid"], hot_rows)
    cut = _edges if method == "edges" else _cursor
    plain, hot = (cut(part.drop("tf", "tt", "of", "ot"), keys) for part in met)
    slices = plain.unionAll(hot)
    hit = F.col("o.hit").isNotNull()
    slices = slices.where(hit if how == "inner" else F.lit(True))

    out: dict[str, Column] = {}
    for c in target.columns:
        if c in base:
            out[rename.get(c, c)] = F.col(f"row.c{base.index(c)}")
        elif c != "geometry":
            out[rename.get(c, c)] = F.col("b" if c == t_schema.bmp else "e")
    for n, c in enumerate(chosen):
        out[c] = F.col(f"o.c{n}")
    result = slices.select(*[v.alias(k) for k, v in out.items()])
    if collapse == "longest":
        named = {r: rename.get(getattr(t_schema, r), getattr(t_schema, r)) for r in ("roadway", "bmp", "emp")}
        # the slices are joined and cut already: they are not made thrice to find hot groups
        return collapse_longest(result, t_schema.updated(**named), collapse_group_cols, hot_rows=NEVER)
    return result


def _edges(met: DataFrame, keys: list[str]) -> DataFrame:
    """Break at every edge: (row, b, e, o) per slice and covering overlay."""
    one = F.struct("ob", "oe", "o")
    groups = met.groupBy(*[f"t{k}" for k in keys], "tid").agg(
        F.any_value("tb").alias("tb"), F.any_value("te").alias("te"), F.any_value("row").alias("row"),
        F.collect_list(F.when(F.col("ob").isNotNull(), one)).alias("ov"),
    )
    none = F.lit(None).cast(met.schema["o"].dataType)
    inner = F.flatten(F.transform("ov", lambda x: F.array(F.greatest(F.col("tb"), x["ob"]), F.least(F.col("te"), x["oe"]))))
    breaks = F.array_sort(F.array_distinct(F.concat(F.array("tb", "te"), inner)))
    pairs = F.transform(F.slice("br", 1, F.size("br") - 1), lambda x, i: F.struct(x.alias("b"), F.element_at("br", i + 2).alias("e")))

    def rows_of(s: Column) -> Column:
        over = F.filter("ov", lambda x: (x["ob"] < s["e"]) & (x["oe"] > s["b"]))
        return F.when(F.size(over) == 0, F.array(_slice(s["b"], s["e"], none))).otherwise(F.transform(over, lambda x: _slice(s["b"], s["e"], x["o"])))

    met_some = F.size("ov") > 0
    groups = groups.withColumn("br", F.when(met_some, breaks))
    cut = F.when(met_some, F.flatten(F.transform(pairs, rows_of))).when(_stays_alone(), F.array(_slice(F.col("tb"), F.col("te"), none)))
    return groups.select("row", F.explode(cut).alias("s")).select("row", "s.b", "s.e", "s.o")


def _slice(b: Column, e: Column, o: Column) -> Column:
    return F.struct(b.alias("b"), e.alias("e"), o.alias("o"))


def _stays_alone() -> Column:
    """Without overlays a target stays if it has length, or bounds unknown."""
    return F.col("tb").isNull() | F.col("te").isNull() | (F.col("tb") < F.col("te"))


def _cursor(met: DataFrame, keys: list[str]) -> DataFrame:
    """Sweep: gap before, and uncovered rest of, each overlay in order."""
    w = Window.partitionBy(*[f"t{k}" for k in keys], "tid").orderBy("ob", "os")
    reach = F.max(F.least("te", "oe")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.max(F.least("te", "oe")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    none = F.lit(None).cast(met.schema["o"].dataType)
    swept = met.withColumns({"cur": F.greatest("tb", reach), "stop": F.greatest("tb", after), "last": F.lead("ob").over(w).isNull()})
    parts = F.array(
        _slice(F.col("cur"), F.least("ob", "te"), none),
        _slice(F.greatest("cur", "ob"), F.least("te", "oe"), F.col("o")),
        F.when(F.col("last"), _slice(F.col("stop"), F.col("te"), none)),
    )
    long = F.filter(parts, lambda s: s["b"] < s["e"])
    cut = F.when(F.col("ob").isNotNull(), long).when(_stays_alone(), F.array(_slice(F.col("tb"), F.col("te"), none)))
    return swept.select("row", F.explode(cut).alias("s")).select("row", "s.b", "s.e", "s.o")


def route_coverage(target: DataFrame, overlay: DataFrame, target_schema: LrsSchema, overlay_schema: LrsSchema) -> DataFrame:
    """(route, found_in): ``target``, ``overlay`` or ``both``."""
    a = target.select(target_schema.key.alias("route")).where("route IS NOT NULL").distinct().withColumn("a", F.lit(True))
    b = overlay.select(overlay_schema.key.alias("route")).where("route IS NOT NULL").distinct().withColumn("b", F.lit(True))
    where = F.when(F.col("b").isNull(), "target").when(F.col("a").isNull(), "overlay").otherwise("both")
    return a.join(b, "route", "full").select("route", where.alias("found_in"))
