"""Locate points on line events: which segment covers a measure?"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import is_point, point_at_measure
from ..plans.schema import LrsSchema, col
from .cells import meet
from .overlay import keyed, match_columns

#: Point columns that an event column of the same name never replaces.
KEPT = ("LRS_PARENT_ID", "LRS_SUB_ID", "LRS_SOURCE_ROW", "ROADWAY_ORIG")


@dataclass(frozen=True)
class Located:
    located: DataFrame
    unmatched: DataFrame


def locate_points(
    points: DataFrame,
    events: DataFrame,
    point_schema: LrsSchema | None = None,
    event_schema: LrsSchema | None = None,
    how: str = "inner",
    event_cols: list[str] | None = None,
    match_pairs: list[tuple[str, str]] | None = None,
    boundary: str = "next",
    unmatched: str = "points",
    hot_rows: int | None = None,
) -> Located:
    """Points with the attributes of each segment that covers them, and those
    that none covers.

    ``boundary="next"``: where a segment ends at the measure and another of the
    route begins there, only the latter counts; ``"both"`` takes both.
    ``unmatched="points"`` gives each uncovered point once, with null event
    columns; ``"pairs"`` every (point, segment) of a route that do not meet,
    and points of routes without segments.  ``how`` is checked and has no
    further effect.  Event columns replace point columns of their name, but
    for the point's route, measure and provenance columns.  Routes of more than
    ``hot_rows`` rows are cut into cells (see ``cells``), but for ``"pairs"`` and for streams of points, whose routes
    can't be counted first.
    """
    if how not in ("inner", "left"):
        raise ValueError("how: inner or left")
    if boundary not in ("next", "both"):
        raise ValueError("boundary: next or both")
    if unmatched not in ("points", "pairs"):
        raise ValueError("unmatched: points or pairs")
    p_schema = point_schema or LrsSchema.of(points, require_measure=True)
    e_schema = event_schema or LrsSchema.of(events, require_line=True)
    p_schema.check_point(points)
    e_schema.check_line(events)
    chosen = [c for c in events.columns if c not in (e_schema.roadway, "geometry")] if event_cols is None else [c for c in event_cols if c in events.columns and c != "geometry"]
    chosen += [c for c in (e_schema.bmp, e_schema.emp) if c not in chosen]
    chosen = [c for c in chosen if c not in (p_schema.roadway, p_schema.measure, *KEPT)]

    pairs = match_columns(points, events, match_pairs)
    p = points.select(
        *keyed(points, p_schema, [a for a, _ in pairs], "p"), p_schema.at.alias("m"),
        F.struct(*[col(c).alias(f"c{n}") for n, c in enumerate(points.columns)]).alias("p"),
    )
    line = [col("geometry").alias("g")] if "geometry" in events.columns else []
    value = lambda c: e_schema.begin if c == e_schema.bmp else e_schema.end if c == e_schema.emp else col(c)
    e = events.select(
        *keyed(events, e_schema, [b for _, b in pairs], "e"), e_schema.begin.alias("b"), e_schema.end.alias("e"),
        F.struct(F.lit(True).alias("hit"), *[value(c).alias(f"c{n}") for n, c in enumerate(chosen)], *line).alias("o"),
    )
    keys = [f"k{n}" for n in range(2 + len(pairs))]
    # points at hand are told of segments that begin at them by what they meet
    told = unmatched == "points" and not points.isStreaming
    if boundary == "next" and not told:
        starts = e.where("b IS NOT NULL").select(*[F.col(f"e{k}").alias(f"s{k}") for k in keys], F.col("b").alias("at")).distinct()
        same = F.col("e") == F.col("at")
        for k in keys:
            same = (F.col(f"e{k}") == F.col(f"s{k}")) & same
        e = e.join(starts.withColumn("next", F.lit(True)), same, "left").drop(*[f"s{k}" for k in keys], "at")
    else:
        e = e.withColumn("next", F.lit(None).cast("boolean"))
    handed_on = F.col("next").isNotNull() & (F.col("m") == F.col("e")) & (F.col("m") > F.col("b"))
    covers = F.col("m").between(F.col("b"), F.col("e")) & ~handed_on

    def output(df: DataFrame) -> DataFrame:
        columns: dict[str, Column] = {c: F.col(f"p.c{n}") for n, c in enumerate(points.columns)}
        columns[p_schema.measure] = F.col("m")
        columns |= {c: F.col(f"o.c{n}") for n, c in enumerate(chosen)}
        own = columns.pop("geometry", None)
        if line:
            along = point_at_measure(F.col("o.g"), F.col("b"), F.col("e"), F.col("m"))
            columns["geometry"] = along if own is None else F.coalesce(F.when(is_point(own), own), along)
        elif own is not None:
            columns["geometry"] = F.when(is_point(own), own)
        return df.select(*[v.alias(k) for k, v in columns.items()])

    both = [(f"p{k}", f"e{k}") for k in keys]
    on_route = reduce(lambda x, y: x & y, [F.col(x) == F.col(y) for x, y in both])
    if told:
        each = [*[f"p{k}" for k in keys], "pid"]
        begins = (F.col("m") == F.col("b")) if boundary == "next" else F.lit(False)
        within = F.col("m").between(F.col("b"), F.col("e"))
        # a segment without a usable end hands on as well: it is met where it begins
        parts = meet(
            p.withColumns({"m2": F.col("m"), "pid": F.monotonically_increasing_id()}), e.withColumn("last", F.coalesce("e", "b")), both,
            ("m", "m2"), ("b", "last"), within | begins, "left", each, hot_rows,
        )
        of_point = Window.partitionBy(*each)

        def judged(part: DataFrame) -> DataFrame:
            part = part.withColumn("next", F.when(F.max(begins).over(of_point), F.lit(True)))
            return part.withColumn("covered", F.coalesce(within & ~handed_on, F.lit(False)))

        # apart, as each part lies by its keys already
        located = [judged(part.where("o.hit")).where("covered") for part in parts]
        alone = [judged(part).withColumns({"n": F.count_if("covered").over(of_point), "nth": F.row_number().over(of_point.orderBy("pid"))}).where("n = 0 AND nth = 1").drop("n", "nth") for part in parts]
        nothing = {c: F.when(F.lit(False), F.col(c)) for c in ("o", "b", "e")}
        return Located(output(reduce(DataFrame.unionAll, located)), output(reduce(DataFrame.unionAll, alone).withColumns(nothing)))
    if unmatched == "points":
        met = p.join(e, on_route & covers, "left")
        return Located(output(met.where("o.hit")), output(met.where("o.hit IS NULL")))
    met = p.join(e, on_route, "left")
    meets = F.coalesce(covers, F.lit(False))
    return Located(output(met.where(meets)), output(met.where(~meets)))
