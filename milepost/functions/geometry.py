"""Lines and points as structs, and measure-based cutting.

A geometry is STRUCT<type, parts ARRAY<ARRAY<STRUCT<x, y, z, m>>>>; a point has
one part of one vertex.  A line "has M" when its first vertex has one.
Cutting runs in Arrow batches; the measure tests that decide whether there is
anything to cut are plain column expressions, applied first.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERTEX = T.StructType([T.StructField(c, T.DoubleType()) for c in "xyzm"])
GEOMETRY = T.StructType([T.StructField("type", T.StringType()), T.StructField("parts", T.ArrayType(T.ArrayType(VERTEX)))])
#: Feet and metres per mile, the sphere's radius in miles.
UNITS_PER_MILE = {"EPSG:2236": 5280.0, "EPSG:2237": 5280.0, "EPSG:26916": 1609.344, "EPSG:26917": 1609.344, "EPSG:3857": 1609.344}
SPHERE_MILES = 3958.7613

LINES, POINTS = ("LineString", "MultiLineString"), ("Point", "MultiPoint")


def vertex(x: Column, y: Column, z: Column | None = None, m: Column | None = None) -> Column:
    null = F.lit(None)
    return F.struct(*[(null if c is None else c).cast("double").alias(n) for n, c in zip("xyzm", (x, y, z, m))])


def line_of(vertices: Column) -> Column:
    return F.struct(F.lit("LineString").alias("type"), F.array(vertices).alias("parts"))


def thinned(part: Column, most: int) -> Column:
    """At most ``most`` vertices of a line, evenly spaced by place, both ends
    among them; lines of fewer, and all with ``most`` below 2, stay."""
    if most < 2:
        return part
    step = (F.size(part) - 1) / F.lit(float(most - 1))
    places = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * step + 0.5).cast("int"))
    return F.when(F.size(part) > most, F.transform(places, lambda i: F.get(part, i))).otherwise(part)


def is_line(g: Column) -> Column:
    return F.coalesce(g["type"].isin(*LINES) & F.exists(g["parts"], lambda p: F.size(p) >= 2), F.lit(False))


def is_point(g: Column) -> Column:
    return F.coalesce(g["type"].isin(*POINTS), F.lit(False))


def is_empty(g: Column) -> Column:
    return g.isNull() | ~F.exists(g["parts"], lambda p: F.size(p) > 0)


def has_m(g: Column) -> Column:
    return F.coalesce(F.exists(g["parts"], lambda p: (F.size(p) > 0) & p[0]["m"].isNotNull()), F.lit(False))


def segment_length(a: Column, b: Column, crs: str | None) -> Column:
    """Distance of two vertices: miles for the known systems, else raw units."""
    if crs == "EPSG:4326":
        half = lambda d: F.pow(F.sin(F.radians(d) / 2), 2)
        h = half(b["y"] - a["y"]) + F.cos(F.radians(a["y"])) * F.cos(F.radians(b["y"])) * half(b["x"] - a["x"])
        return 2 * SPHERE_MILES * F.asin(F.least(F.lit(1.0), F.sqrt(h)))
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"]) / UNITS_PER_MILE.get(crs or "", 1.0)


def part_length(part: Column, crs: str | None = None) -> Column:
    ends = F.slice(part, 2, F.greatest(F.size(part), F.lit(1)))
    steps = F.zip_with(F.slice(part, 1, F.greatest(F.size(part) - 1, F.lit(0))), ends, lambda a, b: segment_length(a, b, crs))
    return F.aggregate(F.filter(steps, lambda d: d.isNotNull()), F.lit(0.0), lambda s, d: s + d)


def line_length(g: Column, crs: str | None = None) -> Column:
    """Length of all parts; null without a geometry."""
    return F.when(g.isNotNull(), F.aggregate(F.transform(g["parts"], lambda p: part_length(p, crs)), F.lit(0.0), lambda s, d: s + d))


def union_parts(listed: Column) -> Column:
    """One line of all the parts of an array of geometries."""
    parts = F.flatten(F.transform(F.filter(listed, lambda g: g.isNotNull()), lambda g: g["parts"]))
    kind = F.when(F.size(parts) > 1, "MultiLineString").otherwise("LineString")
    return F.when(F.size(parts) > 0, F.struct(kind.alias("type"), parts.alias("parts")))


# ---- kernels over the vertices of a whole batch, end to end ----


class Vertices:
    """A batch of lines, flat: per vertex its numbers and its part, per part its
    first and last vertex and its row.  Parts of fewer than ``least`` vertices
    are left out."""

    def __init__(self, parts: pa.Array, least: int = 2):
        self.rows = len(parts)
        per_row = np.where(np.asarray(parts.is_valid()), np.nan_to_num(pc.list_value_length(parts).to_numpy(zero_copy_only=False)), 0).astype(np.int64)
        listed = parts.drop_null().flatten()
        size = np.nan_to_num(pc.list_value_length(listed).to_numpy(zero_copy_only=False)).astype(np.int64)
        flat = listed.drop_null().flatten()
        values = np.stack([flat.field(k).to_numpy(zero_copy_only=False).astype(float) for k in range(4)], 1) if len(flat) else np.zeros((0, 4))
        line = size >= least
        self.row, self.size = np.repeat(np.arange(self.rows), per_row)[line], size[line]
        self.values = values[np.repeat(line, size)]
        self.last = np.cumsum(self.size) - 1
        self.first = self.last - self.size + 1
        self.part = np.repeat(np.arange(len(self.size)), self.size)

    def along(self) -> np.ndarray:
        """Each vertex's distance from its part's start, as drawn."""
        return self.summed(np.hypot(np.diff(self.values[:, 0]), np.diff(self.values[:, 1])))

    def summed(self, steps: np.ndarray) -> np.ndarray:
        """Sums of the steps between neighbours from each part's start on."""
        steps = np.concatenate([[0.0], steps])[: len(self.part)]
        steps[self.first] = 0.0
        total = np.cumsum(steps)
        return total - total[self.first][self.part]

    def measured(self) -> tuple[np.ndarray, np.ndarray]:
        """Does a part begin with an M; may its Ms serve as a scale?"""
        m = self.values[:, 3]
        fall = np.zeros(len(m), bool)
        fall[1:] = ~(np.diff(m) >= 0)
        fall[self.first] = False
        odd = np.bincount(self.part, np.isnan(m) | fall, len(self.size)) > 0
        return ~np.isnan(m[self.first]), ~odd

    def at(self, scale: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Per part, the vertex at its place on its rising scale."""
        before = np.bincount(self.part, scale < place[self.part], len(self.size)).astype(np.int64)
        k = self.first + np.clip(before, 1, self.size - 1)
        width = scale[k] - scale[k - 1]
        t = np.where(width > 0, (place - scale[k - 1]) / np.where(width > 0, width, 1.0), 0.0)
        return self.values[k - 1] + (self.values[k] - self.values[k - 1]) * np.clip(t, 0.0, 1.0)[:, None]


def _listed(rows: int, row: np.ndarray, size: np.ndarray, values: np.ndarray, kind: Callable[[np.ndarray], np.ndarray]) -> pa.Array:
    """Geometries of the parts (their row and size, in order); null without."""
    flat = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(values[:, k]), from_pandas=True) for k in range(4)], names=list("xyzm"))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), flat)
    n = np.bincount(row, minlength=rows)
    parts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), lists)
    none = pa.array(n == 0)
    return pa.StructArray.from_arrays([pc.if_else(none, None, pa.array(kind(n))), parts], names=["type", "parts"])


def _numbers(*columns: pa.Array) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False).astype(float) for c in columns]


@F.arrow_udf(GEOMETRY)
def _cut_udf(parts: pa.Array, line_b: pa.Array, line_e: pa.Array, clip_b: pa.Array, clip_e: pa.Array) -> pa.Array:
    """A line's stretch between two measures: by M where it has one, else by the
    same fraction of every part's drawn length."""
    v = Vertices(parts)
    lb, le, cb, ce = _numbers(line_b, line_e, clip_b, clip_e)
    lo, hi = np.fmax(cb, lb)[v.row], np.fmin(ce, le)[v.row]
    begins_m, sound_m = v.measured()
    by_m = (np.bincount(v.row, begins_m, v.rows) > 0)[v.row]
    d = v.along()
    scale = np.where(by_m[v.part], v.values[:, 3], d)
    span = (le - lb)[v.row]
    with np.errstate(divide="ignore", invalid="ignore"):
        share = [(x - lb[v.row]) / span * d[v.last] for x in (lo, hi)]
    begin, end = (np.where(by_m, x, s) for x, s in zip((lo, hi), share))
    begin, end = np.maximum(begin, scale[v.first]), np.minimum(end, scale[v.last])
    # a part whose M falls, or lacks somewhere, gives nothing
    good = (span > 0) & (hi > lo) & (end > begin) & np.where(by_m, sound_m, True) & (scale[v.last] > scale[v.first])
    inside = (scale > begin[v.part]) & (scale < end[v.part]) & good[v.part]
    n = np.bincount(v.part, inside, len(v.size)).astype(np.int64)
    size = np.where(good, n + 2, 0)
    close = np.cumsum(size)
    out = np.zeros((int(size.sum()), 4))
    out[(close - size)[good]] = v.at(scale, begin)[good]
    out[(close - 1)[good]] = v.at(scale, end)[good]
    place = np.ones(len(out), bool)
    place[(close - size)[good]] = place[(close - 1)[good]] = False
    out[place] = v.values[inside]
    # a stretch of no drawn length is none
    part = np.repeat(np.arange(len(size)), size)
    step = np.concatenate([[0.0], np.hypot(np.diff(out[:, 0]), np.diff(out[:, 1]))])[: len(out)]
    step[(close - size)[good]] = 0.0
    long = np.bincount(part, step, len(size)) > 0
    keep = good & long
    return _listed(v.rows, v.row[keep], size[keep], out[keep[part]], lambda n: np.where(n > 1, "MultiLineString", "LineString"))


@F.arrow_udf(GEOMETRY)
def _point_udf(parts: pa.Array, line_b: pa.Array, line_e: pa.Array, measure: pa.Array) -> pa.Array:
    """The point at a measure on the first part that can tell it."""
    v = Vertices(parts)
    lb, le, m = (x[v.row] for x in _numbers(line_b, line_e, measure))
    begins_m, sound_m = v.measured()
    d = v.along()
    scale = np.where(begins_m[v.part], v.values[:, 3], d)
    with np.errstate(divide="ignore", invalid="ignore"):
        place = np.where(begins_m, np.clip(m, scale[v.first], scale[v.last]), np.clip((m - lb) / (le - lb), 0.0, 1.0) * d[v.last])
    good = np.flatnonzero((le > lb) & np.where(begins_m, sound_m, d[v.last] > 0))
    good = good[np.unique(v.row[good], return_index=True)[1]]
    return _listed(v.rows, v.row[good], np.ones(len(good), np.int64), v.at(scale, place)[good], lambda n: np.full(len(n), "Point"))


def _or_null(made: Column) -> Column:
    return F.when(made["type"].isNotNull(), made)


def split_line_by_measure(g: Column, line_b: Column, line_e: Column, clip_b: Column, clip_e: Column) -> Column:
    """The line between two measures, null where there is nothing to cut."""
    # least and greatest skip nulls
    wanted = is_line(g) & (line_e > line_b) & clip_b.isNotNull() & clip_e.isNotNull() & (F.least(line_e, clip_e) > F.greatest(line_b, clip_b))
    return _or_null(_cut_udf(F.when(wanted, g["parts"]), line_b, line_e, clip_b, clip_e))


def point_at_measure(g: Column, line_b: Column, line_e: Column, measure: Column) -> Column:
    """The point at a measure, held to the line's ends; null without a line."""
    wanted = is_line(g) & (line_e > line_b) & measure.isNotNull()
    return _or_null(_point_udf(F.when(wanted, g["parts"]), line_b, line_e, measure))


def _steps(v: np.ndarray, crs: str | None) -> np.ndarray:
    if crs == "EPSG:4326":
        x, y = np.radians(v[:, 0]), np.radians(v[:, 1])
        h = np.sin(np.diff(y) / 2) ** 2 + np.cos(y[:-1]) * np.cos(y[1:]) * np.sin(np.diff(x) / 2) ** 2
        return 2 * SPHERE_MILES * np.arcsin(np.minimum(1.0, np.sqrt(h)))
    return np.hypot(np.diff(v[:, 0]), np.diff(v[:, 1])) / UNITS_PER_MILE.get(crs or "", 1.0)


def measured_parts(parts: pa.Array, begin: pa.Array, end: pa.Array, crs: str | None) -> pa.Array:
    """The parts with M from ``begin`` to ``end`` by distance along all of them; a
    part of one vertex gets none."""
    v = Vertices(parts, 1)
    b, e = _numbers(begin, end)
    gone = v.summed(_steps(v.values, crs)) if len(v.part) else np.zeros(0)
    length = gone[v.last]
    whole = np.bincount(v.row, length, v.rows)[v.row]
    alone = np.bincount(v.row, minlength=v.rows)[v.row] == 1
    span = (e - b)[v.row]
    share = np.where(whole > 0, length / np.where(whole > 0, whole, 1.0) * span, np.where(alone, span, 0.0))
    before = np.concatenate([[0.0], np.cumsum(share)])[: len(share)]
    first = np.unique(v.row, return_index=True)[1]
    base = np.zeros(v.rows)
    base[v.row[first]] = before[first]
    at = b[v.row] + before - base[v.row]
    ends = np.ones(len(v.part))
    ends[v.first] = 0.0
    place = np.where(length[v.part] > 0, gone / np.where(length > 0, length, 1.0)[v.part], ends)
    out = v.values.copy()
    line = (v.size >= 2)[v.part]
    out[line, 2] = np.nan_to_num(out[line, 2])
    out[line, 3] = (at[v.part] + place * share[v.part])[line]
    return _listed(v.rows, v.row, v.size, out, lambda n: np.full(len(n), "LineString")).field("parts")


def with_measures(g: Column, begin: Column, end: Column, crs: str | None) -> Column:
    """A line with M values; lines that have them, and other geometries, stay."""

    @F.arrow_udf(GEOMETRY["parts"].dataType)
    def measured(parts: pa.Array, begin: pa.Array, end: pa.Array) -> pa.Array:
        return measured_parts(parts, begin, end, crs)

    wanted = is_line(g) & ~has_m(g)
    made = measured(F.when(wanted, g["parts"]), begin, end)
    return F.when(g.isNotNull(), F.struct(g["type"].alias("type"), F.when(wanted, made).otherwise(g["parts"]).alias("parts")))
