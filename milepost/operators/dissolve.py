"""Dissolve and collapse: runs of contiguous segments become one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.schema import LrsSchema, col
from . import scan
from .numbering import stored

#: Aggregations by name for carried columns.
AGGREGATES = {
    "sum": F.sum, "mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "nunique": F.count_distinct,
}


def _ordered(df: DataFrame, schema: LrsSchema, seq_cols: list[str] | None, keys: list[Column], leave: list[str]) -> DataFrame:
    """Rows with both bounds: ``keys`` as g0, g1 ..., bounds, order as s0, s1 ..., and as
    c0, c1 ... their own columns but for the bounds and those in ``leave``.  A column
    that orders too is there once: rows are moved and sorted whole."""
    fields = {c: f"c{n}" for n, c in enumerate(df.columns) if c not in (schema.bmp, schema.emp, *leave)}
    order = [(c, f"s{n}") for n, c in enumerate(seq_cols or []) if c not in fields]
    seq = [col(c).alias(s) for c, s in order] if seq_cols else [F.monotonically_increasing_id().alias("s0")]
    names = [k.alias(f"g{n}") for n, k in enumerate(keys)]
    own = [col(c).alias(f) for c, f in fields.items()]
    return df.select(*own, schema.begin.alias("b"), schema.end.alias("e"), *seq, *names).where("b IS NOT NULL AND e IS NOT NULL")


def _order(df: DataFrame, rows: DataFrame, seq_cols: list[str] | None) -> list[str | list[str]]:
    """What sorts the rows of ``_ordered`` along their keys (see ``Scan``)."""
    place = lambda n, c: f"c{df.columns.index(c)}" if c in df.columns and f"c{df.columns.index(c)}" in rows.columns else f"s{n}"
    return ["b", "e", [place(n, c) for n, c in enumerate(seq_cols)] if seq_cols else ["s0"]]


def _placed(order: list[str | list[str]]) -> list[Column]:
    return [F.struct(*c) if isinstance(c, list) else F.col(c) for c in order]


def _field(df: DataFrame, name: str) -> Column:
    return F.col(f"c{df.columns.index(name)}")


def dissolve(
    df: DataFrame,
    schema: LrsSchema | None = None,
    group_cols: list[str] | None = None,
    require_contiguous: bool = True,
    agg: dict[str, str] | None = None,
    run_order: str = "groups",
    seq_cols: list[str] | None = None,
    hot_rows: float | None = None,
) -> DataFrame:
    """Merge neighbouring rows of equal group values.

    A row continues a block if it begins within the tolerance of the end of
    the row before it.  Groups default to all attributes; the route column is
    always one.  ``run_order="groups"`` looks for neighbours within a group,
    ``"route"`` along the route, where another group's row in between ends the
    block (groups default to the route alone there).  The other columns keep
    the block's first value (``"route"``: first that is not null), or what
    ``agg`` names for them: sum, mean, min, max, count, nunique, first, last.
    Groups (or routes) of more than ``hot_rows`` rows are scanned in segments.
    """
    schema, groups, order, blocks = _rows_in_blocks(df, schema, group_cols, require_contiguous, run_order, seq_cols, hot_rows)
    return _from_blocks(df, schema, groups, order, blocks, agg or {}, run_order).select(df.columns)


def dissolve_apart(df: DataFrame, schema: LrsSchema | None = None, group_cols: list[str] | None = None, require_contiguous: bool = True, seq_cols: list[str] | None = None, hot_rows: float | None = None) -> tuple[DataFrame, DataFrame]:
    """``dissolve`` without bringing a block's geometries together: the blocks
    without geometry, and the geometry of each row.  ``__block`` of both tells which
    block it is.  Runs a job while it is built if rows must be contiguous."""
    schema, groups, order, blocks = _rows_in_blocks(df, schema, group_cols, require_contiguous, "groups", seq_cols, hot_rows)
    names = [f"g{n}" for n in range(len(groups))]
    own = [c for c in blocks[0].columns if c[0] in "cs" and c[1:].isdigit()]
    rows = _united([part.select(*own, "b", "e", *names, "blk") for part in blocks])
    # which block a row is in may rest on how ties were read: both tables must read them alike
    rows = stored(rows) if require_contiguous else rows
    lines = rows.select(F.struct(*names, "blk").alias("__block"), _field(df, "geometry").alias("geometry"))
    return _from_blocks(df, schema, groups, order, [rows], {}, "groups").drop("geometry"), lines


def _rows_in_blocks(
    df: DataFrame, schema: LrsSchema | None, group_cols: list[str] | None, require_contiguous: bool, run_order: str, seq_cols: list[str] | None, hot_rows: float | None
) -> tuple[LrsSchema, list[str], list[str | list[str]], list[DataFrame]]:
    schema = schema or LrsSchema.of(df, require_line=True)
    schema.check_line(df)
    if run_order not in ("groups", "route"):
        raise ValueError("run_order: groups or route")
    if group_cols is None:
        group_cols = schema.attributes(df) if run_order == "groups" else [schema.roadway]
    groups = [schema.roadway, *[g for g in group_cols if g != schema.roadway]]
    rows = _ordered(df, schema, seq_cols, [_own(schema, g) for g in groups], groups)
    names = [f"g{n}" for n in range(len(groups))]
    along = names if run_order == "groups" else names[:1]
    equal = [n for n in names if n not in along]
    if not require_contiguous and not equal:
        # nothing ends a block but its group: no row needs to know the one before
        return schema, groups, _order(df, rows, seq_cols), [rows.withColumn("blk", F.lit(1).cast("long"))]
    before = F.struct("e", *equal)
    joins = F.abs(F.col("b") - F.col("before.e")) <= schema.tolerance if require_contiguous else F.lit(True)
    for n in equal:
        joins = joins & F.col(n).eqNullSafe(F.col(f"before.{n}"))
    order = _order(df, rows, seq_cols)
    return schema, groups, order, _in_blocks(rows, along, before, joins, order, hot_rows)


def _own(schema: LrsSchema, name: str) -> Column:
    return schema.begin if name == schema.bmp else schema.end if name == schema.emp else col(name)


def _from_blocks(df: DataFrame, schema: LrsSchema, groups: list[str], order: list[str | list[str]], blocks: list[DataFrame], agg: dict[str, str], run_order: str) -> DataFrame:
    """A row a block, with ``__block``."""
    names = [f"g{n}" for n in range(len(groups))]
    first = F.struct(*_placed(order))
    carried: dict[str, Column] = {}
    for c in df.columns:
        value = _field(df, c)
        if c == schema.bmp:
            carried[c] = F.min("b")
        elif c == schema.emp:
            carried[c] = F.max("e")
        elif c == "geometry":
            carried[c] = _merged_geometry(value, first)
        elif c not in groups:
            how = agg.get(c, "first")
            if how in ("first", "last"):
                pick = F.min_by if how == "first" else F.max_by
                carried[c] = pick(value, F.when(value.isNotNull(), first)) if run_order == "route" else pick(value, first)
            else:
                carried[c] = AGGREGATES[how](value)
    out = _united([part.groupBy(*names, "blk").agg(*[v.alias(f"v{df.columns.index(c)}") for c, v in carried.items()]) for part in blocks])
    return out.select(*[(F.col(f"v{n}") if c in carried else F.col(f"g{groups.index(c)}")).alias(c) for n, c in enumerate(df.columns)], F.struct(*names, "blk").alias("__block"))


def _in_blocks(rows: DataFrame, keys: list[str], before: Column, joins: Column, order: list[str | list[str]], hot_rows: float | None) -> list[DataFrame]:
    """Rows with the number of their block along their keys: ``joins`` tells, from
    what the row before was, whether a row continues its block."""
    found = []
    for part in scan.parts(rows, keys, "b", hot_rows):
        part = part.previous("before", before, order)
        part = part.add(brk=F.when(F.col("before").isNotNull() & joins, F.lit(0)).otherwise(1).cast("long"))
        found.append(part.running_sum("blk", "brk", order).rows)
    return found


def _united(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, tables)


def _merged_geometry(geometry: Column, order: Column) -> Column:
    """All parts of the block's lines, in order, as one multi-part line."""
    listed = F.array_sort(F.collect_list(F.when(geometry.isNotNull(), F.struct(order.alias("o"), geometry["parts"].alias("p")))))
    parts = F.flatten(F.transform(listed, lambda x: x["p"]))
    kind = F.when(F.size(parts) > 1, "MultiLineString").otherwise("LineString")
    return F.when(F.size(parts) > 0, F.struct(kind.alias("type"), parts.alias("parts")))


def collapse_longest(df: DataFrame, schema: LrsSchema | None = None, group_cols: list[str] | None = None, seq_cols: list[str] | None = None, hot_rows: float | None = None) -> DataFrame:
    """Each contiguous block of equal group values keeps the whole row of its
    longest segment (of equals the last), with the block's bounds.

    Groups default to all attributes.  A change of route ends a block even
    where the route is no group.  Routes of more than ``hot_rows`` rows of a group
    are scanned in segments.
    """
    schema = schema or LrsSchema.of(df, require_line=True)
    schema.check_line(df)
    groups = schema.attributes(df) if group_cols is None else group_cols
    # as a change of route ends a block, the route is always a key
    keys = [_own(schema, g) for g in [*groups, schema.roadway]]
    names = [f"g{n}" for n in range(len(keys))]
    rows = _ordered(df, schema, seq_cols, keys, [])
    order = _order(df, rows, seq_cols)
    blocks = _in_blocks(rows, names, F.struct("e"), F.abs(F.col("b") - F.col("before.e")) <= schema.tolerance, order, hot_rows)
    own = [c for c in rows.columns if c[0] == "c"]
    longest = F.max_by(F.struct(F.lit(True), *own), F.struct((F.col("e") - F.col("b")).alias("l"), *_placed(order)))
    out = _united([part.groupBy(*names, "blk").agg(longest.alias("row"), F.min("b").alias("b"), F.max("e").alias("e")) for part in blocks])
    return out.select(*[(F.col("b") if c == schema.bmp else F.col("e") if c == schema.emp else F.col(f"row.c{df.columns.index(c)}")).alias(c) for c in df.columns])
