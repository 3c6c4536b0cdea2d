"""Ranges that meet along a key, without comparing all rows of a hot key.

Keys of few rows are joined plainly.  Keys of more than ``HOT_ROWS`` rows are
cut into cells along the measure, so that their rows are spread over tasks and
rows far apart never meet.  Cells lie on grids, each ``GRID_STEP`` powers of two
coarser than the one before.  A range is at home on the finest grid on which it
touches two cells at most, and visits the cells that it touches on the coarser
grids that the other side uses along this key.  Two ranges meet once: in the cell,
on the coarser home of the two, that holds the later of their lower ends.

Which keys are hot, and which grids they use, is an aggregate of the same plan
(a count and a bit for each of 64 grids a key), so nothing runs while a query is
being built, and the pairs are the same whatever ``HOT_ROWS`` is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import listed

#: Rows of one key that are compared without cells.
HOT_ROWS = 2000
#: Powers of two between grids: a range's cells are up to 2**GRID_STEP times as long.
GRID_STEP = 4
#: The coarsest grid has one cell.
GRIDS = 64


def _grid(b: Column, e: Column) -> Column:
    """The number of the range's own grid; null for an unknown bound."""
    power = lambda x: F.when(x > 0, F.ceil(F.least(F.log2(x), F.lit(2000.0)))).otherwise(-2000)
    # one more than the logarithm, which may be rounded; cells' numbers stay exact
    least = F.greatest(power(F.abs(e - b)) + 1, power(F.greatest(F.abs(b), F.abs(e))) - 50)
    known = b.isNotNull() & e.isNotNull()
    return F.when(known, F.least(F.greatest(F.ceil(least / GRID_STEP) + GRIDS // 2, F.lit(0)), F.lit(GRIDS - 1)).cast("int"))


def _cell(x: Column, grid: Column) -> Column:
    width = F.pow(F.lit(2.0), (grid - GRIDS // 2) * GRID_STEP)
    return F.when(grid == GRIDS - 1, F.lit(0).cast("long")).otherwise(F.floor(x / width))


def _touched(grid: Column, role: int) -> Column:
    """Cells of the range (__low, __high) on a grid, as (grid, cell, role)."""
    ends = F.array_distinct(F.array(_cell(F.col("__low"), grid), _cell(F.col("__high"), grid)))
    return F.transform(ends, lambda c: F.struct(grid.alias("grid"), c.alias("cell"), F.lit(role).alias("role")))


def _visits(used: str, at_least: Column, role: int) -> Column:
    """Cells on the grids of the mask ``used`` from ``at_least`` on."""
    grids = F.filter(F.sequence(F.lit(0), F.lit(GRIDS - 1)), lambda g: (F.getbit(F.col(used), g) == 1) & (g >= at_least))
    return F.flatten(F.transform(grids, lambda g: _touched(g, role)))


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, conditions)


def meet(
    a: DataFrame, b: DataFrame, keys: list[tuple[str, str]], a_range: tuple[str, str], b_range: tuple[str, str], on: Column, how: str = "inner",
    a_id: list[str] | None = None, hot_rows: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rows of ``a`` joined with those of ``b`` where keys are equal (and not
    null) and ``on`` holds: the plain keys' part and the hot keys' part.

    ``on`` must imply that the ranges have a point in common.  ``how="left"``
    keeps rows of ``a`` that meet nothing, once each, told apart by the columns
    ``a_id``; the second of ``b_range`` is null for them.  The two tables must
    not share column names.  With ``hot_rows`` below 1 all rows go to cells, on the
    grids that the tables use as a whole, and no keys are counted.
    """
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    names = [f"__h{n}" for n in range(len(keys))]
    side = lambda df, place, bounds, first: df.select(
        *[F.col(k[place]).alias(h) for k, h in zip(keys, names)], _grid(*map(F.col, bounds)).alias("__g"), F.lit(first).alias("__a")
    )
    both = side(a, 0, a_range, True).unionAll(side(b, 1, b_range, False))
    bit = F.expr("shiftleft(1L, __g)")
    every = hot_rows < 1
    counts = [F.count(F.lit(1)).alias("__n"), F.bit_or(F.when(F.col("__a"), bit)).alias("__ga"), F.bit_or(F.when(~F.col("__a"), bit)).alias("__gb")]
    hot = F.broadcast(both.agg(*counts).drop("__n")) if every else both.groupBy(*names).agg(*counts)
    hot = hot if every else listed(hot.where(F.col("__n") > hot_rows).drop("__n"), hot_rows)
    is_hot = lambda place: _all([F.col(k[place]) == F.col(h) for k, h in zip(keys, names)])
    same = _all([F.col(x) == F.col(y) for x, y in keys])
    plain = None if every else a.join(hot, is_hot(0), "left_anti").join(b.join(hot, is_hot(1), "left_anti"), same & on, how)

    def dealt(df: DataFrame, place: int, bounds: tuple[str, str]) -> DataFrame:
        low, high = F.least(*bounds), F.greatest(*bounds)
        return (df.crossJoin(hot) if every else df.join(hot, is_hot(place)).drop(*names)).withColumns({"__low": low, "__high": high, "__own": _grid(*map(F.col, bounds))})

    own = F.col("__own")
    at_home = lambda role: _touched(own, role)
    left = dealt(a, 0, a_range).withColumn("__at", F.explode_outer(F.when(own.isNotNull(), F.concat(at_home(0), _visits("__gb", own + 1, 1)))))
    right = dealt(b, 1, b_range).withColumn("__at", F.explode(F.when(own.isNotNull(), F.concat(_visits("__ga", own, 0), at_home(1)))))
    cut = lambda df, s: df.select(*[c for c in df.columns if not c.startswith("__")], *[F.col(f"__at.{c}").alias(f"__{s}{c}") for c in ("grid", "cell", "role")], F.col("__low").alias(f"__{s}low"))
    left, right = cut(left, "a"), cut(right, "b")
    here = F.col("__acell") == _cell(F.greatest("__alow", "__blow"), F.col("__agrid"))
    cells = _all([F.col(f"__a{c}") == F.col(f"__b{c}") for c in ("grid", "cell", "role")])
    found = left.join(right, same & cells & here & on, how)
    if how == "left":
        rows, flag = Window.partitionBy(*a_id), F.col(b_range[1])
        found = found.withColumns({"__met": F.count(flag).over(rows), "__nth": F.row_number().over(rows.orderBy(flag.isNull()))})
        found = found.where(flag.isNotNull() | ((F.col("__met") == 0) & (F.col("__nth") == 1)))
    found = found.select(*a.columns, *b.columns)
    return found.where(F.lit(False)) if every else plain, found
