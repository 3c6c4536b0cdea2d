"""Scans along a key in order: the row before, the row after, running sums.

Keys of few rows are scanned by a window.  A key of more than ``HOT_ROWS`` rows
is cut into segments of equal measure, about one for each ``HOT_ROWS`` rows, which
are scanned apart; what a segment hands on (its last row, its first, its sum) is
one row, and a scan over those rows stitches the segments together.  The results
are those of one scan, whatever ``HOT_ROWS`` is.  Rows of equal measure are never
cut apart.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows of one key that one window scans, and rows of a segment on average.
HOT_ROWS = 100_000
SEGMENT = "__segment"


def _same(pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(a).eqNullSafe(F.col(b)) for a, b in pairs])


#: From so many rows a hot key on, the list of hot keys (a row each, so at most the table's rows
#: divided by this) goes to every task and the rows are not dealt by key, which would bring a hot
#: key's rows to one task.
LISTED_ROWS = 1000


def listed(hot: DataFrame, hot_rows: float) -> DataFrame:
    return F.broadcast(hot) if hot_rows >= LISTED_ROWS else hot


#: Never cut: for rows that are costly to make, as finding the hot keys reads them once more.
NEVER = float("inf")


def parts(rows: DataFrame, keys: list[str], at: str, hot_rows: float | None = None) -> list[Scan]:
    """The rows of plain keys and those of hot ones, as two scans; keys may be
    null, rows whose measure ``at`` is null come last."""
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    if hot_rows == NEVER:
        return [Scan(rows, keys, False)]
    names = [f"__h{n}" for n in range(len(keys))]
    hot = rows.groupBy(*[F.col(k).alias(h) for k, h in zip(keys, names)]).agg(F.count(F.lit(1)).alias("__n"), F.min(at).alias("__lo"), F.max(at).alias("__hi"))
    hot = listed(hot.where(F.col("__n") > hot_rows), hot_rows)
    same = _same(list(zip(keys, names)))
    segments = F.ceil(F.col("__n") / hot_rows)
    share = (F.col(at) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * segments
    inside = F.when((F.col("__hi") > F.col("__lo")) & ~F.isnan(share), F.least(F.floor(share), segments - 1)).otherwise(0)
    cut = rows.join(hot, same).withColumn(SEGMENT, F.when(F.col(at).isNull(), segments).otherwise(inside).cast("long")).drop(*names, "__n", "__lo", "__hi")
    return [Scan(rows.join(hot, same, "left_anti"), keys, False), Scan(cut, keys, True)]


class Scan:
    """Rows with their keys, in segments or not; each step adds a column.  An order
    names columns, nulls last; columns in a list sort as a struct of them does, nulls first."""

    def __init__(self, rows: DataFrame, keys: list[str], cut: bool):
        self.rows, self.keys, self.cut = rows, keys, cut
        self.by = [*keys, SEGMENT] if cut else keys

    def _with(self, rows: DataFrame) -> Scan:
        return Scan(rows, self.keys, self.cut)

    def add(self, **columns: Column) -> Scan:
        return self._with(self.rows.withColumns(columns))

    @staticmethod
    def _place(order: list[str | list[str]]) -> Column:
        """Sorts like the order."""
        return F.struct(*[x for c in order for x in ([F.struct(*c)] if isinstance(c, list) else [F.col(c).isNull(), F.col(c)])])

    def _handed(self, made: Column, step: Callable[[WindowSpec], Column]) -> DataFrame:
        """What reaches each segment from the others of its key: by key and
        segment, where there is something."""
        ends = self.rows.groupBy(*self.by).agg(made.alias("__made"))
        handed = ends.withColumn("__handed", step(Window.partitionBy(*self.keys).orderBy(SEGMENT))).where("__handed IS NOT NULL")
        return handed.select(*[F.col(c).alias(f"__of{n}") for n, c in enumerate(self.by)], "__handed")

    def _joined(self, handed: DataFrame) -> DataFrame:
        return self.rows.join(handed, _same([(c, f"__of{n}") for n, c in enumerate(self.by)]), "left").drop(*[f"__of{n}" for n in range(len(self.by))])

    def _along(self, order: list[str | list[str]]) -> WindowSpec:
        # sorts by the columns themselves: a struct of them would be one more copy in every row moved
        return Window.partitionBy(*self.by).orderBy(*[x for c in order for x in ([F.col(n).asc_nulls_first() for n in c] if isinstance(c, list) else [F.col(c).asc_nulls_last()])])

    def _neighbour(self, name: str, value: Column, order: list[str | list[str]], step: Callable, end: Callable) -> Scan:
        near = step(value).over(self._along(order))
        if not self.cut:
            return self._with(self.rows.withColumn(name, near))
        rows = self._joined(self._handed(end(value, self._place(order)), lambda w: step("__made").over(w)))
        return self._with(rows.withColumn(name, F.coalesce(near, "__handed")).drop("__handed"))

    def previous(self, name: str, value: Column, order: list[str | list[str]]) -> Scan:
        """A struct ``value`` of the row before; null for a key's first row."""
        return self._neighbour(name, value, order, F.lag, F.max_by)

    def following(self, name: str, value: Column, order: list[str | list[str]]) -> Scan:
        return self._neighbour(name, value, order, F.lead, F.min_by)

    def running_sum(self, name: str, value: str, order: list[str | list[str]]) -> Scan:
        """Sum of ``value`` (no nulls) up to and with the row."""
        own = F.sum(value).over(self._along(order).rowsBetween(Window.unboundedPreceding, 0))
        if not self.cut:
            return self._with(self.rows.withColumn(name, own))
        before = lambda w: F.sum("__made").over(w.rowsBetween(Window.unboundedPreceding, -1))
        rows = self._joined(self._handed(F.sum(value), before))
        return self._with(rows.withColumn(name, own + F.coalesce("__handed", F.lit(0).cast("long"))).drop("__handed"))
