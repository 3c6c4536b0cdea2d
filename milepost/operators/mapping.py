"""Rows as map features: lines and points in degrees, thinned, with their row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.crs import Projection, to_wgs84
from ..functions.geometry import is_line, is_point, thinned
from ..plans.schema import col


def map_features(df: DataFrame, projection: Projection, max_vertices: int = 0, row_col: str | None = None) -> DataFrame:
    """_row, geometry and properties (JSON text without nulls) of each row that
    has a line or a point.

    Lines keep at most ``max_vertices`` vertices a part (0: all) and both ends;
    they are thinned before they are projected.  ``_row`` is ``row_col``, or
    numbers that rise in read order, with gaps between partitions.  A projection
    that leads nowhere raises ValueError.
    """
    g = col("geometry")
    number = col(row_col).cast("long") if row_col else F.monotonically_increasing_id()
    nested = (T.StructType, T.MapType, T.ArrayType)
    kept = [c for c in df.columns if c != "geometry"]
    values = [(F.to_json(col(c)) if isinstance(df.schema[c].dataType, nested) else col(c)).alias(c) for c in kept if c != "_row"]
    shown = df.select(number.alias("_row"), *values, g.alias("geometry")).where(is_line(g) | is_point(g))
    thin = F.struct(g["type"].alias("type"), F.when(is_line(g), F.transform(g["parts"], lambda p: thinned(p, max_vertices))).otherwise(g["parts"]).alias("parts"))
    properties = F.to_json(F.struct("_row", *[col(c) for c in kept if c != "_row"]))
    return shown.select("_row", to_wgs84(thin, projection).alias("geometry"), properties.alias("properties"))
