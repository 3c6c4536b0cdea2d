"""Locating a stream of points on a static table of segments."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.locate import locate_points
from ..plans.schema import LrsSchema


def locate_stream(points: DataFrame, events: DataFrame, point_schema: LrsSchema | None = None, event_schema: LrsSchema | None = None, **options) -> DataFrame:
    """The located points of a streaming ``points``.

    A stream-static inner join: each micro-batch meets the whole segment table
    and nothing is kept between batches, so no watermark is needed.  Points
    that nothing covers are left out.
    """
    return locate_points(points, events, point_schema, event_schema, **options).located
