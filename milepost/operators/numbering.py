"""Rows numbered in order, in parallel and for good.

Rows are sorted in ranges, the ranges are kept in the folder that driver and
executors share, and a row's number is its place in its range plus the rows of
the ranges before.  No task sees more than one range, and as the ranges are kept,
a lost executor changes no number.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's folder below ``spark.checkpoint.dir``, which driver and
    executors share.  Only a session in one process may run without that
    setting."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or f"file://{tempfile.gettempdir()}/milepost-scratch")
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """The rows as they are now, in the shared folder; the partitions and their
    order stay."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Spark's setting that removes a query's shuffle files once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """The rows as they are now, in the shared folder, as packed columns; the shuffle
    files that made them go.  Neither partitions nor their order stay."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _settled(spark: SparkSession, df: DataFrame, order: list[Column]) -> DataFrame:
    if not order:
        return kept(df)
    # the place read at tells rows of equal values apart, so that they spread over ranges
    ranked = df.withColumn("__read", F.monotonically_increasing_id())
    names = [f"__o{n}" for n in range(len(order))]
    ranked = ranked.withColumns(dict(zip(names, order)))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return kept(ranked.repartitionByRange(ranges, *names, "__read").sortWithinPartitions(*names, "__read").drop(*names, "__read"))


def numbered(df: DataFrame, name: str, order: list[Column] | None = None, where: Column | None = None) -> DataFrame:
    """The rows with a column of 1, 2, ... in the order given (nulls first, ties in
    the order read), else in the order read.  With ``where`` only rows for which
    it is true are counted; the others get null.

    Runs one job while it is built.  Columns named ``__part``, ``__before``,
    ``__read`` and ``__o0`` ... are its own.  An empty table stays empty.
    """
    rows = _settled(df.sparkSession, df, order or [])
    counts = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    part, place = F.spark_partition_id(), F.monotonically_increasing_id()
    rows = rows.withColumns({"__part": part, "__place": place, "__counts": counts})
    totals = rows.groupBy("__part").agg(F.count_if("__counts").alias("__total"))
    # one row a range
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__part", F.coalesce(F.sum("__total").over(before), F.lit(0).cast("long")).alias("__before"))
    if where is None:
        inside = F.col("__place") - F.shiftleft(F.col("__part").cast("long"), 33) + 1
    else:
        inside = F.sum(F.col("__counts").cast("long")).over(Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__inside", inside).join(F.broadcast(starts), "__part", "left")
    number = F.when(F.col("__counts"), F.col("__inside") + F.col("__before"))
    return rows.withColumn(name, number).drop("__part", "__place", "__counts", "__inside", "__before")
