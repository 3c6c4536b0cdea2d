"""Event tables made from the shared test tables (which hold no routes).

Each view exists twice: as a DataFrame and as SQL for the comparison engine.
Measures are eighths, exact in binary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EIGHT = 8.0


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("tid"), F.col("o_orderkey").cast("string").alias("road"), F.lit(0.0).alias("bmp"),
        ((40 + F.col("o_custkey") % 80) / EIGHT).alias("emp"), F.col("o_orderstatus").alias("status"),
    )


def overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _table(spark, sf_dir, "lineitem")
    return i.select(
        F.col("l_orderkey").cast("string").alias("road"), (F.col("l_partkey") % 80 / EIGHT).alias("bmp"),
        ((F.col("l_partkey") % 80 + F.col("l_quantity")) / EIGHT).alias("emp"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"),
        F.col("l_linenumber").alias("ln"), F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("side"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").cast("string").alias("road"), (F.col("event_id") % 128 / EIGHT).alias("measure"), "event_type")


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _table(spark, sf_dir, "lineitem")
    p = F.col("l_partkey")
    return i.select(
        F.col("l_suppkey").alias("seq_sk"), F.when(p % 50 != 0, F.col("l_orderkey").cast("string")).alias("road"),
        F.when(p % 41 != 0, p % 80 / EIGHT).alias("bmp"), ((p % 80 + F.col("l_quantity") - 5) / EIGHT).alias("emp"), p.alias("pk"), F.col("l_linenumber").alias("ln"),
    )


def _gathered(df: DataFrame, key: Column, *places: str) -> DataFrame:
    """A third of all rows on one long route, each where its key puts it."""
    third = key % 3 == 0
    shifts = {c: F.when(third, F.col(c) + key * 2.0).otherwise(F.col(c)) for c in places}
    return df.withColumns({"road": F.when(third, F.lit("0")).otherwise(F.col("road")), **shifts})


def hot_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gathered(targets(spark, sf_dir), F.col("tid"), "bmp", "emp")


def hot_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gathered(overlays(spark, sf_dir), F.col("road").cast("long"), "bmp", "emp")


def hot_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gathered(points(spark, sf_dir), F.col("event_id"), "measure")


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    until = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate") + F.expr("INTERVAL 365 DAYS"))
    return o.select(F.col("o_orderkey").alias("tid"), F.col("o_custkey").cast("string").alias("road"), F.col("o_orderdate").alias("from_date"), until.alias("to_date"))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets with a straight line of twice the measure's length."""
    from ..functions.geometry import line_of, vertex

    zero = F.lit(0.0)
    return targets(spark, sf_dir).withColumn("geometry", line_of(F.array(vertex(zero, zero), vertex(F.col("emp") * 2, zero))))


def networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bent line per order (level, upright, aslant), by customer; a third of all
    rows is one network.  Whatever meets does so at half steps."""
    from ..functions.geometry import line_of, vertex

    o = _table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    hot = k % 3 == 0
    x, y = k % 7 + F.when(hot, k).otherwise(0), k * 5 % 11
    right, top = x + c % 9 + 1, y + k % 6 + 1
    aslant = c % 5 + 1
    line = line_of(F.array(vertex(x, y), vertex(right, y), vertex(right, top), vertex(right + (1 - k % 2 * 2) * aslant, top + aslant)))
    return o.select(F.when(hot, 0).otherwise(c).alias("net"), k.alias("tid"), line.alias("geometry"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with its items packed as part = measure."""
    i = overlays(spark, sf_dir)
    from ..functions.keys import measure_text

    one = F.struct("pk", "ln", "sk", "qty", F.concat(F.col("pk").cast("string"), F.lit(" = "), measure_text(F.col("bmp"))).alias("t"))
    # the text is made before rows are grouped: gathering evaluates without compiled code
    listed = i.select(F.col("road").alias("LocationID"), one.alias("one")).groupBy("LocationID").agg(F.sort_array(F.collect_list("one")).alias("l"))
    return listed.select("LocationID", F.array_join(F.col("l.t"), "|").alias("Intersecting Roadway Id Milepoints"))


SQL = {
    "fx_target": """SELECT o_orderkey AS tid, CAST(o_orderkey AS VARCHAR) AS road, CAST(0 AS DOUBLE) AS bmp,
      (40 + o_custkey % 80) / CAST(8 AS DOUBLE) AS emp, o_orderstatus AS status FROM orders""",
    "fx_overlay": """SELECT CAST(l_orderkey AS VARCHAR) AS road, (l_partkey % 80) / CAST(8 AS DOUBLE) AS bmp,
      (l_partkey % 80 + l_quantity) / CAST(8 AS DOUBLE) AS emp, l_partkey AS pk, l_suppkey AS sk, l_linenumber AS ln,
      l_quantity AS qty, l_returnflag AS side FROM lineitem""",
    "fx_points": """SELECT event_id, CAST(user_id AS VARCHAR) AS road, (event_id % 128) / CAST(8 AS DOUBLE) AS measure, event_type FROM events""",
    "fx_dirty": """SELECT l_suppkey AS seq_sk, CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE CAST(l_orderkey AS VARCHAR) END AS road,
      CASE WHEN l_partkey % 41 = 0 THEN NULL ELSE (l_partkey % 80) / CAST(8 AS DOUBLE) END AS bmp,
      (l_partkey % 80 + l_quantity - 5) / CAST(8 AS DOUBLE) AS emp, l_partkey AS pk, l_linenumber AS ln FROM lineitem""",
    "fx_hot_target": """SELECT tid, CASE WHEN tid % 3 = 0 THEN '0' ELSE road END AS road, CASE WHEN tid % 3 = 0 THEN bmp + tid * CAST(2 AS DOUBLE) ELSE bmp END AS bmp,
      CASE WHEN tid % 3 = 0 THEN emp + tid * CAST(2 AS DOUBLE) ELSE emp END AS emp, status FROM fx_target""",
    "fx_hot_overlay": """SELECT * REPLACE (CASE WHEN CAST(road AS BIGINT) % 3 = 0 THEN '0' ELSE road END AS road,
      CASE WHEN CAST(road AS BIGINT) % 3 = 0 THEN bmp + CAST(road AS BIGINT) * CAST(2 AS DOUBLE) ELSE bmp END AS bmp,
      CASE WHEN CAST(road AS BIGINT) % 3 = 0 THEN emp + CAST(road AS BIGINT) * CAST(2 AS DOUBLE) ELSE emp END AS emp) FROM fx_overlay""",
    "fx_hot_points": """SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN '0' ELSE road END AS road,
      CASE WHEN event_id % 3 = 0 THEN measure + event_id * CAST(2 AS DOUBLE) ELSE measure END AS measure) FROM fx_points""",
    # the half steps of each line, numbered; coordinates in halves
    "fx_steps": """SELECT net, tid, i, CASE WHEN i <= 2 * w THEN 2 * x + i WHEN i <= 2 * (w + v) THEN 2 * (x + w) ELSE 2 * (x + w) + (1 - tid % 2 * 2) * (i - 2 * (w + v)) END AS px,
      2 * y + CASE WHEN i <= 2 * w THEN 0 ELSE i - 2 * w END AS py, i = 0 OR i = 2 * (w + v + d) AS last,
      CASE WHEN i = 2 * w OR i = 2 * (w + v) THEN 'corner' WHEN i < 2 * w THEN 'level' WHEN i < 2 * (w + v) THEN 'upright' ELSE 'aslant' || tid % 2 END AS course
      FROM (SELECT *, unnest(generate_series(0, 2 * (w + v + d))) AS i FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS net, o_orderkey AS tid,
      o_orderkey % 7 + CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey ELSE 0 END AS x, o_orderkey * 5 % 11 AS y, o_custkey % 9 + 1 AS w, o_orderkey % 6 + 1 AS v, o_custkey % 5 + 1 AS d FROM orders))""",
    "fx_dated": """SELECT o_orderkey AS tid, CAST(o_custkey AS VARCHAR) AS road, o_orderdate AS from_date,
      CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate + INTERVAL '365' DAY END AS to_date FROM orders""",
}


def with_views(body: str, *names: str) -> str:
    """SQL with the named views (all by default) in front."""
    chosen = names or tuple(SQL)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({SQL[n]})" for n in chosen) + ("," if body.lstrip().startswith("-- with") else "") + "\n" + body.lstrip().removeprefix("-- with")
