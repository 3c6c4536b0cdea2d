"""GeoJSON and quoted CSV of any size, each file read by many tasks.

GeoJSON: Spark reads a file as pieces that end at closing braces, in byte ranges.  Whether
a piece begins inside a string, and how deep it lies, is a running sum along the
file: of quotes, then of braces outside strings.  Sums are taken within a range,
and what the ranges before it add up to is one row a range.  An object that
closes at depth one is a member of the file's outermost object, so the pieces up
to there hold one feature; the text of a feature is all that one task must hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.numbering import kept

#: What comes before a brace, strings and the braces in them included.
_SKIP = r'(?:[^"{]++|"(?:[^"\\]++|\\.)*+")*+'


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def _running(rows: DataFrame, value: str, name: str) -> DataFrame:
    """A column: the sum of ``value`` over the pieces of the file before each."""
    sums = rows.groupBy("file", "block").agg(F.sum(value).alias("all"))
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    carried = sums.select("file", "block", F.coalesce(F.sum("all").over(up_to(Window.partitionBy("file").orderBy("block"))), zero).alias("carried"))
    inside = F.coalesce(F.sum(value).over(up_to(Window.partitionBy("file", "block").orderBy("at"))), zero)
    return rows.join(carried, ["file", "block"]).withColumn(name, F.col("carried") + inside).drop("carried")


def feature_texts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(file, text) of each object within an outermost object, features among
    them, and the files read (column ``file``).  Runs a job while it is built."""
    read = spark.read.option("lineSep", "}").text(path)
    # the order of a range's pieces, not their numbers, is what counts
    pieces = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    plain = F.when(F.col("value").contains("\\"), F.regexp_replace("value", r"(?s)\\.", "")).otherwise(F.col("value"))
    pieces = pieces.withColumn("plain", plain).withColumn("quotes", _count(F.col("plain"), '"').cast("long"))
    pieces = _running(pieces, "quotes", "before")
    opened = F.col("before") % 2 == 1
    outside = F.regexp_replace(F.concat(F.when(opened, '"').otherwise(""), F.col("plain")), '"[^"]*("|$)', "")
    closes = F.when((F.col("before") + F.col("quotes")) % 2 == 0, 1).otherwise(0)
    pieces = kept(pieces.select("file", "block", "at", "value", closes.alias("closes"), (_count(outside, "{") - closes).cast("long").alias("step")))
    pieces = _running(pieces, "step", "depth")
    pieces = pieces.withColumn("done", ((F.col("closes") == 1) & (F.col("depth") + F.col("step") == 1)).cast("long"))
    pieces = _running(pieces, "done", "member")
    found = pieces.groupBy("file", "member").agg(F.sort_array(F.collect_list(F.struct("block", "at", "value"))).alias("l"), F.max("done").alias("done")).where("done = 1")
    text = F.concat(F.array_join(F.col("l.value"), "}"), F.lit("}"))
    # the first member comes after the outermost brace
    first, later = rf"^(?s){_SKIP}\{{{_SKIP}", rf"^(?s){_SKIP}"
    text = F.when(F.col("member") == 0, F.regexp_replace(text, first, "")).otherwise(F.regexp_replace(text, later, ""))
    return found.select("file", text.alias("text")), pieces.select("file").distinct()


# ---- CSV ----

_REST = r'[^",][^,]*+'
#: A field in quotes with what follows it up to the comma.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"(?!")[^,]*+'
#: Whole fields, each with its comma, then a field in quotes that stays open.
_OPENS = rf'(?:(?:{_QUOTED}|{_REST})?+,)*+"[^"]*+(?:""[^"]*+)*+$'
#: What a field that is open at the line's start holds, up to its end.
_CLOSES = r'[^"]*+(?:""[^"]*+)*+"(?!")[^,]*+'


def leaves_open(line: Column) -> tuple[Column, Column]:
    """Whether a line ends in an open field in quotes: if it begins outside one,
    and if it begins inside one.  A quote within a field without quotes is text."""
    outside = line.contains('"') & line.rlike(f"^(?s)\ufeff?{_OPENS}")
    inside = ~line.contains('"') | ~line.rlike(f"^(?s){_CLOSES}") | line.rlike(f"^(?s){_CLOSES},{_OPENS}")
    return outside, inside


def _carried(rows: DataFrame, by: list[str], order: str) -> tuple[Column, Column]:
    """The last ``mark`` before each row within ``by``, null if no row before it
    sets the state, and the turns before it."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.last("mark", ignorenulls=True).over(w), F.coalesce(F.sum("turns").over(w), F.lit(0).cast("long"))


def _marked(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """With ``mark``: for a row that sets the state, that state turned back to
    the first row's by the turns so far; null for the others."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("mark", F.when(F.col("sets").isNotNull(), (F.col("sets") + F.sum("turns").over(w)) % 2))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, text, record) of all records of CSV files, numbered from 1 within
    a file; lines end in \\n or \\r\\n.  The lines of a record are joined as they
    are.  Blank lines between records are left out, but numbered."""
    read = spark.read.option("lineSep", "\n").text(path)
    lines = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    outside, inside = leaves_open(F.col("value"))
    lines = lines.withColumn("o", outside).withColumn("i", inside)
    sets, turns = F.when(F.col("o") == F.col("i"), F.col("o").cast("long")), (F.col("o") & ~F.col("i")).cast("long")
    lines = kept(_marked(lines.select("file", "block", "at", "value", sets.alias("sets"), turns.alias("turns")), ["file", "block"], "at"))
    ranges = lines.groupBy("file", "block").agg(F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("at"))).alias("last"), F.sum("turns").alias("turns"))
    # the state after a range that sets it
    ranges = ranges.withColumn("sets", (F.col("last") + F.col("turns")) % 2)
    ranges = _marked(ranges.withColumn("turns", F.when(F.col("sets").isNull(), F.col("turns") % 2).otherwise(0)), ["file"], "block")
    mark, turned = _carried(ranges, ["file"], "block")
    ranges = ranges.select("file", "block", ((F.coalesce(mark, F.lit(0)) + turned) % 2).alias("carried"))
    mark, turned = _carried(lines, ["file", "block"], "at")
    lines = lines.withColumn("m", mark).withColumn("t", turned).join(ranges, ["file", "block"])
    begins = 1 - (F.coalesce("m", "carried") + F.col("t")) % 2
    lines = kept(lines.select("file", "block", "at", "value", begins.cast("long").alias("begins"), F.coalesce(F.col("sets"), (F.col("turns") + 1 - begins) % 2).alias("open")))
    lines = _running(lines, "begins", "n").withColumn("record", F.col("n") + F.col("begins"))
    whole = (F.col("begins") == 1) & (F.col("open") == 0)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"]), "\n")
    joined = lines.where(~whole).groupBy("file", "record").agg(text.alias("text"))
    records = lines.where(whole).select("file", F.col("value").alias("text"), "record").unionByName(joined)
    # read more than once: for numbers in text, then as rows
    return kept(records.withColumn("text", F.regexp_replace("text", r"\r$", "")).where(F.trim("text") != ""))
