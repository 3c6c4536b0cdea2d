"""Exact deduplication with an extendible-hash index on shared files.

The directory over the leading hash bits starts with one bucket; an overfull
bucket splits on its next bit, which doubles the directory where needed, until
no bucket holds more than ``bucket_rows`` rows.  The directory is a table in the
shared folder that grows with the rows.  Every row is routed through it, and the
task that owns a bucket (a range of hash values) keeps its rows in the order of
(hash, bytes): rows of one hash are a chain, each is compared with its
predecessor byte by byte, and equal ones are one entry.  The entry decides which
row stays.

Rows of one hash can't be parted by splitting.  Where they are more than a
bucket holds (a text that a third of all rows carry), they go to overflow pages
of that bucket, dealt evenly; a page's entries are merged with those of the
other pages, one row per page and text.

All of it is DataFrame functions.

Defined results: a null text is the empty text; rows with a null id take part
and can be kept only where every row of the group has a null id; rows that
repeat both id and text share one verdict in ``exact_dedup``, and one of them
stays in ``exact_survivors``; texts of any length are compared whole; an empty
table gives no rows; other columns are ignored by ``exact_dedup`` and carried by
``exact_survivors``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_table

#: The finest slots are this many bits below a bucket of the expected size.
MORE_BITS = 3


def _slot(bits: int) -> Column:
    return F.shiftrightunsigned("h", 64 - bits)


def build_directory(loads: DataFrame, bits: int, bucket_rows: int) -> DataFrame:
    """(slot, bucket) for each slot of ``loads`` (slot, load).

    A bucket is a node of the binary tree over the slots, in heap order (1 is
    the root); a slot belongs to the first node on its way down that is not
    overfull, or to the last.
    """
    way = loads.select("slot", "load", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    shift = lambda name, value, by: F.call_function(name, value, by)
    node = shift("shiftleft", F.lit(1).cast("long"), F.col("depth")) + shift("shiftright", F.col("slot"), F.lit(bits) - F.col("depth"))
    way = way.withColumn("node", node)
    sound = way.groupBy("node").agg(F.sum("load").alias("held"), F.first("depth").alias("depth")).where((F.col("held") <= bucket_rows) | (F.col("depth") == bits))
    return way.join(sound.select("node"), "node").groupBy("slot").agg(F.min("node").alias("bucket"))


def _routed(docs: DataFrame, id_col: str, text_col: str, bucket_rows: int, carry: list[Column]) -> DataFrame:
    """The rows with h, text, rank (by id, a null one lowest), bucket and page
    (null but in overflow pages), each at its bucket's owner."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rank = F.struct(F.col(id_col).isNotNull().alias("known"), F.col(id_col).alias("id"))
    rows = docs.select(F.xxhash64(text).alias("h"), text.alias("text"), rank.alias("rank"), F.monotonically_increasing_id().alias("at"), *carry)
    hashes = shared_table(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "hashes")
    load = F.least("n", F.lit(bucket_rows))
    total = hashes.agg(F.sum(load)).first()[0] or 0
    bits = max(1, math.ceil(math.log2(max(total / bucket_rows, 1))) + MORE_BITS)
    loads = hashes.groupBy(_slot(bits).alias("slot")).agg(F.sum(load).alias("load"))
    directory = shared_table(build_directory(loads, bits, bucket_rows), "directory")
    overflow = hashes.where(F.col("n") > bucket_rows).select("h", F.ceil(F.col("n") / bucket_rows).alias("pages"))
    overflow = shared_table(overflow, "overflow")
    routed = rows.withColumn("slot", _slot(bits)).join(directory, "slot").join(overflow, "h", "left")
    page = F.when(F.col("pages").isNotNull(), F.pmod("at", "pages"))
    return routed.withColumn("page", page).drop("slot", "pages", "at").repartition("bucket", "page")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 2048) -> DataFrame:
    """The index, as a table in the shared folder: one row per document.

    Columns: bucket, page, h, chain (place of its entry among those of its
    hash), sha256, id, and of its entry keep (rank of the row that stays) and n.
    """
    rows = _routed(docs, id_col, text_col, bucket_rows, [])
    chain = Window.partitionBy("bucket", "page").orderBy("h", "text")
    same = F.lag("h").over(chain).eqNullSafe(F.col("h")) & F.lag("text").over(chain).eqNullSafe(F.col("text"))
    rows = rows.withColumn("new", (~same).cast("int"))
    number = Window.partitionBy("bucket", "page").orderBy("h", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("bucket", "page", "h", "rank", F.sha2("text", 256).alias("sha256"), F.sum("new").over(number).alias("entry"))
    entry = Window.partitionBy("bucket", "page", "entry")
    place = Window.partitionBy("bucket", "page", "h").orderBy("entry")
    rows = rows.select("*", F.max("rank").over(entry).alias("keep"), F.count(F.lit(1)).over(entry).alias("n"), F.dense_rank().over(place).alias("chain"))
    return shared_table(rows.drop("entry"), "exact-index")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 2048) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, bucket.

    ``keep_id`` is the largest id among rows of the same text; ``bucket`` is the
    index bucket of the text.
    """
    index = build_index(docs, id_col, text_col, bucket_rows)
    paged = index.where("page IS NOT NULL")
    # one chain in several pages: one row per page and text is merged
    parts = paged.groupBy("h", "sha256", "page").agg(F.first("keep").alias("keep"), F.first("n").alias("n"))
    merged = parts.groupBy("h", "sha256").agg(F.max("keep").alias("keep"), F.sum("n").alias("n"))
    names = ["rank", "keep", "n", "sha256", "bucket"]
    found = index.where("page IS NULL").select(*names).unionByName(paged.drop("keep", "n").join(merged, ["h", "sha256"]).select(*names))
    return found.select(
        F.col("rank.id").alias(id_col),
        F.col("keep.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("rank") == F.col("keep")).alias("kept"),
        F.col("sha256").alias("text_sha256"),
        "bucket",
    )


def exact_survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 2048) -> DataFrame:
    """The rows that stay, with every column of ``docs``: one row per text, by
    the same index, whose entries carry their rows."""
    names = docs.columns
    rows = _routed(docs, id_col, text_col, bucket_rows, [F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")])
    chain = Window.partitionBy("bucket", "page").orderBy("h", "text", "rank")
    last = ~(F.lead("h").over(chain).eqNullSafe(F.col("h")) & F.lead("text").over(chain).eqNullSafe(F.col("text")))
    rows = rows.withColumn("last", last).where("last").select("h", "text", "rank", "row", F.col("page").isNotNull().alias("paged"))
    rows = shared_table(rows, "exact-entries", codec="zstd")
    merged = rows.where("paged").groupBy("h", "text").agg(F.max_by("row", "rank").alias("row"))
    return rows.where("NOT paged").select("row").unionByName(merged.select("row")).select(*[F.col(f"row.`{c}`").alias(c) for c in names])
