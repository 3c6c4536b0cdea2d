"""What each filter does in every order of applying them.

A packed bitmap index counts for all orders at once.  Each partition lays its
rows out by part, every part starting on a whole word, and packs one bitmap per
filter (its failing rows), per label and for the rows themselves, so that a part
is a run of words.  What an order keeps before a step hangs only on the set of
filters that came before, so k filters have 2**k survivor bitmaps for their k!
orders: each is AND-NOT of a smaller one with one filter's bitmap.  Population
counts of survivors AND filter (AND label), summed by part and over the
partitions, give the table that every order's steps are read from.

Nothing but counts leaves a partition: k * 2**(k-1) rows for each part in it.
Rows are counted in stretches of ``STRETCH``, so a task holds a few megabytes
whatever its partition's size, and a part that holds a third of all rows is
counted where its rows are.

Defined results: a null part is the part ''; a null flag is a row that passes;
rows are counted each, repeated ones too; an empty table gives no rows.  For
``text_failures``: a null text is an empty one; ids only matter to
``repeats``: a row repeats if a smaller id has a text of the same SHA-256, so a
null id repeats nothing, and rows equal in id and text do not repeat each other.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import shared_table

#: Rows whose bitmaps are made at once.
STRETCH = 1 << 20
#: A text with this part of all rows is hot.
HOT_SHARE = 1000
UPPER = bytes(range(65, 91))
CONTINUATION = bytes(range(0x80, 0xC0))
SYMBOLS = b"#$%&*|"


def text_failures(text: bytes) -> int:
    """Bits 0 to 3: too few words, too few distinct ones, too many capitals, a
    symbol.  ``text`` is UTF-8."""
    words = text.split()  # of bytes: at 0x20 and 0x09 to 0x0D
    points = len(text) - count_of(text, CONTINUATION)
    few, repetitive = len(words) < 200, 100 * len(set(words)) < 50 * len(words)
    return few | repetitive << 1 | (100 * count_of(text, UPPER) > 2 * points) << 2 | (count_of(text, SYMBOLS) > 0) << 3


def count_of(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def flagged_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, A, B, C, D, E): the failures of each document, E being a text
    that a smaller id has.

    Texts are read once; what is written is 32 bytes of digest and the flags.
    Texts that hold more than a ``HOT_SHARE``-th of all rows each, of which there
    are at most ``HOT_SHARE``, are broadcast; the others are joined by digest.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags, digests = [], []
            for x in batch.column("text"):  # one at a time: texts may be long
                text = x.as_buffer().to_pybytes() if x.is_valid else b""
                flags.append(text_failures(text))
                digests.append(hashlib.sha256(text).digest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), pa.array(flags, pa.int32()), pa.array(digests, pa.binary())], ["id", "part", "flags", "digest"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("binary").alias("text"))
    rows = shared_table(rows.mapInArrow(scan, "id long, part string, flags int, digest binary"), "flags")
    heads = shared_table(rows.groupBy("digest").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1"), "heads")
    # at most HOT_SHARE texts have so many rows each
    hot = heads.where(F.col("n") * HOT_SHARE >= rows.count()).select("digest", F.col("head").alias("hot_head"))
    rows = rows.join(F.broadcast(hot), "digest", "left")
    # their rows are done: with keys of their own they meet nothing
    key = F.when(F.col("hot_head").isNull(), F.col("digest")).otherwise(F.unhex(F.hex(F.monotonically_increasing_id())))
    rows = rows.withColumn("digest", key).join(heads.select("digest", "head"), "digest", "left")
    first = F.coalesce("hot_head", "head")
    failed = {name: (F.col("flags").bitwiseAND(F.lit(1 << n)) > 0).alias(name) for n, name in enumerate("ABCD")}
    return rows.select("id", "part", *failed.values(), F.coalesce(F.col("id") > first, F.lit(False)).alias("E"))


def subset_counts(part: np.ndarray, n_parts: int, failed: np.ndarray, labels: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(survived subset, next filter, rows before it, rows that it removes, those
    of each label), the last three by part: from bitmaps packed part by part.

    ``failed``, ``labels``: one row of booleans per filter or label.
    """
    order = np.argsort(part, kind="stable")
    sizes = np.bincount(part, minlength=n_parts)
    words = -(-sizes // 64)
    first_word, first_row = np.cumsum(words) - words, np.cumsum(sizes) - sizes
    place = np.arange(len(part)) + np.repeat(first_word * 64 - first_row, sizes)

    def bitmap(flags: np.ndarray) -> np.ndarray:
        wide = np.zeros(int(words.sum()) * 64, bool)
        wide[place] = flags[order]
        return np.packbits(wide).view(np.uint64)

    count = lambda bits: np.add.reduceat(np.bitwise_count(bits).astype(np.int64), first_word)
    fails, labelled = [bitmap(f) for f in failed], [bitmap(x) for x in labels]
    alive = {0: bitmap(np.ones(len(part), bool))}
    for subset in range(1 << len(fails)):
        if subset:
            low = (subset & -subset).bit_length() - 1
            alive[subset] = alive[subset & (subset - 1)] & ~fails[low]
        before = count(alive[subset])
        for f, bits in enumerate(fails):
            if not subset >> f & 1:
                hit = alive[subset] & bits
                yield subset, f, before, count(hit), [count(hit & x) for x in labelled]


def bitmap_counts(rows: DataFrame, filters: list[str], labels: list[str], part_col: str = "part") -> DataFrame:
    """part, applied (a bit for each filter that came before), filter (its
    place), alive, removed and ``lost_<label>``: for every set of filters and
    each one that may follow it.

    ``rows`` has a boolean column for each filter (the row fails it) and label.
    """
    names = ["part", "applied", "filter", "alive", "removed", *[f"lost_{x}" for x in labels]]

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size = [], 0
        for batch in batches:
            held, size = [*held, batch], size + batch.num_rows
            if size >= STRETCH:
                yield pa.Table.from_batches(held)
                held, size = [], 0
        if size:
            yield pa.Table.from_batches(held)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in stretches(batches):
            coded = table.column("part").combine_chunks().dictionary_encode()
            flags = lambda cols: np.array([table.column(c).to_numpy() for c in cols], bool).reshape(len(cols), table.num_rows)
            parts = len(coded.dictionary)
            for applied, f, alive, removed, lost in subset_counts(coded.indices.to_numpy(), parts, flags(filters), flags(labels)):
                same = [pa.array(np.full(parts, x, np.int32)) for x in (applied, f)]
                yield pa.RecordBatch.from_arrays([coded.dictionary, *same, *map(pa.array, (alive, removed, *lost))], names)

    sound = rows.select(F.coalesce(F.col(part_col), F.lit("")).alias("part"), *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in (*filters, *labels)])
    partial = sound.mapInArrow(counted, "part string, applied int, filter int" + "".join(f", {n} long" for n in names[3:]))
    return partial.groupBy("part", "applied", "filter").agg(*[F.sum(n).alias(n) for n in names[3:]])


def order_report(counts: DataFrame, filters: list[str], labels: list[str]) -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant,
    unique_fails, ``<label>_lost`` and shapley, from ``bitmap_counts``.

    The steps of all orders are k! * k rows and fixed by ``filters``.
    """
    k = len(filters)
    steps = []
    for order in itertools.permutations(range(k)):
        for step, f in enumerate(order):
            steps.append(("".join(filters[i] for i in order), step + 1, sum(1 << i for i in order[:step]), f))
    steps = counts.sparkSession.createDataFrame(steps, "filter_order string, step int, applied int, filter int")
    # orders in which exactly the filters applied come before this one
    orders = F.element_at(F.array(*[F.lit(math.factorial(n) * math.factorial(k - 1 - n)) for n in range(k)]), F.bit_count("applied") + 1)
    others = F.lit((1 << k) - 1) - F.expr("shiftleft(1, filter)")
    at = lambda applied: F.max(F.when(F.col("applied") == applied, F.col("removed")))
    whole = counts.groupBy("part", "filter").agg(at(F.lit(0)).alias("fails"), at(others).alias("unique_fails"), F.sum(F.col("removed") * orders).alias("shapley"))
    rows = counts.join(F.broadcast(steps), ["applied", "filter"]).join(whole, ["part", "filter"])
    return rows.select(
        "part", "filter_order", "step", (F.col("alive") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails",
        *[F.col(f"lost_{x}").alias(f"{x}_lost") for x in labels], "shapley",
    )


def labelled(rows: DataFrame, labels: DataFrame, marks: dict[str, Column], id_col: str = "doc_id") -> DataFrame:
    """``rows`` with a boolean column for each mark: some label of the row's id
    has it.  Ids without labels, and null ids, have none."""
    known = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in marks.items()]).where("id IS NOT NULL")
    return rows.join(known, "id", "left")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five text filters A to E over ``docs``, in all 120 orders, by source."""
    marks = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    rows = labelled(flagged_documents(docs), labels, marks)
    return order_report(bitmap_counts(rows, list("ABCDE"), list(marks)), list("ABCDE"), list(marks))
