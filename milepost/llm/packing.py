"""Packing token sequences into fixed windows with as little padding as can be.

Tokenise, cut documents longer than a window into pieces, and plan on the
histogram of piece lengths: at most ``window`` counts, whatever the corpus
size.  The plan is a list of (pattern of lengths, how many sequences); it is
laid over the pieces by their rank among pieces of the same length, so every
task places its own rows.

Planning is exact-complement hashing: the lengths still available are indexed
by the sums of one, two and three of them; from the longest length down, combinations
that fill the remaining gap exactly are consumed as often as the counts allow;
what finds no exact filler takes the best fit (the longest length that still
fits) and tries the exact index again on the smaller gap.

Defined results: a null or empty text is the lone end token; texts of any
length are tokenised whole; repeated rows are packed once each; rows with a
null id are packed too; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_table

#: Fixed values of the byte-level BPE file: its one special token and its id.
SPECIAL_TEXT, SPECIAL_ID = "<|endoftext|>", 50256


class ByteBpe:
    """Ids of a byte-level BPE given both as ranks and as a tokenizer file.

    Plain text goes through the rank encoder, which gives the same ids in a
    fraction of the time; a text that spells the special token goes through
    the tokenizer file, which knows it.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.json_path, self.full = json_path, None

    def ids(self, text: str) -> np.ndarray:
        if SPECIAL_TEXT in text:
            if self.full is None:
                from tokenizers import Tokenizer

                self.full = Tokenizer.from_file(self.json_path)
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")


def public_byte_bpe() -> tuple[str, str, str]:
    """Paths and word pattern of the public byte-level BPE."""
    import public_tokenizers as public

    return public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def piece_bounds(n: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter."""
    if n <= window:
        return [(0, n)]
    head = n % window
    cuts = ([0] if head else []) + list(range(head, n, window))
    return [(a, b - a) for a, b in zip(cuts, [*cuts[1:], n])]


def token_pieces(
    docs: DataFrame,
    tokenizer: tuple[str, str, str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 1024,
    end_id: int = 2,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 (and ids)."""
    paths = tokenizer or public_byte_bpe()
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(*paths)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(bpe.ids(text.as_py() or ""), np.uint32(end_id))
                for k, (a, n) in enumerate(piece_bounds(len(ids), window)):
                    part = np.ascontiguousarray(ids[a : a + n])
                    for column, x in zip(out, (doc, k, a, n, zlib.crc32(part.tobytes()), part.astype(np.int32) if with_ids else None)):
                        column.append(x)
            arrays = [
                pa.array(out[0], batch.schema.field(0).type),
                pa.array(out[1], pa.int32()),
                *(pa.array(x, pa.int64()) for x in out[2:5]),
            ] + ([pa.array(out[5], pa.list_(pa.int32()))] if with_ids else [])
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


class SumIndex:
    """Available counts by length, indexed by the sums of one, two and three.

    ``pairs`` holds, for a sum, the longer members of its pairs, and ``triples``
    the lengths that may begin a triple, both with the longest last.  Counts only
    fall, so an entry that can't be filled is removed for good when it is met.
    """

    def __init__(self, counts: dict[int, int], window: int):
        self.left = [0] * (window + 1)
        for n, c in counts.items():
            self.left[n] += c
        self.pairs: dict[int, list[int]] = {}
        self.triples: dict[int, list[int]] = {}

    def fits(self, parts: tuple[int, ...]) -> bool:
        return all(self.left[p] >= parts.count(p) for p in parts)

    def take(self, parts: tuple[int, ...], times: int = 1) -> None:
        for p in parts:
            self.left[p] -= times

    def pairs_of(self, total: int) -> list[int]:
        if total not in self.pairs:
            self.pairs[total] = [a for a in range((total + 1) // 2, total) if self.left[a] and self.left[total - a]]
        found = self.pairs[total]
        while found and not self.fits((found[-1], total - found[-1])):
            found.pop()
        return found

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """Available parts that sum to ``gap``: one, else two, else three, the
        longest first."""
        if self.left[gap]:
            return (gap,)
        if pairs := self.pairs_of(gap):
            return (pairs[-1], gap - pairs[-1])
        if gap not in self.triples:
            self.triples[gap] = [a for a in range(-(-gap // 3), gap - 1) if self.left[a]]
        firsts = self.triples[gap]
        while firsts:
            rest = gap - firsts[-1]
            for b in reversed(self.pairs_of(rest)):
                if self.fits((firsts[-1], b, rest - b)):
                    return (firsts[-1], b, rest - b)
            firsts.pop()
        return None

    def best_fit(self, gap: int) -> int:
        """The longest available length of at most ``gap``; 0 if none."""
        return next((n for n in range(gap, 0, -1) if self.left[n]), 0)


def plan_patterns(counts: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in order, number of sequences) that use every piece once."""
    stock, plan = SumIndex(counts, window), []
    for longest in range(window, 0, -1):
        while stock.left[longest]:
            stock.take((longest,))
            parts, gap = [longest], window - longest
            while gap:
                filler = stock.exact(gap) or ((best,) if (best := stock.best_fit(gap)) else None)
                if not filler:
                    break
                stock.take(filler)
                gap -= sum(filler)
                parts += filler
            # the same pattern again, as often as the counts allow
            more = min(stock.left[p] // parts.count(p) for p in set(parts))
            stock.take(tuple(parts), more)
            plan.append((tuple(parts), more + 1))
    return plan


def plan_slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: (first ranks, first sequence ids, offsets) of its slots."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for parts, times in plan:
        offset = 0
        for p in parts:
            slots.setdefault(p, []).append((used.get(p, 0), base, offset))
            used[p] = used.get(p, 0) + times
            offset += p
        base += times
    return {p: tuple(np.array(x, np.int64) for x in zip(*rows)) for p, rows in slots.items()}


def pack(pieces: DataFrame, window: int = 1024, strand_rows: int = 1 << 18) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns id, piece, length, ...).

    A piece of the window's length is a sequence by itself (of a negative id).
    The others are ranked among those of their length in strands of about
    ``strand_rows`` in all, dealt by hash, so that a length shared by a third of
    all rows is not ranked by one task.  The driver sees a count per length.
    """
    spark = pieces.sparkSession
    stored = shared_table(pieces, "pieces")
    totals = {r.length: r.n for r in stored.where(F.col("length") < window).groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    shared = spark.sparkContext.broadcast(plan_slots(plan_patterns(totals, window)))
    strands = max(64, -(-sum(totals.values()) // strand_rows))
    strand = F.pmod(F.xxhash64("id", "piece", "start"), F.lit(strands)).cast("int")
    short = stored.where(F.col("length") < window).withColumn("strand", strand)
    before = Window.partitionBy("length").orderBy("strand").rowsBetween(Window.unboundedPreceding, -1)
    counts = short.groupBy("length", "strand").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("length", "strand", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "strand").orderBy("id", "piece", "ids_crc32")
    ranked = short.withColumn("place", F.row_number().over(order)).join(counts, ["length", "strand"])
    ranked = ranked.select(*stored.columns, (F.col("before") + F.col("place") - 1).alias("rank"))
    names = stored.columns
    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        for batch in batches:
            length, at = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                begin, base, where = slots[int(n)]
                k = np.searchsorted(begin, at[mine], "right") - 1
                sequence[mine], offset[mine] = base[k] + at[mine] - begin[k], where[k]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"]
            )

    zero = F.lit(0).cast("long")
    full = stored.where(F.col("length") >= window).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), zero.alias("offset"))
    return ranked.mapInArrow(place, schema).unionByName(full)
