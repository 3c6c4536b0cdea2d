"""Ranked lexical search with Block-Max WAND over a posting index.

``build_index`` cuts the documents of each partition into shards and writes, for
every term of a shard, its postings in blocks of ``BLOCK`` documents: gaps
between the documents' places and counts, each in as few whole bytes as the
block needs.  A block's header holds its first and last place, its widths and
its maximum impact, that is the highest

    (1000000000 * tf) div (1000 * tf + 12 * m)

of its postings.  m depends on all documents' lengths, so one scan counts these
first.  ``search`` joins the terms of the queries with their lists, and
meets queries and shards in groups of one shard and ``BATCH`` queries.

Within a shard, documents are places in ascending order of id.  Shallow moves,
which read headers only, bound every place: the weighted maxima of the blocks
that reach over it, added up.  Places whose bound is below the query's k-th
score so far are passed over, and a block that no other place lies in is never
decompressed.  The rest, the pivots, are taken in strides: first those of the
highest bounds, to raise the threshold, then in order.  Within a stride the
lists move deep by falling maximum: a list decompresses the blocks that hold
pivots, adds the exact impacts, and pivots whose score so far and remaining
maxima stay below the threshold are dropped before the next list moves.

A shard has at most ``SHARD_DOCS`` documents and, but for one long text, at
most ``SHARD_BYTES`` of text, so a task's memory has a bound and a frequent
term's postings are spread like the documents.  Only N, L and the number of
queries reach the driver; a term's documents are summed by shard first.

Defined results: a null text has no terms and is not counted in N; documents of
a null id are counted but never returned; rows that repeat an id are documents
each; equal scores go by ascending id; queries that are null or have no term of
the documents, and those of a null id, give no rows; rows that repeat a
query's id are one query with the terms of all; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_table

BLOCK = 128
SHARD_DOCS = 1 << 14
SHARD_BYTES = 1 << 23
#: Queries that meet a shard in one group.
BATCH = 32
#: Pivots that move together, and those of the first stride.
STRIDE, FIRST_STRIDE = 1024, 64
#: Bytes of a text that are cut into terms at once.
PIECE = 1 << 22

_IN_TERM = np.ones(256, bool)
for _a, _b in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _IN_TERM[_a : _b + 1] = False
#: A-Z in lower case, and a space for what is in no term.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if _IN_TERM[b] else 32 for b in range(256))

INDEX = (
    "shard long, term binary, df long, firsts array<int>, lasts array<int>, widths array<int>, impacts array<long>, payload binary, ids array<long>, lengths array<long>"
)
COLUMNS = [c.split()[0] for c in INDEX.split(", ")]


def count_terms(texts: pa.Array) -> np.ndarray:
    """Terms of each text of a binary array (0 for null)."""
    texts = texts.cast(pa.large_binary())
    data, at = texts.buffers()[2], np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    inside = _IN_TERM[np.frombuffer(data, np.uint8)[at[0] : at[-1]]] if data is not None and at[-1] > at[0] else np.zeros(0, bool)
    at = at - at[0]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edge = at[:-1][at[:-1] < len(inside)]
    starts[edge] = inside[edge]  # a text begins anew
    out = np.diff(np.searchsorted(np.flatnonzero(starts), at))
    return np.where(texts.is_null().to_numpy(zero_copy_only=False), 0, out) if texts.null_count else out


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    text, at = text.translate(_FOLD), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def norms(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of each document, div rounding down; exact where 25 * length * N is
    beyond a long."""
    if int(lengths.max(initial=0)) * 25 * n >= 1 << 63:
        return np.array([75 + 25 * int(x) * n // total for x in lengths], np.int64)
    return 75 + 25 * lengths * n // total


def byte_width(most: np.ndarray) -> np.ndarray:
    """1, 2 or 4 bytes."""
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))


def scatter(out: np.ndarray, at: np.ndarray, values: np.ndarray, width: np.ndarray) -> None:
    for n in range(4):
        here = width > n
        out[at[here] + n] = values[here] >> (8 * n) & 255


def compress(term: np.ndarray, place: np.ndarray, tf: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Blocks of postings that are sorted by term and place; ``weight``: each
    posting's impact.  A gap is from the posting before it in the block (from the
    block's first place)."""
    new = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    df = np.diff(np.r_[new, len(term)])
    blocks = -(-df // BLOCK)
    nth = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = np.repeat(new, blocks) + nth * BLOCK
    size = np.minimum(BLOCK, np.repeat(new + df, blocks) - begin)
    block, inner = np.repeat(np.arange(len(begin)), size), np.arange(len(term)) - np.repeat(begin, size)
    gap = np.diff(place, prepend=0)
    gap[begin] = 0
    wide, tall = byte_width(np.maximum.reduceat(gap, begin)), byte_width(np.maximum.reduceat(tf, begin))
    length = size * (wide + tall)
    start = np.cumsum(length) - length
    out = np.zeros(int(length.sum()), np.uint8)
    scatter(out, start[block] + inner * wide[block], gap, wide[block])
    scatter(out, start[block] + size[block] * wide[block] + inner * tall[block], tf, tall[block])
    of_term = np.cumsum(blocks) - blocks
    return {
        "new": new, "df": df, "blocks": blocks, "firsts": place[begin], "lasts": place[begin + size - 1], "widths": wide | tall << 4, "impacts": np.maximum.reduceat(weight, begin),
        "payload": out, "bytes": np.add.reduceat(length, of_term),
    }


def unpack(data: np.ndarray, width: int, n: int) -> np.ndarray:
    return np.frombuffer(data[: n * width].tobytes(), f"<u{width}").astype(np.int64)


class Shard:
    """Documents gathered for one shard, and the rows of its index."""

    def __init__(self):
        self.vocabulary: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        self.terms, self.ids, self.lengths, self.bytes = [], [], [], 0

    def add(self, id_: int | None, text: pa.Buffer) -> None:
        code, n = self.vocabulary.__getitem__, 0
        found = []
        for words in pieces(text.to_pybytes()):
            found.append(np.fromiter(map(code, words), np.int32, len(words)))
            n += len(words)
        if n:
            self.terms.append(np.concatenate(found))
            self.ids.append(id_)
            self.lengths.append(n)
            self.bytes += len(text)

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.bytes >= SHARD_BYTES

    def table(self, shard: int, n: int, total: int) -> pa.Table:
        """A row per term, and one of a null term with the documents."""
        ids = np.array([-(2**63) if i is None else i for i in self.ids], np.int64)
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        lengths = np.array(self.lengths, np.int64)
        keys = np.concatenate(self.terms).astype(np.int64)
        self.terms = []
        keys <<= 20
        keys |= np.repeat(rank, lengths)
        keys.sort()
        new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        tf, keys = np.diff(new, append=len(keys)), keys[new]
        term, place = keys >> 20, keys & ((1 << 20) - 1)
        m = norms(lengths[order], n, total)
        made = compress(term, place, tf, impact(tf, m[place]))
        words = np.empty(len(self.vocabulary), object)
        words[:] = list(self.vocabulary)
        lists = lambda name, kind: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(made["blocks"])], pa.int32()), pa.array(made[name], kind))
        payload = pa.Array.from_buffers(pa.binary(), len(made["df"]), [None, pa.py_buffer(np.r_[0, np.cumsum(made["bytes"])].astype(np.int32)), pa.py_buffer(made["payload"])])
        count, none = len(made["df"]), pa.nulls(len(made["df"]), pa.list_(pa.int64()))
        rows = [
            pa.array(np.full(count, shard)), pa.array(words[term[made["new"]]].tolist(), pa.binary()), pa.array(made["df"]),
            lists("firsts", pa.int32()), lists("lasts", pa.int32()), lists("widths", pa.int32()), lists("impacts", pa.int64()), payload, none, none,
        ]
        numbers = pa.list_(pa.int64())
        places = pa.list_(pa.int32())
        whole = [
            pa.array([shard]), pa.nulls(1, pa.binary()), pa.array([len(ids)]), pa.nulls(1, places), pa.nulls(1, places), pa.nulls(1, places), pa.nulls(1, numbers), pa.nulls(1, pa.binary()),
            pa.array([[None if i == -(2**63) else i for i in ids[order].tolist()]], numbers), pa.array([lengths[order].tolist()], numbers),
        ]
        return pa.concat_tables([pa.table(whole, COLUMNS), pa.table(rows, COLUMNS)])


@dataclass(frozen=True)
class LexicalIndex:
    """The written index; ``n`` documents with ``total`` terms."""

    table: DataFrame
    n: int
    total: int


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LexicalIndex:
    """Blocked posting lists of all terms of all documents."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            found = count_terms(batch.column("text"))
            n, total = n + int((found > 0).sum()), total + int(found.sum())
        yield pa.RecordBatch.from_pydict({"n": [n], "total": [total]})

    n, total = rows.select("text").mapInArrow(lengths, "n long, total long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, Shard()
        for batch in batches:
            for id_, text in zip(batch.column("id"), batch.column("text")):
                if text.is_valid:
                    held.add(id_.as_py(), text.as_buffer())
                if held.full():
                    yield from held.table(number, n, total).to_batches(1 << 16)
                    number, held = number + 1, Shard()
        if held.ids:
            yield from held.table(number, n, total).to_batches(1 << 16)

    return LexicalIndex(shared_table(rows.mapInArrow(shards, INDEX), "postings", codec="zstd"), n, total)


class Postings:
    """One term's list in a shard; blocks are decompressed once, when asked for."""

    def __init__(self, df: int, firsts: np.ndarray, lasts: np.ndarray, widths: np.ndarray, impacts: np.ndarray, payload: np.ndarray, m: np.ndarray):
        self.firsts, self.lasts, self.impacts, self.payload, self.m = firsts, lasts, impacts, payload, m
        self.wide, self.tall = widths & 15, widths >> 4
        self.sizes = np.full(len(firsts), BLOCK)
        self.sizes[-1] = df - BLOCK * (len(firsts) - 1)
        length = self.sizes * (self.wide + self.tall)
        self.starts = np.cumsum(length) - length
        #: exact impacts by place, and which blocks have been read
        self.exact: np.ndarray | None = None
        self.read = np.zeros(len(firsts), bool)

    def decompress(self, block: int) -> None:
        size, wide, tall, at = int(self.sizes[block]), int(self.wide[block]), int(self.tall[block]), int(self.starts[block])
        place = np.cumsum(unpack(self.payload[at:], wide, size)) + self.firsts[block]
        tf = unpack(self.payload[at + size * wide :], tall, size)
        self.exact[place] = impact(tf, self.m[place])
        self.read[block] = True

    def at(self, places: np.ndarray) -> np.ndarray:
        """Exact impacts at ascending places: shallow to the blocks that hold
        them, deep only into those."""
        block = np.searchsorted(self.lasts, places)
        there = block < len(self.lasts)
        there[there] = self.firsts[block[there]] <= places[there]
        out = np.zeros(len(places), np.int64)
        if there.any():
            if self.exact is None:
                self.exact = np.zeros(len(self.m), np.int32)
            hit = block[there]
            for b in np.unique(hit[~self.read[hit]]).tolist():
                self.decompress(b)
            out[there] = self.exact[places[there]]
        return out


def block_max_wand(lists: list[tuple[int, Postings]], returnable: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the k best documents of a shard, ties to smaller
    places.  ``lists``: weights and postings of a query's terms."""
    lists = [x for x in lists if x[0]]
    if not lists:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lists = sorted(lists, key=lambda x: -x[0] * int(x[1].impacts.max()))
    size = len(returnable)
    # shallow: what each place could score by the headers, list by list
    gains = [w * p.impacts for w, p in lists]
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, np.concatenate([p.firsts for _, p in lists]), np.concatenate(gains))
    np.subtract.at(step, np.concatenate([p.lasts for _, p in lists]) + 1, np.concatenate(gains))
    bound = np.where(returnable, np.cumsum(step)[:-1], 0)
    best_place, best_score, threshold = np.zeros(0, np.int64), np.zeros(0, np.int64), 1

    def stride(pivots: np.ndarray) -> None:
        nonlocal best_place, best_score, threshold
        score, could = np.zeros(len(pivots), np.int64), bound[pivots]
        for (weight, postings), gain in zip(lists, gains):
            block = np.minimum(np.searchsorted(postings.lasts, pivots), len(gain) - 1)
            mine = np.where((postings.firsts[block] <= pivots) & (pivots <= postings.lasts[block]), gain[block], 0)
            exact = weight * postings.at(pivots[mine > 0])
            could = could - mine
            add = np.zeros(len(pivots), np.int64)
            add[mine > 0] = exact
            score, could = score + add, could + add
            keep = could >= threshold
            if not keep.all():
                pivots, score, could = pivots[keep], score[keep], could[keep]
            if not len(pivots):
                return
        place, total = np.r_[best_place, pivots], np.r_[best_score, score]
        top = np.lexsort((place, -total))[:k]
        best_place, best_score = place[top], total[top]
        if len(top) == k:
            threshold = max(threshold, int(best_score[-1]))

    pivots = np.flatnonzero(bound >= threshold)
    if len(pivots) > FIRST_STRIDE:
        high = np.sort(pivots[np.argpartition(-bound[pivots], FIRST_STRIDE)[:FIRST_STRIDE]])
        stride(high)
        bound[high] = 0
        pivots = pivots[bound[pivots] >= threshold]
    while len(pivots):
        stride(pivots[:STRIDE])
        pivots = pivots[STRIDE:]
        pivots = pivots[bound[pivots] >= threshold]
    return best_place, best_score


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item, term, times: the terms of each query."""
    rows = queries.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("binary").alias("text")).where("item IS NOT NULL AND text IS NOT NULL")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item"), batch.column("text")):
                for words in pieces(text.as_buffer().to_pybytes()):
                    yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(words), pa.int64()), pa.array(words, pa.binary())], ["item", "term"])

    return rows.mapInArrow(cut, "item long, term binary").groupBy("item", "term").agg(F.count(F.lit(1)).alias("times"))


def search(index: LexicalIndex, queries: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """<id>, rank, doc_id, score: the k best documents of each query."""
    asked = shared_table(query_terms(queries, id_col, text_col), "query-terms")
    batches = max(1, -(-asked.select("item").distinct().count() // BATCH))
    lists = index.table.where("term IS NOT NULL")
    df = lists.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("all_df"))
    weight = F.floor(1000 * F.ln((2.0 * index.n + 2) / (2.0 * F.col("all_df") + 1)))
    one = F.struct("item", (weight * F.col("times")).alias("weight"))
    batch = F.pmod(F.xxhash64("item"), F.lit(batches)).cast("int").alias("batch")
    weighted = asked.join(df, "term").select("term", batch, one.alias("one")).groupBy("term", "batch").agg(F.collect_list("one").alias("asked"))
    # written, so that Spark knows its size before it plans the join with the lists
    weighted = shared_table(weighted, "weighted-terms")
    left = lists.join(weighted, "term").select("shard", "batch", *COLUMNS[2:8], F.col("asked.item").alias("items"), F.col("asked.weight").alias("weights"))
    right = index.table.where("term IS NULL").select(F.col("shard").alias("shard"), "ids", "lengths", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch"))
    n, total = index.n, index.total

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            ids = right.column("ids").combine_chunks().flatten()
            m = norms(right.column("lengths").combine_chunks().flatten().to_numpy(), n, total)
            returnable = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            flat = {}
            for c in ("firsts", "lasts", "widths", "impacts", "items", "weights"):
                col = left.column(c).combine_chunks()
                flat[c] = (col.flatten().to_numpy().astype(np.int64), np.r_[0, np.cumsum(col.value_lengths().to_numpy())])
            of_item: dict[int, list] = defaultdict(list)
            part = lambda c, r: flat[c][0][flat[c][1][r] : flat[c][1][r + 1]]
            for r, (df, payload) in enumerate(zip(left.column("df").to_pylist(), left.column("payload"))):
                postings = Postings(df, *[part(c, r) for c in ("firsts", "lasts", "widths", "impacts")], np.frombuffer(payload.as_buffer(), np.uint8), m)
                for item, weight in zip(part("items", r).tolist(), part("weights", r).tolist()):
                    of_item[item].append((weight, postings))
            for item, its in of_item.items():
                place, score = block_max_wand(its, returnable, k)
                out[0].extend([item] * len(place))
                out[1].extend(ids[place].tolist())
                out[2].extend(score.tolist())
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("item", "doc_id", "score"), out)})

    found = left.groupBy("shard", "batch").cogroup(right.groupBy("shard", "batch")).applyInArrow(meet, "item long, doc_id long, score long")
    best = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(F.col("item").alias(id_col), "rank", "doc_id", "score")
