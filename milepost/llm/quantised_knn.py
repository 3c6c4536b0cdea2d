"""Nearest neighbours by a block matrix join over int8 codes.

Blocks of queries meet chunks of candidates.  Both sides are quantised to one
byte a component with a scale per vector; the product of two code matrices is a
tile of integers (exact in single precision for up to ``WIDTH`` dimensions at a
time), and with the norms of what the codes leave out it bounds every inner
product from both sides:

    |q.v - sq * sv * (Q.V)|  <=  |q| * |v - sv V| + |q - sq Q| * |sv V|

The k-th highest lower bound of a query, or the worst of its heap once that is
full, is a floor; only pairs whose upper bound reaches it are recomputed in
double precision, component by component in order, and pushed to the query's
heap.  So the result is exact: no pair is left out but by its bound.

Of candidates that are equal in all components only those of the k + 1 smallest
ids of a chunk can be among the nearest of a query (one may be its own), so
copies of one vector cost a chunk no more than that.  A task holds one block and
one chunk, both of bounded numbers of rows, and returns at most k rows a query.

Defined results: vectors that are null, empty, all zero, or hold null or
non-finite components take no part, nor do rows of a null id; vectors meet those
of their own length only; ties go to the smaller id; a query with fewer than k
candidates gets all; rows that repeat an id are candidates and queries each,
never of each other, and a query id's rows share k places; a score that is
no number (components of 1e200) is ranked below all others; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Products of so many pairs of codes still sum exactly in single precision.
WIDTH = (1 << 24) // (127 * 127)
#: Pairs recomputed at once.
PAIRS = 1 << 16


def encode(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes in [-127, 127], and per row: scale, norm of the codes' vector, norm
    of what they leave out."""
    scale = np.abs(rows).max(1, initial=0) / 127
    safe = np.where(scale > 0, scale, 1)[:, None]
    codes = np.clip(np.rint(rows / safe), -127, 127).astype(np.int8)
    coarse = codes * scale[:, None]
    return codes, scale, np.linalg.norm(coarse, axis=1), np.linalg.norm(rows - coarse, axis=1)


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of int8 rows."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], WIDTH):
        out += a[:, at : at + WIDTH].astype(np.float32) @ b[:, at : at + WIDTH].astype(np.float32).T
    return out


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, components added in their order, whatever the batch."""
    out = np.zeros(len(a))
    for n in range(a.shape[1]):
        out += a[:, n] * b[:, n]
    return out


def fewest_copies(rows: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the candidates that may be near: of equal rows those with one of
    the k + 1 smallest ids.  ``ids`` ascend."""
    _, group = np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1] * rows.itemsize}").ravel(), return_inverse=True)
    order = np.lexsort((np.arange(len(ids)), group))
    g, i = group[order], ids[order]
    new_group = np.r_[True, g[1:] != g[:-1]]
    new_id = new_group | np.r_[True, i[1:] != i[:-1]]
    nth = np.cumsum(new_id)
    nth -= np.maximum.accumulate(np.where(new_group, nth, 0))
    return np.sort(order[nth <= k])


class Heaps:
    """The k best (score, id) of each query."""

    def __init__(self, n: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(n)]
        self.floor = np.full(n, -np.inf)

    def push(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """``query`` ascends."""
        scores = np.where(np.isnan(scores), -np.inf, scores)
        cuts = np.flatnonzero(np.r_[True, query[1:] != query[:-1], True]) if len(query) else []
        for a, b in zip(cuts, cuts[1:]):
            heap, q = self.heaps[query[a]], query[a]
            best = np.lexsort((ids[a:b], -scores[a:b]))[: self.k] + a
            for s, i in zip(scores[best].tolist(), ids[best].tolist()):
                if len(heap) < self.k:
                    heapq.heappush(heap, (s, -i))
                elif (s, -i) > heap[0]:
                    heapq.heapreplace(heap, (s, -i))
                else:
                    break
            if len(heap) == self.k:
                self.floor[q] = heap[0][0]


def block_nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, tile: tuple[int, int] = (256, 2048)) -> tuple[list[int], list[int], list[float]]:
    """(query's place, id, score) of the k nearest rows of each query."""
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    few = fewest_copies(rows, ids, k)
    rows, ids = rows[few], ids[few]
    heaps = Heaps(len(queries), k)
    q_code, q_scale, _, q_rest = encode(queries)
    q_norm = np.linalg.norm(queries, axis=1)
    v_code, v_scale, v_coarse, v_rest = encode(rows)
    for b in range(0, len(queries), tile[0]):
        qs = slice(b, b + tile[0])
        for c in range(0, len(ids), tile[1]):
            vs = slice(c, c + tile[1])
            with np.errstate(invalid="ignore", over="ignore"):
                near = code_products(q_code[qs], v_code[vs]) * q_scale[qs, None] * v_scale[None, vs]
                # the last term: what the double sums themselves may be off by
                room = q_norm[qs, None] * v_rest[None, vs] + q_rest[qs, None] * v_coarse[None, vs] + 1e-12 * q_norm[qs, None] * (v_coarse + v_rest)[None, vs]
                own = query_ids[qs, None] == ids[None, vs]
                low = np.where(own, -np.inf, near - room)
                floor = heaps.floor[qs]
                if low.shape[1] > k:
                    floor = np.maximum(floor, np.nan_to_num(np.partition(low, -k, axis=1)[:, -k], nan=-np.inf))
                q, v = np.nonzero(~(near + room < floor[:, None]) & ~own)
                for at in range(0, len(q), PAIRS):
                    x, y = q[at : at + PAIRS] + b, v[at : at + PAIRS] + c
                    heaps.push(x, ids[y], inner_products(queries[x], rows[y]))
    found = [(n, -i, s) for n, heap in enumerate(heaps.heaps) for s, i in heap]
    return tuple(map(list, zip(*found))) if found else ([], [], [])


def usable(vector: Column) -> Column:
    """The vector as doubles; null where it takes no part."""
    sound = vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0)
    return F.when(sound, vector)


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = 4096, chunk: int = 8192
) -> DataFrame:
    """query_id, rank, <id>, score: the k nearest others of each query row.

    Blocks and chunks are hash buckets sized by the row counts; a cell of one
    block and one chunk is a group.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), usable(F.col(vector_col)).alias("v"), is_query.alias("q")).where("id IS NOT NULL AND v IS NOT NULL")
    total, asked = rows.agg(F.count(F.lit(1)), F.count_if("q")).first()
    chunks, blocks = max(1, -(-total // chunk)), max(1, -(-asked // query_block))
    bucket = lambda n, seed: F.pmod(F.xxhash64("id", "v", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    size = F.size("v").alias("n")
    left = rows.where("q").select("id", "v", size, bucket(blocks, 1).alias("b"), every(chunks).alias("c"))
    right = rows.select("id", "v", size, every(blocks).alias("b"), bucket(chunks, 2).alias("c"))

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return flat.reshape(t.num_rows, -1), t.column("id").to_numpy()

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = ([], [], [])
        if left.num_rows and right.num_rows:
            (q, q_ids), (v, ids) = matrix(left), matrix(right)
            place, near, score = block_nearest(q, q_ids, v, ids, k)
            found = (q_ids[place], near, score)
        return pa.table({n: pa.array(x, t) for n, x, t in zip(("query_id", "id", "score"), found, (pa.int64(), pa.int64(), pa.float64()))})

    found = left.groupBy("n", "b", "c").cogroup(right.groupBy("n", "b", "c")).applyInArrow(meet, "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
