"""Exact top-k by inner product over integer vectors.

Columnar branch and bound: a chunk of candidates is held in vertical layout
(one row per dimension).  Scores accumulate dimension block by dimension block;
after each block a pair can still gain at most the product of the norms of its
remaining dimensions (its remaining mass), and a pair whose bound stays below
the query's k-th best score so far is dropped.  Once few pairs survive they are
compacted into a list and only they are carried on.

Queries and candidates meet block against chunk: each chunk of candidates is
sent once per query block, so a task holds one block and one chunk whatever the
table's size, and returns k rows per query.

Defined results: vectors that are null, empty, or hold null or non-finite
components take no part; ties go to the smaller id; a query with fewer than k
candidates gets all; rows with a null id take no part; rows that repeat an id
are candidates each, except for a query of that id; vectors meet those of their
own length only; a scale at which a score might not fit a long raises
ValueError; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Below every score; its negative is a long too.
UNSET = -(2**62)


def vertical_topk(
    queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, block: int = 16, step: int = 2048, batch: int = 64
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, candidate id, score) of each query's k best candidates."""
    dims = vectors.shape[1]
    # exact in floats as long as no partial sum can reach the mantissa's end
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * dims
    if most >= -UNSET:
        raise ValueError("scores beyond a long: take a smaller scale")
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    q, tall = queries.astype(kind), np.ascontiguousarray(vectors.T.astype(kind))
    cuts = [*range(0, dims, block), dims]
    norms = lambda m: np.sqrt(np.array([np.square(m[:, c:].astype(np.float64)).sum(1) for c in cuts[1:]]))
    q_rest, v_rest = norms(queries), norms(vectors)
    rounding = most * 2.0**-50  # of a bound, once scores are beyond a double's integers
    best_score = np.full((len(q), k), UNSET, np.int64)
    best_id = np.full((len(q), k), np.iinfo(np.int64).max, np.int64)

    def merge(row: int, found: np.ndarray, scores: np.ndarray) -> None:
        s, i = np.append(best_score[row], scores), np.append(best_id[row], found)
        top = np.lexsort((i, -s))[:k]
        best_score[row], best_id[row] = s[top], i[top]

    for at in range(0, len(ids), step):
        part, part_ids = tall[:, at : at + step], ids[at : at + step]
        for b in range(0, len(q), batch):
            rows = slice(b, min(b + batch, len(q)))
            floor = best_score[rows, -1].astype(np.float64)
            dense = np.zeros((rows.stop - b, part.shape[1]), kind)
            pair_q = pair_v = scores = None
            for n, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                if pair_q is None:
                    dense += q[rows, lo:hi] @ part[lo:hi]
                    slack = q_rest[n, rows, None] * v_rest[n, None, at : at + step] * (1 + 1e-9) + rounding
                    alive = dense + slack >= floor[:, None]
                    if hi == dims or alive.mean() < 0.1:
                        pair_q, pair_v = np.nonzero(alive)
                        scores = dense[pair_q, pair_v]
                else:
                    scores = scores + np.einsum("ij,ij->i", q[b + pair_q, lo:hi], part[lo:hi, pair_v].T)
                    slack = q_rest[n, b + pair_q] * v_rest[n, at + pair_v] * (1 + 1e-9) + rounding
                    keep = scores + slack >= floor[pair_q]
                    pair_q, pair_v, scores = pair_q[keep], pair_v[keep], scores[keep]
            own = query_ids[b + pair_q] == part_ids[pair_v]
            pair_q, pair_v, scores = pair_q[~own], pair_v[~own], scores[~own].astype(np.int64)
            ends = np.searchsorted(pair_q, np.arange(rows.stop - b + 1))
            for r in range(rows.stop - b):
                mine = slice(ends[r], ends[r + 1])
                if ends[r + 1] > ends[r]:
                    merge(b + r, part_ids[pair_v[mine]], scores[mine])
    which, place = np.nonzero(best_score > UNSET)
    return which, best_id[which, place], best_score[which, place]


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) per component as long; null for unusable vectors."""
    sound = vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def exact_topk(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding",
    query_block: int = 4096, chunk: int = 8192,
) -> DataFrame:
    """query_id, rank, <id>, score: the k best candidates of each query row.

    Chunks and blocks are hash buckets sized by the row counts.
    """
    usable = vectors.select(F.col(id_col).alias("id"), quantised(F.col(vector_col), scale).alias("v"), is_query.alias("q"))
    usable = usable.where("id IS NOT NULL AND v IS NOT NULL")
    total, asked = usable.agg(F.count(F.lit(1)), F.count_if("q")).first()
    chunks, blocks = max(1, -(-total // chunk)), max(1, -(-asked // query_block))
    bucket = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    size = F.size("v").alias("n")
    left = usable.where("q").select("id", "v", size, bucket(blocks, 1).alias("b"), every(chunks).alias("c"))
    right = usable.select("id", "v", size, every(blocks).alias("b"), bucket(chunks, 2).alias("c"))

    def meet(left: Iterator[pa.RecordBatch] | pa.Table, right: pa.Table) -> pa.Table:
        def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            flat = t.column("v").combine_chunks()
            rows = flat.flatten().to_numpy(zero_copy_only=False) if t.num_rows else np.zeros(0, np.int64)
            return rows.reshape(t.num_rows, -1), t.column("id").to_numpy()

        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        (q, q_ids), (v, ids) = matrix(left), matrix(right)
        order = np.argsort(ids, kind="stable")
        which, found, score = vertical_topk(q, q_ids, v[order], ids[order], k)
        return pa.table({"query_id": q_ids[which], "id": found, "score": score})

    found = left.groupBy("n", "b", "c").cogroup(right.groupBy("n", "b", "c")).applyInArrow(meet, "query_id long, id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
    )
