"""Quality classifier: histogram gradient-boosted trees on text statistics.

Statistics of whole texts are computed by array kernels where the rows are;
the trees are grown by numpy on a bounded sample of labelled rows
(``sample_rows``, those of least hash, so the same at every run), flattened
into complete-tree arrays, and every batch of rows walks all trees level by
level.  Labels, language, source and id are no inputs of a score.

Defined results: a null text is empty and gets a score from its (zero)
statistics; rows with a null id are scored but never learnt from; rows that
repeat an id are scored each; a null label is no label; with no labels at all
every score is 0.5, with one class the score is that class; an empty table
gives no rows; other columns of the documents are ignored (or carried by
``keep_good``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkernels import SPACES, _U, mix, prefix_sums, span_hashes, text_groups

FEATURES = (
    "bytes words word_bytes space upper digit sentence_mark symbol bar bang dollar hash percent amp star newline non_ascii "
    "distinct_words same_as_before top_word distinct_triples capital_words shouted_words marked_words one_byte_words longest_word "
    "lines line_bytes distinct_lines".split()
)


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


_UPPER, _DIGIT, _SENTENCE = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789"), _class(".,;:?'\"()-")
_SYMBOL = _class("!#$%&*+/<=>@[\\]^_`{|}~")
_CLASSES = [_class("".join(map(chr, SPACES))), _UPPER, _DIGIT, _SENTENCE, _SYMBOL, *(_class(c) for c in "|!$#%&*\n")]
_NON_ASCII = np.arange(256) > 127


def _distinct_and_top(owner: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """By owner: number of distinct values, and count of the most common."""
    if not len(owner):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])]))
    counts = np.diff(np.append(new, len(owner)))
    top = np.zeros(n)
    np.maximum.at(top, owner[new], counts)
    return np.bincount(owner[new], minlength=n).astype(float), top


def text_statistics(column: pa.Array) -> np.ndarray:
    """One row of FEATURES per text."""
    blocks = []
    for _, _, data, ends in text_groups(column):
        n = len(ends)
        starts = np.concatenate([[0], ends[:-1] + 1])
        size = (ends - starts).astype(float)
        over = lambda x, of: np.where(of > 0, x / np.maximum(of, 1), 0.0)
        masks = [np.add.reduceat(t[data], starts, dtype=np.int64).astype(float) for t in [*_CLASSES, _NON_ASCII]]
        masks[0] -= 1  # the separator
        sums = prefix_sums(data)

        def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
            return edge[::2], edge[1::2], np.searchsorted(starts, edge[::2], "right") - 1

        a, b, owner = spans(~_CLASSES[0][data])
        words = np.bincount(owner, minlength=n).astype(float)
        value = span_hashes(sums, a, b)
        each = lambda x: np.bincount(owner, weights=x, minlength=n)
        distinct, top = _distinct_and_top(owner, value, n)
        same = np.zeros(len(a))
        same[1:] = (value[1:] == value[:-1]) & (owner[1:] == owner[:-1])
        triple = mix(value[:-2] + value[1:-1] * _U(3) + value[2:] * _U(5)) if len(value) > 2 else value[:0]
        within = owner[2:] == owner[:-2] if len(value) > 2 else np.zeros(0, bool)
        triples, _ = _distinct_and_top(owner[2:][within], triple[within], n)
        long = np.zeros(n)
        np.maximum.at(long, owner, (b - a).astype(float))
        big = np.concatenate([[0], np.cumsum(_UPPER[data])])
        is_line = data != 10
        is_line[ends] = False
        la, lb, lowner = spans(is_line)
        lines = np.bincount(lowner, minlength=n).astype(float)
        distinct_lines, _ = _distinct_and_top(lowner, span_hashes(sums, la, lb), n)
        rows = [
            np.log1p(size), np.log1p(words), over(each((b - a).astype(float)), words), *(over(m, size) for m in masks),
            over(distinct, words), over(each(same), words), over(top, words), over(triples, np.maximum(words - 2, 0)),
            over(each(_UPPER[data[a]].astype(float)), words), over(each(((big[b] - big[a]) * 2 > b - a).astype(float)), words),
            over(each(_SYMBOL[data[b - 1]].astype(float)), words), over(each((b - a == 1).astype(float)), words), np.log1p(long),
            np.log1p(lines), np.log1p(over(size, lines)), over(distinct_lines, lines),
        ]
        blocks.append(np.stack(rows, 1))
    return np.concatenate(blocks) if blocks else np.zeros((0, len(FEATURES)))


@dataclass(frozen=True)
class FlatTrees:
    """Complete trees in heap order: node k's children are 2k+1 and 2k+2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            while inner and len(x) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            total += v[at - inner]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 5) -> FlatTrees:
    """Logistic boosting; each level's gradient histograms are one bincount."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    if not len(y) or y.min() == y.max():
        base = 0.0 if not len(y) else 30.0 if y[0] else -30.0
        return FlatTrees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    share = y.mean()
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], 1)
    width = x.shape[1]
    flat = code + np.arange(width) * bins
    usable = np.array([[b < len(c) for b in range(bins)] for c in cuts])
    margin = np.full(len(y), base)
    made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            nodes, first = 1 << level, (1 << level) - 1
            key = ((at - first)[:, None] * (width * bins) + flat).ravel()
            hist = lambda w: np.bincount(key, np.repeat(w, width), nodes * width * bins).reshape(nodes, width, bins).cumsum(2)
            gs, hs, ns = hist(g), hist(h), hist(np.ones(len(y)))
            gt, ht, nt = gs[:, :1, -1:], hs[:, :1, -1:], ns[:, :1, -1:]
            gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
            gain[(ns < least) | (nt - ns < least) | ~usable] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            for node, k in enumerate(best):
                if gain.reshape(nodes, -1)[node, k] > 1e-9:
                    f, b = divmod(int(k), bins)
                    feature[first + node], threshold[first + node] = f, cuts[f][b]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        leaf = at - inner
        value = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        margin = margin + value[leaf]
        made.append((feature, threshold, value))
    return FlatTrees(base, *(np.stack(c) for c in zip(*made)))


def held_out(id_col: str) -> Column:
    """Rows kept from learning: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 20_000) -> FlatTrees:
    """Trees learnt from at most ``sample_rows`` labelled rows, none held out."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    known = known.select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("y"))
    sample = known.orderBy(F.xxhash64("id"), "id", "y").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("id", "y", "text")

    def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = text_statistics(batch.column(2))
            stats = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), stats], names=["id", "y", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    table = rows.mapInArrow(statistics, f"id {kind}, y int, x array<double>").toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(table.num_rows, len(FEATURES))
    return fit_trees(x, table.column("y").to_numpy().astype(float))


def score_quality(docs: DataFrame, model: FlatTrees, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(text_statistics(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=[id_col, "held_out", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: FlatTrees, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, all columns."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(text_statistics(batch.column(place))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
