"""Removal of byte strings that occur earlier in the corpus.

Of every string of ``length`` bytes only the first occurrence (least id, then
least offset) stays: a byte goes when some repeated string covers it.  Finding
equal strings is suffix sorting to a fixed depth, by bucket-pointer refinement:

* Initial buckets are q-grams: every offset has its q-gram's bucket identifier.
  A bucket is refined by the identifiers that its members have at a later
  offset: those of 2 q bytes are made of the identifier at an offset and of the
  one q further on, those of 4 q of two of 2 q, and so on; each width reuses the
  one before (``BucketIds``).  Identifiers are names made from what they stand
  for, not ranks, so tasks agree on them without exchanging them.
* Every string of ``length`` bytes holds one anchor, the q-gram of least
  identifier among those inside it, so equal strings share an initial bucket at
  the same offset and only anchors are shuffled (about 2 / (length - q + 2) of
  all positions).  A bucket of one member is final.
* The members of the other buckets are sorted by the refined identifier of all
  strings of the anchor's run: a member that shares both with an earlier one is
  a repeat as a whole and final too.
* Where a bucket holds several such identifiers, its first members are refined
  further: their runs are cut into aligned sub-runs, whose bucket identifier is
  made of the parent's and of the one at the bytes that the sub-run's strings
  share, and the step is repeated on them, down to single strings.

Copies inside one task are settled there, so a passage that a third of all
documents share reaches a bucket as one row per task and context; buckets are
only counted, aggregated and equi-joined, never gathered.

Defined results: a null text is empty; a text of more than 2**28 bytes raises
ValueError; a text shorter than ``length`` keeps all
its bytes; rows with a null id lose nothing and make nothing a repeat; rows
that repeat an id are judged as one document (a span found in one of them
applies to the others too, within their length); an empty table gives no rows;
other columns are ignored.  Bucket identifiers are 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bucketed_table, shared_table
from .textkernels import mix, prefix_sums, sliding_argmin, text_groups, window_hashes

_U = np.uint64


class BucketIds:
    """Bucket identifiers of all offsets of some bytes, for q, 2 q, 4 q ... bytes."""

    def __init__(self, data: np.ndarray, q: int):
        self.q = q
        self.widths = [window_hashes(prefix_sums(data), q)]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The identifier of each stretch of q bytes and more: those of the widest
        kind at its start and, ending where it ends, at a later offset."""
        size = end - start
        out = np.zeros(len(start), np.uint64)
        level, width = 0, self.q
        todo = np.ones(len(start), bool)
        while todo.any():
            if level == len(self.widths):
                ids, half = self.widths[-1], width // 2
                here, later = ids[: max(len(ids) - half, 0)], ids[half:]
                # the q-grams' identifiers are scrambled, so a weighted sum tells them apart
                self.widths.append(here * _U(0x9FB21C651E98DF25) + later)
            mine = np.flatnonzero(todo & (size <= 2 * width))
            ids = self.widths[level]
            out[mine] = mix(mix(ids[start[mine]] + size[mine].astype(_U)) + ids[end[mine] - width])
            todo[mine] = False
            level, width = level + 1, width * 2
        return out


def anchor_runs(data: np.ndarray, ends: np.ndarray, length: int, q: int) -> tuple[np.ndarray, ...]:
    """(text, start, strings, bucket, context) of the anchors' runs.

    A run is the stretch of consecutive strings with one anchor; ``start`` is
    its first string's offset in its text.
    """
    starts = np.concatenate([[0], ends[:-1] + 1])
    ids = BucketIds(data, q)
    gram = ids.widths[0]
    anchor = sliding_argmin(gram, length - q + 1)
    n = len(anchor)
    if not n:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    edges = np.zeros(n + 1, np.int64)
    has = ends - starts >= length
    np.add.at(edges, starts[has], 1)
    np.add.at(edges, ends[has] - length + 1, -1)
    inside = np.cumsum(edges[:n]) > 0
    new = inside.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new)
    stop = np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]]))
    at = anchor[first]
    context = mix(ids.of(first, stop + length) + (at - first).astype(_U))
    text = np.searchsorted(starts, first, "right") - 1
    return text, first - starts[text], stop - first + 1, gram[at].view(np.int64), context.view(np.int64)


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the half-open intervals."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


#: A span of strings packed in one long: its first string's offset, then how many.
PACK = 1 << 28
#: Buckets are told apart by this many bits; a collision only adds a comparison.
BUCKET_BITS = 44


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def _runs(rows: DataFrame, length: int, q: int) -> DataFrame:
    """(bucket, id, run): the first run of each context in a batch, and, under
    negative buckets, the spans that repeat one of the same batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            parts = []
            for first, _, data, ends in text_groups(batch.column(1)):
                text, *rest = anchor_runs(data, ends, length, q)
                parts.append((ids[first + text] if len(text) else text, *rest))
            doc, start, strings, bucket, context = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 5
            order = np.lexsort((start, doc, context))
            again = np.concatenate([[False], context[order][1:] == context[order][:-1]])[: len(order)]
            keep, repeat = order[~again], order[again]
            short = (bucket[keep].view(np.uint64) >> _U(64 - BUCKET_BITS)).view(np.int64)
            yield _batch(bucket=short, id=doc[keep], run=start[keep] * PACK + strings[keep])
            if len(repeat):
                repeat = repeat[np.lexsort((start[repeat], doc[repeat]))]
                # one row per maximal span: lay the documents end to end
                far = np.concatenate([[0], np.cumsum(np.diff(doc[repeat]) != 0)]) * (1 << 40)
                a, b = merged(start[repeat] + far, start[repeat] + strings[repeat] - 1 + length + far)
                at = np.searchsorted(start[repeat] + far, a)
                low = -1 - (mix(a.astype(_U)) >> _U(8)).view(np.int64)
                yield _batch(bucket=low, id=doc[repeat][at], run=(a - far[at]) * PACK + b - a + 1 - length)

    return rows.mapInArrow(run, "bucket long, id long, run long")


def _rows_by_text(one, most: int = 1 << 17):
    """Rows made text by text, sent in batches of at least ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def sent() -> pa.RecordBatch:
            bucket, context, run, anchor, again, ids = (np.concatenate(x) for x in zip(*held))
            return _batch(bucket=bucket, context=context, id=ids, run=run, anchor=anchor, again=again)

        for batch in batches:
            for k in range(batch.num_rows):
                made = one(batch, k)
                held.append((*made, np.full(len(made[0]), batch.column(0)[k].as_py(), np.int64)))
                size += len(made[0])
                if size >= most:
                    yield sent()
                    held, size = [], 0
        if held:
            yield sent()

    return run


_LEVEL = "bucket long, context long, id long, run long, anchor long, again boolean"


def _contexts(asked: DataFrame, length: int, width: int, q: int) -> DataFrame:
    """(bucket, context, id, run) of sub-runs of at most ``width`` strings.

    ``asked``: id, text, and runs, a list of (bucket, run, anchor place).  A
    sub-run holds the strings whose distance to the anchor lies in one aligned
    interval of ``width``, so that equal strings of two runs fall into sub-runs
    of one bucket; its bucket is that of the bytes that all strings of the
    interval share, its context that of all its bytes.
    """

    def one(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, ...]:
        text = batch.column(1)[k].as_buffer()
        spans = batch.column(2)[k].values
        bucket, packed, anchor = (spans.field(f).to_numpy() for f in range(3))
        ids = BucketIds(np.frombuffer(text.to_pybytes(), np.uint8), q)
        start, strings = packed // PACK, packed % PACK
        # distances to the anchor fall from the first string to the last
        lowest = (anchor - (start + strings - 1)) // width
        n = (anchor - start) // width - lowest + 1
        owner = np.repeat(np.arange(len(n)), n)
        cell = lowest[owner] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first = np.maximum(anchor[owner] - (cell + 1) * width + 1, start[owner])
        last = np.minimum(anchor[owner] - cell * width, (start + strings - 1)[owner])
        core = ids.of(anchor[owner] - cell * width, anchor[owner] - (cell + 1) * width + 1 + length)
        place = mix(core ^ mix(bucket[owner].view(np.uint64) + cell.astype(_U)))
        whole = mix(ids.of(first, last + length) + (anchor[owner] - first).astype(_U))
        # what repeats inside the text is settled here
        order = np.lexsort((first, whole, place))
        again = np.zeros(len(owner), bool)
        again[order[1:]] = (place[order[1:]] == place[order[:-1]]) & (whole[order[1:]] == whole[order[:-1]])
        return place.view(np.int64), whole.view(np.int64), first * PACK + last - first + 1, anchor[owner], again

    return asked.mapInArrow(_rows_by_text(one), _LEVEL)


def _whole_contexts(asked: DataFrame, length: int, q: int) -> DataFrame:
    """The same for whole runs, whose anchors are found again in the text."""

    def one(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, ...]:
        spans = batch.column(2)[k].values
        bucket, packed = (spans.field(f).to_numpy() for f in range(2))
        ids = BucketIds(np.frombuffer(batch.column(1)[k].as_buffer().to_pybytes(), np.uint8), q)
        start, strings = packed // PACK, packed % PACK
        anchor = sliding_argmin(ids.widths[0], length - q + 1)[start]
        whole = mix(ids.of(start, start + strings - 1 + length) + (anchor - start).astype(_U))
        return bucket, whole.view(np.int64), packed, anchor, np.zeros(len(bucket), bool)

    return asked.mapInArrow(_rows_by_text(one), _LEVEL)


def repeated_spans(rows: DataFrame, length: int, q: int) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): the texts that can hold a repeat, and the half-open
    spans (id, start, end) of their repeated strings."""
    counts = _runs(rows, length, q).where("bucket >= 0").groupBy("bucket").agg(F.count(F.lit(1)).alias("c"))
    shared = counts.where("c > 1").select("bucket", F.lit(True).alias("met"))
    runs = shared_table(_runs(rows, length, q).join(shared, "bucket", "left").where("bucket < 0 OR met").drop("met"), "runs")
    texts = bucketed_table(rows.join(runs.select("id").distinct().hint("merge"), "id").select("id", "text"), "texts", "id")
    span = lambda df: df.select("id", (start := F.floor(F.col("run") / PACK)).alias("start"), (start + F.pmod("run", F.lit(PACK)) - 1 + length).alias("end"))
    spans = span(runs.where("bucket < 0"))
    asked = runs.where("bucket >= 0")
    for width in (PACK, 8, 1):
        listed = asked.groupBy("id").agg(F.collect_list(F.struct(*[c for c in ("bucket", "run", "anchor") if c in asked.columns])).alias("runs"))
        asked_texts = texts.join(listed, "id").select("id", "text", "runs")
        level = shared_table(_whole_contexts(asked_texts, length, q) if width == PACK else _contexts(asked_texts, length, width, q), "contexts")
        spans = spans.unionAll(span(level.where("again")))
        level = level.where("NOT again")
        least = level.groupBy("bucket", "context").agg(F.min("id").alias("first"))
        if width == 1:
            # a string's place is its context: only earlier copies matter
            later = level.join(least, ["bucket", "context"]).where("id > first")
        else:
            least = shared_table(least, "least")
            several = least.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            judged = level.join(least, ["bucket", "context"]).select("id", "bucket", "run", "anchor", (F.col("id") > F.col("first")).alias("later"))
            judged = shared_table(judged, "judged")
            later = judged.where("later")
            asked = judged.where("NOT later").join(several, "bucket", "left_semi").select("id", "bucket", "run", "anchor")
        spans = spans.unionAll(span(later))
    return texts, spans


def substring_dedup(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", q: int = 24, with_text: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, and
    with ``with_text`` also spans (half-open, in bytes) and kept (binary)."""
    rows = _rows(docs, id_col, text_col)
    texts, spans = repeated_spans(rows, length, q)
    gone = spans.groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("s"))
    more = ", spans array<struct<start:long,end:long>>, kept binary" if with_text else ""
    pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_buffer()
                text = text.to_pybytes() if text is not None else b""
                s = batch.column(2)[k].values
                a, b = merged(s.field(0).to_numpy(), np.minimum(s.field(1).to_numpy(), len(text)))
                a, b = a[a < b], b[a < b]
                kept = b"".join(text[x:y] for x, y in zip([0, *b], [*a, len(text)]))
                found = [dict(start=x, end=y) for x, y in zip(a.tolist(), b.tolist())]
                for column, x in zip(out, (hashlib.sha256(text).hexdigest(), int((b - a).sum()), len(a), hashlib.sha256(kept).hexdigest(), found, kept)):
                    column.append(x)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pair), pa.binary()]
            names = ["sha", "removed", "n", "kept_sha", "spans", "kept"]
            width = 6 if with_text else 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out[:width], kinds))], names=["id", *names[:width]])

    done = texts.join(gone, "id").select("id", "text", "s").mapInArrow(cut, "id long, sha string, removed long, n long, kept_sha string" + more)
    done = done.dropDuplicates(["id", "sha"])
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.select(F.col(id_col), F.col(id_col).cast("long").alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"), *([text.cast("binary").alias("text")] if with_text else []))
    zero = F.lit(0).cast("long")
    columns = [
        F.col(id_col), F.col("n_bytes"), F.coalesce("removed", zero).alias("n_removed"), F.coalesce("n", zero).alias("n_spans"),
        F.coalesce("kept_sha", "sha").alias("kept_sha256"),
    ]
    if with_text:
        columns += [F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")).alias("spans"), F.coalesce("kept", "text").alias("kept")]
    return whole.join(done, ["id", "sha"], "left").select(*columns)
