"""Cross-entropy difference between two n-gram models over words.

A target model (documents named by id) and a background model (all documents)
are matched: pairs of words, the same smoothing, and one vocabulary, every word
of the documents (runs of other characters than ASCII spaces, as spelled) and
the end mark.  A word after another has the probability

    p(w | c) = (count(c w) + mu p(w)) / (count(c) + mu)
    p(w)     = (count(w) + mu / vocabulary) / (all words + mu)

and a document's own counts are taken out of each model that holds it before it
is scored, so that no text is judged by a model that has learnt it.  As every
document ends in the end mark, a word's count is also its count as a context.

The texts are written once, dealt into parts of ``part_bytes``.  Each part
sends every distinct word and pair once, with its counts, to the owner of that
n-gram's hash bucket; the owners sum the counts of all parts and send the sums
back, in the same order; then each part scores its own texts.  An n-gram moves
at most once per part, however often the corpus holds it, so no common word is
a hot key, and no model is gathered anywhere.  Both groupings are bounded: a
part by its bytes (or one text), a bucket by ``bucket_bytes`` of text.

Defined results: a null or empty text, and one of spaces only, has no tokens
and null losses and score; rows with a null id are scored and no target; rows
that repeat an id are documents each; no target leaves the target model uniform;
an empty table gives no rows; other columns are ignored.  Words and pairs are
told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bucketed_table, shared_table
from .textkernels import _IS_WORD, mix, prefix_sums, span_hashes, text_groups

#: Codes of the end mark (a word, so odd) and of a text's start (a context only).
END, START = np.uint64(1), np.uint64(0)
_ODD = np.uint64(1)


def word_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words per text, code of each word); a word's code is odd."""
    sizes, codes = [], []
    for _, _, data, ends in text_groups(column):
        edge = np.flatnonzero(np.diff(np.concatenate([[False], _IS_WORD[data], [False]]).astype(np.int8)))
        codes.append(span_hashes(prefix_sums(data), edge[::2], edge[1::2]) | _ODD)
        sizes.append(np.diff(np.searchsorted(edge[::2], np.concatenate([[0], ends]), "left")))
    none = np.zeros(0, np.int64)
    return (np.concatenate(sizes), np.concatenate(codes)) if sizes else (none, none.view(np.uint64))


def _order(key: np.ndarray, limit: int) -> np.ndarray:
    """A stable order of keys below ``limit``: sorted with their places packed
    beside them, where both fit a long."""
    bits = max(len(key) - 1, 1).bit_length()
    if limit << bits >= 1 << 63:
        return np.argsort(key, kind="stable")
    return np.sort(key.astype(np.int64) << bits | np.arange(len(key))) & ((1 << bits) - 1)


def _ranked(key: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place of each distinct key, number of each, key number per place)."""
    order = _order(key, limit)
    new = np.ones(len(key), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(key))), number


class PartGrams:
    """The tokens of some texts: per token its text and the numbers of its word
    and its pair; and the codes of the distinct words, pairs and the start."""

    def __init__(self, column: pa.Array):
        words, code = word_codes(column)
        self.tokens = np.where(words > 0, words + 1, 0)  # with the end mark
        self.starts = int((words > 0).sum())
        last = np.cumsum(self.tokens)[words > 0] - 1
        n = int(self.tokens.sum())
        self.text = np.repeat(np.arange(len(words)), self.tokens)
        token = np.full(n, END)
        inner = np.ones(n, bool)
        inner[last] = False
        token[inner] = code
        each, self.word = np.unique(token, return_inverse=True)
        self.first = np.zeros(n, bool)  # tokens after the start
        self.first[last[:-1] + 1] = True
        self.first[:1] = True
        context = np.concatenate([[0], self.word[:-1] + 1])[:n]
        context[self.first] = 0
        at, self.pair_n, self.pair = _ranked(context * len(each) + self.word, (len(each) + 1) * len(each))
        before = np.concatenate([[START], each])
        pair = mix(mix(before[context[at]] + _ODD) + token[at]) & ~_ODD
        self.words = len(each)
        #: words by number, then pairs by number, then the start
        self.code = np.concatenate([each, pair, [START]]) if n else each

    def counts(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each code, the count and the count in target texts."""
        if not len(self.code):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        inside = target[self.text].astype(float)
        starts = [self.starts], [int(target[self.tokens > 0].sum())]
        word = lambda *x: np.bincount(self.word, *x, self.words)
        n = np.concatenate([word(None), self.pair_n, starts[0]])
        t = np.concatenate([word(inside), np.bincount(self.pair, inside, len(self.pair_n)), starts[1]])
        return n, t.astype(np.int64)


def _dealt(code: np.ndarray, n: np.ndarray, t: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order in which a part's codes travel (by bucket, then by count, which
    packs well), the buckets met, and their ends in it."""
    owner = (((mix(code >> np.uint64(1)) >> np.uint64(20)) % np.uint64(buckets))).astype(np.int64)
    order = _order(owner * 1024 + np.minimum(n, 31) * 32 + np.minimum(t, 31), buckets * 1024)
    which, first = np.unique(owner[order], return_index=True)
    return order, which, np.append(first, len(order))


def _planes(x: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Stretches of 64-bit values as bytes, all lowest bytes first and so on."""
    x = x.astype(np.uint64)
    return pa.array([x[a:b].view(np.uint8).reshape(-1, 8).T.tobytes() for a, b in zip(ends, ends[1:])], pa.binary())


def _values(column: pa.ChunkedArray) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), np.uint8).reshape(8, -1).T.copy().view(np.uint64)[:, 0] for x in column]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _parts(docs: DataFrame, id_col: str, text_col: str, part_bytes: int) -> DataFrame:
    """(part, place, id, text): runs of rows of about ``part_bytes``."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.spark_partition_id().cast("long").alias("task"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, held = 0, 0, 0
        for batch in batches:
            sizes = [x.as_buffer().size if x.is_valid else 0 for x in batch.column(2)]
            parts, places = [], []
            for n in sizes:
                if held >= part_bytes:
                    part, place, held = part + 1, 0, 0
                parts.append(part)
                places.append(place)
                place, held = place + 1, held + n + 16
            number = np.array(parts, np.int64) + batch.column(0).to_numpy() * (1 << 32)
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(places, pa.int64()), batch.column(1), batch.column(2)], names=["part", "place", "id", "text"])

    return bucketed_table(rows.mapInArrow(run, f"part long, place long, id {kind}, text string"), "texts", "part")


def _flags(places: np.ndarray, rows: int) -> np.ndarray:
    out = np.zeros(rows, bool)
    out[places] = True
    return out


def word_cross_entropy_difference(
    docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", mu: float = 4.0, part_bytes: int = 3 << 20, bucket_bytes: int = 4 << 20
) -> DataFrame:
    """One row per document: id, n_tokens (its words and the end mark),
    target_loss, background_loss (nats per token) and score, the background's
    loss less the target's: the higher, the more like the target documents,
    whose ids the first column of ``target_ids`` holds."""
    texts = _parts(docs, id_col, text_col, part_bytes)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    ids = target_ids.select(F.col(target_ids.columns[0]).alias("id")).distinct()
    chosen = texts.select("part", "place", "id").join(ids, "id", "left_semi").select("part", "place")
    chosen = bucketed_table(chosen, "targets", "part")

    def counts(rows: pa.Table, targets: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        made = PartGrams(rows.column("text").combine_chunks())
        n, t = made.counts(_flags(targets.column("place").to_numpy(), rows.num_rows))
        order, which, ends = _dealt(made.code, n, t, buckets)
        part = np.full(len(which), rows.column("part")[0].as_py(), np.int64)
        return pa.table([pa.array(part), pa.array(which), *(_planes(x[order], ends) for x in (made.code, n, t))], names=["part", "bucket", "code", "n", "t"])

    def sums(key: tuple, rows: pa.Table) -> pa.Table:
        code, n, t = (_values(rows.column(c)) for c in ("code", "n", "t"))
        every, at = np.unique(code, return_inverse=True)
        # exact below 2**53
        n, t = (np.bincount(at, x, len(every)) for x in (n, t))
        ends = np.concatenate([[0], np.cumsum([x.as_buffer().size // 8 for x in rows.column("code")])]).astype(np.int64)
        word = (every & _ODD) == 1
        # the bucket's share of the totals goes on its first row
        totals = [np.zeros(rows.num_rows, np.int64) for _ in range(3)]
        for column, x in zip(totals, (word.sum(), n[word].sum(), t[word].sum())):
            column[:1] = x
        lists = [_planes(x[at], ends) for x in (n, t)]
        return pa.table([rows.column("part"), rows.column("bucket"), *lists, *totals], names=["part", "bucket", "n", "t", "words", "all_n", "all_t"])

    sent = texts.groupBy("part").cogroup(chosen.groupBy("part")).applyInArrow(counts, "part long, bucket long, code binary, n binary, t binary")
    back = sent.groupBy("bucket").applyInArrow(sums, "part long, bucket long, n binary, t binary, words long, all_n long, all_t long")
    back = shared_table(back, "sums", codec="zstd")
    every = back.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "all_n", "all_t")]).first()
    vocabulary, all_n, all_t = (int(x) for x in every)
    kind = texts.schema["id"].dataType.simpleString()
    # a target's place travels with the sums, as a negative bucket
    none = F.lit(None).cast("binary")
    back = back.select("part", "bucket", "n", "t").unionAll(chosen.select("part", -1 - F.col("place"), none, none))

    def scored(rows: pa.Table, reply: pa.Table) -> pa.Table:
        rows, reply = rows.sort_by("place"), reply.sort_by("bucket")
        made = PartGrams(rows.column("text").combine_chunks())
        bucket = reply.column("bucket").to_numpy()
        marks = int((bucket < 0).sum())
        target = _flags(-1 - bucket[:marks], rows.num_rows)
        order = _dealt(made.code, *made.counts(target), buckets)[0]
        text, length = made.text, made.tokens[made.text]
        inside = target[text]
        size = rows.num_rows

        def own(number: np.ndarray, most: int) -> np.ndarray:
            """How often a token's text itself holds the gram of that number."""
            _, n, at = _ranked(text * most + number, size * most)
            return n[at]

        own_word, own_pair = own(made.word, made.words), own(made.pair, len(made.pair_n))
        # the word before is a context as often as it is a word
        own_context = np.concatenate([[1], own_word[:-1]])[: len(text)]
        own_context[made.first] = 1
        total = np.zeros((2, size))
        for k, (column, everything, mine) in enumerate((("n", all_n, 1), ("t", all_t, inside))):
            known = np.empty(len(order))
            known[order] = _values(reply.column(column).slice(marks))
            word = known[made.word]
            context = np.concatenate([[0.0], word[:-1]])[: len(text)]
            context[made.first] = known[-1:]
            pair = known[made.words + made.pair] - own_pair * mine
            low = (word - own_word * mine + mu / max(vocabulary, 1)) / (everything - length * mine + mu)
            total[k] = np.bincount(text, -np.log((pair + mu * low) / (context - own_context * mine + mu)), size)
        sums = [pa.array(x, mask=made.tokens == 0) for x in total]
        return pa.table([rows.column("id"), pa.array(made.tokens), *sums], names=["id", "n", "b", "t"])

    out = texts.groupBy("part").cogroup(back.groupBy("part")).applyInArrow(scored, f"id {kind}, n long, b double, t double")
    b, t = F.col("b") / F.col("n"), F.col("t") / F.col("n")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), t.alias("target_loss"), b.alias("background_loss"), (b - t).alias("score"))
