"""Near-duplicate join on word shingles: exact Jaccard links and components.

Documents are rows and shingles are columns of a sparse incidence matrix; the
product of the matrix with its transpose holds every pair's overlap.  Only
blocks of it that can hold a link are computed:

1. Copies (equal shingle sets) collapse to one row, with a weight.
2. Columns are ordered rare first.  A set of n shingles needs an overlap of
   at least ceil(t n) with any partner, so two linked sets share at least l
   columns among the first n - ceil(t n) + l of each (l grows with n: 1 + n / 32,
   by the smaller set); only those prefix entries are shuffled, and a row that
   meets fewer others' columns than its bound is discarded.  The order may be
   any, as long as it is the same for all; frequent columns come last, so
   a passage that many documents share brings no candidates together.  Their
   list is approximate and bounded: counts below 3 in a task's buffer are left
   out, and past the list's end a column counts as rare.  That changes only the
   cost.
3. Rows that share prefix columns are gathered into row blocks of bounded
   size, around the document that is the least in most of their columns; a
   larger group is dealt over several blocks, each with that document in it.
   The product of every block with itself is made first, and its links are
   contracted to classes.
4. What is left are pairs of rows of different blocks and different classes.
   The rows of a block and class visit each larger block that shares enough
   prefix columns with them, with sizes that could fit, so a block is sent once
   however many visit it, and members of a class never meet again.
5. A product is accumulated column block by column block; a pair is discarded
   once its overlap plus what is left falls below its size-derived bound.  It
   returns, per document, the least document of its part of the class, never
   the pairs.

No cap is set on blocks, visits or partners.  Links inside a class are not
counted: most of them are never computed.

Defined results: a null text or one without words has no shingles and no link;
rows of a null id come back with a null component; rows that repeat an id are
one document with several texts; an empty table gives no rows; other columns
are ignored.  Shingles are compared by 64-bit hashes of five word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import shared_table
from .textkernels import mix, shingle_sets, text_groups


def bound(n: int | np.ndarray, percent: int):
    """The least overlap of a set of n shingles with any partner."""
    return -(-n * percent // 100)


def prefix_overlap(n):
    """The least number of prefix columns that a set of n shares with a partner
    of its size or more (n: an int or a Column of ints)."""
    return 1 + F.floor(n / 32) if isinstance(n, Column) else 1 + n // 32


def _enough(count: Column, n: Column, percent: int) -> Column:
    """Can a set of n have a partner, by its number of met prefix columns?"""
    return count >= prefix_overlap(F.ceil(n * percent / 100))


def signature(s: np.ndarray) -> int:
    """One value per set, as a signed 64-bit number; 0 for the empty set."""
    if not len(s):
        return 0
    folded = np.array([np.bitwise_xor.reduce(s)], np.uint64)
    total = np.array([s.sum(dtype=np.uint64)], np.uint64)
    return int(mix(total + np.uint64(len(s)) ^ mix(folded)).view(np.int64)[0])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def set_table(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Rows (id, n, sig) of all documents, and (sig=shingle, n=count) of those
    shingles that several documents of a task share, told apart by ``kind``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def shared() -> pa.RecordBatch:
            value, count = np.unique(np.concatenate(held or [np.zeros(0, np.uint64)]), return_counts=True)
            often = count >= 3
            n = int(often.sum())
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.int64()), pa.array(count[often].astype(np.int64)), pa.array(value[often].view(np.int64))],
                names=["kind", "id", "n", "sig"],
            )

        for batch in batches:
            sizes, sigs = [], []
            for _, _, data, ends in text_groups(batch.column(1)):
                for s in shingle_sets(data, ends, words):
                    sizes.append(len(s))
                    sigs.append(signature(s))
                    held.append(s)
                    size += len(s)
                if size > 1 << 22:
                    yield shared()
                    held, size = [], 0
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(n, np.int32)), batch.column(0), pa.array(sizes, pa.int64()), pa.array(sigs, pa.int64())], names=["kind", "id", "n", "sig"]
            )
        yield shared()

    return shared_table(_texts(docs, id_col, text_col).mapInArrow(run, "kind int, id long, n long, sig long"), "shingle-sets", "kind")


def prefix_entries(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, common: np.ndarray) -> DataFrame:
    """(tok, id, n) of each set's rarest columns; ``common``: frequent ones,
    the most frequent last.  Of equal sets in one task only the first is sent."""
    order = np.argsort(common)
    shared = docs.sparkSession.sparkContext.broadcast((common[order], order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, ranks = shared.value
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column(0)
            for first, _, data, ends in text_groups(batch.column(1)):
                toks, rows, sizes = [], [], []
                for k, s in enumerate(shingle_sets(data, ends, words)):
                    if not len(s) or not ids[first + k].is_valid or (sig := signature(s)) in seen:
                        continue
                    seen.add(sig)
                    want = len(s) - bound(len(s), percent) + prefix_overlap(len(s))
                    at = np.searchsorted(values, s)
                    hot = (values[np.minimum(at, len(values) - 1)] == s) if len(values) else np.zeros(len(s), bool)
                    rare = s[~hot][:want]
                    if len(rare) < want:
                        last = s[hot]
                        rare = np.concatenate([rare, last[np.argsort(ranks[at[hot]])][: want - len(rare)]])
                    toks.append(rare)
                    rows.append(np.full(len(rare), ids[first + k].as_py(), np.int64))
                    sizes.append(np.full(len(rare), len(s), np.int64))
                if toks:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(toks).view(np.int64)), pa.array(np.concatenate(rows)), pa.array(np.concatenate(sizes))], names=["tok", "id", "n"]
                    )

    return _texts(docs, id_col, text_col).mapInArrow(run, "tok long, id long, n long")


def _met(entries: DataFrame) -> DataFrame:
    """The entries whose column another row has too, with the least such row."""
    w = Window.partitionBy("tok").orderBy("id")
    marked = entries.withColumns({"before": F.lag("id").over(w), "after": F.lead("id").over(w), "head": F.first("id").over(w)})
    return marked.where("before IS NOT NULL OR after IS NOT NULL").select("tok", "id", "n", "head")


def _strong(entries: DataFrame, percent: int) -> DataFrame:
    """The entries of those rows that meet enough others' columns."""
    met = F.count(F.lit(1)).over(Window.partitionBy("id"))
    return entries.withColumn("c", met).where(_enough(F.col("c"), F.col("n"), percent)).drop("c")


def overlap_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int, columns: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Linked (row, row) pairs, the first of ``left``, the second of ``right``.

    Blocked product over the columns that two rows share at least; pairs whose
    bound fails are discarded after every column block.
    """
    n = np.array([len(s) for s in sets], np.int64)
    both = n[left][:, None] + n[right][None, :]
    need = -(-percent * both // (100 + percent))  # 100 x >= percent (a + b - x)
    small = np.minimum(n[left][:, None], n[right][None, :])
    alive = (need <= small) & (left[:, None] != right[None, :]) & (small > 0)
    overlap = np.zeros(alive.shape, np.float32)
    value = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    new = np.concatenate([[True], value[1:] != value[:-1]])
    column = np.cumsum(new) - 1
    common = np.bincount(column)[column] > 1
    row, column = row[common], column[common]
    column = np.unique(column, return_inverse=True)[1]
    todo = np.bincount(row, minlength=len(sets))
    for at in range(0, int(column.max(initial=-1)) + 1, columns):
        a, b = np.searchsorted(column, [at, at + columns])
        part = np.zeros((len(sets), min(columns, column[b - 1] + 1 - at)), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        overlap += part[left] @ part[right].T
        todo = todo - np.bincount(row[a:b], minlength=len(sets))
        alive &= overlap + np.minimum(todo[left][:, None], todo[right][None, :]) >= need
        if not alive.any():
            break
    alive &= overlap >= need
    i, j = np.nonzero(alive)
    return left[i], right[j]


def _settled(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node of each of n nodes' components; edges both ways."""
    least = np.arange(n)
    while True:
        before = least.copy()
        np.minimum.at(least, u, least[v])
        if (least == before).all():
            return least


def class_rows(ids: np.ndarray, owns: np.ndarray, sets: list[np.ndarray], percent: int, tile: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(id, least linked id) of the linked documents of one block's product.

    With visitors (rows that the block does not own) the product is block
    against visitors, else the block against itself.  It is made tile by tile,
    and only a spanning set of a tile's links is kept.
    """
    own = bool(owns.all())
    left, right = (np.arange(len(ids)),) * 2 if own else (np.flatnonzero(owns), np.flatnonzero(~owns))
    names, node = np.unique(ids, return_inverse=True)
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(left), tile):
        for j in range(i if own else 0, len(right), tile):
            x, y = left[i : i + tile], right[j : j + tile]
            rows = np.union1d(x, y)
            a, b = overlap_links([sets[k] for k in rows], np.searchsorted(rows, x), np.searchsorted(rows, y), percent)
            a, b = node[rows[np.concatenate([a, b])]], node[rows[np.concatenate([b, a])]]
            hit = np.unique(a)
            us.append(hit)
            vs.append(_settled(len(names), a, b)[hit])
    u, v = np.concatenate(us), np.concatenate(vs)
    least = _settled(len(names), np.concatenate([u, v]), np.concatenate([v, u]))
    hit = np.unique(np.concatenate([u, v]))
    return names[hit], names[least[hit]]


def _class_links(gathered: DataFrame, words: int, percent: int, most: int) -> DataFrame:
    """Spanning links (u, v) of every block's product.

    ``gathered``: block, visits, id, text; a task reads a block's own rows, then
    its visitors, of which it holds ``most`` at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets, owners = None, [], [], None

        def solve() -> Iterator[pa.RecordBatch]:
            if len(sets) > 1:
                owns = np.arange(len(ids)) < (len(ids) if owners is None else owners)
                out = class_rows(np.array(ids, np.int64), owns, sets, percent)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["u", "v"])

        for batch in batches:
            block, visits, name = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            for first, last, data, ends in text_groups(batch.column(3)):
                for k, s in zip(range(first, last), shingle_sets(data, ends, words)):
                    if key != block[k]:
                        yield from solve()
                        key, ids, sets, owners = block[k], [], [], None
                    if visits[k] and owners is None:
                        owners = len(ids)
                    if owners is not None and len(ids) >= owners + most:
                        yield from solve()
                        ids, sets = ids[:owners], sets[:owners]
                    ids.append(name[k])
                    sets.append(s)
        yield from solve()

    dealt = gathered.select("block", "visits", "id", "text").repartition("block").sortWithinPartitions("block", "visits")
    return dealt.mapInArrow(run, "u long, v long")


def jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75, common_columns: int = 1 << 16, block_weight: int = 4096
) -> DataFrame:
    """One row per document: id, n_shingles, component_id.

    ``common_columns`` is the size of the list of frequent columns (it bounds a
    broadcast of 16 bytes each and only affects the order, not the result);
    ``block_weight`` bounds a row block, a document weighing 1 + n / 1000.
    """
    table = set_table(docs, id_col, text_col, words)
    rows = table.where("kind = 0").select("id", "n", "sig")
    often = table.where("kind = 1").groupBy("sig").agg(F.sum("n").alias("c")).where("c >= 8")
    listed = often.orderBy(F.desc("c"), "sig").limit(common_columns).collect()
    common = np.array([r.sig for r in reversed(listed)], np.int64).view(np.uint64)

    sets = rows.where("n > 0 AND id IS NOT NULL").groupBy("sig", "n").agg(F.min("id").alias("rep"))
    # by column, by row (strong rows as their copies' first), by column again:
    # each step filters before the next one moves what is left
    entries = shared_table(_strong(_met(prefix_entries(docs, id_col, text_col, words, percent, common)), percent), "strong")
    # a set has one strong row a task at most, however many copies
    firsts = rows.where("n > 0").join(entries.select("id").distinct(), "id", "left_semi").join(sets, ["sig", "n"]).select("id", "rep").distinct()
    entries = entries.join(firsts.hint("merge"), "id").select("tok", F.col("rep").alias("id"), "n")
    met = shared_table(_met(entries.repartition("tok").dropDuplicates(["tok", "id"])), "met")

    placed = met.groupBy("id", "head").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("c"))
    most = F.max_by("head", F.struct("c", (-F.col("head")).alias("h")))
    placed = placed.groupBy("id").agg(most.alias("head"), F.max("n").alias("n"), F.sum("c").alias("c"))
    placed = placed.where(_enough(F.col("c"), F.col("n"), percent)).select("id", "head", "n")
    weight = F.sum(1 + F.col("n") / 1000)
    parts = placed.groupBy("head").agg(F.ceil(weight / block_weight).cast("int").alias("parts")).where("parts > 1")
    part = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1)))
    block = lambda part: F.xxhash64("head", part).alias("block")
    blocks = shared_table(placed.join(parts, "head", "left").select("id", block(part.cast("int"))), "blocks")
    copied = parts.select("head", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(F.col("head").alias("id"), block(F.col("part")))
    texts = _texts(docs, id_col, text_col).join(blocks.select("id").union(copied.select("id")).distinct().hint("merge"), "id")
    texts = shared_table(texts, "texts", codec="zstd")
    first = blocks.unionByName(copied).distinct().withColumn("visits", F.lit(False))
    near = shared_table(_class_links(first.join(texts, "id"), words, percent, block_weight), "links")

    classes = components(near.where("u <> v")).select(F.col("node").alias("id"), F.col("root").alias("class"))
    size = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("rows"))
    units = blocks.join(classes, "id", "left").join(size, "block").select("id", "block", "rows", F.coalesce("class", "id").alias("class"))
    units = shared_table(units, "units")
    at = met.join(units, "id").groupBy("tok", "block", "class").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.first("rows").alias("rows"))
    x, y = at.alias("x"), at.alias("y")
    larger = (F.col("x.rows") < F.col("y.rows")) | ((F.col("x.rows") == F.col("y.rows")) & (F.col("x.block") < F.col("y.block")))
    fit = (F.col("x.lo") * percent <= F.col("y.hi") * 100) & (F.col("y.lo") * percent <= F.col("x.hi") * 100)
    open_ = x.join(y, (F.col("x.tok") == F.col("y.tok")) & (F.col("x.class") != F.col("y.class")) & larger & fit)
    visits = open_.groupBy(F.col("x.block").alias("from"), F.col("x.class").alias("class"), F.col("y.block").alias("block")).agg(
        F.count_distinct("x.tok").alias("c"), F.min(F.least("x.lo", "y.lo")).alias("lo")
    )
    visits = visits.where(F.col("c") >= prefix_overlap(F.col("lo"))).select("from", "class", "block")
    guests = shared_table(units.withColumnRenamed("block", "from").join(visits, ["from", "class"]).select("id", "block"), "visits")
    # a block with very many visitors is sent to several tasks
    tables = guests.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / (16 * block_weight)).cast("int").alias("tables"))
    seat = lambda n: F.xxhash64("block", n).alias("block")
    seated = guests.join(tables, "block").select("id", seat(F.pmod(F.xxhash64("id"), F.col("tables")).cast("int")), F.lit(True).alias("visits"))
    hosts = units.join(tables, "block").select("id", "block", F.explode(F.sequence(F.lit(0), F.col("tables") - 1)).alias("t"))
    hosts = hosts.select("id", seat(F.col("t")), F.lit(False).alias("visits"))
    far = shared_table(_class_links(hosts.unionByName(seated).join(texts, "id"), words, percent, block_weight), "links")

    roots = components(near.unionAll(far).where("u <> v"))
    named = sets.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("sig", "n", F.coalesce("root", "rep").alias("root"))
    return rows.join(named, ["sig", "n"], "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("root", "id")).alias("component_id"),
    )
