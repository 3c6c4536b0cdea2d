"""Filter audit, quantised neighbours and ranked lexical search against
brute-force versions, and on odd rows."""

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from milepost.llm import filter_audit as fa
from milepost.llm import lexical_search as lx
from milepost.llm import quantised_knn as kn

from .test_llm import DOCS, corpus, prose

LABELS = "doc_id long, quality int, toxic int"


def failures(rows):
    """Per row: its five failures by the plainest reading."""
    out = []
    for i, text, *_ in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        capitals = len(re.findall("[A-Z]", text))
        twin = i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in rows)
        out.append((len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 2 * len(text), bool(re.search(r"[#$%&*|]", text)), twin))
    return out


def audit(rows, labels):
    """Every order over every row."""
    fails = failures(rows)
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[n] == 1} for n in (0, 1))
    parts = sorted({r[3] or "" for r in rows})
    out = {}
    for order in itertools.permutations(range(5)):
        for part in parts:
            alive = [n for n, r in enumerate(rows) if (r[3] or "") == part]
            mine = list(alive)
            for step, f in enumerate(order):
                hit = [n for n in alive if fails[n][f]]
                alive = [n for n in alive if not fails[n][f]]
                failing = [n for n in mine if fails[n][f]]
                out[part, "".join("ABCDE"[i] for i in order), step + 1] = [
                    len(alive), len(hit), len(failing) - len(hit), sum(sum(fails[n]) == 1 for n in failing), sum(rows[n][0] in good for n in hit), sum(rows[n][0] in toxic for n in hit)
                ]
    totals = {}
    for (part, order, step), row in out.items():
        key = part, order[step - 1]
        totals[key] = totals.get(key, 0) + row[1]
    return {k: (*row, totals[k[0], k[1][k[2] - 1]]) for k, row in out.items()}


def audited(spark, rows, labels, parts=5):
    docs = spark.createDataFrame(rows, DOCS).repartition(parts)
    found = fa.filter_audit(docs, spark.createDataFrame(labels, LABELS)).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found}
    assert len(got) == len(found)
    return got


def test_filter_audit(spark, monkeypatch):
    monkeypatch.setattr(fa, "STRETCH", 7)
    rng = random.Random(4)
    rows = [*corpus(), (None, "a & b", "en", None, "b", "x"), (None, "a & b", "en", "s1", "b", "x"), (7, "A" * 9, "en", "s1", "b", "x"), (7, "A" * 9, "en", "s1", "b", "x")]
    rows += [(1000 + n, prose(rng, 210) + (" # TITLE" * (n % 3)), "en", "s2", "b", "x") for n in range(9)]
    rows += [(2000, rows[-1][1], "en", "s0", "b", "x"), (2001, "é" * 98 + " AB", "en", "s0", "b", "x"), (2002, "a\x00b " * 250, "en", "s0", "b", "x")]
    labels = [(r[0], rng.randrange(2), rng.randrange(2)) for r in rows[::2] if r[0] is not None] + [(None, 1, 1), (rows[0][0], None, 1), (rows[0][0], 1, None)]
    assert audited(spark, rows, labels) == audit(rows, labels)


def test_filter_audit_of_nothing_and_without_labels(spark):
    assert audited(spark, [], []) == {}
    rows = corpus()[:9]
    assert audited(spark, rows, []) == audit(rows, [])


def test_bitmaps_of_a_part_start_on_words():
    rng = np.random.default_rng(2)
    part = rng.permutation(np.repeat(np.arange(5), [1, 64, 65, 300, 7]))
    failed, labels = rng.random((3, len(part))) < 0.3, rng.random((1, len(part))) < 0.5
    seen = set()
    for subset, f, before, removed, (lost,) in fa.subset_counts(part, 5, failed, labels):
        alive = ~failed[[i for i in range(3) if subset >> i & 1]].any(0)
        for p in range(5):
            mine = alive & (part == p)
            assert (before[p], removed[p], lost[p]) == (mine.sum(), (mine & failed[f]).sum(), (mine & failed[f] & labels[0]).sum())
        seen.add((subset, f))
    assert len(seen) == 12


def nearest(rows, k, asks):
    out = {}
    sound = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    for q, a in sound:
        if asks(q):
            found = []
            for i, b in sound:
                if i != q and len(a) == len(b):
                    s = 0.0
                    for x, y in zip(a, b):
                        s += x * y
                    found.append((s, i))
            out.setdefault(q, []).extend(found)
    return {(q, n + 1): (i, s) for q, found in out.items() for n, (s, i) in enumerate(sorted(found, key=lambda x: (-x[0], x[1]))[:k])}


@pytest.mark.parametrize("cells", [(4096, 8192), (5, 40)])
def test_nearest_neighbours(spark, cells):
    rng = np.random.default_rng(3)
    unit = rng.normal(size=(230, 12))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    rows = [(n, v.astype(np.float32).astype(float).tolist()) for n, v in enumerate(unit)]
    rows += [(300 + n, rows[3][1]) for n in range(60)] + [(400, [1e30] * 12), (401, [1e-40] + [0.0] * 11), (402, [-1e30] * 12), (420, [1e30, -1e30] * 6)]
    rows += [(500, None), (501, []), (502, [0.0] * 12), (503, [None] + [1.0] * 11), (504, [float("nan")] * 12), (505, [float("inf")] * 12), (None, rows[0][1])]
    rows += [(520, [1.0, 2.0]), (521, [1.0, 1.0]), (540, [3.0]), (60, rows[9][1]), (11, rows[9][1]), (11, rows[9][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash")).repartition(3)
    found = kn.nearest_neighbours(df, F.col("vec_id") % 20 == 0, k=7, query_block=cells[0], chunk=cells[1]).collect()
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in found}
    assert len(got) == len(found) and got == nearest(rows, 7, lambda q: q % 20 == 0)
    assert kn.nearest_neighbours(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_code_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(40, 1100)), rng.normal(size=(60, 1100))  # wider than one exact product
    (x, sx, _, rx), (y, sy, cy, ry) = kn.encode(a), kn.encode(b)
    exact = x.astype(np.int64) @ y.astype(np.int64).T
    assert (kn.code_products(x, y) == exact).all()
    room = np.linalg.norm(a, axis=1)[:, None] * ry + rx[:, None] * cy
    gap = np.abs(a @ b.T - exact * sx[:, None] * sy)
    assert (gap <= room).all() and room.max() < 0.05 * np.abs(a @ b.T).max() * 10
    # two copies of a vector are enough for one nearest, whatever their number
    assert kn.fewest_copies(np.ones((50, 3)), np.arange(50), 1).tolist() == [0, 1]


def ranked(docs, items, k):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))
    held = [(i, cut(t)) for i, t, *_ in docs]
    held = [(i, w) for i, w in held if w]
    n, total = len(held), sum(len(w) for _, w in held)
    df = {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = {}
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, []).extend(cut(text))
    for item, terms in asked.items():
        found = []
        for i, w in held:
            m = 75 + 25 * len(w) * n // total
            score = 0
            for t in terms:
                if tf := w.count(t):
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf // (1000 * tf + 12 * m))
            if score > 0 and i is not None:
                found.append((-score, i))
        out |= {(item, r + 1): (i, -s) for r, (s, i) in enumerate(sorted(found)[:k])}
    return out


@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 3, "SHARD_DOCS": 13, "SHARD_BYTES": 20_000, "BATCH": 2, "STRIDE": 8, "FIRST_STRIDE": 4, "PIECE": 50}])
def test_lexical_search(spark, monkeypatch, sizes):
    for name, x in sizes.items():
        monkeypatch.setattr(lx, name, x)
    docs = corpus() + [(None, "karbel", "en", "s", "b", "x"), (9000, "Éa ÉA x9 kabel0", "en", "s", "b", "x"), (9001, "kabel0 " * 70_000, "en", "s", "b", "x"), (9002, "--- !", "en", "s", "b", "x")]
    items = [(n, docs[7 * n][1]) for n in range(12)] + [(20, None), (21, ""), (22, "nowhere at all"), (23, "ÉA kabel0 KABEL0 x9"), (None, "kabel0"), (24, "kabel0"), (24, "lodor1")]
    df = spark.createDataFrame(docs, DOCS).repartition(4)
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = lx.search(lx.build_index(df), asked, k=6).collect()
    got = {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in found}
    assert len(got) == len(found) and got == ranked(docs, items, 6)


def test_lexical_search_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    some = spark.createDataFrame(corpus()[:3], DOCS)
    items = spark.createDataFrame([(1, "kabel0")], "item_id long, text string")
    assert lx.search(lx.build_index(none), items).collect() == []
    assert lx.search(lx.build_index(some), items.limit(0)).collect() == []


def test_posting_blocks_round_trip_and_skip():
    rng = np.random.default_rng(6)
    size, m = 9000, np.full(9000, 100)
    lists = []
    for share, most in ((0.9, 3), (0.02, 70_000), (0.3, 300)):
        place = np.flatnonzero(rng.random(size) < share)
        tf = rng.integers(1, most, len(place))
        made = lx.compress(np.zeros(len(place), np.int64), place, tf, lx.impact(tf, m[place]))
        postings = lx.Postings(len(place), *[made[c] for c in ("firsts", "lasts", "widths", "impacts", "payload")], m)
        exact = np.zeros(size, np.int64)
        exact[place] = lx.impact(tf, m[place])
        assert len(made["firsts"]) == -(-len(place) // lx.BLOCK)
        assert (postings.at(np.arange(size)) == exact).all()
        lists.append(lx.Postings(len(place), *[made[c] for c in ("firsts", "lasts", "widths", "impacts", "payload")], m))
    # a list whose places are all below the threshold stays compressed
    rare = np.arange(40)
    made = lx.compress(np.zeros(40, np.int64), rare, np.full(40, 9), lx.impact(np.full(40, 9), m[rare]))
    strong = lx.Postings(40, *[made[c] for c in ("firsts", "lasts", "widths", "impacts", "payload")], m)
    place, score = lx.block_max_wand([(1000, strong), (1, lists[0])], np.ones(size, bool), 5)
    assert len(place) == 5 and (place < 40).all()
    assert lists[0].read.sum() <= 2 and len(lists[0].read) > 50


def test_terms_are_counted_alike():
    texts = [None, "", "a", "b c", " x", "x ", "é-é", "ab1!!2", "z" * 10, "a\x00b"]
    array = pa.array([None if t is None else t.encode() for t in ["left out", *texts]], pa.binary()).slice(1)
    assert lx.count_terms(array).tolist() == [0 if t is None else sum(map(len, lx.pieces(t.encode()))) for t in texts]
