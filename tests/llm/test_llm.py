"""Each operator against a brute-force version, and on the odd inputs: nulls,
empty and very long texts, ties, repeated rows, empty tables, other columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from milepost.llm import license_scan as ls
from milepost.llm import lm_score, mixing, packing, quality, textkernels, warc
from milepost.llm.components import components
from milepost.llm.exact_dedup import build_directory, build_index, exact_dedup, exact_survivors
from milepost.llm.jaccard import jaccard_join
from milepost.llm.substring_dedup import substring_dedup
from milepost.llm.topk import exact_topk

DOCS = "doc_id long, text string, lang string, source string, bucket string, id string"
WORDS = [a + b for a in "ka lo mi nu re so ti ve xa zo".split() for b in "bel dor fin gas hul".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def corpus(seed=1, n=60):
    """Documents with copies, near copies, shared passages and odd texts."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(20, 120)) for _ in range(n)]
    passage = prose(rng, 60)
    texts = list(base)
    texts += [base[0]] * 5 + [base[1].upper(), base[2].replace(" ", "\n\t")]
    for k in range(12):
        words = base[3 + k % 4].split()
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [f"{b[:80]} {passage} {b[80:]}" for b in base[10:30]]
    texts += [None, "", " \n ", "one two three", "one two three", "é" * 300, "ab" * 400, "na " * 500, prose(rng, 3000), passage]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i * 3, texts[k], "en", f"s{k % 3}", "b", "x") for i, k in enumerate(order)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_extendible_directory(spark):
    counts = {s: 1 for s in range(16) if s != 9} | {3: 50}
    loads = spark.createDataFrame([*counts.items()], "slot long, load long")
    d = {r["slot"]: r["bucket"] for r in build_directory(loads, 4, 4).collect()}
    sizes = Counter()
    for slot, bucket in d.items():
        sizes[bucket] += counts[slot]
        depth = bucket.bit_length() - 1
        assert bucket == (1 << depth) + (slot >> (4 - depth))  # a node on the slot's way
        # it had to split: the node above holds too much
        assert depth == 0 or sum(n for s, n in counts.items() if s >> (5 - depth) == bucket // 2 - (1 << depth - 1)) > 4
    assert d.keys() == counts.keys() and d[3] == 16 + 3 and sizes[19] == 50  # at full depth: a chain
    assert all(n <= 4 for b, n in sizes.items() if b != 19)


@pytest.mark.parametrize("bucket_rows", [2, 2048])
def test_exact_dedup(spark, docs, nothing, bucket_rows):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    groups = defaultdict(list)
    for d, t in rows:
        groups[t].append(d)
    want = Counter((d, max(groups[t]), len(groups[t]), d == max(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in rows)
    assert Counter(tuple(r)[:5] for r in exact_dedup(docs, bucket_rows=bucket_rows).collect()) == want
    kept = exact_survivors(docs, bucket_rows=bucket_rows)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(max(g) for g in groups.values())
    index = build_index(docs, bucket_rows=bucket_rows)
    plain = index.where("page IS NULL").groupBy("bucket").count()
    assert plain.agg(F.max("count")).first()[0] <= max(bucket_rows, 8) and index.count() == len(rows)
    assert (index.where("page IS NOT NULL").count() > 0) == (bucket_rows == 2)
    assert exact_dedup(nothing).count() == exact_survivors(nothing).count() == 0
    odd = spark.createDataFrame([(None, "a"), (None, "a"), (1, "a"), (2, "b"), (2, "b"), (None, None)], "doc_id long, text string")
    got = Counter(tuple(r)[:4] for r in exact_dedup(odd, bucket_rows=bucket_rows).collect())
    assert got == {(None, 1, 3, False): 2, (1, 1, 3, True): 1, (2, 2, 2, True): 2, (None, None, 1, True): 1}
    assert exact_survivors(odd, bucket_rows=bucket_rows).count() == 3


def test_texts_of_one_hash_are_told_apart_by_their_bytes(spark, docs, monkeypatch):
    from milepost.llm import exact_dedup as ed

    plain = exact_dedup(docs).drop("bucket").collect()
    # every text has one hash: one chain, in pages or not
    monkeypatch.setattr(ed.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    for bucket_rows in (3, 2048):
        assert Counter(exact_dedup(docs, bucket_rows=bucket_rows).drop("bucket").collect()) == Counter(plain)
        assert exact_survivors(docs, bucket_rows=bucket_rows).count() == len({r["text_sha256"] for r in plain})
    assert build_index(docs).agg(F.max("chain")).first()[0] == len({r["text_sha256"] for r in plain})


def brute_substrings(rows, n=100):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if b[p : p + n] in seen:
                gone[p : p + n] = b"\1" * n
            seen.add(b[p : p + n])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for k, _ in itertools.groupby(gone) if k)
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_substring_dedup(spark, docs, nothing):
    want = brute_substrings([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r[0]: tuple(r)[1:5] for r in substring_dedup(docs).collect()}
    assert got == want and sum(v[1] for v in got.values()) > 2000
    full = substring_dedup(docs, with_text=True).where("n_removed > 0").first()
    assert hashlib.sha256(bytes(full["kept"])).hexdigest() == full["kept_sha256"] and len(full["spans"]) == full["n_spans"]
    assert substring_dedup(nothing).count() == 0
    t = "x" * 250
    odd = spark.createDataFrame([(None, t), (1, t), (1, t), (2, "short"), (3, None)], "doc_id long, text string")
    got = Counter((r[0], r[1], r[2]) for r in substring_dedup(odd).collect())
    assert got == {(None, 250, 0): 1, (1, 250, 249): 2, (2, 5, 0): 1, (3, 0, 0): 1}


def test_bucket_ids_name_stretches_by_their_bytes():
    from milepost.llm.substring_dedup import BucketIds

    data = np.frombuffer(bytes(random.Random(1).choices(b"ab", k=600)) * 2, np.uint8)
    ids = BucketIds(data, 3)
    rng = np.random.default_rng(2)
    start = rng.integers(0, 1100, 4000)
    end = start + rng.integers(3, 100, 4000)
    names = ids.of(start, end).tolist()
    by_bytes = defaultdict(set)
    for a, b, x in zip(start, end, names):
        by_bytes[data[a:b].tobytes()].add(x)
    assert all(len(x) == 1 for x in by_bytes.values()) and len({*names}) == len(by_bytes) and len(ids.widths) > 4


def test_sliding_argmin_and_hashes():
    v = np.random.default_rng(0).integers(0, 50, 400).astype(np.uint64) << np.uint64(40)
    for w in (1, 2, 69, 77):
        got = textkernels.sliding_argmin(v, w)
        assert got.tolist() == [i + int(np.argmin(v[i : i + w])) for i in range(len(v) - w + 1)]
    assert len(textkernels.sliding_argmin(v[:5], 9)) == 0
    data = np.frombuffer(b"abcabcabdabc", np.uint8)
    h = textkernels.window_hashes(textkernels.prefix_sums(data), 3)
    assert h[0] == h[3] == h[9] and len({*h.tolist()}) == 6


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_jaccard(rows):
    sets = {d: shingles(t) for d, t in rows}
    links = defaultdict(set)
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            links[a].add(b)
            links[b].add(a)
    root = {}
    for d in sorted(sets):
        todo = [d]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = d
                todo += links[x]
    return {d: (len(s), root[d], len(links[d])) for d, s in sets.items()}


@pytest.mark.parametrize("block_weight", [2, 7, 4096])
def test_jaccard_join(docs, block_weight):
    want = brute_jaccard([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r[0]: tuple(r)[1:] for r in jaccard_join(docs, block_weight=block_weight).collect()}
    assert got == {d: v[:2] for d, v in want.items()} and sum(v[2] for v in want.values()) > 20


def test_jaccard_tiles():
    from milepost.llm.jaccard import class_rows

    rng = np.random.default_rng(4)
    base = [np.sort(rng.choice(10_000, 40, replace=False)).astype(np.uint64) for _ in range(6)]
    sets = [np.unique(np.concatenate([base[k % 6][2:], rng.choice(10_000, 2).astype(np.uint64)])) for k in range(50)]
    ids = np.arange(50)[::-1] * 2
    for owns in (np.full(50, True), np.arange(50) < 23):
        want = class_rows(ids, owns, sets, 75)
        for tile in (1, 7, 25):
            assert all((a == b).all() for a, b in zip(want, class_rows(ids, owns, sets, 75, tile)))
        assert len(want[0]) == 50 and len(set(want[1].tolist())) == 6


def test_many_near_copies_move_each_text_a_few_times(spark, monkeypatch):
    from milepost.llm import jaccard

    rng = random.Random(8)
    base = prose(rng, 60).split()
    texts = []
    for k in range(900):
        words = list(base)
        words[rng.randrange(60)] = f"edit{k}"
        if k % 90 == 0:  # shares many shingles with the others and is linked with none
            words[20:] = prose(rng, 40).split()
        texts.append((k, " ".join(words)))
    rows = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    sent = []
    real = jaccard._class_links
    monkeypatch.setattr(jaccard, "_class_links", lambda g, *a: (sent.append(g.count()), real(g, *a))[1])
    got = {r[0]: tuple(r)[1:] for r in jaccard_join(rows, block_weight=64).collect()}
    assert got == {d: v[:2] for d, v in brute_jaccard(texts).items()}
    assert sum(sent) < 5 * len(texts)


def test_jaccard_join_on_borders_and_odd_rows(spark, nothing):
    # 20 and 20 words: 16 shingles each; an edit at the end leaves 14 of 18, one more 13 of 19
    w = [f"w{k}" for k in range(20)]
    near, far = [*w[:18], "x", "y"], [*w[:17], "x", "y", "z"]
    odd = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(near)), (3, " ".join(far)), (4, None), (5, ""), (None, " ".join(w)), (6, "One two"), (7, "one  TWO"), (7, "one two")], "doc_id long, text string")
    got = Counter(tuple(r) for r in jaccard_join(odd).select("doc_id", "n_shingles", "component_id").collect())
    assert got[1, 16, 1] == got[2, 16, 1] == 1 and got[4, 0, 4] == got[5, 0, 5] == got[None, 16, None] == 1
    assert got[6, 1, 6] == 1 and got[7, 1, 6] == 2
    assert jaccard_join(nothing).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 102), (100, 102), (200, 201)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[102] == 100 and got[201] == 200 and len(got) == 46
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("scale", [256, 1 << 22, 1 << 25])
def test_exact_topk(spark, scale):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 24))
    vectors[50:70] = vectors[0]
    data = [(int(i), v.tolist(), 1) for i, v in enumerate(vectors)] + [(1000, None, 1), (1001, [], 1), (1002, [float("nan")] * 24, 1), (1003, [None] * 24, 1), (None, [1.0] * 24, 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, score int")
    got = sorted(tuple(r) for r in exact_topk(df, F.col("vec_id") % 50 == 0, scale=scale, query_block=3, chunk=70).collect())
    ints = [[math.floor(scale * x) for x in v] for v in vectors.tolist()]
    want = []
    for q in range(0, 300, 50):
        scores = sorted((-sum(a * b for a, b in zip(ints[q], ints[c])), c) for c in range(300) if c != q)[:5]
        want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores)]
    assert got == sorted(want)


def test_exact_topk_small(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in exact_topk(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert exact_topk(df.limit(0), F.col("vec_id") == 0).count() == 0
    mixed = [(0, [1.0, 2.0]), (1, [2.0]), (2, [1.0, 1.0]), (50, [3.0]), (2, [1.0, 3.0]), (50, [1.0, 1.0]), (2, [1.0, 3.0])]
    got = exact_topk(spark.createDataFrame(mixed, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    unit = 256 * 256
    assert sorted(map(tuple, got)) == [
        (0, 1, 2, 7 * unit), (0, 2, 2, 7 * unit), (0, 3, 2, 3 * unit), (0, 4, 50, 3 * unit),
        (50, 1, 1, 6 * unit), (50, 2, 2, 4 * unit), (50, 3, 2, 4 * unit), (50, 4, 0, 3 * unit), (50, 5, 2, 2 * unit),
    ]
    with pytest.raises(Exception, match="beyond a long"):
        exact_topk(df, F.col("vec_id") == 0, scale=1 << 40).collect()


def fewest_sequences(counts, window):
    """A proven lower bound: pieces over half a window never share one, and
    what the larger ones leave free must hold the small ones."""
    items, best = list(counts.elements()), 0
    for k in range(window // 2 + 1):
        alone = sum(x > window - k for x in items)
        large = [x for x in items if window - k >= x > window / 2]
        small = sum(x for x in items if window / 2 >= x >= k)
        best = max(best, alone + len(large) + max(0, -(-(small - (len(large) * window - sum(large))) // window)))
    return best


def test_packing(spark, docs, nothing):
    pieces = packing.token_pieces(docs, window=64, with_ids=True)
    rows = [r.asDict() for r in packing.pack(pieces, window=64, strand_rows=3).collect()]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.public_byte_bpe()[0])
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["id"]].append(r)
    for d, text in texts.items():
        ids = [*tok.encode(text, add_special_tokens=False).ids, 2]
        mine = sorted(by_doc[d], key=lambda r: r["piece"])
        assert [x for r in mine for x in r["ids"]] == ids and all(r["length"] == 64 for r in mine[1:])
        at = 0
        for n, r in enumerate(mine):
            assert (r["piece"], r["start"], r["length"]) == (n, at, len(r["ids"]))
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            at += r["length"]
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= fewest_sequences(Counter(r["length"] for r in rows), 64) + 2
    assert packing.pack(packing.token_pieces(nothing)).count() == 0
    odd = spark.createDataFrame([(1, "a <|endoftext|> b"), (1, "a <|endoftext|> b"), (None, None)], "doc_id long, text string")
    got = packing.pack(packing.token_pieces(odd, with_ids=True)).collect()
    assert sorted(len(r["ids"]) for r in got) == [1, 5, 5] and 50256 in got[0]["ids"] + got[1]["ids"] + got[2]["ids"]


def test_the_sum_index_finds_a_filler_whenever_there_is_one():
    rng = random.Random(9)
    for _ in range(200):
        counts = Counter(rng.randrange(1, 20) for _ in range(rng.randrange(1, 12)))
        index = packing.SumIndex(counts, 60)
        have = Counter(counts)
        for _ in range(12):
            gap = rng.randrange(1, 60)
            items = sorted(have.elements())
            sums = {k: any(sum(c) == gap for c in itertools.combinations(items, k)) for k in (1, 2, 3)}
            found = index.exact(gap)
            assert (found is None) == (not any(sums.values()))
            if found:
                assert sum(found) == gap and len(found) == min(k for k in sums if sums[k]) and not Counter(found) - have
                index.take(found)
                have -= Counter(found)


def test_packing_plan():
    rng = random.Random(5)
    for _ in range(30):
        counts = Counter(rng.randrange(1, 33) for _ in range(rng.randrange(1, 200)))
        plan = packing.plan_patterns(counts, 32)
        used = Counter()
        for parts, times in plan:
            assert sum(parts) <= 32
            for p in parts:
                used[p] += times
        assert used == counts
        assert sum(t for _, t in plan) <= fewest_sequences(counts, 32) + 1


def test_quality(spark, nothing):
    rng = random.Random(2)
    rows, labels = [], []
    for d in range(400):
        good = d % 3 > 0
        text = ". ".join(prose(rng, 8).capitalize() for _ in range(rng.randrange(2, 9))) if good else rng.choice([lambda: prose(rng, 40).upper() + "!!", lambda: "spam " * 50, lambda: prose(rng, 30).replace(" ", " | ")])()
        rows.append((d, text, "en", "s", "b", "x"))
        labels.append((d, int(good)))
    docs = spark.createDataFrame(rows, DOCS)
    table = spark.createDataFrame([*labels, (0, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit_quality(docs, table)
    scored = {r["doc_id"]: r for r in quality.score_quality(docs, model).collect()}
    held = [d for d in scored if scored[d]["held_out"]]
    assert all(scored[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d in scored)
    assert np.mean([scored[d]["predicted"] == dict(labels)[d] for d in held]) > 0.95 and len(held) > 40
    # labels of held-out rows change nothing
    flipped = spark.createDataFrame([(d, 1 - y if d in held else y) for d, y in labels], "doc_id long, quality int")
    again = quality.fit_quality(docs, flipped)
    assert np.array_equal(again.value, model.value) and np.array_equal(again.feature, model.feature)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d in scored if scored[d]["predicted"]}
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "é" * 100_000)], "doc_id long, text string")
    assert all(0 <= r["score"] <= 1 for r in quality.score_quality(odd, model).collect())
    blank = quality.fit_quality(nothing, table.limit(0))
    assert quality.score_quality(docs, blank).agg(F.max("score")).first()[0] == 0.5 and quality.score_quality(nothing, blank).count() == 0


def test_flat_trees_walk_like_a_plain_descent():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] < -0.5)).astype(float)
    m = quality.fit_trees(x, y, trees=20, depth=3)
    want = []
    for row in x:
        total = m.base
        for f, t, v in zip(m.feature, m.threshold, m.value):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + int(row[f[at]] > t[at])
            total += v[at - len(f)]
        want.append(1 / (1 + math.exp(-total)))
    assert np.allclose(m.score(x), want) and ((m.score(x) > 0.5) == y).mean() > 0.95


@pytest.mark.parametrize("part_bytes", [1, 900, 8 << 20])
def test_word_lm_scores(spark, docs, nothing, part_bytes):
    some = docs.where("doc_id < 90").unionAll(spark.createDataFrame([(None, "one two three", "", "", "", ""), (3, "two one", "", "", "", ""), (3, "two one", "", "", "", "")], DOCS))
    texts = [(r["doc_id"], r["text"]) for r in some.collect()]
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    pairs = lambda t: [*zip(["<"] + words(t), words(t) + [">"])] if words(t) else []
    is_target = lambda d: d is not None and d % 2 == 1
    symbols, mu = len({w for _, t in texts for _, w in pairs(t)}), 4.0

    def loss(chosen, p):
        both, word, before = Counter(), Counter(), Counter()
        for t in chosen:
            for a, b in pairs(t):
                both[a, b] += 1
                word[b] += 1
                before[a] += 1
        low = lambda b: (word[b] + mu / symbols) / (word.total() + mu)
        return np.mean([-math.log((both[x] + mu * low(x[1])) / (before[x[0]] + mu)) for x in p])

    want = []
    for k, (d, t) in enumerate(texts):
        others = texts[:k] + texts[k + 1 :]  # a text is not judged by a model that holds it
        p = pairs(t)
        a, c = (loss([x for i, x in others if i is not None and is_target(i)], p), loss([x for _, x in others], p)) if p else (None, None)
        want.append((d, len(p), a, c, c - a if p else None))
    ids = some.where("doc_id % 2 = 1").select("doc_id")
    got = [tuple(r) for r in lm_score.word_cross_entropy_difference(some, ids, part_bytes=part_bytes, bucket_bytes=2000).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert g[:2] == w[:2] and all(x is y is None or abs(x - y) < 1e-9 for x, y in zip(g[2:], w[2:]))
    if part_bytes > 900:
        assert lm_score.word_cross_entropy_difference(nothing, nothing).count() == 0
        text_ids = some.select(F.col("doc_id").cast("string"), "text")
        assert lm_score.word_cross_entropy_difference(text_ids, text_ids.limit(0)).schema["doc_id"].dataType.simpleString() == "string"


def test_the_lm_query_tells_word_order(spark, tmp_path):
    from milepost.llm.registry import op7_lm_scoring

    # the words' ends and starts are alike for three bytes, so only whole words tell the texts apart
    a, b = "aaaa1xxxx bbbb1xxxx cccc1xxxx " * 20, "aaaa1xxxx cccc1xxxx bbbb1xxxx " * 20
    spark.createDataFrame([(1, a), (2, a), (3, b), (4, b)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in op7_lm_scoring(spark, str(tmp_path)).collect()}
    assert got[1]["n_tokens"] == 61 and got[2]["score"] > got[3]["score"] + 0.5


def test_mixing(spark, nothing):
    rng = random.Random(4)
    rows = [(d, prose(rng, rng.randrange(5, 40)), "en", "big" if d % 3 else f"small{d % 4}", "b", "x") for d in range(1500)] + [(9000, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    size = {r[0]: max(1, len((r[1] or "").split())) for r in rows}
    source = {r[0]: r[3] or "" for r in rows}
    tokens = Counter()
    for d, n in size.items():
        tokens[source[d]] += n
    used = mixing.mix_sources(docs, max_repeats=1.5, budget=20_000.0, carry=["doc_id", "text"], block_docs=16).collect()
    spent, weight, uses = Counter(), {}, Counter()
    for r in used:
        s = source[r["doc_id"]]
        spent[s] += r["mix_tokens"]
        weight[s] = r["mix_weight"]
        uses[r["doc_id"], r["mix_epoch"]] += 1
    assert max(uses.values()) == 1
    for s, w in weight.items():
        assert abs(spent[s] - w * 20_000) <= 40 and w * 20_000 <= 1.5 * tokens[s] * 1.000001
    # the exponent is the same for all sources
    a = [math.log(weight[s] / weight["big"]) / math.log(tokens[s] / tokens["big"]) for s in weight if s != "big"]
    assert max(a) - min(a) < 1e-9
    once = mixing.mix_sources(docs, entropy_share=0.98).collect()
    ids = Counter(r["doc_id"] for r in once)
    assert max(ids.values()) == 1 and len(ids) < len(rows)
    w = {source[r["doc_id"]]: r["mix_weight"] for r in once}
    full = mixing.temperature_weights([float(tokens[s]) for s in sorted(tokens)], mixing.solve_exponent([tokens[s] for s in sorted(tokens)], 0.98, None, 1.0))
    assert abs(mixing.entropy(full) - 0.98 * math.log(len(tokens))) < 1e-6 and all(abs(w[s] - x) < 1e-9 for s, x in zip(sorted(tokens), full) if s in w)
    assert mixing.mix_sources(docs, entropy_share=0.0).count() == len(rows)
    assert mixing.mix_sources(nothing, entropy_share=0.9).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, max_repeats=1.0, budget=1e9).count()


@pytest.mark.parametrize("group_blocks", [3, 1024])
def test_the_drawn_rows_are_those_of_the_plan(spark, group_blocks):
    """Every use of every document by plain Python, but for Spark's hashes."""
    rng = random.Random(8)
    rows = [(d % 700, prose(rng, rng.randrange(0, 30)), "en", rng.choice(["big"] * 6 + ["mid"] * 3 + ["small", None]), "b", "x") for d in range(900)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    found = mixing.mix_sources(docs, entropy_gain=0.5, whole_corpus=True, block_docs=8, group_blocks=group_blocks).collect()
    got = Counter((r["doc_id"], r["text"], r["source"] or "", r["mix_epoch"], r["mix_block"], r["mix_start"]) for r in found)
    size = lambda t: max(1, len((t or "").split()))
    tokens, count = Counter(), Counter()
    for r in rows:
        tokens[r[3] or ""] += size(r[1])
        count[r[3] or ""] += 1
    names, total = sorted(tokens), sum(tokens.values())
    shares = [tokens[n] / total for n in names]
    exponent = mixing.solve_exponent([tokens[n] for n in names], None, None, total, 0.5)
    weights = dict(zip(names, mixing.temperature_weights(shares, exponent)))
    assert 0.01 < exponent < 0.99
    half = (mixing.entropy(shares) + math.log(len(names))) / 2
    assert abs(mixing.entropy(list(weights.values())) - half) < 1e-9
    keyed = docs.select("doc_id", "text", "source", F.regexp_count("text", F.lit(r"[^\x20]+")).alias("n"))
    keyed = keyed.withColumn("n", F.greatest("n", F.lit(1)).cast("long"))
    keyed = keyed.select("*", F.xxhash64("doc_id", "n", F.lit(17)).alias("k"), F.xxhash64("doc_id", F.lit(18)).alias("o")).collect()
    top = max(-(-c // 8) for c in count.values())
    hashes = spark.range(top).select(F.col("id").cast("int").alias("i"), *[F.xxhash64(F.col("id").cast("int"), F.lit(e).cast("long"), F.lit(17)).alias(f"e{e}") for e in range(9)]).collect()
    order = {(r["i"], e): r[f"e{e}"] for r in hashes for e in range(9)}
    want = Counter()
    for name in names:
        blocks = -(-count[name] // 8)
        groups = -(-blocks // group_blocks)
        mine = defaultdict(list)
        for r in keyed:
            if (r["source"] or "") == name:
                mine[r["k"] % blocks].append(r)
        budget, epoch = weights[name] * total, 0
        while budget > 0:
            stop, at, rank = min(budget, tokens[name]), 0, 0
            present = sorted({b % groups for b in mine}, key=lambda g: (order[g, epoch], g))
            for g in present:
                for b in sorted((b for b in mine if b % groups == g), key=lambda b: (order[b, epoch], b)):
                    for r in sorted(mine[b], key=lambda r: (r["o"], r["doc_id"], r["n"])):
                        if at + r["n"] / 2 <= stop:
                            want[r["doc_id"], r["text"], name, epoch, rank, at] += 1
                        at += r["n"]
                    rank += 1
            budget, epoch = budget - tokens[name], epoch + 1
    assert got == want and want.total() > 800 and max(k[3] for k in want) >= 1


def test_license_scan(spark, nothing):
    rng = random.Random(6)
    names = list(ls.TEMPLATES)
    rows, texts = [], {}
    for d in range(120):
        body = prose(rng, rng.randrange(5, 200)).split()
        if d % 2:
            words = ls.TEMPLATES[names[d // 2 % len(names)]].split()
            if d % 5 == 0 and len(words) > 30:
                words[rng.randrange(len(words))] = "other"
            body[len(body) // 2 : len(body) // 2] = words
        texts[d] = " ".join(body).upper() if d % 7 == 0 else " ".join(body)
        rows.append((d, texts[d], "en", "s", "b", "x"))
    rows += [(500, None, None, None, None, None), (501, "license", "en", "s", "b", "x")]
    got = {(r["doc_id"], r["license"]): (r["containment"], r["first_word"]) for r in ls.license_scan(spark.createDataFrame(rows, DOCS)).collect()}
    want = {}
    for c in ls.template_classes(ls.TEMPLATES):
        for d, text in texts.items():
            w = ls.template_words(text)
            grams = [" ".join(w[k : k + 5]) for k in range(len(w) - 4)]
            for t in c["templates"]:
                for at in range(0, max(len(grams), 1), c["stride"]):
                    held = len({*grams[at : at + c["size"]]} & {*t["shingles"]}) / len(t["shingles"])
                    if held * 100 >= 75 and held > want.get((d, t["name"]), (0, 0))[0]:
                        want[d, t["name"]] = (held, at)
    assert got == want and len(want) >= 60
    # by every window start: whatever holds enough of a template in as many shingles is found
    for d, text in texts.items():
        w = ls.template_words(text)
        grams = [" ".join(w[k : k + 5]) for k in range(len(w) - 4)]
        for name, template in ls.TEMPLATES.items():
            t = {*ls._shingles(ls.template_words(template))}
            if {*grams} & t and any(100 * len({*grams[k : k + len(t)]} & t) >= 75 * len(t) for k in range(len(grams))):
                assert (d, name) in got
    planted = {(d, names[d // 2 % len(names)]) for d in range(1, 120, 2)}
    assert len({n for _, n in got}) == len(names) and len(planted & {*got}) >= 0.95 * len(planted)
    twice = spark.createDataFrame([*rows[:20], *rows[:20], (None, " ".join(["filler"] * 40_000) + " " + ls.TEMPLATES["Zlib"], "", "", "", "")], DOCS)
    again = {(r["doc_id"], r["license"]): r["n_windows"] for r in ls.license_scan(twice).collect()}
    assert {k for k in again if k[0] is not None} == {k for k in got if k[0] < 20} and (None, "Zlib") in again
    assert ls.license_scan(spark.createDataFrame(rows[-2:], DOCS)).count() == ls.license_scan(nothing).count() == 0
    with pytest.raises(ValueError):
        ls.template_classes({"x": "too short"})
    sets = {n: ls._shingles(ls.template_words(t)) for n, t in ls.TEMPLATES.items()}
    keys = ls.key_words(sets, 75)
    assert all(sum(any(k in s.split() for k in keys) for s in x) * 100 > 25 * len(x) for x in sets.values())


def test_warc_of_rows_that_come_in_another_order_each_time(spark):
    def mixed(batches):
        import random

        import pyarrow as pa

        for batch in batches:
            rows = batch.to_pylist()
            random.SystemRandom().shuffle(rows)
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    pages = spark.createDataFrame([(n % 40, "u", "same" if n % 2 else f"other {n}") for n in range(60)], "page_id long, url string, html string").coalesce(1)
    got = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.warc_round_trip(pages.mapInArrow(mixed, pages.schema)).collect())
    same = sorted(n % 40 for n in range(60) if n % 2)
    want = Counter((n % 40, "response", None) for n in range(60) if not n % 2) + Counter([(same[0], "response", None)]) + Counter((n, "revisit", same[0]) for n in same[1:])
    assert got == want


def test_warc(spark, tmp_path):
    long = "ü" * 50_000 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"
    rows = [(3, "http://a", "same"), (1, "http://b\r\nX: y", "same"), (7, None, "same"), (2, "u", long), (9, "u", long), (4, "u", None), (5, "u", ""), (1, "u", "same"), (None, "u", "alone")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    got = Counter(tuple(r)[:5] for r in warc.warc_round_trip(pages).collect())
    digest = lambda t: warc.base32_sha1(t.encode())
    same, n = digest("same"), len(long.encode())
    assert got == Counter([(1, 4, same, "response", None), (1, 4, same, "revisit", 1), (3, 4, same, "revisit", 1), (7, 4, same, "revisit", 1),
        (2, n, digest(long), "response", None), (9, n, digest(long), "revisit", 2), (4, 0, digest(""), "response", None), (5, 0, digest(""), "revisit", 4), (None, 5, digest("alone"), "response", None)])
    assert warc.warc_round_trip(pages.limit(0)).count() == 0
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages, path, segment_bytes=1000, chunk_bytes=77)
    records = warc.read_records(spark, path)
    assert records.where("kind = 'continuation'").count() > 90
    back = {r["record_id"]: bytes(r["payload"]) for r in warc.read_warc(spark, path, with_payload=True).where("kind = 'response'").collect()}
    assert sorted(back.values()) == sorted(t.encode() for t in ("same", long, "", "alone"))
    with pytest.raises(Exception, match="segments missing"):
        warc.reassemble(records.where("segment IS NULL OR segment <> 3")).collect()
    import gzip

    record = b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n"
    for data in (record * 3, gzip.compress(record * 3), b"".join(gzip.compress(record) for _ in range(3))):
        for step in (1, 7, 1 << 18):
            assert [b for _, b in warc.parse_records(warc.unzipped(data, step))] == [b"ab\r\nc"] * 3
    for bad in (record[:-1], record + b"x", gzip.compress(record)[:-9]):
        with pytest.raises(ValueError):
            list(warc.parse_records(warc.unzipped(bad)))
    assert warc.dechunk(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"3\r\nab", b"zz\r\n", b"5\r\nabcdefg\r\n"):
        with pytest.raises(ValueError):
            warc.dechunk(bad)
