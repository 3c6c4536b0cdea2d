"""The pipeline's stages, each against a brute-force version of its own input."""

import random
from collections import Counter

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from milepost.llm import mixing
from milepost.llm.shared import shared_table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from .test_llm import brute_jaccard

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    made = {}
    for name, stage in cp.STAGES:
        before = docs
        docs = shared_table(stage(spark, docs, SF), name)
        made[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns and docs.join(before, "doc_id", "left_anti").count() == 0
    ids = lambda df: [r[0] for r in df.select("doc_id").collect()]
    before, after = made["quality_classifier"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = before.join(labels, "doc_id").join(after.select("doc_id", F.lit(1).alias("kept")), "doc_id", "left")
    right = judged.agg(F.avg((F.coalesce("kept", F.lit(0)) == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.95
    before, after = made["exact_dedup"]
    best = {}
    for r in before.collect():
        best[r["text"] or ""] = max(best.get(r["text"] or "", -1), r["doc_id"])
    assert sorted(ids(after)) == sorted(best.values())
    before, after = made["near_dedup"]
    want = brute_jaccard([(r["doc_id"], r["text"]) for r in before.collect()])
    assert sorted(ids(after)) == sorted({v[1] for v in want.values()})
    before, after = made["mixing"]
    assert len(set(ids(after))) == after.count() >= 0.85 * before.count()
    # the mix is flatter than its input, which costs rows of large sources
    tokens = lambda df: [float(r[1]) for r in df.groupBy("source").agg(F.sum(mixing.token_count(F.col("text"), 1))).collect()]
    shares = lambda t: [x / sum(t) for x in t]
    assert after.count() < before.count() and mixing.entropy(shares(tokens(after))) > mixing.entropy(shares(tokens(before)))
    assert 0 < mixing.solve_exponent(tokens(before), None, None, sum(tokens(before)), cp.ENTROPY_GAIN) < 1
    before, after = made["packing"]
    assert {*ids(after)} == {*ids(before)}
    per = after.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert per.where("n > 1024 OR n <> end").count() == 0
    assert per.count() <= 1.05 * after.agg(F.sum("length")).first()[0] / 1024 + 1


def test_run_equals_the_stages(spark):
    out = cp.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 100


def test_the_mix_does_not_hang_on_the_smallest_source(spark):
    docs = [(d, "a b c d e f g h i j", "hot" if d % 3 == 0 else f"s{d % 20}") for d in range(3000)]
    rows = spark.createDataFrame([*docs, (9000, "one document", "rare"), (9001, None, None)], "doc_id long, text string, source string")
    after = cp.mixing(spark, rows, SF)
    kept = {r["doc_id"] for r in after.collect()}
    assert len(kept) == after.count() >= 0.899 * 3000 and {9000, 9001} <= kept
    hot = {d for d, _, s in docs if s == "hot"}
    assert {d for d, _, _ in docs} - hot <= kept and len(hot & kept) < len(hot)
    # a lone source beside one word, and big sources beside many of one word
    for totals in ({"a": (10**9, 10**6), "b": (1, 1)}, {f"b{k}": (10**9, 10**6) for k in range(5)} | {f"r{k}": (1, 1) for k in range(1000)}):
        plan = mixing.source_plan(totals, None, None, None, 128, cp.MIN_KEPT, cp.ENTROPY_GAIN)
        assert sum(p["source_budget"] for p in plan) >= 0.8999 * sum(t for t, _ in totals.values())
        assert all(p["source_budget"] == p["source_tokens"] for p in plan if p["source_tokens"] == 1)


ODD = "doc_id long, text string, lang string, source string, n_chars long, row string, h long, id string, bucket int, class string"


def odd_rows():
    rng = random.Random(3)
    word = lambda: rng.choice(["kabel", "lofin", "migas", "nudor", "rehul"]) + str(rng.randrange(30))
    long = " ".join(word() for _ in range(40))
    texts = [
        (1, long), (1, long), (2, long), (None, long + " end"), (2, " ".join(word() for _ in range(30))), (2, None), (None, None), (3, ""), (4, "   "),
        (5, "one two"), (5, "two one"), (6, " ".join(word() for _ in range(60_000))), (None, "alone here now and then"), (7, "x"), (7, "x"),
    ]
    return [(d, t, "en", None if k % 4 == 0 else "s", None, "r", 1, "i", 2, "c") for k, (d, t) in enumerate(texts)]


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_rows(spark, empty):
    from .test_llm import brute_jaccard

    docs = spark.createDataFrame([] if empty else odd_rows(), ODD).repartition(3)
    rows = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    plain = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    kept = cp.quality_classifier(spark, docs, SF)
    assert kept.columns == docs.columns and not plain(kept) - rows
    kept = cp.exact_dedup(spark, docs, SF)
    best = {}
    for d, t in rows:
        best[t or ""] = max(best.get(t or "", (False, 0)), (d is not None, d or 0))
    assert kept.columns == docs.columns and Counter(((d is not None, d or 0), t or "") for d, t in plain(kept).elements()) == Counter((b, t) for t, b in best.items())
    kept = cp.near_dedup(spark, docs, SF)
    listed = [*rows.elements()]
    group = brute_jaccard([(k, t) for k, (_, t) in enumerate(listed)])
    least = {}
    for k, (d, t) in enumerate(listed):
        g = group[k][1]
        least[g] = min(least.get(g, (True, 1 << 60)), (d is None, d or 0))
    assert kept.columns == docs.columns and Counter((d is None, d or 0) for d, _ in plain(kept).elements()) == Counter(least.values())
    kept = cp.mixing(spark, docs, SF)
    assert kept.columns == docs.columns and not plain(kept) - rows and (empty or plain(kept).total() > 0)
    packed = cp.packing(spark, docs, SF)
    assert packed.where("piece = 0").count() == rows.total()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_without_labels_every_document_stays(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(odd_rows(), ODD)
    assert cp.quality_classifier(spark, docs, str(tmp_path)).count() == len(odd_rows())
