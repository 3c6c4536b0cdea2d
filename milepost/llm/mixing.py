"""Mixing sources to target weights, by temperature.

Each source's token share is raised to one exponent and normalised: 1 keeps
the corpus, 0 makes the sources equal.  The exponent is bisected to meet a
target entropy (a fraction of the highest one, or a part of the way from the
corpus's own to the highest) or a limit on how often a source's tokens repeat.
The weights are then realised within a token budget: a source's documents are
dealt into blocks by hash and the blocks into groups, each epoch goes through
the groups, and through the blocks of each, in its own order, and the last,
partial epoch stops where the source's budget ends.  The result is every use of
every document: its epoch and its place in the epoch's order.

With ``min_kept`` every document is used at most once, sources smaller than
their part of the budget stay whole, and at least that share of the corpus's
tokens stays (within half a document a source), whatever its sources are: so
the mix is only as even as that allows.

Only per-source totals reach the driver (``max_sources`` of them at most, or
ValueError); a document's place needs only its block's documents, the totals of
its group's blocks and those of its source's groups.  So a source that holds a
third of all rows is spread over as many tasks as it has blocks, and the longest
list that one task puts in order has a row for ``block_docs * group_blocks``
documents of a source.

Defined results: a null source is the source ''; a null or empty text counts
``min_tokens`` tokens, as does every text of fewer; rows that repeat an id are
documents each; rows with a null id are mixed like others; ties in the order
are broken by id and token count, and rows equal in both are alike; an empty
table gives no rows; other columns are carried along.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def temperature_weights(shares: list[float], exponent: float) -> list[float]:
    # relative to the largest share, so that no power vanishes
    top = max(shares)
    raised = [(s / top) ** exponent for s in shares]
    return [r / sum(raised) for r in raised]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def target_entropy(shares: list[float], entropy_share: float | None, entropy_gain: float | None) -> float:
    """A part of the highest entropy; or the corpus's own and a part of what it
    lacks."""
    highest = math.log(len(shares))
    if entropy_gain is None:
        return entropy_share * highest
    own = entropy(shares)
    return own + entropy_gain * (highest - own)


def solve_exponent(tokens: list[int], entropy_share: float | None, max_repeats: float | None, budget: float, entropy_gain: float | None = None) -> float:
    """The largest exponent in [0, 1] whose entropy reaches the target, or the
    smallest whose repetition stays within the limit (both fall as it grows)."""
    total = sum(tokens)
    shares = [t / total for t in tokens]
    low, high = 0.0, 1.0
    if entropy_share is not None or entropy_gain is not None:
        target = target_entropy(shares, entropy_share, entropy_gain)
        enough = lambda a: entropy(temperature_weights(shares, a)) >= target
        if enough(1.0):
            return 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if enough(mid) else (low, mid)
        return low
    if max_repeats is None:
        raise ValueError("give entropy_share, entropy_gain or max_repeats")
    within = lambda a: max(w * budget / t for w, t in zip(temperature_weights(shares, a), tokens)) <= max_repeats
    if within(0.0):
        return 0.0
    if not within(1.0):
        raise ValueError(f"a budget of {budget:.0f} tokens repeats the corpus more than {max_repeats} times")
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if within(mid) else (mid, high)
    return high


def token_count(text: Column, min_tokens: int) -> Column:
    """Words, as a stand-in for tokens that needs no tokenizer."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(min_tokens)).cast("long")


def keeping_budget(tokens: list[int], weights: list[float], min_kept: float) -> float:
    """The corpus's tokens, or more where sources smaller than their part would
    leave less than ``min_kept`` of the corpus: the least budget that keeps it."""
    total = float(sum(tokens))
    kept, open_weight = 0.0, 1.0
    # as the budget grows, sources are used up in the order of tokens per weight
    for full, t, w in sorted((t / w, t, w) for t, w in zip(tokens, weights)):
        if kept + open_weight * full >= min_kept * total:
            return max(total, (min_kept * total - kept) / open_weight)
        kept, open_weight = kept + t, open_weight - w
    return max(total, full)


def source_plan(
    totals: dict[str, tuple[int, int]], entropy_share: float | None, max_repeats: float | None, budget: float | None, block_docs: int, min_kept: float | None = None,
    entropy_gain: float | None = None,
) -> list[dict]:
    """Per source: weight, token budget, number of blocks.

    ``totals``: source -> (tokens, documents).  Without a budget it is the
    largest that repeats no source more than ``max_repeats`` (or once).  With
    ``min_kept`` no source repeats: one smaller than its part stays whole.
    """
    names = sorted(totals)
    tokens = [totals[n][0] for n in names]
    spend = budget if budget is not None else float(sum(tokens))
    weights = temperature_weights([float(t) for t in tokens], solve_exponent(tokens, entropy_share, max_repeats, spend, entropy_gain))
    if min_kept is not None:
        if budget is not None or max_repeats is not None:
            raise ValueError("min_kept goes with neither budget nor max_repeats")
        spend = keeping_budget(tokens, weights, min_kept)
    elif budget is None:
        spend = min((max_repeats or 1.0) * t / w for t, w in zip(tokens, weights))
    return [
        {"source": n, "weight": w, "source_budget": w * spend if min_kept is None else min(w * spend, float(t)), "source_tokens": t, "blocks": -(-totals[n][1] // block_docs)}
        for n, w, t in zip(names, weights, tokens)
    ]


def mix_sources(
    docs: DataFrame, entropy_share: float | None = None, max_repeats: float | None = None, budget: float | None = None, id_col: str = "doc_id",
    source_col: str = "source", text_col: str = "text", seed: int = 17, min_tokens: int = 1, block_docs: int = 128, max_sources: int = 100_000, carry: list[str] | None = None,
    min_kept: float | None = None, entropy_gain: float | None = None, whole_corpus: bool = False, group_blocks: int = 1024,
) -> DataFrame:
    """One row per use of a document: the carried columns (all of ``docs`` by
    default), mix_tokens, mix_weight (its source's), mix_epoch, mix_block (rank
    of its block in the epoch) and mix_start (its first token's place).
    ``whole_corpus``: the budget is the corpus's tokens."""
    names = docs.columns if carry is None else carry
    source = F.coalesce(F.col(source_col), F.lit(""))
    fields = [F.col(f"`{c}`") for c in names]
    rows = docs.select(F.struct(*fields).alias("__row"), F.col(id_col).alias("__id"), source.alias("source"), token_count(F.col(text_col), min_tokens).alias("tokens"))
    per_source = rows.groupBy("source").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).limit(max_sources + 1).collect()
    if len(per_source) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    if whole_corpus:
        budget = float(sum(r.t for r in per_source))
    shape = "array<struct<source:string,weight:double,source_budget:double,source_tokens:long,blocks:int>>"
    made = source_plan({r.source: (r.t, r.n) for r in per_source}, entropy_share, max_repeats, budget, block_docs, min_kept, entropy_gain) if per_source else []
    plan = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(made)), shape)))

    dealt = rows.join(F.broadcast(plan), "source")
    key = F.xxhash64(F.col("__id"), F.col("tokens"), F.lit(seed))
    dealt = dealt.withColumn("block", F.pmod(key, F.col("blocks")).cast("int"))
    group = F.pmod(F.col("block"), F.ceil(F.col("blocks") / group_blocks).cast("int"))
    dealt = dealt.withColumn("group", group)
    totals = dealt.groupBy("source", "group", "block").agg(F.sum("tokens").alias("block_tokens"), F.first("source_budget").alias("b"), F.first("source_tokens").alias("t"))
    last = F.floor(F.col("b") / F.col("t"))
    shuffled = lambda keys, place: Window.partitionBy("source", "epoch", *keys).orderBy(F.xxhash64(place, "epoch", F.lit(seed)), place)
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    groups = totals.groupBy("source", "group").agg(F.sum("block_tokens").alias("group_tokens"), F.count(F.lit(1)).alias("n"), F.first("b").alias("b"), F.first("t").alias("t"))
    groups = groups.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    stop = F.when(F.col("epoch") == last, F.col("b") - last * F.col("t")).otherwise(F.col("t").cast("double"))
    over = shuffled([], "group")
    groups = groups.select("source", "group", "epoch", before("group_tokens", over).alias("group_start"), before("n", over).alias("group_rank"), stop.alias("stop"))
    inner = shuffled(["group"], "block")
    placed = totals.drop("b", "t").join(groups, ["source", "group"]).select(
        "source", "block", "epoch", "stop", (F.col("group_rank") + F.row_number().over(inner) - 1).cast("int").alias("block_rank"),
        (F.col("group_start") + before("block_tokens", inner)).alias("block_start"),
    )
    inside = Window.partitionBy("source", "block").orderBy(F.xxhash64("__id", F.lit(seed + 1)), "__id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("inner", F.coalesce(F.sum("tokens").over(inside), F.lit(0).cast("long")))
    start = F.col("block_start") + F.col("inner")
    # a document is in if its middle is: each budget is met within half a document
    used = dealt.join(placed, ["source", "block"]).where(start + F.col("tokens") / 2 <= F.col("stop"))
    return used.select(
        *[F.col(f"__row.`{c}`").alias(c) for c in names], F.col("tokens").alias("mix_tokens"), F.col("weight").alias("mix_weight"),
        F.col("epoch").alias("mix_epoch"), F.col("block_rank").alias("mix_block"), start.alias("mix_start"),
    )
