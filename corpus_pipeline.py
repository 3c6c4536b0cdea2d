"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; its result is written as Parquet and read again as the next
one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from milepost.llm.exact_dedup import exact_survivors
from milepost.llm.jaccard import jaccard_join
from milepost.llm.mixing import mix_sources
from milepost.llm.packing import pack, token_pieces
from milepost.llm.quality import fit_quality, keep_good
from milepost.llm.shared import shared_table

#: How far the mix's entropy goes from the corpus's own to the highest one.
ENTROPY_GAIN = 0.5
#: The mix keeps this share of the words at least, whatever its sources are.
MIN_KEPT = 0.9


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.3) go.

    Defined results: a null text is scored as an empty one, a null id is scored
    and never learnt from, rows that repeat an id are judged each by its text;
    without labels every score is 0.5 and all rows stay; an empty table stays
    empty; other columns are carried.
    """
    return keep_good(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays.

    Defined results: a null text equals an empty one; a null id ranks lowest; of
    rows equal in id and text one stays; an empty table stays empty; other
    columns are carried.
    """
    return exact_survivors(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by shingle similarity the smallest doc_id stays (a
    null one ranks last, ties go to one row); rows are told apart by a key of
    this stage's own.

    Defined results: null and repeated ids are rows like others; a null text or
    one without words is linked with nothing and stays; an empty table stays
    empty; other columns are carried, but for one named ``__key``, which raises
    ValueError.
    """
    if "__key" in docs.columns:
        raise ValueError("a column named __key")
    keyed = shared_table(docs.withColumn("__key", F.monotonically_increasing_id()), "keyed", codec="zstd")
    found = jaccard_join(keyed, id_col="__key").select("__key", F.col("component_id").alias("__group"))
    # only rows of groups of several matter; most groups are one row
    several = found.where("__group <> __key").select("__group").distinct()
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "__key")
    members = found.join(several, "__group").join(keyed.select("__key", "doc_id"), "__key")
    best = members.groupBy("__group").agg(F.min(rank)["__key"].alias("best"))
    gone = members.join(best, "__group").where("__key <> best").select("__key")
    return keyed.join(gone, "__key", "left_anti").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to a flatter mix, every document at most once: sources
    below their part of the corpus stay whole, larger ones are cut to theirs, by
    a tenth of all words at most, so a rare source costs the others no more.

    Defined results: a null source is a source of its own (with the empty one);
    a null or empty text counts one word; null and repeated ids are rows like
    others; an empty table stays empty; other columns are carried.
    """
    return mix_sources(docs, entropy_gain=ENTROPY_GAIN, min_kept=MIN_KEPT).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of at most 1024 tokens.

    Defined results: a null or empty text is the lone end token; null and
    repeated ids are packed like others; an empty table gives no rows; other
    columns are ignored.
    """
    return pack(token_pieces(docs)).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can't express the trees or the tokenizer: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), f"stage-{name}", codec="zstd")
    return STAGES[-1][1](spark, docs, sf_dir)
