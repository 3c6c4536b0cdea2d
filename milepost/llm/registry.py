"""Queries of this subpackage over the shared tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_dedup
from .filter_audit import filter_audit
from .jaccard import jaccard_join
from .lexical_search import build_index, search
from .license_scan import license_scan
from .lm_score import word_cross_entropy_difference
from .mixing import mix_sources
from .packing import pack, token_pieces
from .quality import fit_quality, score_quality
from .quantised_knn import nearest_neighbours
from .substring_dedup import substring_dedup
from .topk import exact_topk
from .warc import warc_round_trip


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_topk(vectors, F.col("vec_id") % 50 == 0, k=5, scale=256)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), length=100)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(token_pieces(docs, window=1024, end_id=2), window=1024).withColumnRenamed("id", "doc_id")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("bucket")


OP5_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tokens as the corpus has, half the way from its own entropy to an
    even mix: small sources repeat, large ones are cut."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs, entropy_gain=0.5, whole_corpus=True, carry=["doc_id", "source"])


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled good and not toxic; background: all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 AND toxic = 0").select("doc_id")
    scored = word_cross_entropy_difference(docs, good)
    return scored.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0),
f AS (SELECT r, d.doc_id, w, CAST(g.doc_id IS NOT NULL AS INTEGER) AS good FROM d LEFT JOIN g ON g.doc_id = d.doc_id),
p AS (SELECT r, good, unnest(list_concat([' start'], w)) AS c, unnest(list_concat(w, [' end'])) AS w FROM f WHERE len(w) > 0),
n AS (SELECT r, good, c, w, count(*) AS k FROM p GROUP BY ALL),
pc AS (SELECT c, w, sum(k) AS b, sum(k * good) AS t FROM n GROUP BY ALL),
wc AS (SELECT w, sum(k) AS b, sum(k * good) AS t FROM n GROUP BY ALL),
cc AS (SELECT c, sum(k) AS b, sum(k * good) AS t FROM n GROUP BY ALL),
ow AS (SELECT r, w, sum(k) AS k FROM n GROUP BY ALL),
oc AS (SELECT r, c, sum(k) AS k FROM n GROUP BY ALL),
le AS (SELECT r, sum(k) AS k FROM n GROUP BY ALL),
a AS (SELECT count(*) AS v, sum(b) AS b, sum(t) AS t FROM wc),
l AS (SELECT n.r, n.k,
  -ln((pc.b - n.k + 4.0::DOUBLE * ((wc.b - ow.k + 4.0::DOUBLE / a.v) / (a.b - le.k + 4.0::DOUBLE))) / (cc.b - oc.k + 4.0::DOUBLE)) AS lb,
  -ln((pc.t - n.k * good + 4.0::DOUBLE * ((wc.t - ow.k * good + 4.0::DOUBLE / a.v) / (a.t - le.k * good + 4.0::DOUBLE))) / (cc.t - oc.k * good + 4.0::DOUBLE)) AS lt
  FROM n JOIN pc ON pc.c = n.c AND pc.w = n.w JOIN wc ON wc.w = n.w JOIN cc ON cc.c = n.c JOIN ow ON ow.r = n.r AND ow.w = n.w
  JOIN oc ON oc.r = n.r AND oc.c = n.c JOIN le ON le.r = n.r, a),
s AS (SELECT r, CAST(sum(k) AS BIGINT) AS n, sum(k * lt) / sum(k) AS t, sum(k * lb) / sum(k) AS b FROM l GROUP BY r)
SELECT d.doc_id, coalesce(s.n, 0) AS n_tokens, round(s.t, 6) AS target_loss, round(s.b, 6) AS background_loss, round(s.b - s.t, 6) AS score
FROM d LEFT JOIN s ON s.r = d.r
"""


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=5, percent=75)


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o.c >= 75 * (x.n + y.n - o.c)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
SELECT n.doc_id, n.n AS n_shingles, (SELECT min(root) FROM r WHERE r.doc_id = n.doc_id) AS component_id FROM n
"""


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP9_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, url, h, lower(sha1(h)) AS x, strlen(h) AS payload_bytes, min(page_id) OVER (PARTITION BY h) AS head FROM p),
b AS (SELECT *, list_reduce(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', substr(x, i, 1))]), lambda a, c: a || c) AS bits FROM s)
SELECT page_id, payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda j: CAST(substr(bits, 5 * i + j + 1, 1) AS INTEGER) * CAST(pow(2, 4 - j) AS INTEGER)))::INTEGER, 1)), lambda a, c: a || c) AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = head THEN NULL ELSE head END AS refers_to, coalesce(url, '') AS url
FROM b
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), threshold=0.3)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT t, min(doc_id) AS head FROM d GROUP BY t),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
x AS (SELECT part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
  100 * len(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 2 * length(d.t), regexp_matches(d.t, '[#$%&*|]'), coalesce(d.doc_id > head, false)] AS f
  FROM d JOIN h ON h.t = d.t LEFT JOIN l ON l.doc_id = d.doc_id),
s AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || e.c || f.c AS filter_order FROM s a, s b, s c, s e, s f WHERE len(list_distinct([a.c, b.c, c.c, e.c, f.c])) = 5),
g AS (SELECT part, filter_order, f, good, toxic, list_position(list_transform(range(1, 6), lambda i: f[ascii(substr(filter_order, CAST(i AS INTEGER), 1)) - 64]), true) AS gone FROM x, o),
k AS (SELECT g.part, g.filter_order, CAST(i AS INTEGER) AS step, ascii(substr(g.filter_order, CAST(i AS INTEGER), 1)) - 64 AS n,
  count_if(gone IS NULL OR gone > i) AS kept, count_if(gone = i) AS removed, count_if(f[ascii(substr(g.filter_order, CAST(i AS INTEGER), 1)) - 64] AND gone < i) AS redundant,
  count_if(f[ascii(substr(g.filter_order, CAST(i AS INTEGER), 1)) - 64] AND len(list_filter(f, lambda y: y)) = 1) AS unique_fails,
  count_if(gone = i AND good = 1) AS good_lost, count_if(gone = i AND toxic = 1) AS toxic_lost
  FROM g, range(1, 6) r(i) GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, n) AS BIGINT) AS shapley FROM k
"""


def op12_quantised_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]), lambda a, b: a + b) AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op13_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=20)


OP13_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
d AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, w FROM t WHERE len(w) > 0),
c AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM d),
p AS (SELECT r, w, count(*) AS tf FROM (SELECT r, unnest(w) AS w FROM d) GROUP BY ALL),
f AS (SELECT w, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS weight FROM (SELECT w, count(*) AS df FROM p GROUP BY w), c),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS w FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT item_id, d.doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll)))) AS BIGINT) AS score
  FROM q JOIN f ON f.w = q.w JOIN p ON p.w = q.w JOIN d ON d.r = p.r, c WHERE d.doc_id IS NOT NULL GROUP BY item_id, d.r, d.doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_topk": op1_exact_topk,
        "op2_license_scan": op2_license_scan,
        "op3_suffix_array_dedup": op3_suffix_array_dedup,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_source_mixing": op6_source_mixing,
        "op7_lm_scoring": op7_lm_scoring,
        "op8_ngram_jaccard": op8_ngram_jaccard,
        "op9_warc": op9_warc,
        "op10_quality": op10_quality,
        "op11_filter_audit": op11_filter_audit,
        "op12_quantised_knn": op12_quantised_knn,
        "op13_block_max_wand": op13_block_max_wand,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_topk": OP1_SQL, "op5_exact_dedup": OP5_SQL, "op7_lm_scoring": OP7_SQL, "op8_ngram_jaccard": OP8_SQL, "op9_warc": OP9_SQL} | {
        "op11_filter_audit": OP11_SQL, "op12_quantised_knn": OP12_SQL, "op13_block_max_wand": OP13_SQL,
    }
