"""Registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import (
    centroids, decontaminate, exact_dedup, hard_negatives, html_text, langid, mixing, pii, secrets, simhash, substring_dedup, suffix_dedup,
    warc,
)

#: Key of the registered surrogate query; real runs pass their own.
SURROGATE_KEY = b"registered query"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_to_weights(_table(spark, sf_dir, "documents"))


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(_table(spark, sf_dir, "pages"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_personal_data(_table(spark, sf_dir, "documents"), SURROGATE_KEY)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op5_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(secrets.scan_secrets(_table(spark, sf_dir, "documents")))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeated_bytes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_benchmark_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeated_words(_table(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "n_units AS n_words", "n_removed", "kept_sha256")


def op9_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_of(_table(spark, sf_dir, "documents"))


def op10_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.expr("vec_id % 7 = 0"), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", shifted))


def op12_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def op13_centroid_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(_table(spark, sf_dir, "embeddings"))


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
caps AS (SELECT *, CAST(source_size AS DOUBLE) * 2 AS cap,
                CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w FROM sources),
steps AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
                 sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w,
                 CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) AS total FROM caps),
level AS (SELECT arg_min((total - used) / left_w, cap / w) FILTER ((total - used) / left_w <= cap / w) AS level FROM steps),
targets AS (SELECT source, source_size, coalesce(least(cap, level * w), cap) AS target FROM steps, level),
parts AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM targets),
rests AS (SELECT *, target - epochs * source_size AS rest FROM parts),
by_hash AS (SELECT source, h, sum(size) AS words FROM sized GROUP BY source, h),
running AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM by_hash),
extra AS (SELECT r.source, r.h, r.upto <= t.rest OR (r.upto - r.words < t.rest AND r.upto - t.rest < t.rest - (r.upto - r.words)) AS more
          FROM running r JOIN rests t ON r.source IS NOT DISTINCT FROM t.source)
SELECT s.doc_id, s.size, t.source_size, t.target,
       CAST(s.size * (t.epochs + CASE WHEN e.more THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN rests t ON s.source IS NOT DISTINCT FROM t.source
JOIN extra e ON s.source IS NOT DISTINCT FROM e.source AND s.h = e.h
"""

OP4_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
at_item AS (SELECT item_id, w, unnest(range(0, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1:i + 10], ' ') AS phrase FROM at_item),
sizes AS (SELECT DISTINCT n FROM windows),
at_doc AS (SELECT r, n, w, unnest(range(0, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT a.r, a.i, a.n, v.item_id
         FROM (SELECT r, i, n, array_to_string(w[i + 1:i + n], ' ') AS phrase FROM at_doc) a
         JOIN windows v ON a.phrase = v.phrase AND a.n = v.n),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
          FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""

OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
           FROM documents),
starts AS (SELECT r, w, unnest(range(0, len(w) - 34)) AS i FROM d WHERE len(w) >= 35),
windows AS (SELECT r, i, array_to_string(w[i + 1:i + 35], ' ') AS phrase FROM starts),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY phrase) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM again),
words AS (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS left_text, count(*) AS n FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(left_text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


OP11_SQL = """
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id,
    CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, embedding FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS MATERIALIZED (SELECT r, i, CAST(floor(256 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT r, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM kept)),
scores AS MATERIALIZED (
  SELECT a.r AS a, c.r AS c, CAST(sum(a.x * c.x) AS BIGINT) AS score
  FROM cells a JOIN kept k ON k.r = a.r AND k.vec_id % 50 = 0 JOIN cells c USING (i) GROUP BY a.r, c.r),
pairs AS (SELECT a, k.vec_id AS anchor_id, k.label AS anchor_label, o.vec_id, o.label, score
  FROM scores JOIN kept k ON k.r = a JOIN kept o ON o.r = c),
positives AS (SELECT * FROM (SELECT a, anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS p
  FROM pairs WHERE label = anchor_label AND vec_id IS DISTINCT FROM anchor_id) WHERE p <= 5),
ranked AS (SELECT p.*, n.vec_id AS negative_id, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.p ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN pairs n ON n.a = p.a AND n.label <> n.anchor_label
    AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 3
"""


OP12_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
g AS (SELECT payload, max(page_id) AS newest FROM p WHERE strlen(payload) >= 1000 GROUP BY payload HAVING count(*) > 1)
SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM newest AND newest IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM newest THEN newest END AS refers_to
FROM p LEFT JOIN g USING (payload)
"""


def _op13_sql() -> str:
    """Ten rounds of assignment and exact floor means over (vector, component) rows."""
    def assigned(i: int) -> str:
        return (f"a{i} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM ("
                f"SELECT r, c, CAST(sum((p.x - m.x) * (p.x - m.x)) AS BIGINT) AS d FROM points p JOIN m{i} m USING (i) GROUP BY r, c) "
                f"GROUP BY r)")

    def moved(i: int) -> str:
        return (f"m{i + 1} AS MATERIALIZED (SELECT m.c, m.i, coalesce(t.x, m.x) AS x FROM m{i} m LEFT JOIN ("
                f"SELECT c, i, (s - ((s % n) + n) % n) // n AS x FROM (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n "
                f"FROM points JOIN a{i} USING (r) GROUP BY c, i)) t ON t.c = m.c AND t.i = m.i)")

    rounds = ",\n".join(f"{assigned(i)},\n{moved(i)}" for i in range(10))
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
points AS MATERIALIZED (SELECT r, i, CAST(floor(1024 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT r, embedding, unnest(range(1, 65)) AS i FROM kept)),
seeds AS (SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM kept ORDER BY sha256('3:' || vec_id) LIMIT 8),
m0 AS MATERIALIZED (SELECT c, i, x FROM points JOIN seeds USING (r)),
{rounds},
{assigned(10)},
named AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM m10 GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a10 JOIN kept USING (r) JOIN named USING (c)
"""


OP13_SQL = _op13_sql()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_mix_sources, op2_html_main_text, op3_pii_surrogates, op4_exact_dedup, op5_secret_ledger, op6_suffix_dedup,
        op7_benchmark_index, op8_substring_dedup, op9_language_profiles, op10_simhash_covering, op11_hard_negatives, op12_warc_packages,
        op13_centroid_threshold)
} | {"pipeline": corpus_pipeline.run}

ORACLES = {"op1_mix_sources": OP1_SQL, "op4_exact_dedup": OP4_SQL, "op7_benchmark_index": OP7_SQL,
           "op8_substring_dedup": OP8_SQL, "op11_hard_negatives": OP11_SQL, "op12_warc_packages": OP12_SQL,
           "op13_centroid_threshold": OP13_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
