"""The registered queries of the corpus operators and their SQL twins.

Each query applies its operator with production parameters to the whole of its
table and derives the digest columns of its contract from the operator's output.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.llm import (bpe, exact_dedup, filter_audit, hard_negatives, html_text, hyperminhash, masked_lm, mixing,
                           phrase_dedup, quality, suffix_dedup, token_counts, topk)
from pixelmill.llm.common import table

RANKS = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"


def held_out(doc_id: Column) -> Column:
    """Rows that no classifier learns from; a null id is none of them."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> quality.Voters:
    labels = table(spark, sf_dir, "labels")
    return quality.fit(docs, labels.where(~held_out(F.col("doc_id"))))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality_model(spark, sf_dir, docs))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("n_rows")


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.pmod(F.col("vec_id"), F.lit(50)) == 0), k=5)


def op4_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = phrase_dedup.dedup_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (mixing.mix_counts(table(spark, sf_dir, "documents"))
            .select("doc_id", "size", "source_size", "target", "taken"))


def op6_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.masked_scores(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER),
                                     public_tokenizers.PATTERN)


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_groups(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.failure_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.pmod(F.col("vec_id"), F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = hard_negatives.labelled_vectors(rows, label_col=moved)
    return hard_negatives.hard_negatives(vectors, vectors.where(F.pmod(F.col("vec_id"), F.lit(50)) == 0))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_topk_search": op3_topk_search,
    "op4_phrase_dedup": op4_phrase_dedup,
    "op5_mix_sources": op5_mix_sources,
    "op6_masked_lm": op6_masked_lm,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_bpe_codec": op9_bpe_codec,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_html_text": op13_html_text,
}

#: Integer vectors that take part, as a DuckDB table expression.
_VECTORS = """
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""

SQL = {
    "op2_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op3_topk_search": f"""
WITH v AS ({_VECTORS}),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
  WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op5_mix_sources": mixing.SQL,
    "op4_phrase_dedup": """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
windows AS (
  SELECT doc_id, s, md5(array_to_string(ws[s:s + 19], ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20)),
later AS (
  SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, s + unnest(range(20)) AS p FROM later) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE
         list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone ON w.doc_id IS NOT DISTINCT FROM gone.doc_id""",
    "op10_minhash_near_dedup": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sets AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[s:s + 4], ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS s FROM w WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.k = b.k AND a.doc_id < b.doc_id
  GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)""",
    "op11_filter_audit": """
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         {'A': len(ws) < 200, 'B': 100 * len(list_distinct(ws)) < 50 * len(ws),
          'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t),
          'D': regexp_matches(t, '[#$%&*|]'),
          'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE)} AS x
  FROM w LEFT JOIN marks USING (doc_id)),
fails AS (SELECT part, good, toxic, MAP(['A', 'B', 'C', 'D', 'E'], [x.A, x.B, x.C, x.D, x.E]) AS m FROM f),
cells AS (SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, m),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT [a.l, b.l, c.l, d.l, e.l] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT array_to_string(o, '') AS filter_order, step, o[step] AS own, o[1:step - 1] AS before
          FROM orders, (SELECT unnest(range(1, 6)) AS step)),
judged AS (
  SELECT part, filter_order, step, own, n, good, toxic, coalesce(m[own], FALSE) AS bad,
         len(list_filter(before, lambda l: m[l])) > 0 AS gone,
         len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda l: m[l])) = 1 AS once
  FROM cells, steps),
counted AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (NOT bad AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (bad AND NOT gone), 0) AS removed,
         coalesce(sum(n) FILTER (bad AND gone), 0) AS redundant, coalesce(sum(n) FILTER (bad AND once), 0) AS unique_fails,
         coalesce(sum(good) FILTER (bad AND NOT gone), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (bad AND NOT gone), 0) AS toxic_lost
  FROM judged GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS anchor_id, c.vec_id AS other, q.label = c.label AS same, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
ranked AS (
  SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
         other AS negative_id, positive_score, score AS negative_score
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
   AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT * FROM ranked WHERE rank <= 3""",
}
