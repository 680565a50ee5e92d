"""Registered queries of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import decontaminate, fingerprints, hard_negatives, jaccard_join, language_model, licenses, packing, quality, ranked_search, secrets, token_counts, url_filter, vantage
from .common import crc_bucket, keep, shared_dir, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranged = fingerprints.ranges(docs)
    own = fingerprints.fingerprint_documents(ranged.withColumn("next_text", F.lead("text").over(fingerprints.next_row())))
    both = own.withColumn("next_hashes", F.lead("winnowed.hashes").over(fingerprints.next_row())).where("_halo = 0")
    n = F.length("text")
    third = F.expr("length(text) div 3").cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    done = both.withColumn("edited", edited).withColumn("edited_winnowed", fingerprints.winnow(F.col("edited")))
    return done.select(
        "doc_id",
        n.cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.digest(F.col("winnowed")).alias("fingerprint"),
        fingerprints.digest(F.col("edited_winnowed")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("winnowed.hashes"), F.col("edited_winnowed.hashes")).alias("near_edited"),
        fingerprints.likeness(F.col("winnowed.hashes"), F.col("next_hashes")).alias("near_next"),
        F.size("winnowed.hashes").cast("bigint").alias("n_chosen"),
        F.array_join("winnowed.positions", ",").alias("positions"),
    )


def op3_language_model(spark: SparkSession, sf_dir: str, order: int = 2) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    model = language_model.fit(docs.where(~language_model.held_out()), order)
    scored = language_model.score_documents(docs, model)
    return scored.select("doc_id", language_model.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted, those not in English move to a new tokenizer
    version, and repeated texts are deleted; one batch is sent twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    text = F.coalesce("text", F.lit(""))
    counts = {v: token_counts.token_count(F.col("text"), v).alias(v) for v in token_counts.VERSIONS}
    rows = keep(docs.select("doc_id", "source", "lang", F.length(text).alias("chars"), F.sha2(text.cast("binary"), 256).alias("digest"), *counts.values()), "counts")
    # equal texts of one source and language are one row before they meet by text
    groups = rows.groupBy("digest", "source", "lang", "chars", *token_counts.VERSIONS).agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"))
    first = F.min("lo").over(Window.partitionBy("digest"))
    copies = groups.withColumn("n", F.col("n") - F.when(F.col("lo") == first, 1).otherwise(0))
    moved = F.coalesce(F.col("lang") != "en", F.lit(True))
    rollup = token_counts.Rollup(spark, f"{shared_dir(spark)}/tidemark-rollup-{uuid.uuid4().hex}")
    rollup.commit("1-load", token_counts.inserted(rows, "words-1", "words-1"))
    move = token_counts.revised(rows.where(moved), ("words-1", "words-1"), ("pieces-1", "pieces-1"))
    rollup.commit("2-move", move)
    rollup.commit("2-move", move)
    gone = token_counts.deleted(copies.where(moved), "pieces-1", "pieces-1", "n").unionByName(token_counts.deleted(copies.where(~moved), "words-1", "words-1", "n"))
    rollup.commit("3-copies", gone)
    return rollup.totals()


OP4_SQL = r"""
WITH kept AS (
  SELECT source, lang, coalesce(text, '') AS text, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) AS n
  FROM documents
)
SELECT source, lang, CASE WHEN lang = 'en' THEN 'words-1' ELSE 'pieces-1' END AS version,
  count(*) AS docs,
  CAST(sum(CASE WHEN lang = 'en' THEN len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))
    ELSE len(regexp_extract_all(text, '[A-Za-z0-9]+|[^\x20\x09-\x0DA-Za-z0-9]')) END) AS BIGINT) AS tokens,
  CAST(sum(length(text)) AS BIGINT) AS chars
FROM kept WHERE n = 1 GROUP BY 1, 2, 3
"""


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(secrets.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(crc_bucket("doc_id", quality.FOLDS) == quality.HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(moved, F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH own AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM own a JOIN own b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank,
  n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) <= 3
"""


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factor one, since these vectors have no near rows that a looser search would find sooner."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vantage.nearest(rows, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score")


OP12_SQL = """
WITH own AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), lengths AS (
  SELECT vec_id, v, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda x, y: x + y)) AS length FROM own
), pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id,
    list_reduce(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]), lambda x, y: x + y) / (a.length * b.length) AS score
  FROM lengths a JOIN lengths b ON a.vec_id <> b.vec_id AND a.length > 0 AND b.length > 0 WHERE a.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked_search.search(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


OP13_SQL = r"""
WITH tokens AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), tf AS (
  SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY 1, 2
), lengths AS (
  SELECT doc_id, count(*) AS n FROM tokens GROUP BY 1
), totals AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM lengths
), terms AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2.0 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, totals WHERE term IN (SELECT term FROM terms) GROUP BY term
), scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // len)))) AS BIGINT) AS score
  FROM terms JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (doc_id), totals GROUP BY 1, 2
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""


def op3_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is registered as op3_language_model: order three."""
    return op3_language_model(spark, sf_dir, 3)


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontamination, op2_fingerprints, op3_language_model, op4_token_counts, op5_licenses, op6_url_filter, op7_jaccard_join, op8_packing, op9_secrets, op10_quality, op11_hard_negatives, op12_nearest, op13_ranked_search)} | {"op3_language_model": op3_trigrams}


def oracle_sql() -> dict[str, str]:
    return {"op4_token_counts": OP4_SQL, "op11_hard_negatives": OP11_SQL, "op12_nearest": OP12_SQL, "op13_ranked_search": OP13_SQL}
