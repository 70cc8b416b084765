"""The numbered operators as queries over the driver's tables, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasestream.llm import decontaminate, fingerprints, jaccard_join, language_model, lexical_search, mixing, pii, quality, substring_dedup, token_counts, toxicity, warc, whitening
from phrasestream.llm import words as W

QUERIES: dict = {}
SQL: dict = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(fold: int):
    return (W.fold_of(F.col("doc_id")) == fold).alias("held_out")


@query
def op1_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


@query
def op2_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


@query
def op3_toxicity(spark, sf_dir):
    docs = W.text_frame(table(spark, sf_dir, "documents"), "doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), W.fold_of(F.col("_id")) != 0)
    return toxicity.score(docs, model).select(
        "doc_id", held_out(0), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))


@query
def op4_lm_scoring(spark, sf_dir):
    docs = W.text_frame(table(spark, sf_dir, "documents"), "doc_id", "text")
    return language_model.scores(docs.select("*", held_out(1)))


@query
def op5_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"))


@query
def op6_substring_dedup(spark, sf_dir):
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op7_quality(spark, sf_dir):
    docs = W.text_frame(table(spark, sf_dir, "documents"), "doc_id", "text")
    weights = quality.fit(docs, table(spark, sf_dir, "labels"), W.fold_of(F.col("_id")) != 0)
    return quality.score(docs, weights).select(
        "doc_id", held_out(0), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))


@query
def op8_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_token_counts(spark, sf_dir):
    docs = W.text_frame(table(spark, sf_dir, "documents"), "doc_id", "text")
    counted = token_counts.token_counts(docs, token_counts.load_pieces())
    return counted.select("doc_id", F.col("_words").alias("n_words"), F.col("_tokens").alias("n_tokens"))


@query
def op10_personal_data(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents"))


@query
def op11_warc(spark, sf_dir):
    files = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.page_records(warc.read_archives(spark, files, with_data=False))


SQL["op11_warc"] = """
WITH records AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
hashed AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM records),
first AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM hashed)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS DISTINCT FROM page_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
FROM first
"""


@query
def op12_ranked_search(spark, sf_dir):
    indexed = lexical_search.index(table(spark, sf_dir, "documents"))
    return lexical_search.search(indexed, table(spark, sf_dir, "benchmark"))


SQL["op12_ranked_search"] = r"""
WITH lower_docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
lower_items AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
wanted AS (SELECT item_id, term, count(*) AS times FROM lower_items GROUP BY ALL),
totals AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS all_terms FROM lower_docs WHERE len(terms) > 0),
used AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM lower_docs) GROUP BY ALL),
spread AS (SELECT term, count(*) AS df FROM used GROUP BY term),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM spread, totals),
norms AS (SELECT doc_id, 25 + (75 * len(terms)::BIGINT * docs) // all_terms AS m FROM lower_docs, totals WHERE len(terms) > 0),
scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN used USING (term) JOIN norms USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""


@query
def op13_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
