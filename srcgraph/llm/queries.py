"""The numbered operators on their whole tables, as thin queries: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, hard_negatives, html_text, media, mixing, ngram_join, quote_links, spelling, suffix_dedup, token_files, toxicity, url_filter
from .base import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge(pages, url_filter.fit(url_filter.labelled_urls(spark)))
    return judged.select("page_id", "host", "path", "rule", "verdict", "junk_probability")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ["doc_id"])


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.to_media(table(spark, sf_dir, "documents"), ["doc_id"])
    return media.media_features(stored, ["doc_id", "n_bytes"])


#: Shares of tokens by language that a mix is to have.
MIX = {"en": 0.5, "de": 0.18, "fr": 0.18, "es": 0.14}


def labelled_domains(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """(text, domain) of labelled documents: their language is the domain. The classifier's sample is
    bounded, so its ids are chosen first, in hash order, and sent to the texts."""
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("mixing"))
    ids = table(spark, sf_dir, "labels").select("doc_id").distinct().orderBy(order, "doc_id").limit(mixing.MAX_LABELLED)
    return docs.select("doc_id", "text", F.col("lang").alias("domain")).join(F.broadcast(ids), "doc_id", "left_semi").drop("doc_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return mixing.mixed(documents, labelled_domains(spark, sf_dir, documents), MIX, ["doc_id"])


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.deduplicated(table(spark, sf_dir, "embeddings"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.clustered(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_links.conversations(table(spark, sf_dir, "conversations"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))
    held_out = toxicity.fold_of(F.col("doc_id")) == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"), ["page_id"])


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.removed(documents).drop("text")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.prepared(table(spark, sf_dir, "embeddings"), relabel=7)
    return hard_negatives.mined(rows, rows.where("vec_id % 100 = 0"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.checksums(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.grouped(spelling.count_words(table(spark, sf_dir, "documents"), changed=spelling.CHANGED))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_bpe": op2_bpe,
    "op3_media": op3_media,
    "op4_mixing": op4_mixing,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_ngram_join": op6_ngram_join,
    "op7_quote_links": op7_quote_links,
    "op8_toxicity": op8_toxicity,
    "op9_html_text": op9_html_text,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_files": op12_token_files,
    "op13_spelling": op13_spelling,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op11_hard_negatives": """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
        FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10""",
}
