"""A training corpus from `documents`, stage by stage.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.

For all stages: a null text counts as empty and stays null where the row stays; very long texts are
read whole; an empty table gives an empty result; columns beside those of documents go through, whatever
their names, until the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.llm import bpe, mixing, ngram_join, suffix_dedup, toxicity
from srcgraph.llm.base import stored, table
from srcgraph.llm.queries import MIX, labelled_domains


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier rejects go. Empty texts and rows without a
    doc_id are scored like all others; repeated rows are scored alike and share their fate; a score of
    just 0.5 goes; without labelled rows of both classes all stay."""
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked shingle sets stays, that of the smallest doc_id. Texts without
    words are linked with nothing and stay, and so do rows without a doc_id; of rows that repeat doc_id
    and text one stays."""
    return ngram_join.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated windows are cut out of the texts; n_chars follows (null for a null text). Rows all stay,
    also those that are empty now; equal texts lose all their windows; texts under 200 bytes stay as
    they are; bytes of a character that is cut through go too."""
    return suffix_dedup.cleaned(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their fitted rate says, so that one of rate 1.5 comes once or twice, with
    equal doc_ids: further epochs of a domain that is to weigh more. The token budget is the least at which
    no domain shrinks, so that no document goes that its domain's weight does not rule out. Repeated rows
    are rows of their own and come equally often; without labelled rows each row comes once; likeliest
    domains that tie go to the first in order."""
    return mixing.resampled(docs, labelled_domains(spark, sf_dir, docs), MIX)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's token ids and their digests beside doc_id, lang and source; empty texts have none."""
    return bpe.encode_texts(docs, public_tokenizers.path("word_bpe_49k.json"), ["doc_id", "lang", "source"])


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", one_of_near_copies),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_domains),
    ("bpe", encode),
]

#: SQL cannot express the stages; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
