"""Tests of the sixth round: how many rounds the n-gram join makes."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from srcgraph.llm import ngram_join


def unlike_texts(n, passages=12, seed=3):
    """Texts of four out of a few passages each: every token is in a third of them, and next to no two are similar."""
    rng = random.Random(seed)
    pool = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(50)) for _ in range(passages)]
    texts = [" ".join(rng.sample(pool, 4)) for _ in range(n)]
    return list(enumerate([*texts, f"{texts[5]} tail", f"{texts[5]} other tail", texts[7]]))


@pytest.mark.parametrize(("n", "cheap", "filtered", "turns"), [(120, 1 << 24, True, 2), (120, 0, True, 4), (360, 1 << 24, False, 4)])
def test_hot_tokens_of_unlike_sets_end_the_rounds(spark, monkeypatch, n, cheap, filtered, turns):
    """Each further round joined nothing and was made all the same. Rounds go on where comparing all is dear, or
    lets too many pairs pass."""
    docs, calls, verified = unlike_texts(n), [], ngram_join._verified
    monkeypatch.setattr(ngram_join, "CHEAP", cheap, raising=False)
    monkeypatch.setattr(ngram_join, "_verified", lambda *a: calls.append(1) or verified(*a))
    if not filtered:
        monkeypatch.setattr(ngram_join, "able", lambda a, b: F.lit(True))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.clustered(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == brute.clustered(docs)
    assert len(calls) == turns


def test_repeated_ids_give_one_mark_each(spark, monkeypatch):
    """Ids of pairs repeat; whether a task tells their places in one chunk or several, the filter is the same."""
    ids = spark.range(0, 4000, 8)
    once = ngram_join.key_filter(ids)
    monkeypatch.setattr(ngram_join, "CHUNK", 64, raising=False)
    assert (ngram_join.key_filter(ids) == once).all()
    many = ngram_join.key_filter(ids.unionByName(ids).unionByName(ids.where("id < 80")))
    digests = lambda df: np.array([r[0] for r in df.select(F.xxhash64("id")).collect()])
    assert ngram_join.marked(digests(ids), many).all() and ngram_join.marked(digests(spark.range(10_000, 10_500)), many).mean() < 0.008
    assert not ngram_join.key_filter(ids.limit(0)).any()
