"""Tests of the fifth round: what reaches the verification of the n-gram join, words of token files."""

import random

import brute
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from srcgraph.llm import ngram_join, token_files


def pairs_of_sets(share, n=900, seed=1):
    """Pairs of sets of about n tokens with `share` of each in common, and of sizes up to a quarter apart."""
    rng = np.random.default_rng(seed)
    for i in range(60):
        size = n + i * (n // 240)
        both = rng.integers(0, 1 << 63, int(n * share)).astype(np.uint64)
        yield tuple(np.unique(np.r_[both, rng.integers(0, 1 << 63, m - len(both)).astype(np.uint64)]) for m in (n, size))


def room(a, b):
    return len(a) + len(b) - 2 * int(ngram_join.needed(len(a), len(b)))


def test_wide_bits_never_exceed_the_difference():
    for n in (1, 7, 60, 500, 1000):
        for share in (0.5, 0.9, 1):
            for a, b in pairs_of_sets(share, n):
                assert ngram_join.differing(ngram_join.wide(a), ngram_join.wide(b)) <= np.setxor1d(a, b).size
                assert ngram_join.differing(ngram_join.wide(b), ngram_join.wide(a)) == ngram_join.differing(ngram_join.wide(a), ngram_join.wide(b))


def test_wide_bits_drop_large_sets_that_are_nearly_similar():
    """128 parity bits let any two sets of some hundred tokens pass."""
    for a, b in pairs_of_sets(0.8):
        assert ngram_join.differing(ngram_join.wide(a), ngram_join.wide(b)) > room(a, b)
        few = (ngram_join.parity(x).view(np.uint64) for x in (a, b))
        assert sum(bin(int(p) ^ int(q)).count("1") for p, q in zip(*few, strict=True)) <= room(a, b)


def edited(rng, base, words):
    some = list(base)
    for at in range(3, len(some), len(some) // words):
        some[at] = f"z{rng.randrange(10**9)}"
    return " ".join(some)


def test_whole_sets_are_made_for_close_pairs_only(spark, monkeypatch):
    """Results beside brute force; sets this small were kept from verification by the older filters too."""
    rng = random.Random(2)
    bases = [[f"w{rng.randrange(10**9)}" for _ in range(600)] for _ in range(12)]
    docs = [(10 * i + k, edited(rng, base, words)) for i, base in enumerate(bases) for k, words in enumerate((1, 8, 26))]
    verified, stored = [], ngram_join.stored

    def counting(df, name):
        made = stored(df, name)
        if name == "met":
            verified.extend((r["a"], r["b"]) for r in made.collect())
        return made

    monkeypatch.setattr(ngram_join, "stored", counting)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.clustered(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == brute.clustered(docs) and len({c for _, _, c in got}) == 24
    assert len(verified) <= 14, verified


def test_few_ids_without_a_mark_pass_the_key_filter(spark):
    """One bit an id let through 2 to 3 of a hundred others."""
    ids = spark.range(0, 80_000, 8)
    marks = ngram_join.key_filter(ids)
    digests = lambda df: np.array([r[0] for r in df.select(F.xxhash64("id")).collect()])
    assert ngram_join.marked(digests(ids), marks).all()
    assert ngram_join.marked(digests(spark.range(1_000_000, 1_040_000)), marks).mean() < 0.008


def test_words_that_stand_alone_are_kept_once(monkeypatch):
    """A word that is a stretch was kept in both tables and looked up in both."""
    machine = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    machine.words, machine.stretches = token_files.Kept(), token_files.Kept()
    learnt, word = [], machine.word
    monkeypatch.setattr(machine, "word", lambda w: learnt.append(w) or word(w))
    for text in ("zweifel été zweifel", "Zweifel, été's hund,\thund", "hund katze, été"):
        assert np.frombuffer(machine.packed(text), machine.width).tolist() == machine.ids(text)
    assert sorted(learnt) == sorted(["zweifel", "été", ",", "'s", "hund", "katze"])
    assert not machine.words.now.keys() & {"zweifel", "été", "katze,"} and {"zweifel", "été", "katze,"} <= machine.stretches.now.keys()
    # An older generation of either table still knows its words.
    monkeypatch.setattr(token_files, "KEPT", 0)
    learnt.clear()
    text = "zweifel. ZWEIFEL katze hund. été"
    assert np.frombuffer(machine.packed(text), machine.width).tolist() == machine.ids(text)
    assert sorted(learnt) == ["."]
