"""Tests of the fourth round: memory of large groups, words of token files."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from srcgraph.llm import ngram_join, suffix_dedup, token_files


def contexts(n, size, seed=1):
    """n rows of one group: contexts of `size` bytes, three quarters of which all share."""
    rng = np.random.default_rng(seed)
    shared = rng.integers(0, 256, size * 3 // 4, dtype=np.uint8).tobytes()
    texts = [shared + rng.integers(0, 256, size - len(shared), dtype=np.uint8).tobytes() for _ in range(n)]
    same = lambda v: pa.array(np.full(n, v))
    columns = [same(5), same(0), same(1), pa.array(np.arange(n)), same(0), same(0), same(True), pa.array(texts, pa.binary())]
    return pa.table(columns, names=["h", "part", "parts", "k1", "k2", "lo", "own", "context"])


def test_a_large_group_takes_little_memory():
    """A part holds up to HOT occurrences of an anchor: digests of all its bytes at once took 465 MB."""
    rows = contexts(suffix_dedup.HOT, 330)
    tracemalloc.start()
    found = list(suffix_dedup._equal(rows))
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    # Windows that lie in the shared part are repeated, and by chance some with the next bytes.
    assert sum(b.num_rows for b in found) == suffix_dedup.HOT
    assert all(lo == 0 and hi >= 330 * 3 // 4 - 200 for b in found for lo, hi in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
    assert most < 300e6, most


def test_digests_of_contexts_do_not_depend_on_pieces(monkeypatch):
    rows = contexts(50, 260).column(7).combine_chunks()
    data = np.frombuffer(b"".join(rows.to_pylist()), np.uint8)
    at = np.arange(51) * 260
    whole = suffix_dedup.digits_of(data)
    places = (at[:-1, None] + np.arange(61)).ravel()
    for chunk in (1, 600, 1 << 20):
        monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
        for a, b in zip(suffix_dedup.digits_of_contexts(data, at), whole, strict=True):
            assert (a == b[places]).all()


def test_stretches_are_learnt_once_in_whatever_case():
    """`Word,` and `word,` were kept and encoded each on its own."""
    machine = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    machine.words, machine.stretches = token_files.Kept(), token_files.Kept()
    text = "Zweifel, zweifel,\nZWEIFEL, Été été's\té İx x÷ 'S a1 don'"
    assert np.frombuffer(machine.packed(text), machine.width).tolist() == machine.ids(text)
    assert [s for s in machine.stretches.now if s.startswith(("Z", "z", "É", "é"))] == ["zweifel,", "été", "été's", "é"]
    # Case is kept where special tokens may stand, and beside other characters.
    for odd in ("Zweifel　été", "a\xa0b", "<|EndOfText|> Zweifel", "<|endoftext|>", "日本 zweifel", "ΣΑΣ Σ"):
        assert np.frombuffer(machine.packed(odd), machine.width).tolist() == machine.ids(odd)
    assert "Zweifel" in machine.stretches.now


def test_prefix_rows_are_packed_and_come_back(spark):
    """A row for each prefix token had six numbers of 64 bits in the shuffle."""
    names = [c.split()[0] for c in ngram_join.PACKED.split(", ")]
    assert len(names) == 4
    f1, f2, n, part, pos = -(1 << 62), (1 << 32) - 1, (1 << 31) - 1, 7, 12345
    made = [(1, f1, int(np.uint64(f2 << 32 | n).view(np.int64)), (part + 1) << 32 | pos), (2, 3, 4 << 32 | 5, 6)]
    got = {tuple(r) for r in ngram_join.unpacked(spark.createDataFrame(made, ngram_join.PACKED)).collect()}
    assert got == {(1, part, n, f1, f2, pos), (2, -1, 5, 3, 4, 6)}
