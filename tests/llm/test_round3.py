"""Hard negatives, token files and spelling variants against plain versions and the tokenizers library."""

import random
import string
import zlib

import brute3
import numpy as np
import oracle
import public_tokenizers
import pytest
from conftest import SF
from pyspark.sql import functions as F

from srcgraph.llm import hard_negatives, queries, quote_links, spelling, token_files

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
VECTORS = "vec_id long, label int, embedding array<double>, whole string, n long"


def mined(spark, rows):
    frame = spark.createDataFrame([(*r, "w", 1) for r in rows], VECTORS).repartition(3)
    made = hard_negatives.prepared(frame, relabel=7)
    got = hard_negatives.mined(made, made.where("vec_id % 100 = 0"))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def vectors(count, dim, seed, clusters=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(max(1, clusters), dim))
    out = []
    for i in range(count):
        v = rng.normal(size=dim) if not clusters else centers[i % clusters] + 0.2 * rng.normal(size=dim)
        out.append((i, int(rng.integers(0, 10)), (v / np.linalg.norm(v)).astype(np.float32).astype(float).tolist()))
    return out


@pytest.mark.parametrize(("dim", "clusters"), [(64, 0), (24, 7), (5, 0)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, dim, clusters):
    monkeypatch.setattr(hard_negatives, "BLOCK", 3)
    monkeypatch.setattr(hard_negatives, "ROWS", 100)
    rows = vectors(650, dim, dim, clusters)
    assert mined(spark, rows) == brute3.negatives(rows)


def test_hard_negatives_on_odd_rows(spark):
    rows = vectors(240, 12, 5)
    same = rows[3][2]
    rows += [(1000 + i, 4, same) for i in range(30)]  # ties go by id
    rows += [(100_000, 4, same), (2000, None, same), (2001, 3, None), (2002, 3, [None] * 12), (2003, 3, [float("nan")] * 12), (2004, 3, [float("inf")] * 12), (None, 3, same)]
    rows += [(2100, 1, [0.5, 0.25]), (2101, 1, [0.5, 0.5]), (2102, 2, [0.25, 0.25]), (2200, 1, []), (2201, 1, [0.0] * 12), (200, rows[200][1], rows[200][2])]
    want = brute3.negatives(rows[:-1])  # the repeated row takes part once
    assert mined(spark, rows) == want
    assert mined(spark, []) == []


def test_hard_negatives_of_large_components(spark):
    rng = random.Random(1)
    rows = [(i, i % 3, [rng.choice([-1, 1]) * rng.random() * 10 ** rng.choice([0, 3, 6]) for _ in range(6)]) for i in range(150)]
    assert mined(spark, rows) == brute3.negatives(rows)


def test_segments_bound_products():
    rng = np.random.default_rng(0)
    for dim in (64, 7, 1):
        a, b = rng.normal(size=(40, dim)) * 50, rng.normal(size=(30, dim)) * 50
        for width in (16, 4, 3):
            (am, ad), (bm, bd) = hard_negatives.summary(a, width), hard_negatives.summary(b, width)
            exact = a @ b.T
            assert (np.abs(exact - am @ bm.T) <= ad @ bd.T + 1e-6).all()


def test_hard_negatives_equal_sql(spark):
    assert oracle.spark(queries.op11_hard_negatives(spark, SF)) == oracle.duck(queries.ORACLE_SQL["op11_hard_negatives"], SF)


def texts(spark, rows):
    return spark.createDataFrame([(i, t, 3, "p") for i, t in rows], "doc_id long, text string, n_tokens int, part string").repartition(4)


def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(VOCABULARY)
    found.no_truncation()
    found.no_padding()
    return found


ODD = [
    "", None, " ", "A b c", "x" * 9000, "<|endoftext|> and<|startoftext|>x", "a\x1cb \x1d c", "é ́e　z", "ΣΑΣ σας", "don't DON'T 'tis", "İstanbul ǅ ﬁ ½ ² Ⅷ", "👩‍👩‍👧 日本語 テキスト",
    "a​b c\x85d", "﻿abc", "tab\tnew\nline\r\nend ", "no" * 40_000, "1234 5 ٣٤", "__init__ a_b-c",
]


def test_stretches_are_encoded_as_the_library_encodes_texts(spark):
    machine, tool = token_files.encoder(VOCABULARY), library()
    assert machine.parted
    found = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    rng = random.Random(4)
    signs = string.ascii_letters + string.whitespace + "'’.,-_<|>é́ßΣ   \x1f᠎日👍0٣"
    made = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(400)]
    for text in [t or "" for t in found + ODD] + made:
        assert np.frombuffer(machine.packed(text), machine.width).tolist() == tool.encode(text, add_special_tokens=False).ids, text[:80]


def wanted(rows, tool):
    coded = []
    for i, t in rows:
        ids = [*tool.encode(t or "", add_special_tokens=False).ids, 1]
        coded.append(((i is not None, i or 0, zlib.crc32(np.array(ids, "<u2").tobytes())), i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    out, start = [], 0
    for _, i, n, crc in sorted(coded, key=lambda x: x[0]):
        out.append((i, start, n, crc))
        start += n
    return out


@pytest.mark.parametrize(("part", "block"), [(32 << 20, 1 << 16), (3000, 500)])
def test_files_give_back_the_ids_of_the_library(spark, monkeypatch, part, block):
    monkeypatch.setattr(token_files, "PART_BYTES", part)
    monkeypatch.setattr(token_files, "BLOCK_IDS", block)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(7000 + i, t) for i, t in enumerate(ODD)] + [(None, "no name"), (None, None), (5, rows[5][1]), (5, "other words")]
    got = token_files.checksums(texts(spark, rows), VOCABULARY)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == wanted(rows, library())


def test_files_of_an_empty_table_and_whole_ids(spark):
    assert token_files.checksums(texts(spark, []), VOCABULARY).count() == 0
    folder, order = token_files.token_files(texts(spark, [(2, "b c"), (1, "a")]), VOCABULARY, end_id=None)
    got = token_files.read(spark, folder, order, lambda ids: (ids.tolist(),), "ids array<long>").orderBy("start").collect()
    assert [r["ids"] for r in got] == [library().encode(t, add_special_tokens=False).ids for t in ("a", "b c")]


def test_codes_of_one_to_four_bytes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (2 ** (rng.random(n) * 32)).astype(np.uint64).clip(0, 2**32 - 1).astype(np.uint32)
        control, data = token_files.coded(ranks)
        assert token_files.decoded(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n).tolist() == ranks.tolist()
    content = token_files.block(3, 17, [5, None], [2, 1], np.array([70_000, 1, 300])) + b"\n" + token_files.block(3, 20, [9], [0], np.array([], np.uint32)) + b"\n"
    assert [(p, b, d, n.tolist(), r.tolist()) for p, b, d, n, r in token_files.blocks(content)] == [(3, 17, [5, None], [2, 1], [70_000, 1, 300]), (3, 20, [9], [0], [])]


def spelled(spark, rows, **more):
    return {r["word"]: tuple(r)[1:] for r in spelling.grouped(spelling.count_words(texts(spark, rows), changed=31, **more)).collect()}


def test_spelling_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()][:60]
    got = spelled(spark, rows)
    assert got == brute3.variants(brute3.counted(rows))
    assert any(v[0] for v in got.values())


def test_spelling_of_odd_words(spark):
    rng, rows = random.Random(2), []
    base = ["aaaaaaa", "abcdefgh", "éàüßöçñ", "mississippi", "×÷×÷×÷×", "İabcdefgh", "naïveté" * 30]
    for k, w in enumerate(base):
        rows.append((k, f"{w.upper() if k % 2 else w} " * (300 if k < 4 else 20)))
        for i in range(40):
            at = rng.randrange(len(w))
            variant = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("aéz") + w[at:], w[:at] + rng.choice("aéz") + w[at + 1 :]])
            rows.append((100 * k + i, f"{variant}, {variant}-{variant[:-1]}."))
    rows += [(None, "abcdefgx abcdefgx " * 3), (9, None), (9, ""), (10, "aaaaaaa " * 20_000), (10, "bbaaaaa " * 3), (10, "baaaaaa " * 31)]
    got = spelled(spark, rows)
    want = brute3.variants(brute3.counted(rows))
    assert got == want
    assert got["bbaaaaa"][0] == "baaaaaa"
    assert got["bbaaaaa"][1] == "aaaaaaa"  # forms of forms
    assert spelled(spark, []) == {}


def test_one_edit_keeps_reduced_words_within_one_edit(spark):
    words = spark.createDataFrame([("abcdefg",), ("aaaaaaa",)], "word string").select("word", spelling.reduced(F.col("word"), 3).alias("r"))
    for r in words.select("r", spelling.neighbourhood(F.col("r"), 3).alias("near")).collect():
        full = {r["r"][:i] + r["r"][i + 1 :] for i in range(7)} | {r["r"][:i] + c + r["r"][i + 1 :] for i in range(7) for c in "abc" if c < r["r"][i]}
        assert set(r["near"]) == full
        assert len(r["near"]) == len(full)


def replied(rows):
    """Reply-ordered turns of each conversation, by plain recursion over what each message quotes."""
    held = {}
    for conv, turn, _, text in rows:
        held.setdefault(conv, {}).setdefault(turn, []).append(text or "")
    out = {}
    for conv, turns in held.items():
        own = {}
        for turn in sorted(turns):
            for text in turns[turn]:
                body = [line for line in text.split("\n") if not line.startswith(">")]
                for part in quote_links.parts(body):
                    own.setdefault(part, turn)
        children, roots = {}, []
        for turn in sorted(turns):
            found = []
            for text in turns[turn]:
                level, block = 0, []
                for line in [*text.split("\n"), ""]:
                    deep = len(line) - len(line.lstrip("> ")) if line.startswith(">") else 0
                    deep = line[:deep].count(">")
                    if deep != level:
                        found += [(-level, len(p), own[p]) for p in quote_links.parts(block) if level and own.get(p, turn) < turn]
                        level, block = deep, []
                    block.append(line.lstrip("> ") if deep else line)
            if found:
                children.setdefault(max(found)[2], []).append(turn)
            else:
                roots.append(turn)
        order, todo = [], roots[::-1]
        while todo:
            turn = todo.pop()
            order.append(turn)
            todo += children.get(turn, [])[::-1]
        out[conv] = order
    return out


def test_conversations_come_in_reply_order(spark):
    rng, rows = random.Random(6), []
    for conv in range(25):
        said = []
        for turn in range(rng.randint(1, 30)):
            body = f"message {conv} {turn} {rng.random()}\nsecond line {turn}{conv}"
            text = body
            if said and rng.random() < 0.8:
                t, earlier = rng.choice(said)
                quoted = "\n".join("> " + x for x in earlier.split("\n"))
                deeper = "\n> > " + rng.choice(said)[1].split("\n")[0] if rng.random() < 0.4 else ""
                text = f"{quoted}{deeper}\n{body}" if rng.random() < 0.5 else f"{body}\n{quoted}{deeper}"
            said.append((turn, body))
            rows.append((conv, turn * 2, "user", text))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit("x")).repartition(3)
    got = {}
    for r in sorted(quote_links.conversations(df, piece=7).collect(), key=lambda r: (r["conv_id"], r["piece"])):
        assert r["n_messages"] == len(r["turns"]) <= 7
        assert ">" not in r["text"].replace("|>", "")
        got.setdefault(r["conv_id"], []).extend(r["turns"])
    assert got == replied(rows)


def test_conversations_of_odd_rows(spark):
    rows = [(1, 0, "user", "hello there"), (1, 1, "user", "> hello there\nyes"), (1, 1, "user", "> hello there\nyes"), (1, 1, "bot", "no"), (1, None, "user", "lost"), (None, 3, "user", "x"), (None, 3, None, None), (2, 5, "user", None)]
    rows += [(7, t, "user", f"line {t}" if not t else f"> line {t - 1}\nline {t}") for t in range(300)] + [(8, 0, "user", "start")] + [(8, t, "user", f"> start\nreply {t}") for t in range(1, 200)]
    rows += [(9, 0, "user", "word " * 60_000), (9, 1, "user", "> " + "word " * 60_000 + "\nlong")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    made = quote_links.conversations(df).collect()
    got = {}
    for r in sorted((r for r in made if r["conv_id"] is not None), key=lambda r: (r["conv_id"], r["turns"] == [None], r["piece"])):
        got.setdefault(r["conv_id"], []).extend(r["turns"])
    assert got.pop(1)[-1] is None and got == {2: [5], 7: list(range(300)), 8: list(range(200)), 9: [0, 1]}
    assert sorted(r["n_messages"] for r in made if r["conv_id"] == 1) == [1, 3]
    assert sum(r["conv_id"] is None for r in made) == 2
    assert quote_links.conversations(df.limit(0)).count() == 0
