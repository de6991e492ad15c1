"""Near-duplicate, suffix, vector, mixing, toxicity and quotation operators against plain versions."""

import random
import zlib

import brute
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from srcgraph.llm import components, embedding_dedup, mixing, ngram_join, queries, quote_links, suffix_dedup, toxicity


@pytest.fixture(scope="module")
def rows(spark):
    found = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r["text"]) < 6000]
    passage = found[3][1][:600].ljust(300, "x")
    found += [(2000 + i, f"{i} lead {i * 7919} " * 3 + passage + f" tail {i * 31}") for i in range(30)]
    rng, base = random.Random(3), found[9][1].split()[:120]
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
        found.append((5000 + i, " ".join(words)))
    found += [(6000, None), (6001, ""), (6002, "a b"), (6003, "A  b"), (6004, "a b c"), (6005, "   "), (6006, found[3][1] + " x"), (6007, "a" * 1000), (6008, "ä" * 150), (6009, "ä" * 150), (5, found[5][1])]
    return found


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, lang string, n_removed long").repartition(3)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 120)] + [(200, 201), (201, 200), (7, 7)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 120), 100), 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.mark.parametrize("hot", [20_000, 5])
def test_removed_bytes_equal_brute_force(spark, rows, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    got = {}
    for r in suffix_dedup.removed(frame(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
    assert {i: sorted(v) for i, v in got.items()} == brute.removed(rows)


def test_long_texts_are_hashed_in_parts():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 123, 30_000).astype(np.uint8)
    data[20_000:20_400] = data[100:500]
    whole = suffix_dedup.filed(data, np.array([0]), np.array([len(data)]))
    parts = [suffix_dedup.filed(data[a : a + 7000 + 199], np.array([0]), np.array([len(data[a : a + 7199])])) for a in range(0, 30_000 - 199, 7000)]
    flat = {(int(d), int(p) + 7000 * k, s) for k, part in enumerate(parts) for d, p, lo, hi in zip(*part[1:], strict=True) for s in range(int(lo) + 7000 * k, int(hi) + 7000 * k + 1)}
    assert flat == {(int(d), int(p), s) for d, p, lo, hi in zip(*whole[1:], strict=True) for s in range(int(lo), int(hi) + 1)}


def test_cleaned_texts(spark, rows):
    kept = {r["doc_id"]: r["text"] for r in suffix_dedup.cleaned(frame(spark, rows)).collect()}
    assert len(kept[2000]) < 300 and kept[6002] == "a b" and kept[6009] == "" and kept[6000] is None
    assert suffix_dedup.removed(frame(spark, rows).limit(0)).count() == 0


def test_components_of_similar_texts_equal_brute_force(spark, rows):
    some = rows[:-1]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.clustered(frame(spark, some)).collect())
    assert got == brute.clustered(some)


def test_one_of_each_keeps_columns_and_empty_texts(spark, rows):
    docs = frame(spark, [*rows[:-1], rows[0], rows[0]])
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = {c for _, _, c in brute.clustered(rows[:-1])}
    assert set(ids) == want and len(ids) == len(want)


def test_similar_texts_of_no_or_null_rows(spark):
    assert ngram_join.clustered(frame(spark, [(1, "a")]).limit(0)).count() == 0
    got = ngram_join.clustered(frame(spark, [(None, "a b c d e f"), (3, "a b c d e f"), (None, None)])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == [("3", "3"), ("None", "3"), ("None", "None")]


def similar_sets():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) > 0.1], rng.integers(0, 1 << 63, int(rng.integers(0, 8))).astype(np.uint64)])
        both = np.intersect1d(a, b).size
        if len(b) and 100 * both >= 80 * (len(a) + len(b) - both):
            yield a, b, both


def test_filters_let_similar_sets_pass():
    levels = np.random.default_rng(2).integers(0, 6, ngram_join.BUCKETS).astype(np.uint8)
    for a, b, both in similar_sets():
        for order in range(ngram_join.ORDERS):
            x, y = ngram_join.prefix(a, levels, order), ngram_join.prefix(b, levels, order)
            assert np.intersect1d(x, y).size
        differ = sum(bin(int(p) ^ int(q)).count("1") for p, q in zip(ngram_join.parity(a).view(np.uint64), ngram_join.parity(b).view(np.uint64), strict=True))
        assert differ <= len(a) + len(b) - 2 * both


def near_copies(n, words=120, edits=5, seed=4):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**9)}" for _ in range(words)]
    for i in range(n):
        some = list(base)
        for _ in range(rng.randint(0, edits)):
            some[rng.randrange(words)] = f"z{rng.randrange(10**9)}"
        yield i, " ".join(some)


@pytest.mark.parametrize(("hot", "pivots"), [(7, 2), (1 << 16, 1)])
def test_large_groups_of_near_copies(spark, monkeypatch, hot, pivots):
    some = [*near_copies(150), *((1000 + i, t) for i, t in near_copies(40, 60, 8, 5))]
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "MOST_PIVOTS", pivots)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.clustered(frame(spark, some)).collect())
    assert got == brute.clustered(some)


def test_pairs_grow_with_a_group_and_not_with_its_square(spark, monkeypatch):
    counts, verified = {}, ngram_join._verified
    for n in (400, 1600):
        counts[n] = 0

        def counting(pairs, sets, wholes, n=n):
            counts[n] += pairs.count()
            return verified(pairs, sets, wholes)

        monkeypatch.setattr(ngram_join, "_verified", counting)
        assert len({r["component_id"] for r in ngram_join.clustered(frame(spark, list(near_copies(n, edits=2)))).collect()}) == 1
    assert counts[1600] <= 6 * counts[400] and counts[1600] <= 6 * 1600


def test_vectors_equal_brute_force(spark):
    found = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    rng = np.random.default_rng(5)
    base = rng.normal(size=64)
    found += [(50_000 + i, [float(x) for x in base + rng.normal(size=64) * rng.choice([0.2, 0.35])]) for i in range(120)]
    found += [(60_000 + i, found[3][1]) for i in range(20)]
    found += [(70_000, None), (70_001, [0.0] * 64), (70_002, [float("nan")] * 64), (70_003, [1.0, None]), (70_004, [1.0, 2.0]), (70_005, [2.0, 4.0]), (70_006, [])]
    want = brute.linked_vectors(found)
    got = embedding_dedup.deduplicated(spark.createDataFrame(found, "vec_id long, embedding array<float>").repartition(3)).collect()
    assert len(got) == len(found)
    right = sum((r["n_links"], r["component_id"]) == want[r["vec_id"]] for r in got)
    assert right >= 0.98 * len(found) and sum(r["n_links"] for r in got) >= 0.95 * sum(n for n, _ in want.values())
    assert all(r["n_links"] <= want[r["vec_id"]][0] and r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert embedding_dedup.deduplicated(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_salted_shards_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "MAX_SHARD", 60)
    rng = np.random.default_rng(6)
    base = rng.normal(size=16)
    found = [(i, [float(x) for x in base + rng.normal(size=16) * 0.1]) for i in range(200)]
    want = brute.linked_vectors(found)
    got = embedding_dedup.deduplicated(spark.createDataFrame(found, "vec_id long, embedding array<float>")).collect()
    assert sum(r["n_links"] for r in got) >= 0.95 * sum(n for n, _ in want.values()) and {r["component_id"] for r in got} == {0}


def test_lost_sparse_pairs_are_found_by_the_audit(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base, singles = rng.normal(size=32), rng.normal(size=(40, 32))
    vectors = [*(base + rng.normal(size=(60, 32)) * 0.05), *singles, *(singles + rng.normal(size=(40, 32)) * 0.05)]
    found = [(i, v.tolist()) for i, v in enumerate(vectors)]
    searched = embedding_dedup._linked
    monkeypatch.setattr(embedding_dedup, "SHARD", 10)
    monkeypatch.setattr(embedding_dedup, "BLOCK_BYTES", 9000)
    # A search that sees the large group only: nearly all pairs, and none of most vectors' links.
    monkeypatch.setattr(embedding_dedup, "_linked", lambda nodes, overlap: searched(nodes.where("id < 60"), overlap))
    got = embedding_dedup.deduplicated(spark.createDataFrame(found, "vec_id long, embedding array<double>").repartition(3)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == brute.linked_vectors(found)
    assert {r["audit_recall"] for r in got} == {1.0}


def test_vectors_of_many_lengths(spark, monkeypatch):
    rng = np.random.default_rng(9)
    singles = [rng.normal(size=n) for n in range(4, 76)]
    found = [(i, v.tolist()) for i, v in enumerate([*singles, *(v + rng.normal(size=len(v)) * 0.01 for v in singles)])]
    # One length of more nodes than a shard is to have.
    monkeypatch.setattr(embedding_dedup, "SHARD", 5)
    found += [(1000 + i, (singles[20] + rng.normal(size=24) * 0.01).tolist()) for i in range(12)]
    got = embedding_dedup.deduplicated(spark.createDataFrame(found, "vec_id long, embedding array<double>").repartition(3)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == brute.linked_vectors(found)


def test_rates_reach_the_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = mixing.mixed(docs, queries.labelled_domains(spark, SF, docs), queries.MIX, ["doc_id", "lang"])
    got = out.collect()
    assert len(got) == docs.count() and min(r["rate"] for r in got) >= 0
    assert sum(r["domain"] == r["lang"] for r in got) >= 0.9 * len(got)
    sums = np.sum([np.array(r["posteriors"]) * r["n_tokens"] * r["rate"] for r in got], axis=0)
    assert np.allclose(sums / sums.sum(), [queries.MIX[d] for d in ("de", "en", "es", "fr")], atol=0.002)


def test_mixing_edges(spark):
    docs = spark.createDataFrame([(1, None, "en", 5.0), (2, "", None, 1.0), (2, "", None, 1.0), (None, "a b c", "de", 2.0)], "doc_id long, text string, lang string, rate double")
    none = mixing.mixed(docs, docs.select("text", F.lit(None).cast("string").alias("domain")), queries.MIX, ["doc_id"]).collect()
    assert [r["rate"] for r in none] == [1.0] * 4 and sum(r["n_tokens"] for r in none) == 3
    some = mixing.mixed(docs, docs.select("text", F.col("lang").alias("domain")), queries.MIX, ["doc_id"]).collect()
    assert len(some) == 4 and all(r["rate"] >= 0 for r in some)
    again = mixing.resampled(docs, docs.select("text", F.col("lang").alias("domain")), queries.MIX)
    assert again.columns == docs.columns
    assert mixing.targets_of([60.0, 20.0, 20.0], ("a", "b", "c"), {"a": 0.5, "b": 0.25, "c": 0.25}, None) == [60.0, 30.0, 30.0]


def test_unnamed_domains_keep_their_share(spark):
    got = mixing.targets_of([50.0, 20.0, 20.0, 10.0], ("a", "b", "c", "x"), {"a": 0.5, "b": 0.25, "c": 0.25}, 100.0)
    assert np.allclose(got, [45.0, 22.5, 22.5, 10.0])
    assert np.allclose(mixing.targets_of([50.0, 50.0], ("x", "y"), {"a": 1.0}, None), [50.0, 50.0])
    assert np.allclose(mixing.targets_of([60.0, 20.0, 20.0], ("a", "b", "x"), {"a": 0.5, "b": 0.5}, None), [60.0, 60.0, 30.0])
    assert mixing.targets_of([0.0, 0.0], ("a", "x"), {"a": 1.0}, None) == [0.0, 0.0]
    docs = spark.createDataFrame([(i, f"{d} {d}word {d}text " * 4, d) for i, d in enumerate(["en", "de", "it", "it"] * 6)], "doc_id long, text string, lang string")
    out = mixing.mixed(docs, docs.select("text", F.col("lang").alias("domain")), {"en": 0.75, "de": 0.25}, ["doc_id", "lang"]).collect()
    assert min(r["rate"] for r in out if r["lang"] == "it") > 0.9


def test_toxicity_is_learnt_outside_the_fold(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op8_toxicity(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for r in got)
    known = [(r["score"], labels[r["doc_id"]]) for r in got if r["doc_id"] in labels and r["held_out"]]
    toxic, clean = [s for s, y in known if y], [s for s, y in known if not y]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.7 and np.mean([s >= 0.5 for s in clean]) < 0.1


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 9.0), (None, "x", 9.0), (2, "", 9.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels) is None
    assert [r["score"] for r in toxicity.score(docs, None).collect()] == [0.0] * 3
    assert toxicity.accepted(docs, None).columns == docs.columns
    long = toxicity.fit_rows([(f"fine words number {i} here", 0, i) for i in range(40)] + [(f"you utter nitwit {i} go away nitwit", 1, i) for i in range(40)])
    assert toxicity.score_of(long, "some nitwit came by, the nitwit " * 3) > toxicity.score_of(long, "a fine day in the garden " * 3)


def test_toxicity_keeps_texts_that_open_alike(monkeypatch):
    head = "From the archive of the daily herald, all rights reserved by the owners, issue of the last Sunday in the month. "
    rows = [(f"{head}you utter nitwit {i} go away nitwit", 1, i) for i in range(40)] + [(f"{head}fine words number {i} here", 0, i) for i in range(40)]
    model = toxicity.fit_rows(rows)
    assert model is not None
    assert toxicity.score_of(model, head + "you utter nitwit 77 go away nitwit") >= 0.5 > toxicity.score_of(model, head + "fine words number 77 here")
    seen = []
    monkeypatch.setattr(toxicity, "toxic_dictionary", lambda toxic, ordinary: seen.append((len(toxic), len(ordinary))) or b"nitwit")
    # Equal but for case: once for each label; all others stay.
    toxicity.fit_rows([*rows, (rows[0][0].upper(), 1, 90), (rows[0][0], 0, 91)])
    assert seen[-1] == (40, 41)


def test_toxicity_scores_equal_the_plain_form(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("aeiourstlnd") for _ in range(rng.randint(3, 8)))
    rows = [(i, " ".join(rng.choice(["nitwit", "blockhead"]) if i % 3 == 0 and rng.random() < 0.1 else word() for _ in range(rng.randint(20, 200)))) for i in range(150)]
    docs = spark.createDataFrame([*rows, (500, None), (501, "x " * 100_000), (0, rows[0][1])], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    # The same, plainly: every window compressed with both dictionaries, one text at a time.
    ordinary, toxic = toxicity.compressors(model.ordinary, model.toxic)
    for r in toxicity.score(docs, model).collect():
        words = (r["text"] or "").lower().encode().split()
        gains = []
        for i in range(0, len(words), toxicity.WINDOW_WORDS):
            window = b" " + b" ".join(words[i : i + toxicity.WINDOW_WORDS]) + b" "
            gains += [len(ordinary.compress(window[k : k + 1024])) - len(toxic.compress(window[k : k + 1024])) for k in range(0, len(window), 1024)]
        counts = [sum(g >= least for g in gains) for least in toxicity.GAINS]
        row = [1.0, *np.log1p(counts), *np.log1p([100 * c / (len(gains) + 2) for c in counts]), np.log1p(len(gains))]
        assert abs(r["score"] - 1 / (1 + np.exp(-np.clip(np.dot(row, model.weights), -30, 30)))) < 1e-9
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert np.mean([scores[i] > 0.5 for i in range(0, 150, 3)]) > 0.7 and np.mean([scores[i] < 0.5 for i in range(150) if i % 3]) > 0.9


def test_quotes_lead_to_threads(spark):
    rows = [
        (1, 0, "user", "Hello there\nHow do I sort a list?"), (1, 1, "assistant", "> How do I sort a list?\nUse sorted()."), (1, 2, "user", "Another thing."),
        (1, 3, "user", "On Monday X wrote:\n> > How do I sort a list?\n> Use   SORTED().\nThanks"), (1, 4, "a", ">> unknown\nok"), (2, 0, "u", None), (2, 1, "u", "> hello THERE\n no"), (None, 1, "u", "> x"),
    ]
    df = spark.createDataFrame([(*r, "old") for r in rows], "conv_id long, turn long, role string, text string, body string")
    got = {(r["conv_id"], r["turn"]): r for r in quote_links.linked(df).collect()}
    assert [got[1, t]["reply_turn"] for t in range(5)] == [None, 0, None, 1, None]
    assert [got[1, t]["thread_turn"] for t in range(5)] == [0, 0, 2, 0, 4] and got[1, 3]["depth"] == 2
    assert got[1, 3]["body"] == "Thanks" and got[1, 1]["message"] == "<|assistant|>\nUse sorted().\n"
    assert got[2, 1]["reply_turn"] is None and len(got) == len(rows)
    assert quote_links.linked(df.limit(0)).count() == 0
    chain = spark.createDataFrame([(7, i, "u", (f"> line {i - 1}\n" if i else "") + f"line {i}") for i in range(30)], "conv_id long, turn long, role string, text string")
    assert {(r["thread_turn"], r["depth"] - r["turn"]) for r in quote_links.linked(chain).collect()} == {(0, 0)}


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "suffix_dedup", "mixing", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, corpus_pipeline.stored(stage(spark, kept, SF), name)
        assert kept.columns == columns and kept.count() > 0
        if name == "ngram_join":
            listed = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert {r["doc_id"] for r in kept.collect()} == {c for _, _, c in brute.clustered(listed)}
    assert kept.where("n_chars <> length(text)").count() == 0


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline

    rows = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "one two three", None, None, 13), (3, "one two three", None, None, 13), (None, "four five", "de", "t", 9), (4, "long " * 30_000, "en", "s", 150_000), (5, "x", "fr", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"score": F.lit(7.0), "kept": F.lit("c"), "posteriors": F.lit(1)})
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        for some in (docs, docs.limit(0)):
            out = stage(spark, some, SF)
            assert name == "bpe" or out.columns == docs.columns
            got = out.collect()
            assert some is docs or not got
            found.setdefault(name, got)
    ids = lambda name: sorted(str(r["doc_id"]) for r in found[name])
    assert ids("toxicity") == ids("suffix_dedup") == ids("bpe") == ["1", "2", "3", "3", "4", "5", "None"]
    assert ids("ngram_join") == ["1", "2", "3", "4", "5", "None"] and set(ids("mixing")) == {"1", "2", "3", "4", "5", "None"}
    cut = {r["doc_id"]: r for r in found["suffix_dedup"]}
    assert cut[1]["text"] is None and cut[1]["n_chars"] is None and cut[2]["text"] == "" and cut[3]["text"] == "one two three" and cut[4]["text"] == "" and cut[4]["kept"] == "c"
