"""Repeated rows, empty tables and sparse links of operators."""

import random

import brute
import brute3
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from srcgraph.llm import embedding_dedup, html_text, media, mixing, ngram_join, queries, spelling, suffix_dedup, toxicity, url_filter


@pytest.fixture(scope="module")
def model(spark):
    return url_filter.fit(url_filter.labelled_urls(spark))


def test_repeated_urls_are_judged_alike(spark, model):
    urls = ["https://www.casino-royal.example/x", "http://Library.COM/en/1", None, "no scheme", "http://a.net/es/", "x://" + "y" * 50_000]
    rows = [(i, u, "old", 1.0) for u in urls for i in range(3)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, host string, junk_probability double"), model).collect()
    assert len(got) == len(rows)
    for u in urls:
        assert len({(r["host"], r["path"], r["rule"], r["verdict"], r["junk_probability"]) for r in got if r["url"] == u}) == 1
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), model).count() == 0


def test_empty_tables_give_empty_results(spark, model):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, n_bytes long, score double")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert media.media_features(media.to_media(docs, ["doc_id"]), ["doc_id", "n_bytes"]).count() == 0
    assert html_text.extract_pages(spark.createDataFrame([], "page_id long, html string, text string"), ["page_id"]).count() == 0
    assert mixing.mixed(docs, docs.select("text", F.col("lang").alias("domain")), queries.MIX, ["doc_id"]).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 0
    assert ngram_join.clustered(docs).count() == 0 and suffix_dedup.removed(docs.select("doc_id", "text")).count() == 0
    assert spelling.grouped(spelling.count_words(docs)).count() == 0


def sparse(count, pairs, seed):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=32) for _ in range(count)]
    for k in range(pairs):
        rows[count - 1 - k] = rows[k * 7] + 0.1 * rng.normal(size=32)
    return [(i, v.astype(np.float32).astype(float).tolist()) for i, v in enumerate(rows)]


@pytest.mark.parametrize("pairs", [40, 0])
def test_sparse_links_are_found_and_recall_is_measured_or_null(spark, monkeypatch, pairs):
    monkeypatch.setattr(embedding_dedup, "SHARD", 200)
    monkeypatch.setattr(embedding_dedup, "MAX_SHARD", 400)
    rows = sparse(1500, pairs, 3)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label string").repartition(4)
    got = embedding_dedup.deduplicated(df).collect()
    want = brute.linked_vectors(rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want
    assert {r["audit_recall"] for r in got} == ({1.0} if pairs else {None})
    assert sum(n for n, _ in want.values()) >= 2 * pairs


def test_posteriors_fit_what_a_plain_descent_fits(spark):
    """Rates against projected gradient in plain Python on the same posteriors."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mixed(docs, queries.labelled_domains(spark, SF, docs), queries.MIX, ["doc_id"]).collect()
    tokens, posteriors = np.array([r["n_tokens"] for r in got], float), np.array([r["posteriors"] for r in got])
    shares = tokens @ posteriors
    domains = sorted({r["domain"] for r in got})
    weights = np.array([queries.MIX.get(d, 0) for d in domains])
    if posteriors.shape[1] != len(domains):
        pytest.skip("a labelled domain is nobody's likeliest one")
    wanted = weights * max(s / w for s, w in zip(shares, weights, strict=True) if w)
    rates = np.ones(len(got))
    for _ in range(400):
        errors = (tokens * rates) @ posteriors - wanted
        rates = np.maximum(0, rates - posteriors @ (errors / shares))
    assert np.allclose([r["rate"] for r in got], rates, atol=1e-3)
    assert {r["target_error"] for r in got} == {got[0]["target_error"]} and got[0]["target_error"] < 1e-4
    assert np.allclose((tokens * rates) @ posteriors, wanted, rtol=1e-3)


def test_words_of_random_letters_equal_brute_force(spark):
    rng = random.Random(12)
    base = ["".join(rng.choice("abcdeéü") for _ in range(rng.randint(6, 9))) for _ in range(60)]
    text = [" ".join(w if rng.random() < 0.6 else w[:2] + rng.choice("abé") + w[3:] for w in rng.choices(base, k=200)) for _ in range(30)]
    rows = list(enumerate(text))
    made = spelling.grouped(spelling.count_words(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), changed=31)).collect()
    assert {r["word"]: tuple(r)[1:] for r in made} == brute3.variants(brute3.counted(rows))


def test_pages_are_laid_out_by_their_own_rules():
    text = html_text.extract
    style = "<style>/* .a{} */ .h, p.x { color:red; DISPLAY : none } #only{display:none!important} @media print { .a{display:none} } .h.on{display:block} div p{display:none}</style>"
    assert text(f"{style}<p class='h'>1</p><p class='a'>2</p><p class='x'>3</p><div class='h on'>4</div><b id=only style='display:inline'>5</b><p class=h style='display:block'>6</p><div><p>7</p></div>") == "2\n\n4\n\n6\n\n7"
    assert text("<details><summary>Head</summary>body<p>more</p></details><details open><summary>Two</summary>shown</details>") == "Head\nTwo\nshown"
    assert text("<ol reversed><li>a<li>b<li hidden>x<li>c</ol><ol reversed start=9><li>d<li>e</ol>").split("\n") == ["3. a", "2. b", "1. c", "", "9. d", "8. e"]
    table = "<table><tr><th>Name<th>Parts<th>N<tr><td>car<td><ul><li>wheel<li>door</ul><td>2<tr><td>a<br>b<td>plain<p>text</p><td>1</table>"
    assert text(table).split("\n") == ["Name | Parts      | N", "car  | - wheel    | 2", "     | - door", "a    | plain text | 1", "b"]
    deep = "<table><tr><td>" * 400 + "x" + "</table>" * 400
    assert text(deep).strip(" |-") == "x"


def test_layout_equals_a_plain_renderer():
    """Pages of nested blocks and lists, made with their layout at hand."""
    rng = random.Random(9)
    for _ in range(60):
        markup, want = [], []
        for _ in range(rng.randint(1, 6)):
            kind = rng.choice(["p", "ul", "ol", "table", "pre"])
            words = [[f"w{rng.randrange(999)}" for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 4))]
            if kind == "p":
                markup.append(f"<p>{'  '.join(words[0])}")
                want.append([" ".join(words[0])])
            elif kind in ("ul", "ol"):
                markup.append(f"<{kind}>" + "".join(f"<li>{' '.join(w)}" for w in words) + f"</{kind}>")
                want.append([(f"{i + 1}. " if kind == "ol" else "- ") + " ".join(w) for i, w in enumerate(words)])
            elif kind == "pre":
                markup.append("<pre>" + "\n".join("  ".join(w) for w in words) + "</pre>")
                want.append(["  ".join(w) for w in words])
            else:
                rows = [[w[0], w[-1] * 2] for w in words]
                markup.append("<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in r) for r in rows) + "</table>")
                wide = max(len(r[0]) for r in rows)
                want.append([f"{r[0].ljust(wide)} | {r[1]}" for r in rows])
        assert html_text.extract("".join(markup)) == "\n\n".join("\n".join(block) for block in want), "".join(markup)


def plain_crc(bits):
    value = 0xFFFF
    for bit in bits:
        top = value >> 15 ^ bit
        value = (value << 1) & 0xFFFF
        value ^= 0x8005 if top else 0
    return value


@pytest.mark.parametrize(("second", "index", "mode", "bits"), [
    (0xFE, 8, 0, 256), (0xFE, 8, 3, 128), (0xFE, 8, 0x40 >> 6 | 0, 4 * (4 + 32)), (0xFC, 10, 3, None), (0xFC, 10, 0, None), (0xFC, 2, 3, None), (0xF4, 8, 3, None),
])
def test_checksums_of_layers_one_and_two(second, index, mode, bits):
    rng = random.Random(second + index + mode)
    word = bytes((0xFF, second, index << 4 | 1 << 2, mode << 6))
    h = media.header(word)
    assert h.protected and h.layer in (1, 2)
    frames = []
    for _ in range(5):
        body = rng.randbytes(h.size - 6)
        flat = [b >> k & 1 for b in word[2:] + body for k in range(7, -1, -1)]
        count = media.covered_bits(h, body)
        assert bits is None or count == bits
        frames.append(word + plain_crc(flat[: 16 + count]).to_bytes(2) + body)
    found = media.read_stream(b"".join(frames))
    assert (found.checked, found.bad, len(found.offsets), found.samples) == (5, 0, 5, 5 * h.samples)
    wrong = bytearray(b"".join(frames))
    wrong[h.size + 6] ^= 0x80
    assert media.read_stream(bytes(wrong)).bad == 1


def test_allocation_of_layer_two_is_counted_by_hand():
    # 48 kHz mono at 160 kbit/s: 11 subbands of 4 bits, 12 of 3, 4 of 2; nothing chosen, then all.
    h = media.header(bytes((0xFF, 0xFC, 9 << 4 | 1 << 2, 0xC0)))
    assert media.covered_bits(h, bytes(200)) == 44 + 36 + 8 and media.covered_bits(h, b"\xff" * 200) == 88 + 2 * 27


def test_tables_tags_and_free_format():
    word = bytes((0xFF, 0xFB, 9 << 4, 0xC0))
    size = media.header(word).size
    vbri = b"VBRI" + (1).to_bytes(2) + bytes(4) + (9000).to_bytes(4) + (3).to_bytes(4) + (2).to_bytes(2) + (1).to_bytes(2) + (2).to_bytes(2) + (1).to_bytes(2) + b"abcd"
    head = (word + bytes(32) + vbri).ljust(size, b"\0")
    found = media.read_stream(head + 3 * word.ljust(size, b"\1"))
    assert found.vbr == (3, 9000, b"abcd") and len(found.offsets) == 3
    text = b"\0k\0" + b"v\xff\x00w" * 40
    frame = b"TXXX" + media._syncsafe(len(text)) + b"\0\x02" + text
    tag = b"ID3\x04\0\x00" + media._syncsafe(len(frame)) + frame
    assert media.read_stream(tag + word.ljust(size, b"\1")).tags == {"k": "v\xffw" * 40}
    old = b"TXXX" + len(b"\0k\0v\xffw").to_bytes(4) + b"\0\0" + b"\0k\0v\xff\x00w"
    assert media.read_stream(b"ID3\x03\0\x80" + media._syncsafe(len(old)) + old + word.ljust(size, b"\1")).tags == {"k": "v\xffw"}
    free = bytes((0xFF, 0xFB, 0, 0xC0))
    got = media.read_stream(b"".join(free.ljust(500, b"\2") for _ in range(4)))
    assert got.offsets == [0, 500, 1000, 1500] and got.samples == 4 * 1152 and got.skipped == 0
