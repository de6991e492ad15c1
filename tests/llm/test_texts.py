"""URL filter, BPE, media and HTML against plain versions, libraries and round trips."""

import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
from conftest import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from srcgraph.llm import bpe, html_text, media, queries, url_filter

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", " ", "Hello wörld's  ΑΣ end", "<|endoftext|>x<|startoftext|>", "a" * 9000, "é" * 5000, "İstanbul Å Å \u200b\u2028 x", "it's we'll 42 ½ 中文 😀😀", "\x1c a\x1f b\x85c", "the" * 3000]


def docs(spark, extra=()):
    rows = [(i, t, "en", 1) for i, t in enumerate(TEXTS)] + [(100, None, None, None), (None, "x y", "en", 2), (0, "", "en", 1), *extra]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens long")


# URL filter


def plain_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for kind, rule in url_filter.RULES:
        domain, start = rule.split("/", 1)
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[1])):
            best = kind, rule
    return host, path, best


@pytest.fixture(scope="module")
def model(spark):
    return url_filter.fit(url_filter.labelled_urls(spark))


def test_hosts_paths_and_rules_equal_the_plain_form(spark, model):
    urls = ["http://EXAMPLE.com/en/x", "https://www.example.com/en/1?q", "http://a.net/es/", "http://net/fr/#x", "http://b.org", "http://notexample.com/en/", "nope", None, "", "://x/y", "http://c.com", "x://y://z/p", "http://ÄB.com/Ü?ü", "http://d.net/ES/"]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    for r in url_filter.judge(df, model).collect():
        host, path, best = plain_url(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[1])
        assert r["verdict"] == (best[0] if best else "block" if r["junk_probability"] >= 0.5 else "allow")
    assert url_filter.judge(df.limit(0), model).count() == 0


def test_names_decide_where_no_rule_does(spark, model):
    urls = {"https://www.cheap-pills.example.org/en/1": "block", "http://casino-bonus.example.net/de/7.html": "block", "https://blog.gardening-school.example.org/en/1": "allow", "http://m.riverbank.example.net/de/9": "allow"}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r["url"]: r["verdict"] for r in url_filter.judge(df, model).collect()} == urls
    plan = queries.op1_url_filter(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert queries.op1_url_filter(spark, SF).count() == spark.read.parquet(f"{SF}/pages.parquet").count()


# BPE


def random_texts(n=300):
    rng = random.Random(4)
    letters = "".join(map(chr, [*range(9, 127), 0x85, 0xA0, 0x3A3, 0x130, 0x300, 0x301, 0x308, 0xE9, 0xDF, 0x4E2D, 0x1F600, 0x2028, 0x200B, 0x660, 0x1C5, 0x212B]))
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(n)] + ["".join(rng.choice("abcdeinrst") for _ in range(12_000))]


def test_ids_and_text_equal_the_library():
    machine, library = bpe.transducer(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    for text in TEXTS + random_texts():
        want = library.encode(text, add_special_tokens=False).ids
        ids: list = []
        n, ids_hash, text_hash = bpe.digests(machine, text, ids)
        decoded = library.decode(want, skip_special_tokens=False)
        assert ids == want == machine.encode(text) and n == len(want)
        assert machine.decode(want) == decoded
        assert ids_hash == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest() and text_hash == hashlib.sha256(decoded.encode()).hexdigest()


def test_windows_make_no_difference(monkeypatch):
    machine = bpe.Transducer(VOCABULARY)
    word = "".join(random.Random(5).choice("aeinrst") for _ in range(6000))
    whole = list(machine.tokens(word))
    monkeypatch.setattr(bpe, "WINDOW", 100)
    assert list(machine.tokens(word)) == whole


def test_lookahead_is_a_chain_over_the_merges():
    assert bpe.lookahead([("a", "b")], "") == 2
    assert bpe.lookahead([("b", "c"), ("a", "b")], "") > bpe.lookahead([("b", "c")], "")


def test_split_characters_wait():
    assert "".join(bpe.incremental_text([b"\xc3", b"\xa9x", b"\xf0\x9f", b"\x98\x80"])) == "éx😀"


def test_bpe_rows(spark):
    got = bpe.encode_digests(docs(spark), VOCABULARY, ["doc_id"]).collect()
    assert len(got) == len(TEXTS) + 3
    assert {r["n_tokens"] for r in got if r["doc_id"] in (0, 100)} == {0}
    assert bpe.encode_digests(docs(spark).limit(0), VOCABULARY, ["doc_id"]).count() == 0


# Media


def test_streams_are_lossless_for_any_bytes():
    rng = random.Random(6)
    for n in (0, 1, 63, 64, 65, 936, 937, 938, 5000, 200_000):
        data = media.padded(rng.randbytes(n))
        found = media.read_stream(media.write_stream(data))
        assert media.payload_of(found) == data and not found.bad and not found.skipped
        assert found.vbr[0] == len(found.offsets) and found.samples == 1152 * len(found.offsets)


def test_damage_is_found_and_passed_over():
    stream = media.write_stream(media.padded(b"x" * 6000))
    whole = media.read_stream(stream)
    at = whole.offsets[2]
    flipped = bytearray(stream)
    flipped[at + 8] ^= 1
    assert media.read_stream(bytes(flipped)).bad == 1
    torn = media.read_stream(stream[:at] + b"noise\xff\xfb" + stream[at + 1 :])
    assert torn.skipped > 0 and len(torn.offsets) == len(whole.offsets) - 1
    assert media.read_stream(b"no audio at all").offsets == [] and media.read_stream(b"").samples == 0


def test_headers_of_other_versions():
    assert media.header(bytes((0xFF, 0xFB, 0x90, 0x00))).size == 417  # 128 kbit/s, 44.1 kHz
    assert media.header(bytes((0xFF, 0xF3, 0x80, 0xC0))).samples == 576
    assert media.header(b"\xff\xff\xff\xff") is None


def test_media_rows(spark):
    got = media.media_features(media.to_media(docs(spark), ["doc_id"]), ["doc_id", "n_bytes"]).collect()
    for r in got:
        if r["doc_id"] is not None:
            data = media.padded((TEXTS + [""] * 100)[r["doc_id"]].encode())
            assert (r["payload_sha256"], r["tail_crc32"], r["payload_bytes"]) == (hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(data))
    assert len(got) == len(TEXTS) + 3


# HTML


CASES = {
    "": "",
    "plain &amp; simple": "plain & simple",
    "<p>a<p>b": "a\n\nb",
    "<p>a<div>b</div>c": "a\n\nb\nc",
    "a<br>b<br/>c": "a\nb\nc",
    "<head><title>t</title><style>p{}</style></head><body>x<script>var a='</p>'</script>y": "xy",
    "<ul><li>a<li>b<ul><li>c</ul></ul><ol start=3><li>d</ol>": "- a\n- b\n  - c\n\n3. d",
    "<table><tr><th>n<th>value<tr><td>alpha<td>1</table>": "n     | value\nalpha | 1",
    "<table><td>x<td>y<tr><td colspan=2>wide one<tr><td>z</table>": "x | y\nwide one\nz",
    "<pre>a\n  b</pre>": "a\n  b",
    "<p hidden>no</p><p style='DISPLAY : none'>no</p><p style='color:red'>yes</p><input type=hidden value=q>": "yes",
    "<b>x<i>y</b>z</i>": "xyz",
    "<!-- c -->a<!-- open": "a",
    "a<": "a<",
    "<p>one   two\n three</p>": "one two three",
    "</p>x</div>": "x",
    "<textarea><b>t</b></textarea>": "<b>t</b>",
    "<dl><dt>k<dd>v<dt>l<dd>w</dl>": "k\n  v\nl\n  w",
    "<select><option>a<option>b</select>": "a\nb",
    "<blockquote>q</blockquote>r": "  q\n\nr",
    "a<!-->b<p>c": "ab\n\nc",
    "a<!--->b": "ab",
    "a<!-- x --!>b<p>c": "ab\n\nc",
    "<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>": "yes",
    "<div style='display:none'>no<b style='visibility:visible'>no</b></div>x": "x",
    "<table style='visibility:hidden'><tr><td>no<td style='visibility:visible'>yes</table>": " | yes",
    "<table><tr><td rowspan=2>aa<td>b<tr><td>c<tr><td>d<td>e</table>": "aa | b\n   | c\nd  | e",
    "<ol><li value=7>x<li>y</ol>": "7. x\n8. y",
}


@pytest.mark.parametrize("markup", CASES)
def test_layout(markup):
    assert html_text.extract(markup) == CASES[markup]


def test_all_visible_words_come_out_in_order(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        bare = re.sub(r"(?s)<!--.*?-->|<(script|style|title)\b.*?</\1>|<head\b.*?</head>", " ", r["html"])
        words = re.sub(r"(?s)<[^>]*>", " ", bare)
        want = html_text.html.unescape(words).split()
        got = [w for w in html_text.extract(r["html"]).split() if w not in ("-", "|")]
        assert "".join(got) == "".join(w for w in want if w not in ("-", "|"))


def test_deep_and_long_pages():
    assert html_text.extract("<div>" * 50_000 + "x") == "x"
    assert html_text.extract("<table><tr><td>" * 400 + "x").endswith("x")
    assert len(html_text.extract("<p>" + "w " * 300_000)) == 599_999


def test_html_rows(spark):
    got = html_text.extract_pages(spark.createDataFrame([(1, None, "a"), (None, "<p>x", "b"), (1, None, "a")], "page_id long, html string, text string"), ["page_id"]).orderBy(F.col("n_chars")).collect()
    assert [r["text"] for r in got] == ["", "", "x"]
