"""Names of two tables, several repositories, communities, coupling."""

import itertools
import random
import re

from srcgraph.jobs import linked
from srcgraph.operators import names as N
from srcgraph.operators import repos as P
from srcgraph.operators import walk as W


def suffixes(name):
    tokens = [t.lower() for t in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", name)]
    return ["".join(tokens[i:]) for i in range(len(tokens))]


def test_matching_equals_a_nested_loop(spark):
    rng = random.Random(3)
    words = ["get", "Order", "HTTP", "x", "Line2", "total", "Sum", "of", "GetOrder"]
    names = sorted({"".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(120)} | {"", "_"})
    queries = sorted({"".join(rng.choice(words) for _ in range(rng.randint(1, 3)))[: rng.randint(1, 14)] for _ in range(80)} | {"", "--", "get_order", "GETORDERX"})
    got = {(r["name"], r["query"]) for r in N.matching(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(q,) for q in queries], "query string"), "name", "query").collect()}
    plain = lambda q: re.sub("[^A-Za-z0-9]", "", q).lower()
    assert got == {(n, q) for n, q in itertools.product(names, queries) if plain(q) and any(s.startswith(plain(q)) for s in suffixes(n))}
    exact = {(r["name"], r["query"]) for r in N.matching_exactly(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(q,) for q in queries], "query string"), "name", "query").collect()}
    assert exact == {(n, q) for n, q in itertools.product(names, queries) if plain(q) and suffixes(n) and suffixes(n)[0] == plain(q)}


def test_roots_and_labels(spark):
    rows = [("g", "a/b/c/x.py"), ("g", "a/b/d/y.py"), ("g", "a\\b\\z.py"), ("one", "k/only.py"), ("none", "p.py"), ("none", "q/r.py"), ("same", "m/n/o.py"), ("same", "m/n/o.py"), ("e", None), ("e", "")]
    got = {r["by"]: r["root"] for r in N.common_root(spark.createDataFrame(rows, "by string, path string"), "path", ["by"]).collect()}
    assert got == {"g": "a/b", "one": "k", "none": "", "same": "m/n"}
    paths = ["a/x.py", "b/x.py", "b/y.py", "c/b/x.py", "z.py", None, "x.py"]
    labels = {r["path"]: r["label"] for r in N.labels(spark.createDataFrame([(p,) for p in paths], "path string"), "path").collect()}
    assert labels == {"a/x.py": "a/x.py", "b/x.py": "b/x.py", "b/y.py": "y.py", "c/b/x.py": "c/b/x.py", "z.py": "z.py", "x.py": "x.py"}


def clique(names):
    return [(a, b, 1.0) for a, b in itertools.combinations(names, 2)]


def test_communities_of_cliques(spark):
    two = clique("abcd") + clique("efgh") + [("d", "e", 1.0)]
    got = {r["node"]: r["community"] for r in W.communities(spark.createDataFrame(two, "a string, b string, weight double")).collect()}
    assert got == {**dict.fromkeys("abcd", "a"), **dict.fromkeys("efgh", "e")}
    ring = [(f"{k:02}{a}", f"{k:02}{b}", w) for k in range(6) for a, b, w in clique("abcde")] + [(f"{k:02}a", f"{(k + 1) % 6:02}b", 1.0) for k in range(6)]
    edges = spark.createDataFrame(ring, "a string, b string, weight double")
    found = W.communities(edges)
    assert {r["node"]: r["community"] for r in found.collect()} == {f"{k:02}{c}": f"{k:02}a" for k in range(6) for c in "abcde"}
    stats = {r["community"]: (r["size"], r["weight"]) for r in W.community_stats(edges, found).collect()}
    assert stats == {f"{k:02}a": (5, 10.0) for k in range(6)}
    assert W.communities(spark.createDataFrame([], "a string, b string, weight double")).count() == 0


def test_communities_are_no_worse_than_label_propagation(spark):
    rng = random.Random(8)
    edges = [(a, b, 1.0) for a, b in itertools.combinations(range(60), 2) if rng.random() < (0.5 if a // 15 == b // 15 else 0.03)]
    df = spark.createDataFrame(edges, "a long, b long, weight double")
    own = W.modularity(df, W.communities(df).withColumnRenamed("community", "label"))
    assert own >= W.modularity(df, W.label_propagation(df)) - 1e-9 and own > 0.4


def test_traces_cross_links_and_stop(spark):
    calls = spark.createDataFrame([("a", "Run", "saveAll", False), ("a", "saveAll", "Run", False), ("a", "Tests", "Run", True), ("b", "SaveHandler", "store", False), ("a", None, "Run", False)], "repo string, caller string, callee string, is_test boolean")
    links = spark.createDataFrame([("a", "saveAll", "b", "SaveHandler"), ("b", "store", "gone", "x"), ("b", "store", "a", "Run")], "from_repo string, from_symbol string, to_repo string, to_symbol string")
    seeds = spark.createDataFrame([("a", "run")], "repo string, name string")
    rows = P.cross_trace(calls, links, seeds, 4).collect()
    got = {(tuple(f"{x['repo']}:{x['name']}" for x in r["path"]), r["crossed"], r["is_cycle"], r["error"]) for r in rows}
    base = ("a:run", "a:saveAll")
    assert got == {
        (("a:run",), False, False, None), (base, False, False, None), ((*base, "a:Run"), False, False, None), ((*base, "b:SaveHandler"), True, False, None), ((*base, "a:Run", "a:saveAll"), False, True, None),
        ((*base, "b:SaveHandler", "b:store"), False, False, None), ((*base, "b:SaveHandler", "b:store", "gone:x"), True, False, "unknown repository gone"), ((*base, "b:SaveHandler", "b:store", "a:Run"), True, False, None),
    }
    up = P.cross_trace(calls, links, spark.createDataFrame([("b", "store")], "repo string, name string"), 2, up=True).collect()
    assert {tuple(x["name"] for x in r["path"]) for r in up} == {("store",), ("store", "SaveHandler"), ("store", "SaveHandler", "saveAll")}
    assert P.cross_trace(calls, links, seeds.limit(0), 2).count() == 0


def test_links_are_suggested_by_shared_words(spark):
    from srcgraph.operators import extract as X

    rows = [
        ("shop/a.ts", "shop", "typescript", "class A {\n  load() {\n    fetch('/api/orders/42?x=1');\n    axios.get(\"/v1/\");\n  }\n}\nfetch('/orders/free');\n"),
        ("api/o.py", "api", "python", "@app.get('/orders/{id}/lines')\ndef order(id):\n    return id\n\n@app.post('/items')\ndef item():\n    return 1\n"), ("shop/b.py", "shop", "python", "@app.get('/orders')\ndef own():\n    return 1\n"),
    ]
    files = spark.createDataFrame(rows, "path string, repo string, language string, text string")
    defined = X.symbols(files)
    got = {(r["from_symbol"], r["from_line"], r["to_repo"], r["to_symbol"], tuple(r["evidence"])) for r in P.suggested(P.outbound(files, defined), P.served(files, defined)).collect()}
    assert got == {("A.load", 3, "api", "order", ("orders",))}


def test_coupling_counts_the_first_other_file(spark):
    defined = spark.createDataFrame([("f", "b"), ("f", "a"), ("f", "c"), ("g", "a"), ("h", "b")], "name_l string, path string")
    sites = spark.createDataFrame([("f", "a", "m", False), ("f", "b", "m", False), ("f", "b", "m", False), ("g", "a", "m", False), ("h", "a", None, False), ("h", "a", "m", True), ("h", "c", "m", False)], "callee_l string, caller_path string, caller string, caller_is_test boolean")
    assert {tuple(r) for r in linked.file_coupling(sites, defined).collect()} == {("a", "b", 3), ("b", "c", 1)}


def test_digests_summaries_and_decisions(spark):
    from srcgraph.operators import digest as D
    from srcgraph.operators import extract as X

    cs = "// Keeps orders. More text.\nusing System.Linq;\nusing A = Shop.Core;\npublic class Order {\n    public int Total(int a) { return getTotal(a) + Sum; }\n    public int Sum { get; set; }\n}\n"
    py = '"""Totals of a day."""\nimport os, sys\nfrom json import loads\n\ndef get_total(x):\n    return x\n'
    rows = [("src/Order.cs", "csharp", cs), ("day.py", "python", py), ("tests/test_total.py", "python", "from day import get_total\n\ndef test_total():\n    get_total(1)\n"), ("e.py", "python", "")]
    files = spark.createDataFrame(rows, "path string, language string, text string")
    defined = X.symbols(files)
    got = {r["path"]: (r["defs"], r["refs"], r["purpose_only"], r["entry"]) for r in D.digest(files, defined, "total", D.purposes(files)).collect()}
    assert got == {"src/Order.cs": (1, 2, False, True), "day.py": (1, 2, False, True), "tests/test_total.py": (1, 3, False, False)}
    assert {r["path"]: r["purpose"] for r in D.purposes(files).collect()} == {"src/Order.cs": "Keeps orders.", "day.py": "Totals of a day."}
    assert {(r["path"], r["dependency"]) for r in D.dependencies(files).collect()} == {("src/Order.cs", "System.Linq"), ("src/Order.cs", "Shop.Core"), ("day.py", "os"), ("day.py", "json"), ("tests/test_total.py", "day")}
    text = {r["path"]: r["summary"] for r in D.summaries(files, defined).collect()}
    assert text["src/Order.cs"].split("\n")[1:] == ["Keeps orders.", "class Order L4", "method Order.Total L5", "property Order.Sum L6", "uses Shop.Core, System.Linq"] and text["e.py"] == "e.py: python, 1 tokens"
    assert {r["name"] for r in D.definitions(defined, "total").collect()} == {"Total", "get_total"} and {r["name"] for r in D.definitions(defined, "gettotal", exact=True).collect()} == {"get_total"}
    records = spark.createDataFrame([(1, ["CaseProcessor"]), (2, ["other", "Case"]), (3, [])], "id int, affects array<string>")
    asked = spark.createDataFrame([("HandleCaseProcessor",), ("proc",), ("",)], "query string")
    assert {tuple(r) for r in D.concerning(records, asked).collect()} == {(1, "HandleCaseProcessor"), (2, "HandleCaseProcessor"), (1, "proc")}


def test_tests_that_reach_a_symbol_and_their_command(spark):
    from srcgraph.operators import digest as D
    from srcgraph.operators import extract as X

    rows = [
        ("src/a.py", "python", "def save():\n    return 1\n\ndef mid():\n    save()\n"),
        ("tests/test_a.py", "python", "def test_near():\n    save()\n\ndef helper():\n    mid()\n\ndef test_far():\n    helper()\n    mid()\n"),
        ("tests/b.test.ts", "typescript", "function other() {\n  nothing();\n}\n"),
        ("src/Worker.cs", "csharp", "public class W {\n    public void Lonely() { }\n}\n"),
    ]
    files = spark.createDataFrame(rows, "path string, language string, text string")
    defined = X.symbols(files)
    sites = X.call_sites(files, defined)
    found = D.covering_tests(sites, defined, "save")
    assert {(r["name"], r["depth"], r["via"]) for r in found.collect()} == {("test_near", 1, "save"), ("helper", 2, "mid"), ("test_far", 2, "mid")}
    assert D.test_command(found).collect()[0]["command"] == 'python -m pytest -k "test_near or helper or test_far"'
    assert D.test_command(found.limit(0)).count() == 0
    assert {r["name"] for r in X.dead(defined, sites).collect()} == set()
