"""Source texts at size: one scan places calls, sites are dealt by their callee alone, plans stay small."""

import random

import pytest
from pyspark.sql import functions as F
from test_code import files, plain_enclosing

from srcgraph.functions import scan
from srcgraph.functions import text as T
from srcgraph.jobs import code, scratch
from srcgraph.operators import asof, digest, frames, repos, resolve
from srcgraph.operators import extract as X
from srcgraph.operators import names as N


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_sweep_of_a_text_equals_a_plain_search():
    rng = random.Random(7)
    for _ in range(200):
        source = scan.Source("f(1);\n" * 60, "python")
        marks = []
        for i in range(rng.randint(0, 25)):
            line = rng.randint(1, 60)
            marks.append((line, rng.choice([0, line, line + rng.randint(0, 40), max(1, line - 3)]), i, f"m{i}"))
        marks.sort(key=lambda m: (m[0], m[2]))
        source.symbols = [scan.Symbol(name, name, "function", None, line, end, -1, -1, 0, at, "") for line, end, at, name in marks]
        assert [s.caller for s in source.sites()] == [plain_enclosing(marks, s.line) for s in source.calls()]


def test_sites_equal_those_placed_by_joins(spark):
    texts = files(spark)
    defined = X.symbols(texts)
    marks, columns = X.holders(defined, "c")
    got = X.calls(texts).select("caller_path", "line", "site_seq", "caller", "caller_line", "caller_container")
    want = asof.enclosing(got.select(F.col("caller_path").alias("path"), "line", "site_seq"), marks, columns)
    same = got.join(want.drop("line"), "site_seq").where(F.col("caller").eqNullSafe(F.col("c")) & (F.col("caller_line") == F.coalesce("c_line", F.lit(0))) & F.col("caller_container").eqNullSafe(F.col("c_in")))
    assert same.count() == got.count() > 8


def test_a_site_meets_only_the_names_that_are_known(spark):
    # Before, sites met their types and ten blocks of lines each, by joins on their path.
    texts = files(spark)
    facts = scratch.stored(X.scanned(texts), "facts")
    sites = X.call_sites(texts, X.symbols(facts), facts)
    assert plan(sites).count("Join ") == 1 and plan(sites).count("Generate ") == 2
    pairs = resolve.candidates(sites, X.symbols(facts).withColumnRenamed("line", "def_line").drop("language", "at"))
    assert plan(pairs).count("Join ") == 3 and "MapInArrow" not in plan(pairs)


def test_texts_are_made_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(code, "stored", lambda df, name: made.append(name) or scratch.stored(df, name))
    _, sites, pairs = code.resolved(files(spark))
    assert made == ["facts"] and "MapInArrow" not in plan(sites) + plan(pairs)


def test_types_of_a_text(spark):
    assert scan.declared_types("A f; void g(B f) {} C h = new D(); Éa é; list<Foo bar, x> y; \U0001d400b z;", "csharp") == {"é": "Éa", "bar": "Foo", "z": "\U0001d400b"}
    assert scan.declared_types("Dim a As Shop.\nDim b As Shop.Till\n", "vbnet") == {"b": "Till"}
    assert scan.declared_types("a: Num", "generic") == {}
    sites = X.calls(spark.createDataFrame([("a.cs", "csharp", "class A {\n    Till t;\n    void f() { t.g(); u.g(); this.g(); }\n}\n")], "path string, language string, text string"))
    assert [(r["recv"], r["recv_type"]) for r in sites.orderBy("site_seq").select("recv", "recv_type").distinct().orderBy("recv").collect()] == [("t", "Till"), ("this", None), ("u", None)]


@pytest.mark.parametrize("most", [12_000])
def test_plans_of_blocks_stay_small(spark, most):
    marks = spark.createDataFrame([("a", 1, 9, 0, "m")], "path string, line int, end_line int, at int, name string")
    assert len(asof.enclosing(marks.select("path", "line"), marks, ["name"])._jdf.queryExecution().analyzed().toString()) < most


def test_calls_are_dealt_once_for_all_steps(spark):
    rows = [("a.cs", "csharp", "class A {\n    void low() { }\n    void mid() { low(); }\n    void top() { mid(); }\n}\n"), ("tests/t.cs", "csharp", "class T {\n    void check() { top(); unknown(); }\n}\n")]
    texts = spark.createDataFrame(rows, "path string, language string, text string")
    defined = X.symbols(texts)
    found = lambda sites: {(r["name"], r["depth"], r["via"]) for r in digest.covering_tests(sites, defined, "low").collect()}
    assert found(X.calls(texts)) == found(X.call_sites(texts, defined)) == {("check", 3, "top")}
    edges = scratch.bucketed(spark.range(100).select((F.col("id") % 7).cast("string").alias("src"), "id"), ["src"], "edges")
    met = edges.hint("merge").join(spark.range(7).select(F.col("id").cast("string").alias("src")), "src")
    assert met._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1 and met.count() == 100


def test_pairs_of_calls_and_routes_are_not_shuffled(spark):
    calls = spark.range(60).select(F.lit("shop").alias("repo"), F.col("id").cast("string").alias("caller"), F.lit("c").alias("path"), F.lit(1).alias("line"), F.lit("/a/b").alias("url"), F.array(F.lit("a"), F.lit("b")).alias("tokens"))
    routes = spark.range(40).select(F.lit("api").alias("repo"), F.col("id").cast("string").alias("target"), F.lit("r").alias("path"), F.lit(1).alias("line"), F.lit("/b/c/a").alias("route"), F.array(F.lit("b"), F.lit("c"), F.lit("a")).alias("tokens"))
    # Rows that say the same count once; the words of both of a route's rows count.
    found = repos.suggested(calls.unionByName(calls), routes.unionByName(routes.withColumn("tokens", F.array(F.lit("z")))))
    assert found.count() == 2400 and {tuple(r["evidence"]) for r in found.select("evidence").distinct().collect()} == {("a", "b")}
    assert not plan(found).startswith("Aggregate")  # before, each pair went through an exchange


def test_names_are_keyed_once_for_all_steps(spark):
    names = spark.createDataFrame([("LoadOrder",), ("order12x",), ("x",), ("orders",), ("é",), ("",)], "name string")
    asked = spark.createDataFrame([("o",), ("order",), ("Order-1",), ("orders2",), ("x",), ("12x",), ("loadorderx",), ("",)], "query string")
    want = {(n["name"], q["query"]) for q in asked.collect() for n in names.where(T.matches(F.col("name"), q["query"])).collect()}
    found = N.matching(names, asked, "name", "query")
    assert {(r["name"], r["query"]) for r in found.collect()} == want and len(want) > 8
    keyed = N.by_suffix(names, "name", [])
    assert keyed.count() == 7  # before, one row for each of a suffix's first letters


def test_frames_are_looked_up_by_method_and_path(spark):
    rows = spark.createDataFrame([("t", i, "A.low", "a.cs", i) for i in range(1, 9)] + [("t", 9, "A.low", None, 3), ("t", 9, None, None, None)], "trace_id string, line_no int, method string, path string, line int")
    defined = X.symbols(spark.createDataFrame([("a.cs", "csharp", "class A {\n    void low() {\n    }\n}\n")], "path string, language string, text string"))
    found = frames.resolve_frames(rows, defined)
    assert sorted((r["line_no"], r["status"], r["drift"]) for r in found.collect()) == [(i, "project", i not in (2, 3)) for i in range(1, 9)] + [(9, "project", False), (9, "unresolved", False)]
    assert not any("trace_id" in line for line in plan(found).splitlines() if "Aggregate" in line)


def test_only_identifiers_that_match_leave_their_text(spark):
    rows = [("a.cs", "csharp", "class A {\n    void p_17() { }\n    void q() { p_17(); xp17(); P17b(); $p17(); other(); }\n}\n"), ("b.cs", "csharp", "class B { }\n")]
    texts = spark.createDataFrame(rows, "path string, language string, text string")
    found = digest.digest(texts, X.symbols(texts), "p17")
    assert [(r["path"], r["defs"], r["refs"], r["entry"]) for r in found.collect()] == [("a.cs", 1, 4, True)]
    assert "contains" in plan(found).lower()
    assert "calls" not in X.symbols(texts)._jdf.queryExecution().analyzed().toString()  # sites are not made for symbols
