"""Facts of texts and the joins of them: calls, holders, types, accesses, routes, slices, briefs."""

import random

import pytest
from pyspark.sql import functions as F

from srcgraph.operators import asof, resolve
from srcgraph.operators import extract as X
from srcgraph.operators import search as S

CS = """namespace Shop {
public interface IPrinter {
    int Fmt(int x);
    void Bare();
}
public class Printer : Base<int, string>, IPrinter, Other.Tool {
    public event Changed Done;
    public int Size { get; set; }
    public Printer(int n) { Size = n; }
    public int Fmt(int x) => x.Scale();
    public int Scale() { return Size; }
    public int Bare() { return 0; }
}
public class Till {
    private readonly IPrinter printer;
    private Till other;
    public void Run(List<Printer> all) {
        Log($"total={Fmt(1)} {{x}}", "Fmt(2)"); // Fmt(3)
        printer.Fmt(1); printer.Fmt(1);
        var made = new Printer(1);
        made.Size += Size;
        if (made.Size == 2) { Helper(made
            .Size); }
    }
    public void Twice(string other) { other.Run(null); }
}
}
"""
JS = "class A { b() {\n    return `x ${c(1)} c(2)`;\n  }\n  static d = () => { this.b(); };\n}\nconst c = function(a) { return a; };\n"
PY = "class A:\n    class B:\n        @property\n        def size(self):\n            return f'{tidy(1)}' + 'tidy(2)'\n\ndef tidy(x):\n    return x.size\n"
ROUTES = """public class Api {
    [HttpGet("/a/{id}")]
    [Authorize]
    public int A() { return 1; }
    [Route('/far')]





    public int B() { return 1; }
}
"""


def files(spark, *more):
    rows = [("src/shop.cs", "csharp", CS), ("a.js", "javascript", JS), ("b.py", "python", PY), ("api.cs", "csharp", ROUTES), *more]
    return spark.createDataFrame(rows, "path string, language string, text string")


@pytest.fixture(scope="module")
def facts(spark):
    texts = files(spark)
    defined = X.symbols(texts).persist()
    return texts, defined, X.call_sites(texts, defined).persist()


def test_kinds_bases_and_qualified_names(facts):
    rows = {(r["path"], r["qualified"]): r for r in facts[1].collect()}
    kind = {k: r["kind"] for k, r in rows.items()}
    assert kind["src/shop.cs", "Printer.Printer"] == "constructor" and kind["src/shop.cs", "Printer.Done"] == "event" and kind["src/shop.cs", "Printer.Size"] == "property"
    assert kind["a.js", "A.b"] == "method" and kind["a.js", "A.d"] == "method" and kind["a.js", "c"] == "function"
    assert kind["b.py", "A.B"] == "class" and kind["b.py", "A.B.size"] == "property" and rows["b.py", "A.B.size"]["container"] == "B"
    assert rows["src/shop.cs", "Printer"]["bases"] == ["Base", "IPrinter", "Tool"]


def test_calls_in_interpolated_strings_and_out_of_interfaces(spark, facts):
    got = sorted((r["callee"], r["line"], r["recv"] or "", r["argc"], r["caller"], r["caller_container"]) for r in facts[2].where("caller_path = 'src/shop.cs'").collect())
    assert got == sorted([
        ("Scale", 10, "x", 0, "Fmt", "Printer"), ("Fmt", 18, "", -1, "Run", "Till"), ("Fmt", 19, "printer", 1, "Run", "Till"), ("Fmt", 19, "printer", 1, "Run", "Till"),
        ("Printer", 20, "", 1, "Run", "Till"), ("Run", 25, "other", 1, "Twice", "Till"),
    ])
    assert facts[2].count() == facts[2].select("site_seq").distinct().count()
    assert {(r["callee"], r["argc"], r["caller"]) for r in facts[2].where("caller_path = 'a.js'").collect()} == {("c", -1, "b"), ("b", 0, "d")}
    assert {(r["callee"], r["argc"], r["caller"]) for r in facts[2].where("caller_path = 'b.py'").collect()} == {("tidy", -1, "size")}
    assert {r["name"] for r in X.dead(facts[1], facts[2]).where("path = 'src/shop.cs'").collect()} == {"Bare", "Twice"}
    texts = files(spark).where("path = 'src/shop.cs'")
    every = X.call_sites(texts, X.symbols(texts), X.scanned(texts, everywhere=True))
    assert sorted(r["argc"] for r in every.where("callee = 'Fmt' and line = 18").collect()) == [-1, -1, -1]


def test_declared_types_and_implementors_decide(spark, facts):
    texts, defined, sites = facts
    types = {(r["name"], r["type"]) for r in X.declared_types(texts).where("path = 'src/shop.cs'").collect()}
    assert {("printer", "IPrinter"), ("made", "Printer"), ("all", "List")} <= types
    pairs = resolve.candidates(sites, defined.withColumnRenamed("line", "def_line").drop("language", "at"))
    tiers = {(r["callee"], r["line"], r["recv"], r["container"]): r["tier"] for r in pairs.collect()}
    assert tiers["Fmt", 19, "printer", "Printer"] == resolve.EXACT
    assert tiers["Fmt", 18, None, "Printer"] == resolve.NAME_ONLY
    mixed = spark.createDataFrame([("x.cs", "csharp", "A f; void g(B f) {} C h = new D();"), ("x.vb", "vbnet", "Dim a As Shop.Till\nDim b = New Till()\n"), ("x.ts", "typescript", "let s: Svc = new Svc(); f(a: Num, t?: Text)")], "path string, language string, text string")
    assert {(r["path"], r["name"], r["type"]) for r in X.declared_types(mixed).where("name <> type").collect()} == {("x.vb", "a", "Till"), ("x.vb", "b", "Till"), ("x.ts", "s", "Svc"), ("x.ts", "a", "Num"), ("x.ts", "t", "Text")}


def test_field_accesses(facts):
    got = sorted((r["field"], r["line"], r["enclosing"], r["is_write"]) for r in X.field_accesses(facts[0], facts[1]).where("path = 'src/shop.cs'").collect())
    assert got == sorted([("Size", 9, "Printer", True), ("Size", 11, "Scale", False), ("Size", 21, "Run", True), ("Size", 21, "Run", False), ("Size", 22, "Run", False), ("Size", 23, "Run", False)])
    refs = X.field_refs(X.field_accesses(facts[0], facts[1]), facts[1], "siz").where("path = 'src/shop.cs'").collect()
    assert [r["what"] for r in refs] == ["definition"] + ["read"] * 4 + ["write"] * 2


def test_routes_name_the_next_method_or_what_is_around(facts):
    got = {(r["pattern"], r["handler"], r["handler_line"]) for r in X.routes(facts[0], facts[1]).collect()}
    assert got == {("/a/{id}", "A", 4), ("/far", "Api", 1)}


def test_slices_by_name_and_place(spark):
    more = [("deep/er/shop.cs", "csharp", "public class Z {\n    /// <summary>Counts\n    /// things. Slowly.</summary>\n    [Fast]\n    public int Count() {\n        return 1;\n    }\n}\n"), ("tests/t.cs", "csharp", "public class CountTests {\n    public void Count() { }\n}\n")]
    texts = files(spark, *more)
    defined = X.symbols(texts)
    found = X.peek(defined, texts, "count").collect()
    assert [(r["path"], r["name"], r["first_line"], r["last_line"]) for r in found] == [("deep/er/shop.cs", "Count", 2, 7), ("tests/t.cs", "Count", 2, 2), ("tests/t.cs", "CountTests", 1, 3)]
    assert found[0]["doc"] == "Counts things."
    asked = spark.createDataFrame([("shop.cs:21",), ("er\\shop.cs:6",), ("shop.cs:900",), ("none.cs:1",), ("shop.cs",), ("shop.cs:x",), ("op.cs:1",)], "location string")
    got = {r["location"]: (r["path"], r["name"], r["matched"], r["error"]) for r in X.peek_at(defined, texts, asked).collect()}
    assert got == {
        "shop.cs:21": ("src/shop.cs", "Run", 2, None), "er\\shop.cs:6": ("deep/er/shop.cs", "Count", 1, None), "shop.cs:900": ("src/shop.cs", "Fmt", 2, None), "none.cs:1": (None, None, 0, "no file matches"),
        "shop.cs": (None, None, 0, "expected <path>:<line>"), "shop.cs:x": (None, None, 0, "expected <path>:<line>"), "op.cs:1": ("src/shop.cs", None, 2, "no declaration encloses the line"),
    }


def plain_enclosing(marks, line):
    open_ = [m for m in marks if m[0] <= line and (m[1] == 0 or line <= max(m[1], m[0]))]
    return max(open_, key=lambda m: (m[0], m[2]))[3] if open_ else None


def test_enclosing_and_following_equal_a_plain_search(spark):
    rng, rows, asked = random.Random(5), [], []
    for f in range(6):
        for i in range(60):
            start = rng.randint(1, 400)
            rows.append((f"f{f}", start, rng.choice([0, start, start + rng.randint(0, 8), start + rng.randint(0, 300)]), i, f"m{i}"))
        asked += [(f"f{f}", line) for line in range(0, 760, 7)]
    asked += [("none", 3), ("f0", 5_000_000)]
    marks, places = spark.createDataFrame(rows, "path string, line int, end_line int, at int, name string"), spark.createDataFrame(asked, "path string, line int")
    by_file = {}
    for p, *m in rows:
        by_file.setdefault(p, []).append(tuple(m))
    got = {(r["path"], r["line"]): r["name"] for r in asof.enclosing(places, marks, ["name"]).collect()}
    assert got == {(p, line): plain_enclosing(by_file.get(p, []), line) for p, line in asked}
    ahead = {(r["path"], r["line"]): r["name"] for r in asof.following(places, marks, ["name"], 5).collect()}
    nearest = lambda p, line: min(((m[0], m[2], m[3]) for m in by_file.get(p, []) if line <= m[0] <= line + 5), default=(0, 0, None))[2]
    assert ahead == {(p, line): nearest(p, line) for p, line in asked}


def test_enclosing_grows_with_rows_not_with_their_product(spark):
    n = 10_000
    marks = spark.range(n).select(F.lit("big").alias("path"), (F.col("id") * 3 + 1).cast("int").alias("line"), (F.col("id") * 3 + 3).cast("int").alias("end_line"), F.lit(0).alias("at"), F.col("id").cast("string").alias("name"))
    places = spark.range(3 * n).select(F.lit("big").alias("path"), (F.col("id") + 1).cast("int").alias("line"))
    joined = asof.enclosing(places, marks, ["name"])
    assert joined.where(F.col("name") == F.floor((F.col("line") - 1) / 3).cast("string")).count() == 3 * n
    assert max(len(r["b"]) for r in marks.select(asof._covers(F.col("line").cast("long"), F.lit(asof.LAST).cast("long")).alias("b")).limit(50).collect()) <= asof.LEVELS * 2 * (asof.BASE - 1)


def test_a_question_of_stop_words_gives_no_row(spark, facts):
    texts, defined, _ = facts
    docs = defined.select("sym_seq", F.lit("prints a receipt").alias("doc"))
    ranks = spark.createDataFrame([("fmt", 0.5)], "node string, rank double")
    for question in ("", "the of a", "x y"):
        assert S.brief(defined, texts, docs, ranks, question).count() == 0
    best = S.brief(defined, texts, docs, ranks, "Fmt receipt").orderBy(F.desc("score")).collect()
    assert best[0]["name"] == "Fmt" and best[0]["name_score"] > 0 and all(r["bm25"] > 0 for r in best)
