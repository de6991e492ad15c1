from pyspark.sql import functions as F

from srcgraph.operators import extract as X
from srcgraph.sources import tree
from srcgraph.streaming import ingest

CS = """namespace Post {
public class Sorter : Machine {
    private readonly Belt belt;
    public int Speed { get; set; }
    public Sorter(Belt b) { belt = b; }
    /// <summary>Moves parcels.</summary>
    [Fast]
    public int Move(int n, params int[] rest) {
        // Stamp(1, 2)
        var s = "Stamp(3)";
        belt.Feed(x => { Stamp(1, 2); }, new Dictionary<string, int>());
        return this.Stamp(n, 1) + Load().Stamp (
            2);
    }
    private int Stamp(int a, int b = 2) { return a + b; }
    public static int Grow(this int x) => x + 1;
    int Load() { return 0; }
}
}
"""
PY = "class Tray:\n    async def put(self, item):\n        self.check(item)\n\n    def check(self, item):\n        return item\n\ndef test_it():\n    Tray().put(*args)\n"
VB = "Public Class Desk\n    Public Sub Open(ByVal x As Integer, Optional y As Integer = 1)\n        Me.Close(x) ' Open(1)\n    End Sub\n    Function Close(a) As Integer\n    End Function\nEnd Class\n"
TS = "export class Slip extends Note {\n  fold(a: number, b?: string) {\n    return this.tear(...a);\n  }\n}\nexport const cut = async (x, y) => {\n  new Slip().fold(x);\n};\n"


def files(spark):
    rows = [("src/Sorter.cs", "csharp", CS), ("tests/test_tray.py", "python", PY), ("Desk.vb", "vbnet", VB), ("slip.ts", "typescript", TS), ("e.py", "python", ""), ("n.cs", "csharp", None), ("x.md", "markdown", "f(1)")]
    return spark.createDataFrame(rows, "path string, language string, text string")


def test_symbols_have_extents_containers_and_arity(spark):
    got = {(r["path"], r["qualified"]): (r["kind"], r["line"], r["end_line"], r["pmin"], r["pmax"], r["pflags"]) for r in X.symbols(files(spark)).collect()}
    assert got["src/Sorter.cs", "Sorter"] == ("class", 2, 18, -1, -1, 0)
    assert got["src/Sorter.cs", "Sorter.Speed"] == ("property", 4, 4, -1, -1, 0)
    assert got["src/Sorter.cs", "Sorter.Move"] == ("method", 8, 14, 1, 99, 0)
    assert got["src/Sorter.cs", "Sorter.Stamp"] == ("method", 15, 15, 1, 2, 0)
    assert got["src/Sorter.cs", "Sorter.Grow"] == ("method", 16, 0, 1, 1, 1)
    assert got["src/Sorter.cs", "Sorter.Load"] == ("method", 17, 17, 0, 0, 0)
    assert got["tests/test_tray.py", "Tray"] == ("class", 1, 6, -1, -1, 0) and got["tests/test_tray.py", "Tray.put"][:3] == ("method", 2, 3)
    assert got["Desk.vb", "Desk.Open"] == ("method", 2, 4, 1, 2, 0) and got["Desk.vb", "Desk.Close"] == ("method", 5, 6, 1, 1, 0)
    assert got["slip.ts", "Slip.fold"] == ("method", 2, 4, 1, 2, 0) and got["slip.ts", "cut"] == ("function", 6, 8, 2, 2, 0)


def test_sites_have_receivers_and_counts(spark):
    defined = X.symbols(files(spark))
    sites = X.call_sites(files(spark), defined)
    got = sorted(((r["callee"], r["line"], r["recv"], r["recv_kind"], r["argc"], r["caller"]) for r in sites.where("caller_path = 'src/Sorter.cs'").collect()), key=str)
    assert got == sorted([("Stamp", 11, None, 0, 2, "Move"), ("Stamp", 12, "this", 3, 2, "Move"), ("Load", 12, None, 0, 0, "Move"), ("Stamp", 12, None, 1, 1, "Move")], key=str)
    others = {(r["callee"], r["recv"], r["recv_kind"], r["argc"], r["caller_container"]) for r in sites.where("caller_path <> 'src/Sorter.cs'").collect()}
    assert others == {("check", "self", 3, 1, "Tray"), ("Tray", None, 0, 0, None), ("put", None, 1, -1, None), ("Close", "Me", 3, 1, "Desk"), ("Slip", None, 4, 0, None), ("fold", None, 1, 1, None)}
    assert [(r["caller"], r["lines"]) for r in X.callers(sites, "stamp").collect()] == [("Move", [11, 12, 12])]
    assert {r["name"] for r in X.dead(defined, sites).where("path = 'src/Sorter.cs'").collect()} == {"Move", "Grow"}


def test_bodies_and_markers(spark):
    rows = {(r["path"], r["name"]): r for r in X.bodies(X.symbols(files(spark)), files(spark)).collect()}
    move = rows["src/Sorter.cs", "Move"]
    assert (move["first_line"], move["last_line"]) == (6, 14) and move["body"].startswith("    /// <summary>") and move["body"].endswith("    }")
    assert rows["src/Sorter.cs", "Grow"]["last_line"] == 16
    marks = spark.createDataFrame([("a.py", "python", "# todo: x\ny = 1\n# FIXME and TODO\n# todo: x\nTODOS")], "path string, language string, text string")
    assert [(r["line"], r["marker"], r["excerpt"]) for r in X.comment_markers(marks).orderBy("line").collect()] == [(1, "TODO", "# todo: x"), (3, "FIXME", "# FIXME and TODO")]


def test_argument_counting_is_linear():
    import time

    from srcgraph.functions import scan

    def seconds(n):
        began = time.perf_counter()
        scan.groups("f(a, g(b, [c, d]), {e: 1});\n" * n)
        return time.perf_counter() - began

    seconds(100)
    assert seconds(20_000) < 12 * max(seconds(5_000), 1e-3)
    assert scan.groups("f(a<b, c)")[1][1] == -1 and scan.groups("f(List<int, int> x, y)")[1][1] == 2 and 1 not in scan.groups("f(a, b")


def test_filter_texts(spark):
    from srcgraph.functions import ask

    assert ask.parse('edges tier>=strong caller~"a b"') == ("edges", [("tier", ">=", "strong"), ("caller", "~", "a b")])
    assert ask.parse("kind=method") == ("symbols", [("kind", "=", "method")])
    for wrong in ("", "name", "nope=1", 'name="x', "edges callers>1"):
        try:
            ask.parse(wrong)
            raise AssertionError(wrong)
        except ask.FilterError:
            pass
    rows = spark.createDataFrame([("Save", 10, True, 0.5), ("load", 9, False, 1.5), (None, None, None, None)], "name string, line int, is_test boolean, pagerank double")
    names = lambda text: sorted(str(r["name"]) for r in rows.where(ask.filtered(text)[1]).collect())
    assert names("name~AV") == ["Save"] and names("line>9") == ["Save"] and names("line=9") == ["load"] and names("is_test=yes") == ["Save"]
    assert names("is_test!=true") == ["None", "load"] and names("pagerank>=x") == [] and names("name>1") == [] and names("line=x") == [] and names("name=save\\\\") == []


def test_frames_meet_symbols(spark):
    from srcgraph.operators import frames

    raw = ["   at Post.Sorter.Move(Int32 n) in C:\\src\\Sorter.cs:line 9", "   at Post.Sorter.Stamp(Int32 a) in C:\\src\\Sorter.cs:line 99", "   at System.Linq.Enumerable.Sum()", "   at Post.Other.Gone()", '  File "lib/site-packages/x.py", line 7, in run']
    rows = spark.createDataFrame([(1, i, r) for i, r in enumerate(raw)], "trace_id int, line_no int, raw string")
    got = frames.resolve_frames(tree.stack_frames(rows), X.symbols(files(spark))).orderBy("line_no").collect()
    assert [(r["status"], r["line"], r["drift"]) for r in got] == [("project", 8, False), ("project", 15, True), ("external", None, False), ("unresolved", None, False), ("external", None, False)]
    calls = spark.createDataFrame([("Sorter.Move", "Post.Sorter.Stamp", 3), ("lambda", "put", 1), ("Move", "Nowhere.at", 2)], "caller string, callee string, count long")
    sites = {(r["caller"], r["callee"], r["line"], r["hits"], r["verified"]) for r in frames.runtime_sites(calls, X.symbols(files(spark))).collect()}
    assert sites == {("Move", "Stamp", 8, 3, True), (None, "put", 2, 1, True)}


def test_tree_keeps_underscores_and_skips_ignored(spark, tmp_path):
    (tmp_path / "_sub").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "_sub" / "__init__.py").write_bytes(b"\xef\xbb\xbfx = 1")
    (tmp_path / "a.cs").write_bytes("// caf\xe9".encode("latin-1"))
    (tmp_path / "node_modules" / "b.js").write_text("x()")
    (tmp_path / "c.txt").write_text("other")
    rows = {r["path"].rsplit("/", 1)[1]: r["text"] for r in tree.source_files(spark, str(tmp_path), ["node_modules"]).collect()}
    assert rows == {"__init__.py": "x = 1", "a.cs": "// café"}
    assert [r["text"] for r in tree.source_files(spark, str(tmp_path), ["node_modules"], indexed=False).collect()] == ["other"]


def test_json_lines_are_read_tolerantly(spark):
    lines = ['{"caller": "a", "callee": "b", "count": 3}', "# note", "", "{broken", '{"caller": "a"}']
    got = tree.json_lines(spark.createDataFrame([(x,) for x in lines], "value string"), "caller string, callee string, count long", ["caller", "callee"]).collect()
    assert [tuple(r) for r in got] == [("a", "b", 3)]


def test_stack_frames(spark):
    raw = ['  File "app/x.py", line 7, in run', "    at render (web/x.js:10:5)", "   at Shop.Order.Total(Int32 n) in C:\\src\\Order.cs:line 12", "   at Shop.Order.<Save>d__3.MoveNext()", "noise"]
    rows = spark.createDataFrame([(1, i, r) for i, r in enumerate(raw)], "trace_id int, line_no int, raw string")
    got = [(r["method"], r["path"], r["line"]) for r in tree.stack_frames(rows).orderBy("line_no").collect()]
    assert got[0] == ("run", "app/x.py", 7) and got[1] == ("render", "web/x.js", 10) and got[2] == ("Shop.Order.Total", "C:\\src\\Order.cs", 12)
    assert got[3][0] == "Shop.Order.Save" and len(got) == 4


def test_commit_log(spark):
    log = ["abc1234|Ann|100", "", "src/a.py", "src/b.py", "def5678|Bo|200", "src/a.py"]
    rows = tree.commits(spark.createDataFrame([(0, i, x) for i, x in enumerate(log)], "part int, line_no int, line string"))
    assert sorted(tuple(r) for r in rows.collect()) == [("abc1234", "Ann", 100, "src/a.py"), ("abc1234", "Ann", 100, "src/b.py"), ("def5678", "Bo", 200, "src/a.py")]


def test_windows_over_a_stream_equal_the_batch(spark):
    folder = "/root/testdata/sf0.001"
    q = ingest.windowed(ingest.event_stream(spark, folder)).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = spark.read.parquet(f"{folder}/events.parquet").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    key = lambda df: sorted((str(r["window"]), r["event_type"], r["n"]) for r in df.collect())
    assert key(spark.table("w")) == key(want)


def test_ignore_patterns():
    out = lambda path, *lines: tree.is_ignored(path, [p for p in map(tree.ignore_pattern, lines) if p])
    assert out("a/b.log", "*.log") and out("b.log", "# x", "", "*.log") and not out("b.log", "*.log", "!b.log")
    assert out("build/x/y.c", "build/") and not out("build", "build/") and out("src/build/y", "build")
    assert out("docs/a.md", "docs/*.md") and not out("x/docs/a.md", "docs/*.md") and not out("docs/a/b.md", "/docs/*.md")
    assert out("x/y/z.c", "x/**/z.c") and out("x/z.c", "x/**/z.c") and out("q/x/k", "**/x/**") and out("a1", "a[0-9]") and not out("ab", "a[!b]")
    try:
        tree.ignore_pattern("a[b")
        raise AssertionError
    except ValueError:
        pass
    assert tree.languages_for([".PY", ".zig"]) == {".py": "python", ".zig": "generic"}


def test_outputs_are_shortened(spark):
    from srcgraph.operators import outputs

    failing = "==== test session starts ====\nplatform x\ncollected 3 items\na.py ..F\n==== FAILURES ====\n>  assert 0\n\n==== short test summary info ====\nFAILED a\n==== 1 failed, 2 passed in 0.10s ===="
    green = "==== test session starts ====\ncollected 2 items\na.py ..\n==== 2 passed in 0.05s ===="
    jest = "PASS a.js\n\n\nFAIL b.js\n  ✓ fine\n  x broken"
    cargo = "test a::b ... ok\ntest a::c ... FAILED\ntest result: FAILED"
    texts = [("f", "pytest", failing), ("g", "pytest", green), ("n", "pytest", "no banner\nhere"), ("j", "npm_test", jest), ("c", "cargo_test", cargo), ("o", "generic", "PASS x\n1\n2")]
    rows = [(r, tool, i, line) for r, tool, text in texts for i, line in enumerate(text.split("\n"))]
    lines = spark.createDataFrame(rows, "run string, tool string, line_no int, line string")
    got = {r["run"]: r["text"] for r in outputs.joined_lines(outputs.compressed(lines)).collect()}
    assert got["f"].split("\n") == ["collected 3 items", "==== FAILURES ====", ">  assert 0", "", "==== short test summary info ====", "FAILED a", "==== 1 failed, 2 passed in 0.10s ===="]
    assert got["g"] == "==== 2 passed in 0.05s ====" and got["n"] == "no banner\nhere"
    assert got["j"] == "\nFAIL b.js\n  x broken" and got["c"] == "test a::c ... FAILED\ntest result: FAILED" and got["o"] == "PASS x\n1\n2"
    assert {r["text"] for r in outputs.joined_lines(lines.where("run = 'o'"), most=1).collect()} == {"PASS x\n… 2 more"}
    calls = {"python3.12 -m pytest -q": "pytest", "C:\\bin\\pytest.exe": "pytest", "/usr/bin/npm run test": "npm_test", "git diff": "git_diff", "git push": "generic", "cargo build": "cargo_build", "python x.py": "generic", "python -m": "generic", "mypy": "mypy"}
    argv = spark.createDataFrame([(k, k.split(" ")) for k in calls] + [("", [])], "k string, argv array<string>")
    assert {r["k"]: r["t"] for r in argv.select("k", outputs.tool_of(F.col("argv")).alias("t")).collect()} == {**calls, "": "generic"}


def test_trees_are_read_by_folder_and_filters_reach_them(spark, tmp_path):
    from srcgraph.sources import datasource

    for name in ("a/x/one.py", "a/x/deep/er/two.py", "a/y/three.cs", "b/four.py", "five.py", "build/z/six.py", "a/x/_p.py", "a/notes.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"# {name}")
    reader = datasource.TreeReader({"path": str(tmp_path), "ignored": "build/"})
    planned = {(p.path.removeprefix(str(tmp_path)), p.deep) for p in reader.partitions()}
    assert planned == {("", False), ("/a", False), ("/b", False), ("/a/x", True), ("/a/y", True)}
    found = tree.source_files(spark, str(tmp_path), ["build/"])
    names = lambda df: sorted(r["path"].removeprefix(str(tmp_path) + "/") for r in df.collect())
    assert names(found) == ["a/x/_p.py", "a/x/deep/er/two.py", "a/x/one.py", "a/y/three.cs", "b/four.py", "five.py"]
    assert found.rdd.getNumPartitions() == 5
    assert names(found.where("language = 'csharp'")) == ["a/y/three.cs"]
    only = found.where(F.col("path").startswith(f"{tmp_path}/a/x"))
    assert names(only) == ["a/x/_p.py", "a/x/deep/er/two.py", "a/x/one.py"] and only.rdd.getNumPartitions() == 3
    assert names(found.where(F.col("path") == f"{tmp_path}/five.py")) == ["five.py"]
    assert names(tree.source_files(spark, str(tmp_path), [], extensions=[".txt"])) == ["a/notes.txt"]


def test_changed_files_come_from_git(spark, tmp_path):
    import subprocess

    from srcgraph.sources import datasource

    git = lambda *words: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@example.org", *words], check=True, capture_output=True)
    git("init", "-q")
    for name in ("keep.py", "edit me.py", "gone.py"):
        (tmp_path / name).write_text("1")
    git("add", ".")
    git("commit", "-qm", "first")
    (tmp_path / "edit me.py").write_text("2")
    (tmp_path / "gone.py").unlink()
    datasource.register(spark)
    rows = spark.read.format("changed_files").load(str(tmp_path)).collect()
    assert {(r["path"].rsplit("/", 1)[1], r["status"]) for r in rows} == {("edit me.py", "M"), ("gone.py", "D")}
