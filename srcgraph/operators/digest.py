"""What a name means across files: definitions and references by file, ambiguity, decisions that concern it, and short
summaries of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcgraph.functions import text as T
from srcgraph.jobs.scratch import bucketed, stored
from srcgraph.operators import resolve, walk
from srcgraph.operators.names import matching

#: Symbols and dependencies that a summary names; kinds in the order in which it names them.
MOST_SYMBOLS, MOST_DEPENDENCIES = 60, 30
KIND_ORDER = ("class", "interface", "struct", "enum", "record", "module", "component", "type", "function", "method", "constructor", "property", "event", "control")
#: What a text depends on, by language.
_DEPENDS = {
    "csharp": (r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;",),
    "vbnet": (r"(?im)^\s*Imports\s+(?:\w+\s*=\s*)?([\w.]+)",),
    "python": (r"(?m)^import\s+(\w+)", r"(?m)^from\s+(\w+)"),
    "javascript": (r"\bfrom\s*[\"']([^\"']+)[\"']", r"\brequire\(\s*[\"']([^\"']+)[\"']", r"(?m)^\s*import\s*[\"']([^\"']+)[\"']"),
}
#: Names of a test filter; test runners by suffix, and how they are asked for some tests.
MOST_NAMES = 12
RUNNERS = {"cs": "dotnet", "vb": "dotnet", "py": "pytest", "ts": "jest", "tsx": "jest", "js": "jest", "jsx": "jest"}
_FILTERS = {"dotnet": ('dotnet test --filter "', "FullyQualifiedName~", "|"), "pytest": ('python -m pytest -k "', "", " or "), "jest": ('npx jest -t "', "", "|")}
_DEPENDS["typescript"] = _DEPENDS["javascript"]


def definitions(defined: DataFrame, query: str, exact: bool = False) -> DataFrame:
    """Distinct production definitions whose name a query matches, or is with `exact`."""
    wanted = "".join(c for c in query.lower() if c.isascii() and c.isalnum())
    hit = (T.collapsed(F.col("name")) == wanted) if exact else T.matches(F.col("name"), query)
    return defined.where(hit & ~F.col("is_test") & ~F.col("generated")).select("name", "qualified", "kind", "path", "line").dropDuplicates(["name", "path", "line"])


def digest(files: DataFrame, defined: DataFrame, query: str, purposes: DataFrame | None = None) -> DataFrame:
    """(path, defs, refs, purpose_only, is_test, entry) of the files that define or use what a query matches, or whose
    purpose names it; entry: production files that define it, ordered by refs, then defs. Identifiers that
    do not match stay where their text is."""
    hits = defined.where(T.matches(F.col("name"), query)).groupBy("path").agg(F.count(F.lit(1)).alias("defs"))
    # A name that matches holds the query once its joining signs are gone, and so does its text.
    wanted = "".join(c for c in query.lower() if c.isascii() and c.isalnum())
    holds = lambda c: F.contains(F.lower(F.translate(c, "_$", "")), F.lit(wanted))
    idents = files.where(holds("text")).select("path", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0))).alias("ident"))
    refs = idents.where(holds("ident")).where(T.matches(F.col("ident"), query)).groupBy("path").agg(F.count(F.lit(1)).alias("refs"))
    met = hits.join(refs, "path", "full_outer")
    if purposes is not None:
        said = purposes.where(F.lower("purpose").rlike(rf"\b\Q{query.lower()}\E")).select("path", F.lit(True).alias("said"))
        met = met.join(said, "path", "full_outer")
    else:
        met = met.withColumn("said", F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0))
    is_test = T.is_test_path(F.col("path"))
    rows = met.select("path", zero("defs").alias("defs"), zero("refs").alias("refs"), (F.coalesce("said", F.lit(False)) & (zero("defs") == 0)).alias("purpose_only"), is_test.alias("is_test"))
    return rows.withColumn("entry", (F.col("defs") > 0) & ~F.col("is_test")).orderBy(F.desc("entry"), F.desc("refs"), F.desc("defs"), "path")


def ambiguity(defined: DataFrame, pairs: DataFrame, by: str = "callee") -> DataFrame:
    """(by, definitions, resolved): called names with several production definitions, and the path of the one that all
    their sites mean, null where they differ or nothing is sure. pairs: resolve.candidates with def_line."""
    named = pairs.drop("line").withColumnRenamed("def_line", "line")
    several = named.where("name_l is not null and not is_test and not generated").groupBy(by).agg(F.count_distinct("qualified", "path", "line").alias("definitions")).where("definitions > 1")
    one = resolve.unanimous(named, by).select(by, F.col("path").alias("resolved"))
    return several.join(one, by, "left")


def concerning(records: DataFrame, queries: DataFrame) -> DataFrame:
    """Distinct (id, query): records (id, affects) that name a query, either way: a word run of the name begins with the
    query, or of the query with the name."""
    named = records.select("id", F.explode("affects").alias("name")).distinct()
    here = matching(named, queries, "name", "query")
    there = matching(queries, named, "query", "name").select("name", "query")
    return named.join(here.unionByName(there).distinct(), "name").select("id", "query").distinct()


def dependencies(files: DataFrame) -> DataFrame:
    """(path, dependency): distinct names that a text imports."""
    found = F.array().cast("array<string>")
    for language, patterns in _DEPENDS.items():
        listed = F.concat(*(F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in patterns))
        found = F.when(F.col("language") == language, listed).otherwise(found)
    return files.select("path", F.explode(F.array_distinct(found)).alias("dependency"))


def purposes(files: DataFrame) -> DataFrame:
    """(path, purpose): the first sentence of the comment or docstring that a text begins with."""
    doc = F.regexp_extract("text", r"(?s)^\s*(?:\"\"\"|''')(.*?)(?:\"\"\"|''')", 1)
    block = F.regexp_extract("text", r"(?s)^\s*/\*+(.*?)\*/", 1)
    rows = F.regexp_extract("text", r"^\s*((?:[ \t]*(?://|#|'|--)[^\n]*(?:\n|$))+)", 1)
    said = F.when(doc != "", doc).when(block != "", block).otherwise(rows)
    bare = F.regexp_replace(F.regexp_replace(said, r"(?m)^\s*(?:///?|#+!?|'+|--|\*)\s?", ""), "<[^>]*>", "")
    return files.select("path", T.first_sentence(bare).alias("purpose")).where("purpose <> ''")


def summaries(files: DataFrame, defined: DataFrame) -> DataFrame:
    """(path, summary): language, size, purpose, the first symbols by kind and line, and dependencies, a line each. What is
    kept of a file is bounded before its rows come together."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, KIND_ORDER)), F.col("kind")), F.lit(0))
    order = F.when(rank > 0, rank).otherwise(len(KIND_ORDER) + 1)
    numbered = defined.select("path", "qualified", "kind", "line", order.alias("o"), "at").withColumn("__r", F.row_number().over(Window.partitionBy("path").orderBy("o", "line", "at")))
    listed = numbered.groupBy("path").agg(
        F.array_sort(F.collect_list(F.when(F.col("__r") <= MOST_SYMBOLS, F.struct("__r", F.concat("kind", F.lit(" "), "qualified", F.lit(" L"), F.col("line").cast("string")).alias("t"))))).alias("s"), F.count(F.lit(1)).alias("n")
    )
    uses = dependencies(files).withColumn("__r", F.row_number().over(Window.partitionBy("path").orderBy("dependency"))).where(F.col("__r") <= MOST_DEPENDENCIES).groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("dependency")), ", ").alias("uses"))
    met = files.select("path", "language", T.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens")).join(purposes(files), "path", "left").join(listed, "path", "left").join(uses, "path", "left")
    more: Column = F.when(F.col("n") > MOST_SYMBOLS, F.concat(F.lit("and "), (F.col("n") - MOST_SYMBOLS).cast("string"), F.lit(" more")))
    head = F.concat("path", F.lit(": "), F.coalesce("language", F.lit("generic")), F.lit(", "), F.col("tokens").cast("string"), F.lit(" tokens"))
    parts = F.concat(F.array(head, F.col("purpose")), F.coalesce(F.transform("s", lambda x: x.t), F.array().cast("array<string>")), F.array(more, F.concat(F.lit("uses "), "uses")))
    return met.select("path", F.array_join(F.array_compact(parts), "\n").alias("summary"))


def covering_tests(sites: DataFrame, defined: DataFrame, query: str, depth: int = 4) -> DataFrame:
    """(name, container, path, line, depth, via): test methods that reach a symbol whose name a query matches, through
    any callers, with the least number of steps and the call that leads there. Calls of unknown names change nothing:
    no step leads to them. The calls are dealt by their callee once, for all steps."""
    calls = bucketed(sites.where("caller is not null").select(F.col("callee_l").alias("src"), F.lower("caller").alias("dst")), ["src"], "calls")
    seeds = defined.where(T.matches(F.col("name"), query)).select(F.col("name_l").alias("node")).distinct()
    reached = walk.reach(calls, seeds, depth - 1)
    found = sites.where("caller_is_test and caller is not null").join(reached, F.col("callee_l") == F.col("node"))
    rows = found.select(F.col("caller").alias("name"), F.col("caller_container").alias("container"), F.col("caller_path").alias("path"), F.col("caller_line").alias("line"), (F.col("depth") + 1).alias("depth"), F.col("callee_l").alias("via"))
    return rows.groupBy("name", "container", "path", "line").agg(F.min(F.struct("depth", "via")).alias("b")).select("name", "container", "path", "line", "b.depth", "b.via")


def test_command(tests: DataFrame) -> DataFrame:
    """(command): one row with a command that runs the nearest MOST_NAMES of the found tests by the runner that most of
    them belong to, and how many more there are; no row where no runner is known."""
    suffix = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    runner = F.coalesce(*(F.when(suffix == s, r) for s, r in RUNNERS.items()))
    known = stored(tests.withColumn("runner", runner).where("runner is not null"), "tests")
    most = known.groupBy("runner").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "runner").limit(1).select("runner")
    full = F.when(F.col("container").isNotNull() & (F.col("container") != ""), F.concat("container", F.lit("."), "name")).otherwise(F.col("name"))
    names = known.join(F.broadcast(most), "runner").groupBy("runner", full.alias("full")).agg(F.min(F.struct("depth", "path", "line")).alias("o"))  # most: one row
    count = names.groupBy("runner").agg(F.count(F.lit(1)).alias("n"))
    best = names.orderBy("o", "full").limit(MOST_NAMES).groupBy("runner").agg(F.array_sort(F.collect_list(F.struct("o", "full"))).alias("b"))
    command = F.lit(None).cast("string")
    for name, (head, mark, between) in _FILTERS.items():
        full_names = F.transform("b", lambda x: x.full)
        shown = full_names if name == "dotnet" else F.transform(full_names, T.short_name)
        listed = F.array_join(F.transform(shown, _marked(mark)), between)
        command = F.when(F.col("runner") == name, F.concat(F.lit(head), listed, F.lit('"'))).otherwise(command)
    more = F.when(F.col("n") > MOST_NAMES, F.concat(F.lit("   # +"), (F.col("n") - MOST_NAMES).cast("string"), F.lit(" more not included"))).otherwise("")
    return best.join(F.broadcast(count), "runner").select(F.concat(command, more).alias("command"))  # one row


def _marked(mark: str):  # noqa: ANN202
    return lambda x: F.concat(F.lit(mark), x)
