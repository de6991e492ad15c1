"""Symbols, call sites, field accesses and routes from source texts, and the questions that are asked of them.

Declarations, declared types and calls of a text, with the declaration around each call, come from
srcgraph.functions.scan, one row's text at a time in Arrow batches; accesses and routes are patterns and tokens within
Spark. What joins texts with each other is relational. A text is one row, so its facts are bounded by it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcgraph.functions import scan
from srcgraph.functions import text as T
from srcgraph.operators import asof

_KINDS = {"string": pa.string(), "int": pa.int32()}
SYMBOL = "name string, qualified string, kind string, container string, line int, end_line int, pmin int, pmax int, pflags int, at int, bases string"
SITE = "callee string, line int, at int, recv string, recv_kind int, argc int, recv_type string, caller string, caller_line int, caller_kind string, caller_in string"
DECLARED = "name string, type string"
#: Kinds whose names are types; kinds that a route can name; lines from a route to its handler.
TYPES, HANDLERS, ROUTE_GAP = sorted(scan.TYPES), ("method", "function", "constructor"), 5
#: Texts whose facts are held at a time.
TEXTS = 64
#: Lines above a declaration that belong to it: comments, attributes, decorators, tags (fixed values).
_ABOVE = r"^\s*(///|//|'|#|\*|/\*|\[|@|<[A-Za-z])"
# Words that are no field accesses (fixed values).
NO_FIELDS = (
    "if else elif for foreach while do switch case return break continue class struct interface enum def function public private protected internal static "
    "readonly const var let val new true false null none nil undefined self this me mybase myclass cls try catch finally throw raise import from using namespace "
    "package void int string bool float double long object and or not in is as async await yield lambda with pass get set"
).split()
ASSIGNMENTS = ("=", "+=", "-=", "*=", "/=", "%=", "|=", "&=", "^=", "<<=", ">>=", "??=")
#: Names, numbers, then signs, the longest first.
_TOKEN = r"(?U)[\p{L}_$][\w$]*|\d[\w.]*|<<=|>>=|\?\?=|=>|[=!<>+\-*/%|&^]=|\S"
#: Where a text declares a route: attributes, decorators, and calls of an application object.
_ROUTES = (r"\[(?:Http\w+|Route)\(\s*[\"']([^\"']+)[\"']", r"@\w*\.(?:route|get|post|put|delete|patch)\(\s*[\"']([^\"']+)[\"']", r"\bapp\.\w+\(\s*[\"']([^\"']+)[\"']")


def lines(files: DataFrame) -> DataFrame:
    return files.select("path", "language", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "text")).select("path", "language", (F.col("pos") + 1).alias("line"), "text")


def _listed(rows: list[list[tuple]], schema: str) -> pa.Array:
    """Each text's rows as a list of structs."""
    names, kinds = zip(*(part.split() for part in schema.split(", ")), strict=True)
    columns = list(zip(*(r for one in rows for r in one), strict=True)) or [()] * len(names)
    flat = pa.StructArray.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(columns, kinds, strict=True)], names=names)
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, rows))], pa.int32()), flat)


def scanned(files: DataFrame, everywhere: bool = False) -> DataFrame:
    """(path, language, symbols, calls) of (path, language, text): one scan of each text. With `everywhere`, names in
    comments and strings count as calls, too."""

    def facts(language: str, text: str) -> tuple[list, list]:
        source = scan.Source(text, language)
        return source.symbols, source.sites(everywhere)

    return _read(files, facts, {"symbols": SYMBOL, "calls": SITE})


def _read(files: DataFrame, facts: Callable[[str, str], tuple[list, ...]], lists: dict[str, str]) -> DataFrame:
    """(path, language) of texts with the lists that `facts` makes of each (language, text)."""
    fields = lambda schema: schema.replace(" ", ":").replace(",:", ",")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                some = batch.slice(k, TEXTS)
                found = [facts(language or "", text or "") for language, text in zip(some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True)]
                made = [_listed(list(rows), schema) for rows, schema in zip(zip(*found, strict=True), lists.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *made], names=["path", "language", *lists])

    return files.select("path", "language", "text").mapInArrow(run, "path string, language string, " + ", ".join(f"{name} array<struct<{fields(schema)}>>" for name, schema in lists.items()))


def symbols(files: DataFrame) -> DataFrame:
    """Declarations of texts, or of what scanned() made of them: names, kinds, containers, extents (end_line 0:
    unknown), bases and parameter counts (-1: unknown), as resolve.candidates takes them."""
    facts = files if "symbols" in files.columns else _read(files, lambda language, text: (scan.Source(text, language).symbols,), {"symbols": SYMBOL})
    found = facts.select("path", "language", F.explode("symbols").alias("s")).select("path", "language", "s.*")
    path = F.col("path")
    bases = F.when(F.col("bases") == "", F.array().cast("array<string>")).otherwise(F.split("bases", ","))
    return found.withColumn("bases", bases).select(
        "*", T.is_test_path(path).alias("is_test"), T.is_generated_path(path).alias("generated"), F.lower("name").alias("name_l"), F.xxhash64("path", "line", "at", "name").alias("sym_seq"),
        (~F.col("kind").isin("method", "function")).alias("not_logic"),
    )


def declared_types(files: DataFrame) -> DataFrame:
    """(path, name, type): what scan.declared_types() finds in each text."""
    found = _read(files, lambda language, text: (list(scan.declared_types(text, language).items()),), {"declared": DECLARED})
    return found.select("path", F.explode("declared").alias("d")).select("path", "d.*")


def holders(defined: DataFrame, prefix: str) -> tuple[DataFrame, list[str]]:
    """Declarations as marks for asof.enclosing, with the columns that name them."""
    columns = [prefix, f"{prefix}_line", f"{prefix}_kind", f"{prefix}_in"]
    container = F.when(F.col("kind").isin(*TYPES), F.col("name")).otherwise(F.col("container"))
    return defined.select("path", "line", "end_line", "at", *(c.alias(n) for c, n in zip((F.col("name"), F.col("line"), F.col("kind"), container), columns, strict=True))), columns


def calls(files: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Calls of any name, as call_sites gives those of known ones."""
    found = (facts or scanned(files)).select("path", F.explode("calls").alias("c")).select("path", "c.*").where("caller_kind is null or caller_kind <> 'interface'")
    return found.select(
        F.xxhash64("path", "at").alias("site_seq"), "callee", F.lower("callee").alias("callee_l"), "line", "recv", "recv_kind", "argc", "caller", "caller_line",
        F.col("caller_in").alias("caller_container"), F.col("path").alias("caller_path"), "recv_type", F.lit(False).alias("verified"), T.is_test_path(F.col("path")).alias("caller_is_test"),
    )


def call_sites(files: DataFrame, defined: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Calls of known names, with receivers, their declared types and argument counts, as resolve.candidates
    takes them. A declaration's own name is no call, and nothing within an interface is; the caller is the
    innermost declaration of the text around the call, as its scan finds it. defined: symbols of the texts;
    facts: what scanned() made of them, where that is at hand."""
    found = calls(files, facts)
    return found.join(defined.select(F.col("name_l").alias("callee_l")).distinct(), "callee_l", "left_semi").select(found.columns)


def field_accesses(files: DataFrame, defined: DataFrame) -> DataFrame:
    """(field, path, line, enclosing, enclosing_line, is_write, is_test): names of properties where texts use them.

    Tokens of a line are an array; the sign after a name is the next token of its line or the first one of the
    next line that has any. A name before a parenthesis is a call, one before an assignment is written; a
    declaration's own name and what an interface holds are no accesses."""
    tokens = F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(0))
    rows = lines(files).select("path", "line", tokens.alias("tokens")).where("size(tokens) > 0")
    rows = rows.withColumn("next_first", F.lead(F.get("tokens", F.lit(0))).over(Window.partitionBy("path").orderBy("line")))
    named = F.filter(F.transform("tokens", lambda x, i: F.struct(x.alias("field"), F.coalesce(F.get("tokens", i + 1), F.col("next_first"), F.lit("")).alias("behind"))), lambda t: t.field.rlike(r"(?U)^[\p{L}_$]") & (t.behind != "("))
    uses = rows.select("path", "line", F.explode(named).alias("t")).select("path", "line", "t.field", "t.behind", F.lower("t.field").alias("field_l")).where(~F.col("field_l").isin(*NO_FIELDS))
    known = uses.join(defined.where("kind = 'property'").select(F.col("name_l").alias("field_l")).distinct(), "field_l", "left_semi")
    own = defined.groupBy("path", "line").agg(F.max_by("name_l", "at").alias("field_l"))
    marks, columns = holders(defined, "enclosing")
    placed = asof.enclosing(known.join(own, ["path", "line", "field_l"], "left_anti"), marks, columns).where("enclosing_kind is null or enclosing_kind <> 'interface'")
    return placed.select("field", "path", "line", "enclosing", F.coalesce("enclosing_line", F.lit(0)).alias("enclosing_line"), F.col("behind").isin(*ASSIGNMENTS).alias("is_write"), T.is_test_path(F.col("path")).alias("is_test"))


def field_refs(accesses: DataFrame, defined: DataFrame, query: str) -> DataFrame:
    """Uses and definitions of the properties that a query names, production first, reads before writes."""
    hit = lambda name: T.matches(F.col(name), query)
    uses = accesses.where(hit("field")).select("field", "path", "line", "enclosing", F.when(F.col("is_write"), "write").otherwise("read").alias("what"), "is_test")
    made = defined.where(hit("name") & (F.col("kind") == "property") & ~F.col("is_test") & ~F.col("generated")).select(F.col("name").alias("field"), "path", "line", F.col("container").alias("enclosing"), F.lit("definition").alias("what"), "is_test").distinct()
    return made.unionByName(uses).orderBy(F.col("what") != "definition", "is_test", F.col("what") == "write", "path", "line")


def routes(files: DataFrame, defined: DataFrame) -> DataFrame:
    """(pattern, path, line, handler, handler_line, is_test): declared routes with the method that follows within
    ROUTE_GAP lines, else with the declaration around them."""
    found = F.concat(*(F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in _ROUTES))
    declared = lines(files).where(F.col("text").rlike("|".join(_ROUTES))).select("path", "line", F.explode(found).alias("pattern"))
    marks, columns = holders(defined, "around")
    ahead = asof.following(declared, defined.select("path", "line", "at", F.col("name").alias("next"), F.col("line").alias("next_line"), F.col("kind").alias("next_kind")), ["next", "next_line", "next_kind"], ROUTE_GAP)
    both = asof.enclosing(ahead, marks, columns)
    direct = F.col("next_kind").isin(*HANDLERS)
    return both.select(
        "pattern", "path", "line", F.when(direct, F.col("next")).otherwise(F.col("around")).alias("handler"), F.when(direct, F.col("next_line")).otherwise(F.coalesce("around_line", F.lit(0))).alias("handler_line"), T.is_test_path(F.col("path")).alias("is_test")
    )


def callers(sites: DataFrame, name: str) -> DataFrame:
    """Who calls a name: one row for each calling declaration with its lines."""
    hits = sites.where(F.col("callee_l") == name.lower())
    return hits.groupBy(F.col("caller_path").alias("path"), "caller", "caller_line").agg(F.sort_array(F.collect_list("line")).alias("lines"), F.max("caller_is_test").alias("is_test")).orderBy("is_test", "path", "caller_line")


def dead(defined: DataFrame, sites: DataFrame) -> DataFrame:
    """Production methods and functions that nothing calls; files that are entered from outside are left out."""
    live = defined.where("kind in ('method', 'function') and not is_test and not generated").where(~T.is_entry_path(F.col("path")))
    return live.join(sites.select(F.col("callee_l").alias("name_l")).distinct(), "name_l", "left_anti").select("path", "name", "line")


def extents(defined: DataFrame, rows: DataFrame) -> DataFrame:
    """defined with first_line and last_line: the extent where it is known, else up to the next declaration, and
    from the first of the comment, attribute and decorator lines right above. rows: lines() of the texts."""
    file = Window.partitionBy("path").orderBy("line")
    # Runs of lines that belong to what follows: gaps and islands over the lines of a text.
    marked = rows.select("path", "line", F.col("text").rlike(_ABOVE).alias("above"))
    broken = F.max(F.when(~F.col("above"), F.col("line"))).over(file.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = marked.withColumn("first_line", F.coalesce(broken, F.lit(0)) + 1).where("above").select("path", (F.col("line") + 1).alias("line"), "first_line")
    sizes = rows.groupBy("path").agg(F.max("line").alias("lines"))
    open_ = defined.withColumn("before_next", F.lead("line").over(Window.partitionBy("path").orderBy("line", "at")) - 1).join(sizes, "path").join(runs, ["path", "line"], "left")
    last = F.when(F.col("end_line") > 0, F.col("end_line")).otherwise(F.coalesce("before_next", "lines"))
    return open_.withColumns({"first_line": F.coalesce("first_line", "line"), "last_line": F.greatest(F.least(last, F.col("lines")), F.col("line"))}).drop("before_next", "lines")


def bodies(defined: DataFrame, files: DataFrame) -> DataFrame:
    """(path, name, line, at, first_line, last_line, body, doc): the text of each declaration, with its doc line. A
    text's lines meet its extents in one row, which cuts each body out once."""
    found = extents(defined.select("path", "name", "line", "end_line", "at"), lines(files))
    per_file = found.groupBy("path").agg(F.collect_list(F.struct("name", "line", "at", "first_line", "last_line")).alias("extents"))
    split = files.select("path", F.split("text", r"\r?\n").alias("all_lines"))  # below the join, so that it is made once
    cut = lambda s: F.array_join(F.slice("all_lines", s["first_line"], s["last_line"] - s["first_line"] + 1), "\n")
    made = split.join(per_file, "path").select("path", F.explode(F.transform("extents", lambda s: s.withField("body", cut(s)))).alias("s"))
    return made.select("path", "s.*").withColumn("doc", doc_line(F.col("body"), F.col("line") - F.col("first_line")))


def doc_line(body: Column, above: Column) -> Column:
    """First sentence of the comment lines above a declaration, of their summary where they have one."""
    said = F.filter(F.slice(F.split(body, "\n"), F.lit(1), F.greatest(above, F.lit(0))), lambda x: ~x.rlike(r"^\s*[\[@]"))
    bare = F.regexp_replace(F.array_join(said, "\n"), r"(?m)^\s*(///|//|'''|'|#|/\*+|\*/|\*)\s?|\*/\s*$", "")
    summary = F.regexp_extract(bare, "(?is)<summary>(.*?)</summary>", 1)
    return T.first_sentence(F.regexp_replace(F.when(F.trim(summary) != "", summary).otherwise(bare), "<[^>]*>", ""))


def at_line(defined: DataFrame, places: DataFrame) -> DataFrame:
    """The innermost declaration around each (path, at); places without one are left out."""
    marks = defined.select("path", "name", "kind", "line", "end_line", "at", F.col("line").alias("begins"), F.col("end_line").alias("ends"))
    found = asof.enclosing(places.select("path", F.col("at").alias("place")), marks, ["name", "kind", "begins", "ends"], "place").where("name is not null")
    return found.select("path", F.col("place").alias("at"), "name", "kind", F.col("begins").alias("line"), F.col("ends").alias("end_line"))


def peek(defined: DataFrame, files: DataFrame, query: str, most: int = 5) -> DataFrame:
    """Bodies of the declarations whose name a query matches, the best ones first: production, not generated, of just
    that name, methods and functions."""
    wanted = "".join(c for c in query.lower() if c.isalnum())
    hits = defined.where(T.matches(F.col("name"), query)).withColumn("other", F.lower("name") != wanted)
    logic = ~F.col("kind").isin(*HANDLERS)
    best = hits.orderBy("is_test", "generated", "other", logic, "path", "line").limit(most)
    cut = bodies(defined.join(best.select("path").distinct(), "path", "left_semi"), files.join(best.select("path").distinct(), "path", "left_semi"))
    return best.select("path", "name", "kind", "line", "at", "is_test", "generated", "other", logic.alias("not_logic")).join(cut.drop("name", "line"), ["path", "at"]).orderBy("is_test", "generated", "other", "not_logic", "path", "line")


def peek_at(defined: DataFrame, files: DataFrame, places: DataFrame) -> DataFrame:
    """(location, path, name, first_line, last_line, body, matched, error) for locations such as `Service.cs:12`: the
    declaration around a line of the file that the path ends in, the shortest such path where there are several.
    error says what is wrong with a location: its form, no such file, or no declaration around it."""
    given = F.regexp_extract("location", r"^(.*):-?\d+$", 1)
    number = F.regexp_extract("location", r":(-?\d+)$", 1).try_cast("int")
    asked = places.select("location", F.replace(given, F.lit("\\"), F.lit("/")).alias("tail"), number.alias("place")).distinct()
    # A suffix of a path meets it through its last segment, which the suffix holds whole or in part.
    paths = files.select("path", F.replace("path", F.lit("\\"), F.lit("/")).alias("slashed")).select("path", "slashed", F.element_at(F.split("slashed", "/"), -1).alias("base"))
    ends = paths.select("path", "slashed", F.explode(F.transform(F.sequence(F.lit(1), F.length("base")), lambda i: F.substring(F.col("base"), i, F.length("base")))).alias("key"))
    met = asked.where("place is not null").withColumn("key", F.element_at(F.split("tail", "/"), -1)).join(ends, "key").where(F.endswith("slashed", F.col("tail")))
    chosen = met.groupBy("location", "place").agg(F.min(F.struct(F.length("path").alias("n"), "path")).alias("best"), F.count_distinct("path").alias("matched"))
    marks = defined.select("path", "line", "end_line", "at", "name", F.col("at").alias("own"))
    placed = asof.enclosing(chosen.select("location", "place", "matched", F.col("best.path").alias("path")), marks, ["name", "own"], "place")
    cut = bodies(defined, files).select("path", F.col("at").alias("own"), "first_line", "last_line", "body")
    found = asked.select("location", "place").join(placed.drop("place"), "location", "left").join(cut, ["path", "own"], "left")
    error = F.when(F.col("place").isNull(), "expected <path>:<line>").when(F.col("path").isNull(), "no file matches").when(F.col("own").isNull(), "no declaration encloses the line")
    return found.select("location", "path", "name", "first_line", "last_line", "body", F.coalesce("matched", F.lit(0)).alias("matched"), error.alias("error"))


def comment_markers(files: DataFrame, most: int = 8, width: int = 120) -> DataFrame:
    """(path, line, marker, excerpt): the first marker of each line, distinct by text, the first of a file."""
    marker = F.regexp_extract("text", rf"(?i)\b({T.COMMENT_MARKERS})\b", 1)
    found = lines(files).withColumn("marker", F.upper(marker)).where("marker <> ''").select("path", "line", "marker", F.substring(F.trim("text"), 1, width).alias("excerpt"))
    once = found.groupBy("path", "excerpt").agg(F.min("line").alias("line"), F.min_by("marker", "line").alias("marker"))
    ranked = once.withColumn("__r", F.row_number().over(Window.partitionBy("path").orderBy("line", "excerpt")))
    return ranked.where(F.col("__r") <= most).select("path", "line", "marker", "excerpt")
