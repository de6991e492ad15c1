"""Queries over source texts: text -> symbols -> call sites -> evidence -> answers, in one job each.

The texts are made by Spark from the standard tables, so that their facts are known and SQL can say what must
come out. A part is a method in two classes, one of which fits its calls; an order is a method that calls the
parts of its lines; a customer is the class of its orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.functions import ask
from srcgraph.functions import text as T
from srcgraph.operators import extract as X
from srcgraph.operators import frames as R
from srcgraph.operators import resolve
from srcgraph.operators import search as S
from srcgraph.operators import walk as W
from srcgraph.sources import tree

from .catalog import query, table
from .scratch import stored

#: Parts of a library file.
BUCKET = 40


def _numbered(n: Column, one: str) -> Column:
    """'one0, one1 ...', n of them."""
    items = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit(one), (i - 1).cast("string")))
    return F.when(n > 0, F.array_join(items, ", ")).otherwise("")


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lib/L<k>.cs and alt/K<k>.cs: each part as a method, with p_size % 4 parameters in one, one more (modulo 4)
    in the other. A file holds BUCKET parts at most."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.floor(F.col("p_partkey") / BUCKET).alias("k"))
    out = None
    for folder, letter, more in (("lib", "L", 0), ("alt", "K", 1)):
        head = F.concat(F.lit("    public int p"), F.col("p_partkey").cast("string"), F.lit("("), _numbered((F.col("p_size") + more) % 4, "int a"), F.lit(")\n    {\n        return 0;\n    }\n"))
        bodies = part.select("k", "p_partkey", head.alias("m")).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "m"))).alias("ms"))
        k = F.col("k").cast("string")
        text = F.concat(F.lit(f"public class {letter}"), k, F.lit("\n{\n"), F.array_join(F.transform("ms", lambda x: x.m), ""), F.lit("}\n"))
        files = bodies.select(F.concat(F.lit(f"{folder}/{letter}"), k, F.lit(".cs")).alias("path"), F.lit("csharp").alias("language"), text.alias("text"))
        out = files if out is None else out.unionByName(files)
    return out


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """app/C<customer>.cs: each order as a method that calls the parts of its lines with l_linenumber % 4 arguments;
    returned lines name the class, some others go through `this`. Orders of a customer and lines of an order
    are few."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_returnflag").alias("l"))

    def call(x: Column) -> Column:
        named = F.concat(F.lit("L"), F.floor(x.l_partkey / BUCKET).cast("string"), F.lit("."))
        on = F.when(x.l_returnflag == "R", named).when(x.l_returnflag == "N", "this.").otherwise("")
        return F.concat(F.lit("        "), on, F.lit("p"), x.l_partkey.cast("string"), F.lit("("), _numbered(x.l_linenumber % 4, ""), F.lit("); // p0(1)\n"))

    # Calls are written out behind the exchange; those of a line number in the order of their texts.
    made = F.transform(F.collect_list("l"), lambda x: F.struct(x.l_linenumber.alias("l_linenumber"), call(x).alias("c")))
    calls = line.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(made), lambda x: x.c), "").alias("body"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(calls, F.col("o_orderkey") == F.col("l_orderkey"))
    method = F.concat(F.lit("    public void o"), F.col("o_orderkey").cast("string"), F.lit("()\n    {\n"), F.col("body"), F.lit("    }\n"))
    files = orders.select("o_custkey", "o_orderkey", method.alias("m")).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "m"))).alias("ms"))
    k = F.col("o_custkey").cast("string")
    text = F.concat(F.lit("public class C"), k, F.lit("\n{\n"), F.array_join(F.transform("ms", lambda x: x.m), ""), F.lit("}\n"))
    return files.select(F.concat(F.lit("app/C"), k, F.lit(".cs")).alias("path"), F.lit("csharp").alias("language"), text.alias("text"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library(spark, sf_dir).unionByName(programs(spark, sf_dir))


def resolved(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbols, sites, and the candidates of each site with their tier. Each text is made and scanned once; its facts
    are written, and read again for each of the three."""
    facts = stored(X.scanned(files), "facts")
    defined = X.symbols(facts)
    sites = X.call_sites(files, defined, facts)
    return defined, sites, resolve.candidates(sites, defined.withColumnRenamed("line", "def_line").drop("language", "at"))


# The same facts from the tables: a line's two definitions and whether they fit its number of arguments.
_LINES = """calls AS (SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag = 'R' AS named, l_linenumber % 4 = p_size % 4 AS fits_l, l_linenumber % 4 = (p_size + 1) % 4 AS fits_k
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
    tiered AS (SELECT *, CASE WHEN fits_l AND named THEN 3 WHEN fits_l OR fits_k THEN 1 ELSE 0 END AS tier FROM calls)"""


@query(
    f"""WITH {_LINES} SELECT 'p' || l_partkey AS callee, 'o' || l_orderkey AS caller, count(*) AS n_sites, max(tier) AS tier FROM tiered GROUP BY 1, 2"""
)
def source_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who calls each name, from which declaration, and the best evidence among its sites; no evidence counts as none,
    whether nothing is known or all is contradicted."""
    _, _, pairs = resolved(sources(spark, sf_dir))
    per_site = pairs.groupBy("callee", "caller", "caller_path", "line").agg(F.max("tier").alias("tier"))
    return per_site.groupBy("callee", "caller").agg(F.count(F.lit(1)).alias("n_sites"), F.greatest(F.lit(0), F.max("tier")).alias("tier"))


@query(
    """SELECT name FROM (SELECT 'p' || p_partkey AS name, p_partkey AS k FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    UNION ALL SELECT 'o' || o_orderkey, o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"""
)
def source_deadcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods that no text calls; a part's two methods are one name."""
    defined, sites, _ = resolved(sources(spark, sf_dir))
    return X.dead(defined, sites).select("name").distinct()


@query(
    f"""WITH {_LINES}, places AS (SELECT p_partkey, p_partkey // {BUCKET} AS k, 3 + 4 * (row_number() OVER (PARTITION BY p_partkey // {BUCKET} ORDER BY p_partkey) - 1) AS line FROM part)
    SELECT 'o' || l_orderkey || '>p' || l_partkey AS edge, 'L' || k || '.p' || l_partkey AS qualified, 'lib/L' || k || '.cs' AS path, line
    FROM (SELECT l_orderkey, l_partkey FROM tiered GROUP BY 1, 2 HAVING min(tier) = 3) JOIN places ON l_partkey = p_partkey"""
)
def source_unanimous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (caller>callee) whose every site means one and the same place."""
    _, _, pairs = resolved(sources(spark, sf_dir))
    named = pairs.withColumns({"site_seq": F.struct("caller_path", "line"), "edge": F.concat("caller", F.lit(">"), "callee")}).drop("line").withColumnRenamed("def_line", "line")
    return resolve.unanimous(named, "edge")


@query(
    f"""WITH {_LINES} SELECT 'o' || l_orderkey AS caller, 'p' || l_partkey AS callee, CASE WHEN fits_l THEN 'lib/L' ELSE 'alt/K' END || (l_partkey // {BUCKET}) || '.cs' AS path, count(*) AS n
    FROM calls GROUP BY 1, 2, 3"""
)
def source_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The definition that each site means: the fitting one where evidence decides, else the first in order."""
    _, _, pairs = resolved(sources(spark, sf_dir))
    best = resolve.best_definition(pairs.withColumn("site_seq", F.struct("caller_path", "line")).drop("line").withColumnRenamed("def_line", "line"))
    return best.groupBy("caller", "callee", "path").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LINES} SELECT 'p' || l_partkey AS callee, count(*) FILTER (fits_l <> fits_k) AS narrowed, count(*) AS n_sites FROM calls GROUP BY 1")
def source_narrowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites whose name has several places and of which contradictions leave exactly one."""
    _, _, pairs = resolved(sources(spark, sf_dir))
    place = F.struct("path", "def_line")
    per_site = pairs.groupBy("callee", "caller_path", "line").agg(F.size(F.collect_set(place)).alias("places"), F.size(F.collect_set(F.when(F.col("tier") != resolve.CONTRADICTED, place))).alias("left"))
    return per_site.groupBy("callee").agg(F.count_if((F.col("places") > 1) & (F.col("left") == 1)).alias("narrowed"), F.count(F.lit(1)).alias("n_sites"))


@query(
    f"""SELECT 'lib/L' || (p_partkey // {BUCKET}) || '.cs' AS path, 'p' || p_partkey AS name, CAST(3 + 4 * (row_number() OVER (PARTITION BY p_partkey // {BUCKET} ORDER BY p_partkey) - 1) AS INTEGER) AS line,
    '    public int p' || p_partkey || '(' || array_to_string(list_transform(range(p_size % 4), lambda i: 'int a' || i), ', ') || ')' || chr(10) || '    {{' || chr(10) || '        return 0;' || chr(10) || '    }}' AS body FROM part"""
)
def source_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each library method, cut out by its extent."""
    files = library(spark, sf_dir).where("path like 'lib/%'")
    return X.bodies(X.symbols(files).where("kind = 'method'"), files).select("path", "name", "line", "body")


@query(
    f"""SELECT 'lib/L' || (p_partkey // {BUCKET}) || '.cs' AS path, CAST(5 + 4 * (row_number() OVER (PARTITION BY p_partkey // {BUCKET} ORDER BY p_partkey) - 1) AS INTEGER) AS at, 'p' || p_partkey AS name FROM part"""
)
def source_at_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The method around each `return`."""
    files = library(spark, sf_dir).where("path like 'lib/%'")
    places = X.lines(files).where("text like '%return%'").select("path", F.col("line").alias("at"))
    return X.at_line(X.symbols(files), places).select("path", "at", "name")


def _raw_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A .NET stack line for each order line: the part in its class, a framework call, or an unknown name; where the
    line number is even, 500 lines behind the method."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    k = F.floor(F.col("l_partkey") / BUCKET).cast("string")
    own = F.concat(F.lit("   at Shop.L"), k, F.lit(".p"), F.col("l_partkey").cast("string"), F.lit("(Int32 a) in C:\\src\\L"), k, F.lit(".cs:line "), F.when(F.col("l_linenumber") % 2 == 0, "100500").otherwise("5"))
    raw = F.when(F.col("l_linenumber") == 3, "   at System.Linq.Enumerable.Sum(Int32 n)").when(F.col("l_linenumber") == 5, "   at Shop.Gone.Missing()").otherwise(own)
    return lines.select(F.col("l_orderkey").alias("trace_id"), F.col("l_linenumber").alias("line_no"), raw.alias("raw"))


@query(
    f"""WITH places AS (SELECT p_partkey, p_partkey // {BUCKET} AS k, row_number() OVER (PARTITION BY p_partkey // {BUCKET} ORDER BY p_partkey) AS place FROM part),
    f AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber NOT IN (3, 5) THEN 'project' WHEN l_linenumber = 3 THEN 'external' ELSE 'unresolved' END AS status,
        l_linenumber NOT IN (3, 5) AND (l_linenumber % 2 = 0 OR place > 1) AS drifted FROM lineitem JOIN places ON l_partkey = p_partkey)
    SELECT l_orderkey AS trace_id, count(*) AS total, count(*) FILTER (status = 'project') AS project, count(*) FILTER (status = 'external') AS external, count(*) FILTER (status = 'unresolved') AS unresolved,
    count(*) FILTER (drifted) AS drifted, min(l_linenumber) FILTER (status = 'project') AS start_here FROM f GROUP BY 1"""
)
def source_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stack traces against the symbols. Frames name line 5, which is within the first method of a class, or a
    line far behind all: frames of other methods and of even lines have drifted."""
    resolved = R.resolve_frames(tree.stack_frames(_raw_frames(spark, sf_dir)), X.symbols(library(spark, sf_dir)))
    return R.stack_totals(resolved).select("trace_id", "total", "project", "external", "unresolved", "drifted", "start_here")


@query(
    f"""WITH {_LINES}, recorded AS (SELECT DISTINCT l_orderkey, l_partkey FROM calls WHERE l_linenumber <= 2)
    SELECT 'static' AS origin, CAST(tier AS INTEGER) AS tier, count(*) AS n, CAST(0 AS BIGINT) AS hits FROM tiered GROUP BY 1, 2
    UNION ALL SELECT 'runtime', 4, count(*), sum(n) FROM (SELECT l_orderkey, l_partkey, count(*) AS n FROM calls WHERE l_linenumber <= 2 GROUP BY 1, 2)"""
)
def source_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded calls beside the static ones: the first two lines of each order were seen to run."""
    defined, sites, _ = resolved(sources(spark, sf_dir))
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2")
    caller, callee = F.concat(F.lit("o"), F.col("l_orderkey").cast("string")), F.concat(F.lit("L"), F.floor(F.col("l_partkey") / BUCKET).cast("string"), F.lit(".p"), F.col("l_partkey").cast("string"))
    recorded = lines.groupBy(caller.alias("caller"), callee.alias("callee")).agg(F.count(F.lit(1)).alias("count"))
    both = R.with_runtime(sites, R.runtime_sites(recorded, defined))
    pairs = resolve.candidates(both, defined.withColumnRenamed("line", "def_line").drop("language", "at"))
    per_site = pairs.groupBy("verified", "caller_path", "caller", "callee", "line").agg(F.greatest(F.lit(0), F.max("tier")).alias("tier"), F.max("hits").alias("hits"))
    return per_site.groupBy(F.when(F.col("verified"), "runtime").otherwise("static").alias("origin"), "tier").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("hits"), F.lit(0)).cast("long").alias("hits"))


@query(
    """SELECT 'L' || (p_partkey // 40) || '.p' || p_partkey AS qualified, count(*) AS callers FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
    WHERE contains('p' || p_partkey, 'p1') GROUP BY p_partkey HAVING count(*) > 25"""
)
def source_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter text over symbols with their number of call sites and their rank."""
    _, condition = ask.filtered('symbols kind=method callers>25 name~"P1" path~lib/ is_test=no pagerank>0')
    defined, sites, pairs = resolved(sources(spark, sf_dir))
    return ranked(defined, sites, pairs).where(condition).select("qualified", "callers")


def name_edges(sites: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, weight): production calls between names, as far as any evidence speaks for them."""
    best = pairs.groupBy("site_seq").agg(F.max("tier").alias("tier")).where("tier > 0")
    used = sites.where("not caller_is_test and caller is not null").join(best, "site_seq", "left_semi")
    return used.groupBy(F.lower("caller").alias("src"), F.col("callee_l").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def ranked(defined: DataFrame, sites: DataFrame, pairs: DataFrame) -> DataFrame:
    """Symbols with callers (their name's call sites) and pagerank, as filter texts name them."""
    counted = sites.groupBy(F.col("callee_l").alias("name_l")).agg(F.count(F.lit(1)).alias("callers"))
    ranks = W.pagerank(name_edges(sites, pairs), rounds=10).select(F.col("node").alias("name_l"), F.round("rank", 12).alias("pagerank"))
    return defined.join(counted, "name_l", "left").join(ranks, "name_l", "left").withColumns({"callers": F.coalesce("callers", F.lit(0)), "pagerank": F.coalesce("pagerank", F.lit(0.0))})


@query(
    f"""WITH {_LINES} SELECT 'o' || l_orderkey AS caller, 'p' || l_partkey AS callee, CAST(tier AS INTEGER) AS tier, count(*) AS n FROM tiered
    WHERE tier >= 1 AND contains('o' || l_orderkey, 'o1') AND l_linenumber % 4 < 3 GROUP BY 1, 2, 3"""
)
def source_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter text over edges: those with evidence, from some callers, of fewer than three arguments."""
    _, condition = ask.filtered("edges tier>=ok caller~O1 argc<3 verified=no")
    _, sites, pairs = resolved(sources(spark, sf_dir))
    edges = sites.join(resolve.edge_tiers(pairs), "site_seq").withColumn("is_test", F.col("caller_is_test"))
    return edges.where(condition).groupBy("caller", "callee", "tier").agg(F.count(F.lit(1)).alias("n"))


#: A question: one word is stopped, one matches the methods p17, p170 and so on, and one no name.
QUESTION = "which p17 number"


@query(
    f"""WITH names AS (SELECT p_partkey AS p, letter || (p_partkey // {BUCKET}) || '.p' || p_partkey AS qualified FROM part, (VALUES ('L'), ('K')) AS v(letter) WHERE starts_with('p' || p_partkey, 'p17'))
    SELECT qualified, round(CASE WHEN p = 17 THEN 3 ELSE 1 END / (1 + ln(1 + (SELECT count(*) FROM names))), 6) AS name_score FROM names"""
)
def source_brief_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the names alone give a question: a word weighs less, the more names it matches, and three times as much
    where it is the whole name."""
    return _brief(spark, sf_dir)[0].where("name_score > 0").join(_brief_symbols(spark, sf_dir), ["path", "line"]).select("qualified", F.round("name_score", 6).alias("name_score"))


def _brief_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.symbols(library(spark, sf_dir)).select("path", "line", "qualified")


def _brief(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = stored(sources(spark, sf_dir), "sources")
    defined, sites, pairs = resolved(files)
    cut = stored(X.bodies(defined, files).select("path", "line", "at", T.token_estimate(F.col("body")).alias("size"), "doc"), "bodies")
    docs = defined.join(cut, ["path", "line", "at"]).select("sym_seq", F.concat_ws(" ", F.lit("part number in"), "container", "doc").alias("doc"))
    scored = S.brief(defined, files, docs, W.pagerank(name_edges(sites, pairs), rounds=10), QUESTION, stop=(*S.STOP_WORDS, "which"))
    return scored, cut


@query()
def source_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best methods for a question, greedily under a budget of tokens."""
    scored, cut = _brief(spark, sf_dir)
    sized = stored(scored.withColumn("score", F.round("score", 6)).join(cut.select("path", "line", "size"), ["path", "line"]), "brief")
    return S.within_budget(sized, "sym_seq", "score", "size", budget=6000, top=8)


# Desks, nations and regions: classes with declared receivers, interfaces and properties -------------------


def desks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """world/R<region>.cs: an interface; world/N<nation>.cs: a class that implements its region's; desk/D<customer>.cs:
    a class that calls both through fields, writes or reads a property of the nation, and has one of its own. Where
    the balance is negative, the field's name is declared again with another type."""
    n = lambda c: F.col(c).cast("string")
    join = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    region = table(spark, sf_dir, "region").select(
        join("world/R", n("r_regionkey"), ".cs").alias("path"), join("public interface IRegion", n("r_regionkey"), "\n{\n    int Weigh(int a);\n    int Price { get; }\n}\n").alias("text")
    )
    nation = table(spark, sf_dir, "nation").select(
        join("world/N", n("n_nationkey"), ".cs").alias("path"),
        join("public class Nation", n("n_nationkey"), " : Base<int>, IRegion", n("n_regionkey"), "\n{\n    public int Price { get; set; }\n    public int Weigh(int a)\n    {\n        return Price;\n    }\n}\n").alias("text"),
    )
    customer = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    poor = F.col("c_acctbal") < 0
    text = join(
        "public class Desk", n("c_custkey"), "\n{\n    private readonly Nation", n("c_nationkey"), " home;\n    private readonly IRegion", n("n_regionkey"), " zone;\n    public int Limit { get; set; }\n    public void run()\n    {\n",
        F.when(poor, "        Other home = null;\n").otherwise(""), "        home.Weigh(1);\n        zone.Weigh(2);\n        Limit += home.Price;\n",
        F.when(poor, "        home\n            .Price = 5;\n").otherwise('        Log($"{Weigh(3)}", home.Price == 5);\n'), "    }\n}\n",
    )
    desk = customer.select(join("desk/D", n("c_custkey"), ".cs").alias("path"), text.alias("text"))
    return region.unionByName(nation).unionByName(desk).select("path", F.lit("csharp").alias("language"), "text")


@query(
    """WITH d AS (SELECT c_custkey, c_nationkey, n_regionkey, c_acctbal < 0 AS poor, (SELECT count(*) FROM nation) AS all_n, (SELECT count(*) FROM nation o WHERE o.n_regionkey = n.n_regionkey) AS near_n FROM customer JOIN nation n ON c_nationkey = n_nationkey)
    SELECT 'Desk' || c_custkey AS desk, 'home' AS recv, CASE WHEN poor THEN 0 ELSE 1 END AS exact, all_n - CASE WHEN poor THEN 0 ELSE 1 END AS fits, 0 AS unknown FROM d
    UNION ALL SELECT 'Desk' || c_custkey, 'zone', near_n, all_n - near_n, 0 FROM d
    UNION ALL SELECT 'Desk' || c_custkey, '', 0, 0, all_n FROM d WHERE NOT poor"""
)
def source_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of one name in all classes: the declared type of the receiver decides, itself or as a base; a receiver with
    two types decides nothing, and a call within an interpolated string has no argument count."""
    _, _, pairs = resolved(desks(spark, sf_dir))
    count = lambda tier: F.count_if(F.col("tier") == tier)
    return pairs.groupBy(F.col("caller_container").alias("desk"), F.coalesce("recv", F.lit("")).alias("recv")).agg(count(resolve.EXACT).alias("exact"), count(resolve.FITS).alias("fits"), count(resolve.NAME_ONLY).alias("unknown"))


@query(
    """SELECT 'desk/D' || c_custkey || '.cs' AS path, 'run' AS enclosing, 'Limit' AS field, TRUE AS is_write, 1 AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT 'desk/D' || c_custkey || '.cs', 'run', 'Price', FALSE, CASE WHEN c_acctbal < 0 THEN 1 ELSE 2 END FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT 'desk/D' || c_custkey || '.cs', 'run', 'Price', TRUE, 1 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0
    UNION ALL SELECT 'world/N' || n_nationkey || '.cs', 'Weigh', 'Price', FALSE, 1 FROM nation"""
)
def source_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads and writes of properties; their declarations are none."""
    files = desks(spark, sf_dir)
    found = X.field_accesses(files, stored(X.symbols(files), "symbols"))
    return found.groupBy("path", "enclosing", "field", "is_write").agg(F.count(F.lit(1)).alias("n"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """web/S<supplier>.cs: a route, s_suppkey % 8 empty lines, and a method."""
    k = F.col("s_suppkey").cast("string")
    gap = F.repeat(F.lit("\n"), (F.col("s_suppkey") % 8).cast("int"))
    text = F.concat(F.lit("public class Web"), k, F.lit('\n{\n    [HttpGet("/supplier/'), k, F.lit('/{id}")]\n'), gap, F.lit("    public int Get"), k, F.lit("()\n    {\n        return 0;\n    }\n}\n"))
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("web/S"), k, F.lit(".cs")).alias("path"), F.lit("csharp").alias("language"), text.alias("text"))


@query(
    """SELECT '/supplier/' || s_suppkey || '/{id}' AS pattern, CASE WHEN s_suppkey % 8 < 5 THEN 'Get' ELSE 'Web' END || s_suppkey AS handler, CAST(CASE WHEN s_suppkey % 8 < 5 THEN 4 + s_suppkey % 8 ELSE 1 END AS INTEGER) AS handler_line FROM supplier"""
)
def source_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes with their handler: the method that follows within five lines, else the class around them."""
    files = pages(spark, sf_dir)
    return X.routes(files, stored(X.symbols(files), "symbols")).select("pattern", "handler", "handler_line")


@query(
    """WITH s AS (SELECT s_suppkey AS k, CAST(s_suppkey % 8 AS INTEGER) AS gap FROM supplier)
    SELECT 'S' || k || '.cs:' || (6 + gap) AS location, 'web/S' || k || '.cs' AS path, 'Get' || k AS name, CAST(CASE WHEN gap = 0 THEN 3 ELSE 4 + gap END AS INTEGER) AS first_line, CAST(7 + gap AS INTEGER) AS last_line, CAST(NULL AS VARCHAR) AS error FROM s
    UNION ALL SELECT 'web/S' || k || '.cs:2', 'web/S' || k || '.cs', 'Web' || k, 1, 8 + gap, NULL FROM s
    UNION ALL SELECT 'web\\S' || k || '.cs:900', 'web/S' || k || '.cs', NULL, NULL, NULL, 'no declaration encloses the line' FROM s
    UNION ALL SELECT 'T' || k || '.cs:4', NULL, NULL, NULL, NULL, 'no file matches' FROM s
    UNION ALL SELECT 'S' || k || '.cs', NULL, NULL, NULL, NULL, 'expected <path>:<line>' FROM s"""
)
def source_peek_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices by coordinate: suffixes of paths, with either slash, and each way to be wrong."""
    files = pages(spark, sf_dir)
    k, inside = F.col("s_suppkey").cast("string"), (F.col("s_suppkey") % 8 + 6).cast("string")
    asked = F.array(F.concat(F.lit("S"), k, F.lit(".cs:"), inside), F.concat(F.lit("web/S"), k, F.lit(".cs:2")), F.concat(F.lit("web\\S"), k, F.lit(".cs:900")), F.concat(F.lit("T"), k, F.lit(".cs:4")), F.concat(F.lit("S"), k, F.lit(".cs")))
    places = table(spark, sf_dir, "supplier").select(F.explode(asked).alias("location"))
    return X.peek_at(stored(X.symbols(files), "symbols"), files, places).select("location", "path", "name", "first_line", "last_line", "error")
