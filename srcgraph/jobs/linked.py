"""Queries over several tables of names: word-boundary joins, repositories and their links, labels, communities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.operators import digest as D
from srcgraph.operators import extract as X
from srcgraph.operators import names as N
from srcgraph.operators import repos as P
from srcgraph.operators import walk as W

from .catalog import query, table
from .code import _LINES, BUCKET, pages, resolved, sources
from .scratch import stored


def _join(*parts: Column | str) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _text(column: str) -> Column:
    return F.col(column).cast("string")


@query(
    """WITH n AS (SELECT DISTINCT p_name AS name, regexp_extract_all(lower(p_name), '[a-z]+|[0-9]+') AS t FROM part),
    s AS (SELECT DISTINCT name, array_to_string(t[i:], '') AS suffix FROM n, unnest(range(1, len(t) + 1)) AS u(i)),
    q AS (SELECT DISTINCT w AS query, lower(w) AS c FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part UNION ALL SELECT left(unnest(string_split(p_name, ' ')), 3) FROM part UNION ALL SELECT p_type FROM part))
    SELECT DISTINCT name, query FROM s JOIN q ON starts_with(suffix, c)"""
)
def boundary_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts against words of names, their first letters, and types."""
    part = table(spark, sf_dir, "part")
    word = part.select(F.explode(F.split("p_name", " ")).alias("query"))
    asked = word.unionByName(word.select(F.substring("query", 1, 3).alias("query"))).unionByName(part.select(F.col("p_type").alias("query")))
    return N.matching(part.select(F.col("p_name").alias("name")), asked, "name", "query")


def shops(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files of two repositories: shop, where each customer's class asks for its nation's list, and api, where each
    supplier's class serves a path of its nation."""
    n = _text
    shop = table(spark, sf_dir, "customer").select(
        _join("shop/C", n("c_custkey"), ".cs").alias("path"), F.lit("shop").alias("repo"), F.lit("csharp").alias("language"),
        _join("public class C", n("c_custkey"), '\n{\n    public void load()\n    {\n        http.GetAsync("/api/nation', n("c_nationkey"), '/list?x=1");\n        http.GetAsync("/api/v1");\n    }\n}\n').alias("text"),
    )
    api = table(spark, sf_dir, "supplier").select(
        _join("api/S", n("s_suppkey"), ".cs").alias("path"), F.lit("api").alias("repo"), F.lit("csharp").alias("language"),
        _join("public class S", n("s_suppkey"), '\n{\n    [HttpGet("/v2/Nation', n("s_nationkey"), "/{id}/", n("s_suppkey"), '")]\n    public int serve(int id)\n    {\n        return id;\n    }\n}\n').alias("text"),
    )
    files = shop.unionByName(api)
    return files, stored(X.symbols(files), "symbols")


@query(
    """SELECT 'C' || c_custkey || '.load' AS from_symbol, 5 AS from_line, 'S' || s_suppkey || '.serve' AS to_symbol, '/v2/Nation' || s_nationkey || '/{id}/' || s_suppkey AS route, 'nation' || s_nationkey AS evidence
    FROM customer JOIN supplier ON c_nationkey = s_nationkey"""
)
def suggested_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and routes of two repositories that share a word of their paths."""
    files, defined = shops(spark, sf_dir)
    found = P.suggested(P.outbound(files, defined), P.served(files, defined)).where("from_repo = 'shop' and to_repo = 'api'")
    return found.select("from_symbol", "from_line", "to_symbol", "route", F.array_join("evidence", ",").alias("evidence"))


@query(
    """WITH c AS (SELECT c_custkey AS k FROM customer), o AS (SELECT o_custkey AS k, o_orderkey AS o, o_orderstatus AS s FROM orders JOIN c ON o_custkey = k),
    l AS (SELECT DISTINCT k, o, l_partkey AS p FROM o JOIN lineitem ON l_orderkey = o WHERE s = 'F')
    SELECT 0 AS depth, 'shop' AS repo, FALSE AS crossed, '' AS error, count(*) AS n FROM c
    UNION ALL SELECT 1, 'shop', FALSE, '', count(*) FROM o
    UNION ALL SELECT 2, 'api', TRUE, '', count(*) FROM o WHERE s = 'F'
    UNION ALL SELECT 2, 'lost', TRUE, 'unknown repository lost', count(*) FROM o WHERE s = 'P' HAVING count(*) > 0
    UNION ALL SELECT 3, 'api', FALSE, '', count(*) FROM l"""
)
def cross_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From customers to orders in one repository, over links to the lines of filled orders in another, and to
    their parts; links of pending orders lead nowhere. Counted by depth."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    name = lambda letter, key: _join(letter, _text(key), "x")
    first = orders.select(F.lit("shop").alias("repo"), name("c", "o_custkey").alias("caller"), name("o", "o_orderkey").alias("callee"), F.lit(False).alias("is_test"))
    second = lines.select(F.lit("api").alias("repo"), name("l", "l_orderkey").alias("caller"), name("p", "l_partkey").alias("callee"), F.lit(False).alias("is_test"))
    links = orders.where("o_orderstatus in ('F', 'P')").select(F.lit("shop").alias("from_repo"), name("o", "o_orderkey").alias("from_symbol"), F.when(F.col("o_orderstatus") == "F", "api").otherwise("lost").alias("to_repo"), name("l", "o_orderkey").alias("to_symbol"))
    seeds = table(spark, sf_dir, "customer").select(F.lit("shop").alias("repo"), name("c", "c_custkey").alias("name"))
    found = P.cross_trace(first.unionByName(second), links, seeds, 3)
    return found.groupBy("depth", "repo", "crossed", F.coalesce("error", F.lit("")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


_PATHS = "SELECT DISTINCT regexp_replace(url, '^[a-z]+://', '') AS path FROM pages WHERE url IS NOT NULL"


@query(
    f"""WITH p AS ({_PATHS}), s AS (SELECT path, string_split(path, '/') AS g FROM p),
    e AS (SELECT path, n, array_to_string(g[len(g) - n + 1:], '/') AS label FROM s, unnest(range(1, len(g) + 1)) AS u(n)),
    once AS (SELECT label FROM e GROUP BY label HAVING count(*) = 1)
    SELECT p.path, coalesce(min_by(e.label, e.n) FILTER (once.label IS NOT NULL), p.path) AS label FROM p JOIN e ON p.path = e.path LEFT JOIN once ON e.label = once.label GROUP BY p.path"""
)
def path_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest ending of each page's path that no other page has."""
    paths = table(spark, sf_dir, "pages").where("url is not null").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return N.labels(paths, "path")


@query(
    f"""WITH p AS ({_PATHS}), s AS (SELECT path, string_split(path, '/')[1] AS host, string_split(path, '/') AS g FROM p),
    pre AS (SELECT host, n, array_to_string(g[1:n], '/') AS root, count(*) AS c FROM s, unnest(range(1, len(g))) AS u(n) GROUP BY 1, 2, 3),
    total AS (SELECT host, count(*) AS c FROM s GROUP BY host)
    SELECT total.host, coalesce(max_by(pre.root, pre.n), '') AS root FROM total LEFT JOIN pre ON pre.host = total.host AND pre.c = total.c GROUP BY total.host"""
)
def path_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest folder that all pages of a host are in."""
    paths = table(spark, sf_dir, "pages").where("url is not null").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path")).distinct()
    return N.common_root(paths.withColumn("host", F.split("path", "/")[0]), "path", ["host"])


def file_coupling(sites: DataFrame, defined: DataFrame) -> DataFrame:
    """(a, b, weight): production call sites between files, each counted for the first file, other than its own, that
    defines its callee. Two paths are kept of each name: the first and the first other one."""
    paths = defined.select("name_l", "path").distinct()
    first = paths.groupBy("name_l").agg(F.min("path").alias("first"))
    other = paths.join(first, "name_l").where("path <> first").groupBy("name_l").agg(F.min("path").alias("second"))
    ends = first.join(other, "name_l", "left").withColumnRenamed("name_l", "callee_l")
    # Sites of one name in one file count together before they meet the definitions.
    used = sites.where("caller is not null and not caller_is_test").groupBy("callee_l", "caller_path").agg(F.count(F.lit(1)).alias("n"))
    met = used.join(ends, "callee_l").withColumn("target", F.when(F.col("first") != F.col("caller_path"), F.col("first")).otherwise(F.col("second"))).where("target is not null")
    return met.groupBy(F.least("caller_path", "target").alias("a"), F.greatest("caller_path", "target").alias("b")).agg(F.sum("n").alias("weight"))


_COUPLED = f"""SELECT 'alt/K' || (l_partkey // {BUCKET}) || '.cs' AS a, 'app/C' || o_custkey || '.cs' AS b, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""


def _coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = sources(spark, sf_dir)
    facts = stored(X.scanned(files), "facts")
    defined = X.symbols(facts)
    return file_coupling(X.call_sites(files, defined, facts), defined)


@query(_COUPLED)
def source_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often files call each other."""
    return _coupling(spark, sf_dir)


@query()
def source_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of files by modularity, with their size, weight and the file with most of it."""
    edges = stored(_coupling(spark, sf_dir), "coupling")
    return W.community_stats(edges, stored(W.communities(edges), "communities"))


@query(
    """WITH m AS (SELECT n_name AS node, r_name AS community FROM nation JOIN region ON n_regionkey = r_regionkey),
    e AS (SELECT least(c.n_name, s.n_name) AS a, greatest(c.n_name, s.n_name) AS b, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation c ON c_nationkey = c.n_nationkey JOIN nation s ON s_nationkey = s.n_nationkey GROUP BY 1, 2),
    i AS (SELECT a, b, weight FROM e JOIN m x ON a = x.node JOIN m y ON b = y.node WHERE x.community = y.community),
    w AS (SELECT node, sum(weight) AS w FROM (SELECT a AS node, weight FROM i UNION ALL SELECT b, weight FROM i) GROUP BY node),
    r AS (SELECT community, m.node, coalesce(w, 0) AS w FROM m LEFT JOIN w ON w.node = m.node)
    SELECT community, count(*) AS size, CAST(sum(w) / 2 AS DOUBLE) AS weight, min_by(node, (-w, node)) AS representative FROM r GROUP BY community"""
)
def region_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of given groups: nations by region, tied by what they sell to each other."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    members = nation.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("node"), F.col("r_name").alias("community"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    orders = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.sum("n").alias("n"))
    sold = orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    name = lambda key, c: nation.select(F.col("n_nationkey").alias(key), F.col("n_name").alias(c))
    pairs = sold.groupBy("c_nationkey", "s_nationkey").agg(F.sum("n").alias("n")).join(name("c_nationkey", "x"), "c_nationkey").join(name("s_nationkey", "y"), "s_nationkey")
    edges = pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("n").cast("double").alias("weight"))
    return W.community_stats(edges, members)


@query(
    f"""WITH d AS (SELECT p_partkey // {BUCKET} AS k, count(*) AS n FROM part WHERE starts_with('p' || p_partkey, 'p17') GROUP BY 1),
    r AS (SELECT o_custkey AS c, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE starts_with('p' || l_partkey, 'p17') GROUP BY 1)
    SELECT 'lib/L' || k || '.cs' AS path, n AS defs, n AS refs, TRUE AS entry FROM d UNION ALL SELECT 'alt/K' || k || '.cs', n, n, TRUE FROM d UNION ALL SELECT 'app/C' || c || '.cs', 0, n, FALSE FROM r"""
)
def source_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that define or use what a word matches."""
    files = sources(spark, sf_dir)
    return D.digest(files, X.symbols(files), "p17").select("path", "defs", "refs", "entry")


@query(
    f"""WITH {_LINES}, s AS (SELECT l_partkey AS p, min(tier) AS least FROM tiered GROUP BY 1)
    SELECT 'p' || p AS callee, 2 AS definitions, CASE WHEN least = 3 THEN 'lib/L' || (p // {BUCKET}) || '.cs' END AS resolved FROM s"""
)
def source_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Called names with several definitions, and the one that all their sites mean."""
    defined, _, pairs = resolved(sources(spark, sf_dir))
    return D.ambiguity(defined, pairs).select("callee", "definitions", "resolved")


@query(
    """WITH n AS (SELECT DISTINCT p_name AS name, string_split(p_name, ' ') AS w FROM part), a AS (SELECT p_partkey AS id, unnest(string_split(p_name, ' ')) AS word FROM part),
    s AS (SELECT name, array_to_string(w, '_') AS query, array_to_string(w[i:], '') AS suffix, array_to_string(w, '') AS whole FROM n, unnest(range(1, len(w) + 1)) AS u(i)),
    m AS (SELECT DISTINCT word, query FROM (SELECT DISTINCT word FROM a) JOIN s ON starts_with(suffix, word) OR starts_with(word, whole))
    SELECT DISTINCT id, query FROM a JOIN m USING (word)"""
)
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that concern a name: each part is one on the words of its name, and each distinct name is asked for."""
    part = table(spark, sf_dir, "part")
    records = part.select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("affects"))
    return D.concerning(records, part.select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("query")).distinct())


@query(
    """WITH s AS (SELECT s_suppkey AS k, s_suppkey % 8 AS gap FROM supplier),
    t AS (SELECT *, length('public class Web' || k || 'x{x    [HttpGet("/supplier/' || k || '/{id}")]x') + gap + length('    public int Get' || k || '()x    {x        return 0;x    }x}x') AS n FROM s)
    SELECT 'web/S' || k || '.cs' AS path, 'web/S' || k || '.cs: csharp, ' || greatest(1, CAST(round_even(n / 4.0, 0) AS BIGINT)) || ' tokens' || chr(10) || 'class Web' || k || ' L1' || chr(10) || 'method Web' || k || '.Get' || k || ' L' || (4 + gap) AS summary FROM t"""
)
def source_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short summary of each file."""
    files = pages(spark, sf_dir)
    return D.summaries(files, X.symbols(files))


def tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sources() and tests/T<customer>.cs: a method that calls those of the customer's orders."""
    line = _join("        o", _text("o_orderkey"), "();\n")
    lines = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", line.alias("l")).groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "l"))), lambda x: x.l), "").alias("b"))
    k = _text("o_custkey")
    text = _join("public class T", k, "\n{\n    public void check", k, "()\n    {\n", F.col("b"), "    }\n}\n")
    return sources(spark, sf_dir).unionByName(lines.select(_join("tests/T", k, ".cs").alias("path"), F.lit("csharp").alias("language"), text.alias("text")))


_COVERED = """t AS (SELECT o_custkey AS c, min(o_orderkey) AS o, min('o' || o_orderkey) AS via FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE starts_with('p' || l_partkey, 'p17') GROUP BY 1)"""


def _covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tested(spark, sf_dir)
    facts = stored(X.scanned(files), "facts")
    return D.covering_tests(X.calls(files, facts), X.symbols(facts), "p17")


@query(f"WITH {_COVERED} SELECT 'check' || c AS name, 'T' || c AS container, 'tests/T' || c || '.cs' AS path, 3 AS line, 2 AS depth, via FROM t")
def source_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests that reach the parts that a word matches, through the orders that call them."""
    return _covering(spark, sf_dir)


@query(
    f"""WITH {_COVERED}, f AS (SELECT 'T' || c || '.check' || c AS n, row_number() OVER (ORDER BY 'tests/T' || c || '.cs') AS r, count(*) OVER () AS k FROM t)
    SELECT 'dotnet test --filter "' || string_agg('FullyQualifiedName~' || n, '|' ORDER BY r) || '"' || CASE WHEN max(k) > 12 THEN '   # +' || (max(k) - 12) || ' more not included' ELSE '' END AS command FROM f WHERE r <= 12"""
)
def source_test_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command that runs the nearest of those tests."""
    return D.test_command(_covering(spark, sf_dir))
