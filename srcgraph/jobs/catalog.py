"""Every query of the library over the standard tables, and its SQL where SQL can express it.

A query is a thin call of operators; `sql` holds what DuckDB runs on the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.functions import text as T
from srcgraph.operators import events as E
from srcgraph.operators import resolve as R
from srcgraph.operators import search as S
from srcgraph.operators import store as K
from srcgraph.operators import walk as W
from srcgraph.streaming import ingest as I

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Filters, projections, scalar functions ------------------------------------------------------


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part WHERE p_size > 40 AND lower(p_type) LIKE '%eco%' AND lower(p_brand) <> 'brand#11'")
def symbols_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    wanted = T.all_of([("p_size", ">", "40"), ("p_type", "~", "eco"), ("p_brand", "!=", "Brand#11")], part.columns)
    return part.where(wanted).select("p_partkey", "p_name", "p_brand", "p_type", "p_size")


@query("SELECT count(*) AS total FROM orders WHERE o_totalprice >= 100000 AND lower(o_orderpriority) LIKE '%urgent%'")
def filter_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.where(T.all_of([("o_totalprice", ">=", "100000"), ("o_orderpriority", "~", "urgent")], orders.columns)).agg(F.count(F.lit(1)).alias("total"))


@query("SELECT doc_id, greatest(1, CAST(round_even(length(text) / 4.0, 0) AS BIGINT)) AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query(
    """SELECT page_id, t AS token FROM (
    SELECT page_id, unnest(list_distinct(string_split(lower(regexp_extract(url, '^(?:[a-z]+://[^/?#]*)?([^?#]*)', 1)), '/'))) AS t FROM pages)
    WHERE t NOT IN ('', 'api', 'v1', 'v2', 'v3', 'index') AND NOT regexp_matches(t, '^([0-9]+|[{:<].*)$')"""
)
def url_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(T.url_tokens(F.col("url"))).alias("token"))


@query(
    """SELECT name, string_agg(t, '' ORDER BY i) AS collapsed, count(*) AS n_tokens FROM (
    SELECT name, t, i FROM (SELECT DISTINCT p_name AS name, lower(p_name) AS l FROM part),
    unnest(regexp_extract_all(l, '[a-z]+|[0-9]+')) WITH ORDINALITY AS u(t, i)) GROUP BY name"""
)
def id_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.lower("p_name").alias("l"), F.col("p_name").alias("name")).distinct()
    return names.select("name", T.collapsed(F.col("l")).alias("collapsed"), F.size(T.id_tokens(F.col("l"))).cast("long").alias("n_tokens")).where("n_tokens > 0")


@query(
    """SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name), '(^|[^a-z])(bl)') OR regexp_matches(lower(p_name), '(^|[^a-z])gre')"""
)
def boundary_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.lower("p_name")
    return table(spark, sf_dir, "part").where(T.matches(name, "bl") | T.matches(name, "gre")).select("p_partkey", "p_name")


@query(
    """SELECT doc_id, CASE WHEN length(s) > 120 THEN left(s, 119) || '…' ELSE s END AS first_sentence FROM (
    SELECT doc_id, CASE WHEN regexp_extract(c, '^(.*?[.!?])(?: |$)', 1) <> '' THEN regexp_extract(c, '^(.*?[.!?])(?: |$)', 1) ELSE c END AS s
    FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS c FROM documents))"""
)
def first_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.first_sentence(F.col("text")).alias("first_sentence"))


# Edge resolution -----------------------------------------------------------------------------

_SITES_SQL = """sites AS (SELECT l_orderkey AS caller, l_partkey AS callee_l, l_linenumber AS argc, CAST(l_suppkey % 7 AS VARCHAR) AS caller_path,
    'Brand#' || CAST(l_suppkey % 5 + 1 AS VARCHAR) || CAST(l_linenumber % 5 + 1 AS VARCHAR) AS recv_type, l_returnflag = 'R' AND l_linestatus = 'F' AS verified, l_quantity
    FROM lineitem), defs AS (SELECT p_partkey AS name_l, p_brand AS container, CAST(p_partkey % 7 AS VARCHAR) AS path,
    CASE WHEN p_size % 11 = 0 THEN -1 ELSE p_size % 4 END AS pmin, p_size % 9 AS pmax, p_size % 2 AS pflags FROM part),
    pairs AS (SELECT *, CASE WHEN argc < 0 OR pmin < 0 OR pmax < 0 THEN NULL
    ELSE (argc BETWEEN pmin AND pmax) OR (pflags = 1 AND argc + 1 BETWEEN pmin AND pmax) END AS fits FROM sites JOIN defs ON callee_l = name_l),
    tiered AS (SELECT *, CASE WHEN verified THEN 4 WHEN coalesce(fits, true) AND lower(recv_type) = lower(container) THEN 3 WHEN fits = false THEN -1
    WHEN fits AND caller_path = path THEN 2 WHEN fits THEN 1 ELSE 0 END AS tier FROM pairs)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as call sites and part as definitions: the resolver's own columns."""
    text = lambda c: c.cast("string")
    sites = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("caller"), F.col("l_partkey").alias("callee_l"), F.col("l_linenumber").alias("argc"), text(F.col("l_suppkey") % 7).alias("caller_path"),
        F.concat(F.lit("Brand#"), text(F.col("l_suppkey") % 5 + 1), text(F.col("l_linenumber") % 5 + 1)).alias("recv_type"),
        ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("verified"), F.lit(None).cast("string").alias("recv"),
        F.lit(R.RECV_EXPR).alias("recv_kind"), F.lit(None).cast("string").alias("caller_container"), "l_quantity",
    )
    size = F.col("p_size")
    defs = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("name_l"), F.col("p_brand").alias("container"), text(F.col("p_partkey") % 7).alias("path"),
        F.when(size % 11 == 0, -1).otherwise(size % 4).alias("pmin"), (size % 9).alias("pmax"), (size % 2).alias("pflags"),
    )
    return R.candidates(sites, defs).where("name_l is not null")


@query(f"WITH {_SITES_SQL} SELECT tier, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS quantity FROM tiered GROUP BY tier")
def edges_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@query(f"WITH {_SITES_SQL} SELECT callee_l AS part, count(*) AS indegree FROM tiered WHERE tier > 0 GROUP BY callee_l")
def indegree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).where("tier > 0").groupBy(F.col("callee_l").alias("part")).agg(F.count(F.lit(1)).alias("indegree"))


@query(
    f"""WITH {_SITES_SQL} SELECT callee_l AS part, caller_path, count(*) AS n_sites, greatest(0, max(tier)) AS tier,
    min(caller) AS first_caller FROM tiered GROUP BY callee_l, caller_path"""
)
def callers_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _pairs(spark, sf_dir).groupBy(F.col("callee_l").alias("part"), "caller_path")
        .agg(F.count(F.lit(1)).alias("n_sites"), F.greatest(F.lit(0), F.max("tier")).alias("tier"), F.min("caller").alias("first_caller"))
    )


@query(
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey
    ORDER BY l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS r FROM lineitem) WHERE r = 1"""
)
def calls_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min(order).alias("f"))
    return first.select("l_orderkey", "l_partkey", "f.l_suppkey", "f.l_linenumber", "f.l_quantity")


@query(
    f"""WITH {_SITES_SQL} SELECT callee_l AS part, min(tier) AS tier, count(*) AS n FROM tiered GROUP BY callee_l HAVING min(tier) = max(tier)"""
)
def unanimous_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose sites all have the same evidence."""
    grouped = _pairs(spark, sf_dir).groupBy(F.col("callee_l").alias("part")).agg(F.min("tier").alias("tier"), F.max("tier").alias("most"), F.count(F.lit(1)).alias("n"))
    return grouped.where("tier = most").drop("most")


@query(
    """SELECT o_orderkey, p_partkey, p_brand FROM (SELECT o_orderkey, p_partkey, p_brand, row_number() OVER (PARTITION BY o_orderkey
    ORDER BY CASE WHEN p_size > 25 THEN 2 ELSE 0 END + CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END DESC, p_partkey) AS r
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey) WHERE r = 1"""
)
def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One arg-max pick for each order. max_by aggregates before the shuffle; a window would sort all rows."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    score = F.when(F.col("p_size") > 25, 2).otherwise(0) + F.when(F.col("l_quantity") > 25, 1).otherwise(0)
    scored = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.max(F.struct(score.alias("s"), (-F.col("p_partkey")).alias("k"), "p_partkey", "p_brand")).alias("m"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return scored.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "m.p_partkey", "m.p_brand")


# Set-like joins ------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def deadcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    called = table(spark, sf_dir, "lineitem").select("l_orderkey")
    orders = table(spark, sf_dir, "orders")
    return orders.join(called, orders["o_orderkey"] == called["l_orderkey"], "left_anti").select("o_orderkey", "o_orderstatus")


@query(
    """SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P')"""
)
def changed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey")
    touched = table(spark, sf_dir, "lineitem").join(changed, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_partkey")
    part = table(spark, sf_dir, "part")
    return part.join(touched, part["p_partkey"] == touched["l_partkey"], "left_semi").select("p_partkey", "p_name")


@query(
    """SELECT l_suppkey AS node, 'calls' AS direction, count(*) AS n FROM lineitem GROUP BY 1
    UNION ALL SELECT l_partkey, 'callers', count(*) FROM lineitem GROUP BY 1"""
)
def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    sides = [lines.groupBy(F.col(key).alias("node")).agg(F.count(F.lit(1)).alias("n")).withColumn("direction", F.lit(name)) for key, name in (("l_suppkey", "calls"), ("l_partkey", "callers"))]
    return sides[0].unionByName(sides[1]).select("node", "direction", "n")


@query(
    """WITH lines AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), small AS (SELECT l_orderkey FROM lines GROUP BY 1 HAVING count(*) <= 100)
    SELECT a.l_partkey AS a, b.l_partkey AS b, count(*) AS weight FROM lines a JOIN lines b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey
    GROUP BY 1, 2 HAVING count(*) > 1"""
)
def coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts ordered together. An order has few lines by its schema (line numbers are small), so its
    pairs are made from its own list."""
    parts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("p"))
    pairs = F.flatten(F.transform("p", lambda x, i: F.transform(F.slice("p", i + 2, F.greatest(F.size("p") - i - 1, F.lit(0))), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return parts.select(F.explode(pairs).alias("x")).groupBy("x.a", "x.b").agg(F.count(F.lit(1)).alias("weight")).where("weight > 1")


_TOKEN_SQL = """tokens AS (SELECT page_id, t FROM (SELECT page_id, unnest(list_distinct(string_split(lower(regexp_extract(url, '^(?:[a-z]+://[^/?#]*)?([^?#]*)', 1)), '/'))) AS t FROM pages)
    WHERE t NOT IN ('', 'api', 'v1', 'v2', 'v3', 'index') AND NOT regexp_matches(t, '^([0-9]+|[{:<].*)$'))"""


@query(
    f"""WITH {_TOKEN_SQL}, names AS (SELECT DISTINCT t FROM tokens), langs AS (SELECT DISTINCT lang FROM documents)
    SELECT t AS token, count(*) AS pages, min(page_id) AS first_page FROM tokens WHERE t IN (SELECT lang FROM langs) GROUP BY t"""
)
def path_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route tokens that outside names share, by an equi-join on the token instead of pairs of routes."""
    tokens = table(spark, sf_dir, "pages").select("page_id", F.explode(T.url_tokens(F.col("url"))).alias("token"))
    names = table(spark, sf_dir, "documents").select(F.col("lang").alias("token")).distinct()
    return tokens.join(names, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page"))


@query(
    """SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_name) > 1 THEN p_brand || '/' || p_name ELSE p_name END AS label FROM part"""
)
def disambiguate(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    clashing = part.groupBy("p_name").agg(F.count(F.lit(1)).alias("n"))
    return part.join(clashing, "p_name").select("p_partkey", F.when(F.col("n") > 1, F.concat("p_brand", F.lit("/"), "p_name")).otherwise(F.col("p_name")).alias("label"))


# Walks ---------------------------------------------------------------------------------------


def _supplier_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected supplier-part graph; parts are negative nodes."""
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), (-F.col("l_partkey")).alias("p")).distinct()
    return pairs.select(F.col("s").alias("src"), F.col("p").alias("dst")).unionByName(pairs.select(F.col("p").alias("src"), F.col("s").alias("dst")))


_EDGES_SQL = """e AS (SELECT DISTINCT l_suppkey AS src, -l_partkey AS dst FROM lineitem UNION ALL SELECT DISTINCT -l_partkey, l_suppkey FROM lineitem)"""


@query(
    f"""WITH RECURSIVE {_EDGES_SQL}, walk AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION SELECT e.dst, walk.depth + 1 FROM walk JOIN e ON walk.node = e.src WHERE walk.depth < 3)
    SELECT node, min(depth) AS depth FROM walk GROUP BY node"""
)
def impact_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "supplier").where("s_suppkey = 1").select(F.col("s_suppkey").alias("node"))
    return W.reach(_supplier_part(spark, sf_dir), seeds, 3)


@query(
    f"""WITH RECURSIVE {_EDGES_SQL}, walk AS (SELECT CAST(2 AS BIGINT) AS node, 0 AS depth UNION SELECT e.dst, walk.depth + 1 FROM walk JOIN e ON walk.node = e.src WHERE walk.depth < 3),
    seen AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node)
    SELECT p_partkey, p_name, depth FROM seen JOIN part ON p_partkey = -node WHERE p_size > 45"""
)
def tests_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk through everything, harvest only some."""
    seeds = table(spark, sf_dir, "supplier").where("s_suppkey = 2").select(F.col("s_suppkey").alias("node"))
    seen = W.reach(_supplier_part(spark, sf_dir), seeds, 3)
    part = table(spark, sf_dir, "part").where("p_size > 45").select("p_partkey", "p_name")
    return part.join(seen, F.col("p_partkey") == -F.col("node")).select("p_partkey", "p_name", "depth")


@query(
    f"""WITH RECURSIVE {_EDGES_SQL}, walk AS (SELECT s_suppkey AS source, s_suppkey AS node, 0 AS depth FROM supplier WHERE s_suppkey <= 3
    UNION SELECT walk.source, e.dst, walk.depth + 1 FROM walk JOIN e ON walk.node = e.src WHERE walk.depth < 2),
    seen AS (SELECT source, node, min(depth) AS depth FROM walk GROUP BY 1, 2) SELECT source, depth, count(*) AS n FROM seen GROUP BY 1, 2"""
)
def changed_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "supplier").where("s_suppkey <= 3").select(F.col("s_suppkey").alias("source"), F.col("s_suppkey").alias("node"))
    return W.reach(_supplier_part(spark, sf_dir), seeds, 2, by="source").groupBy("source", "depth").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT r_name AS path, 0 AS depth FROM region UNION ALL SELECT r_name || '/' || n_name, 1 FROM region JOIN nation ON n_regionkey = r_regionkey
    UNION ALL SELECT r_name || '/' || n_name || '/' || c_name, 2 FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey"""
)
def trace_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("node"), F.col("r_name").alias("name"))
    levels = [(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", "n_name"), (table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", "c_name")]
    return W.path_tree(levels, root).select("path", "depth")


def _pagerank_sql(rounds: int) -> str:
    parts = ["g AS (SELECT l_suppkey AS src, -l_partkey AS dst, count(*) AS w FROM lineitem GROUP BY 1, 2 UNION ALL SELECT -l_partkey, l_suppkey, count(*) FROM lineitem GROUP BY 1, 2)",
             "o AS (SELECT src, sum(w) AS total FROM g GROUP BY src)", "c AS (SELECT count(*) AS n FROM o)", "r0 AS (SELECT src AS node, 1.0::DOUBLE / (SELECT n FROM c) AS rank FROM o)"]
    for i in range(1, rounds + 1):
        parts.append(
            f"r{i} AS (SELECT node, 0.15::DOUBLE / (SELECT n FROM c) + 0.85::DOUBLE * coalesce(flow, 0) AS rank FROM r0 LEFT JOIN "
            f"(SELECT dst, sum(rank * w / total) AS flow FROM r{i - 1} JOIN g ON node = g.src JOIN o ON o.src = g.src GROUP BY dst) ON node = dst)"
        )
    return f"WITH {', '.join(parts)} SELECT node, round(rank, 8) AS rank FROM r{rounds}"


@query(_pagerank_sql(4))
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _supplier_part_weighted(spark, sf_dir)
    return W.pagerank(edges, rounds=4).select("node", F.round("rank", 8).alias("rank"))


def _supplier_part_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s"), (-F.col("l_partkey")).alias("p")).agg(F.count(F.lit(1)).alias("weight"))
    return pairs.select(F.col("s").alias("src"), F.col("p").alias("dst"), "weight").unionByName(pairs.select(F.col("p").alias("src"), F.col("s").alias("dst"), "weight"))


@query()
def clusters_lp(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _supplier_part_weighted(spark, sf_dir).where("src > 0").select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight")
    return W.label_propagation(edges, rounds=3).groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("representative"))


# Search --------------------------------------------------------------------------------------


@query(
    """SELECT doc_id, line_no, len(regexp_extract_all(line, 'tion[a-z]')) AS hits, left(trim(line, ' '), 160) AS excerpt FROM (
    SELECT doc_id, line, i AS line_no FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, i)) WHERE regexp_matches(line, 'tion[a-z]')"""
)
def find_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.find_lines(table(spark, sf_dir, "documents"), "doc_id", "text", "tion[a-z]")


@query("""SELECT lower(t) AS ident, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*')) AS t FROM documents) GROUP BY 1""")
def ident_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ident_freq(table(spark, sf_dir, "documents"), "doc_id", "text")


TERMS = ("the", "and", "tion", "with", "thing", "from")


@query(
    """SELECT doc_id, count(DISTINCT t) AS score, count(*) AS refs FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*'))) AS t FROM documents)
    WHERE t IN ('the', 'and', 'tion', 'with', 'thing', 'from') GROUP BY doc_id"""
)
def map_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cooccurrence(table(spark, sf_dir, "documents"), "doc_id", "text", TERMS)


_BM25_SQL = """words AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: lower(x)) AS w FROM documents),
    stats AS (SELECT doc_id, len(w) AS len, len(list_filter(w, lambda x: x = 'tion')) AS a, len(list_filter(w, lambda x: x = 'thing')) AS b, len(list_filter(w, lambda x: x = 'from')) AS c FROM words),
    tot AS (SELECT count(*) AS n, avg(len) AS av, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db, count(*) FILTER (c > 0) AS dc FROM stats),
    scored AS (SELECT doc_id, ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.5 / (a + 1.5 * (0.25 + 0.75 * len / av)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.5 / (b + 1.5 * (0.25 + 0.75 * len / av))
    + ln(1 + (n - dc + 0.5) / (dc + 0.5)) * c * 2.5 / (c + 1.5 * (0.25 + 0.75 * len / av)) AS score FROM stats, tot WHERE len > 0)"""


@query(f"WITH {_BM25_SQL} SELECT doc_id, round(CAST(score AS DOUBLE), 6) AS score FROM scored WHERE score > 0")
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", ("tion", "thing", "from")).select("doc_id", F.round("score", 6).alias("score"))


@query()
def brief_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranked = S.bm25(docs, "doc_id", "text", ("tion", "thing", "from")).select("doc_id", F.round("score", 6).alias("score"))
    sized = ranked.join(docs.select("doc_id", T.token_estimate(F.col("text")).alias("size")), "doc_id")
    return S.within_budget(sized, "doc_id", "score", "size", budget=6000, top=8)


@query(
    """SELECT t AS term, count(*) AS n_docs, round(1 / (1 + ln(1 + count(*))), 9) AS weight FROM (
    SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*'))) AS t FROM documents) WHERE t IN ('the', 'and', 'tion', 'with', 'thing', 'from') GROUP BY t"""
)
def term_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.identifiers(table(spark, sf_dir, "documents"), "doc_id", "text").where(F.col("ident").isin(*TERMS)).distinct()
    return found.groupBy(F.col("ident").alias("term")).agg(F.count(F.lit(1)).alias("n_docs")).withColumn("weight", F.round(1 / (1 + F.log1p("n_docs")), 9))


@query(
    """SELECT doc_id, list_filter(['%%%', '###', '***', '&&&'], lambda m: contains(text, m)).array_to_string(',') AS gotchas FROM documents
    WHERE contains(text, '%%%') OR contains(text, '###') OR contains(text, '***') OR contains(text, '&&&')"""
)
def gotchas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = ("%%%", "###", "***", "&&&")
    found = F.array_compact(F.array(*(F.when(F.contains("text", F.lit(r)), F.lit(r)) for r in rules)))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(found, 1, 12), ",").alias("gotchas")).where("gotchas <> ''")


@query(
    """SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS link FROM pages) GROUP BY 1, 2"""
)
def markup_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(links).alias("link")).groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages) GROUP BY tag"""
)
def markup_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1))).alias("tag"))
    per_page = tags.groupBy("page_id", F.lower("tag").alias("tag")).agg(F.count(F.lit(1)).alias("n"))
    return per_page.groupBy("tag").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("pages"))


# Storage and snapshots -----------------------------------------------------------------------


@query("SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def dedup_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query(
    """SELECT source, count(*) AS n, CAST(sum(CAST('0x' || left(md5(CAST(doc_id AS VARCHAR) || chr(10) || sha256(text)), 12) AS BIGINT)) AS VARCHAR) AS fingerprint FROM documents GROUP BY source"""
)
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sum of row digests for each source: order independent, aggregated before the shuffle, and
    the same however rows are dealt."""
    row = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("\n"), F.sha2("text", 256)))
    number = F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(number).cast("string").alias("fingerprint"))


@query(
    """WITH old AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 10 <> 3), new AS (SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 4)
    SELECT coalesce(old.doc_id, new.doc_id) AS doc_id, CASE WHEN old.h IS NULL THEN 'new' WHEN new.h IS NULL THEN 'gone' WHEN old.h = new.h THEN 'unchanged' ELSE 'changed' END AS state
    FROM old FULL JOIN new ON old.doc_id = new.doc_id"""
)
def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of one table, made by leaving rows out of and changing rows of it."""
    docs = table(spark, sf_dir, "documents")
    old = docs.where("doc_id % 10 <> 3").select("doc_id", F.md5("text").alias("hash"))
    new = docs.where("doc_id % 10 <> 4").select("doc_id", F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("hash"))
    return E.snapshot_diff(old, new, "doc_id")


@query("SELECT DISTINCT o.o_custkey FROM orders o WHERE o.o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def garbage(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey")
    orders = table(spark, sf_dir, "orders").select("o_custkey")
    return orders.join(live, F.col("o_custkey") == F.col("c_custkey"), "left_anti").distinct()


@query("SELECT event_type, user_id, sum(n) AS count FROM (SELECT event_type, user_id, 1 AS n FROM events UNION ALL SELECT event_type, user_id, 2 FROM events WHERE value > 50) GROUP BY 1, 2")
def runtime_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    old = rows.select("event_type", "user_id", F.lit(1).cast("long").alias("count"))
    new = rows.where("value > 50").select("event_type", "user_id", F.lit(2).cast("long").alias("count"))
    return E.upsert_counts(old, new, ["event_type", "user_id"])


@query(
    """SELECT event_type, CAST(k AS BIGINT) AS k, count(*) AS n FROM (SELECT event_type, json_extract_string(props, '$.k') AS k FROM events) WHERE k IS NOT NULL GROUP BY 1, 2"""
)
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k BIGINT").alias("j")).where("j.k is not null")
    return parsed.groupBy("event_type", F.col("j.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


# Events --------------------------------------------------------------------------------------


@query(
    """SELECT event_id, user_id, signup_id FROM (SELECT event_id, user_id, event_type, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS signup_id FROM events) WHERE event_type = 'error'"""
)
def enclosing_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.struct("ts", "event_id").alias("at"))
    found = E.last_before(rows, "user_id", "at", F.col("event_type") == "signup", F.col("event_id"))
    return rows.withColumn("signup_id", found).where("event_type = 'error'").select("event_id", "user_id", "signup_id")


@query(
    """SELECT event_id, next_id FROM (SELECT event_id, ts, lead(event_id) OVER w AS next_id, lead(ts) OVER w AS next_ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    WHERE next_ts <= ts + INTERVAL 2 DAY"""
)
def next_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.struct("ts", "event_id").alias("at"))
    following = rows.withColumn("next", E.next_after(rows, "user_id", "at", F.struct("event_id", "ts")))
    return following.where(F.col("next.ts") <= F.col("ts") + F.expr("INTERVAL 2 DAYS")).select("event_id", F.col("next.event_id").alias("next_id"))


@query(
    """SELECT event_type, count(*) AS commits, count(DISTINCT user_id) AS authors, max(ts) AS last_touched, count(*) * max(CAST(floor(value) AS BIGINT)) AS risk FROM events GROUP BY event_type"""
)
def churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.churn(table(spark, sf_dir, "events"), "event_type", "user_id", "ts", F.floor("value").cast("long"))


@query(
    """SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked_at FROM conversations"""
)
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return rows.withColumn("asked_at", E.carried(rows, "conv_id", "turn", F.when(F.col("role") == "user", F.col("turn"))))


# Reports -------------------------------------------------------------------------------------


@query(
    """SELECT 'lang' AS kind, lang AS name, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source
    UNION ALL SELECT 'hotspot', CAST(l_partkey AS VARCHAR), n FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 15)"""
)
def arch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    parts = [docs.groupBy(F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(c)) for c in ("lang", "source")]
    hot = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l_partkey").limit(15)
    parts.append(hot.select(F.col("l_partkey").cast("string").alias("name"), "n", F.lit("hotspot").alias("kind")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("kind", "name", "n")


@query(
    """SELECT source, count(*) AS files, sum(CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END) AS missing, sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS outdated
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source"""
)
def status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_id"), "quality")
    joined = docs.join(labels, F.col("doc_id") == F.col("l_id"), "left")
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("l_id").isNull()).alias("missing"), F.count_if(F.col("quality") == 0).alias("outdated"))


@query("SELECT o_orderpriority, arg_max(o_orderstatus, (n, o_orderstatus)) AS runner, max(n) AS n FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def dominant_runner(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("o_orderpriority").agg(F.max_by("o_orderstatus", F.struct("n", "o_orderstatus")).alias("runner"), F.max("n").alias("n"))


@query(
    """SELECT doc_id, raw_tokens, summary_tokens, round(CAST(raw_tokens AS DOUBLE) / summary_tokens, 2) AS ratio FROM (
    SELECT doc_id, greatest(1, CAST(round_even(length(text) / 4.0, 0) AS BIGINT)) AS raw_tokens, greatest(1, CAST(round_even(least(length(s), 120) / 4.0, 0) AS BIGINT)) AS summary_tokens FROM (
    SELECT doc_id, text, CASE WHEN regexp_extract(c, '^(.*?[.!?])(?: |$)', 1) <> '' THEN regexp_extract(c, '^(.*?[.!?])(?: |$)', 1) ELSE c END AS s
    FROM (SELECT doc_id, text, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS c FROM documents)))"""
)
def show_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much shorter a text's one-line summary is."""
    sized = table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("raw_tokens"), T.token_estimate(T.first_sentence(F.col("text"))).alias("summary_tokens"))
    return sized.withColumn("ratio", F.round(F.col("raw_tokens") / F.col("summary_tokens"), 2))


@query(
    """SELECT p_partkey, p_name, p_size FROM part WHERE lower(p_type) LIKE '%eco%' ORDER BY p_size DESC, p_name, p_partkey LIMIT 5"""
)
def peek_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.contains(F.lower("p_type"), F.lit("eco"))).orderBy(F.desc("p_size"), "p_name", "p_partkey").limit(5).select("p_partkey", "p_name", "p_size")


@query(
    """SELECT doc_id, n_lines, CASE WHEN n_lines > 5 THEN array_to_string(list_slice(l, 1, 5), chr(10)) || chr(10) || '… ' || CAST(n_lines - 5 AS VARCHAR) || ' more' ELSE text END AS shown
    FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l, len(string_split(text, chr(10))) AS n_lines FROM documents)"""
)
def compress_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first lines and how many more there are, where that is shorter in lines."""
    split = F.split("text", "\n")
    cut = F.concat(F.array_join(F.slice(split, 1, 5), "\n"), F.lit("\n… "), (F.size(split) - 5).cast("string"), F.lit(" more"))
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(split).cast("long").alias("n_lines"), F.when(F.size(split) > 5, cut).otherwise(F.col("text")).alias("shown"))


@query(
    """SELECT host, arg_min(page_id, (length(url), page_id)) AS page_id FROM (SELECT page_id, url, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages) GROUP BY host"""
)
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))
    return pages.groupBy("host").agg(F.min_by("page_id", F.struct(F.length("url"), "page_id")).alias("page_id"))


@query(
    """SELECT doc_id, sum(n) AS refs FROM (SELECT doc_id, lower(t) AS ident, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*')) AS t FROM documents) GROUP BY 1, 2)
    WHERE regexp_matches(ident, '(^|[_$0-9])thing') GROUP BY doc_id"""
)
def ref_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted by distinct identifier before the boundary match is evaluated."""
    counted = S.identifiers(table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("doc_id", "ident").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(T.matches(F.col("ident"), "thing")).groupBy("doc_id").agg(F.sum("n").alias("refs"))


@query(
    """SELECT d.doc_id, l.doc_id IS NOT NULL AS indexed FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE contains(d.text, 'copyright') OR contains(d.text, 'license')"""
)
def find_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in indexed and in other documents, one union."""
    docs = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("copyright")) | F.contains("text", F.lit("license"))).select("doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id")
    inside = docs.join(labels, "doc_id", "left_semi").withColumn("indexed", F.lit(True))
    return inside.unionByName(docs.join(labels, "doc_id", "left_anti").withColumn("indexed", F.lit(False)))


@query(
    """SELECT doc_id, source FROM documents d WHERE source LIKE 'src1%' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"""
)
def prune_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows under a prefix that were not seen: only these would go."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").where(F.startswith("source", F.lit("src1")))
    return docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query(
    """SELECT pattern, count(*) AS pages, min(page_id) AS first_page FROM (SELECT page_id, regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '[0-9]+', '{n}', 'g') AS pattern FROM pages) GROUP BY pattern"""
)
def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = F.regexp_replace(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1), "[0-9]+", "{n}")
    return table(spark, sf_dir, "pages").select("page_id", pattern.alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page"))


@query(
    """SELECT doc_id, CASE WHEN c < r THEN c ELSE r END AS shipped, c < r AS compressed FROM (SELECT doc_id, greatest(1, CAST(round_even(length(text) / 4.0, 0) AS BIGINT)) AS r,
    greatest(1, CAST(round_even((length(regexp_replace(text, chr(10) || '+', chr(10), 'g')) + 40) / 4.0, 0) AS BIGINT)) AS c FROM documents)"""
)
def never_worse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compressed form counts, with its trailer of 40 characters, only where it is smaller."""
    small = F.concat(F.regexp_replace("text", "\n+", "\n"), F.lit(" " * 40))
    sized = table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("r"), T.token_estimate(small).alias("c"))
    return sized.select("doc_id", F.least("c", "r").alias("shipped"), (F.col("c") < F.col("r")).alias("compressed"))


@query(
    f"""WITH {_SITES_SQL}, per AS (SELECT caller, callee_l, max(tier) AS best, min(tier) AS worst, count(*) AS n FROM tiered GROUP BY 1, 2)
    SELECT caller, callee_l AS part, n FROM per WHERE worst = -1 AND best > -1"""
)
def narrowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges where contradictions leave something over."""
    per = _pairs(spark, sf_dir).groupBy("caller", F.col("callee_l").alias("part")).agg(F.max("tier").alias("best"), F.min("tier").alias("worst"), F.count(F.lit(1)).alias("n"))
    return per.where("worst = -1 and best > -1").select("caller", "part", "n")


@query("SELECT l_partkey AS field, l_returnflag = 'R' AS is_write, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 7 GROUP BY 1, 2")
def field_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads and writes of known fields: a semi join first, then counts."""
    fields = table(spark, sf_dir, "part").where("p_size = 7").select("p_partkey")
    uses = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("field"), (F.col("l_returnflag") == "R").alias("is_write"))
    return uses.join(fields, F.col("field") == F.col("p_partkey"), "left_semi").groupBy("field", "is_write").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, user_id, count(*) AS count FROM events GROUP BY 1, 2")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.run_upserts(I.event_stream(spark, sf_dir), ["event_type", "user_id"])


@query(
    """SELECT c.c_custkey, n.n_name, o.n_orders FROM customer c JOIN nation n ON c_nationkey = n_nationkey JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) o ON o_custkey = c_custkey"""
)
def caller_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites to their callers by key, counted before the join."""
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return counts.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "n_orders")


@query(
    f"""WITH RECURSIVE {_EDGES_SQL}, walk AS (SELECT [s_suppkey] AS path, 0 AS depth, false AS is_cycle FROM supplier WHERE s_suppkey = 1 UNION ALL
    SELECT list_append(path, dst), depth + 1, list_contains(path, dst) FROM walk JOIN e ON path[len(path)] = src WHERE depth < 2 AND NOT is_cycle)
    SELECT array_to_string(path, '>') AS path, depth, is_cycle FROM walk"""
)
def trace_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path tree over the whole graph that cuts cycles along each path only."""
    seeds = table(spark, sf_dir, "supplier").where("s_suppkey = 1").select(F.col("s_suppkey").alias("node"))
    paths = W.trace(_supplier_part(spark, sf_dir), seeds, 2)
    return paths.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "depth", "is_cycle")


@query(
    """WITH rows AS (SELECT user_id, event_type, value, ts, event_id FROM events UNION ALL SELECT user_id, event_type, value + 1, ts + INTERVAL 1 DAY, event_id FROM events WHERE value > 50)
    SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC, value DESC) AS r FROM rows) WHERE r = 1"""
)
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as the old version, and new ones, a day later, of those whose value is high."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts", "event_id")
    new = rows.where("value > 50").withColumns({"value": F.col("value") + 1, "ts": F.col("ts") + F.expr("INTERVAL 1 DAY")})
    return K.upsert(rows, new, ["user_id", "event_type"], ["ts", "event_id", "value"]).select("user_id", "event_type", "value")


@query(
    """SELECT p_partkey, p_name, o_orderkey FROM part JOIN (SELECT l_partkey, min(l_orderkey) AS o_orderkey FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON l_partkey = p_partkey WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)"""
)
def first_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first heavy site of each definition that is dearer than most."""
    sites = table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy("l_partkey").agg(F.min("l_orderkey").alias("o_orderkey"))
    part = table(spark, sf_dir, "part")
    mean = part.agg(F.avg("p_retailprice").alias("mean"))
    part = part.crossJoin(F.broadcast(mean)).where("p_retailprice > mean").select("p_partkey", "p_name")  # mean: one row
    return part.join(sites, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", "p_name", "o_orderkey")
