"""Queries over feeds of text lines: commit logs beside files, shortened outputs of runs, JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.functions import text as T
from srcgraph.operators import events as E
from srcgraph.operators import outputs as O
from srcgraph.operators import store as K
from srcgraph.sources import tree

from .catalog import query, table
from .code import BUCKET, library
from .linked import _join, _text


@query(
    f"""WITH c AS (SELECT o_orderkey, o_custkey, CAST(epoch(o_orderdate) AS BIGINT) AS ts, l_partkey // {BUCKET} AS k FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4),
    m AS (SELECT p_partkey // {BUCKET} AS k, sum(length('    public int p' || p_partkey || '(' || array_to_string(list_transform(range(p_size % 4), lambda i: 'int a' || i), ', ') || ')') + length('x    {{x        return 0;x    }}x')) AS n FROM part GROUP BY 1),
    f AS (SELECT k, greatest(1, CAST(round_even((n + length('public class L' || k || 'x{{x') + 2) / 4.0, 0) AS BIGINT)) AS tokens FROM m)
    SELECT 'lib/L' || f.k || '.cs' AS path, count(*) AS commits, count(DISTINCT o_custkey) AS authors, max(ts) AS last_touched, count(*) * max(tokens) AS risk FROM c JOIN f ON c.k = f.k GROUP BY f.k"""
)
def source_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits from a log joined with the files that are there: what changes often and is large. An order is a commit
    by its customer that touches the library files of its parts, and a file that is no longer there."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.unix_timestamp("o_orderdate").alias("ts"))
    touched = table(spark, sf_dir, "lineitem").select("l_orderkey", _join("lib/L", F.floor(F.col("l_partkey") / BUCKET).cast("string"), ".cs").alias("line")).distinct()
    paths = orders.join(touched, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "o_orderkey", F.lit(1).alias("n"), "line")
    header = _join(F.lpad(F.lower(F.hex("o_orderkey")), 8, "0"), "|A", _text("o_custkey"), "|", _text("ts"))
    heads = orders.select("o_custkey", "o_orderkey", F.lit(0).alias("n"), header.alias("line"))
    gone = orders.select("o_custkey", "o_orderkey", F.lit(2).alias("n"), F.lit("lib/gone.cs").alias("line"))
    # A customer's log is a part; its lines are in the order of its orders, the header first.
    log = heads.unionByName(paths).unionByName(gone).select(F.col("o_custkey").alias("part"), F.struct("o_orderkey", "n", "line").alias("line_no"), "line")
    files = library(spark, sf_dir).select("path", T.token_estimate(F.col("text")).alias("raw_tokens"))
    return E.churn(tree.commits(log).join(files, "path"), "path", "author", "ts", F.col("raw_tokens"))


@query(
    """WITH k AS (SELECT user_id AS run, event_id AS line_no, event_type <> 'view' AS said, CASE event_type WHEN 'view' THEN '' WHEN 'error' THEN 'FAIL at ' || event_id ELSE event_type || ' ' || event_id END AS line FROM events WHERE event_type <> 'click'),
    b AS (SELECT *, lag(said) OVER (PARTITION BY run ORDER BY line_no) AS before FROM k)
    SELECT run, count(*) AS lines, count(*) FILTER (said) AS said, sum(length(line)) + count(*) - 1 AS chars FROM b WHERE said OR coalesce(before, TRUE) GROUP BY run"""
)
def run_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The output of a test run of each user, shortened: passes go, and empty lines collapse."""
    line = F.when(F.col("event_type") == "click", _join("PASS ", _text("event_id"))).when(F.col("event_type") == "view", "").when(F.col("event_type") == "error", _join("FAIL at ", _text("event_id"))).otherwise(_join(F.col("event_type"), " ", _text("event_id")))
    argv = F.array(F.lit("/usr/bin/npm"), F.lit("run"), F.lit("test"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("line_no"), line.alias("line"), O.tool_of(argv).alias("tool"))
    text = O.joined_lines(O.compressed(rows))
    lines = F.split("text", "\n")
    return text.select("run", F.size(lines).cast("long").alias("lines"), F.size(F.filter(lines, lambda x: x != "")).cast("long").alias("said"), F.length("text").cast("long").alias("chars"))


@query(
    """WITH j AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type NOT IN ('click', 'view', 'signup'))
    SELECT user_id, count(*) AS n, sum(k) AS k FROM j WHERE k IS NOT NULL GROUP BY user_id"""
)
def json_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a feed in which some lines are comments, some are cut off and some lack a field."""
    kind = F.col("event_type")
    body = _join('{"user": ', _text("user_id"), ', "k": ', F.get_json_object("props", "$.k"), "}")
    value = F.when(kind == "click", _join("# ", body)).when(kind == "view", F.substring(body, 1, 12)).when(kind == "signup", _join('{"user": ', _text("user_id"), "}")).otherwise(body)
    rows = tree.json_lines(table(spark, sf_dir, "events").select(F.coalesce(value, F.lit("")).alias("value")), "user long, k long", ["user", "k"])
    return rows.groupBy(F.col("user").alias("user_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"))


@query(
    """WITH i AS (SELECT source || '/' || doc_id AS path, md5(text) AS content_hash, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS seen FROM documents d),
    k AS (SELECT * FROM i WHERE NOT starts_with(path, 'src1') OR seen)
    SELECT content_hash, count(*) AS paths, min(path) AS first_path FROM k GROUP BY 1"""
)
def index_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of documents by path and content: paths under a prefix that a walk has not seen go, and contents
    that no path names go with them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", _join(F.col("source"), "/", _text("doc_id")).alias("path"), F.md5("text").alias("content_hash"))
    index = docs.select("path", "content_hash")
    seen = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("path")
    left = K.pruned(index, seen, "src1")
    blobs = K.referenced(index.select("content_hash").distinct(), left)
    return left.join(blobs, "content_hash").groupBy("content_hash").agg(F.count(F.lit(1)).alias("paths"), F.min("path").alias("first_path"))
