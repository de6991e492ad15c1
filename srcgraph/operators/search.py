"""Text search: lines, identifier counts, co-occurrence, BM25, and a greedy bundle under a budget."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from srcgraph.functions import text as T
from srcgraph.jobs.scratch import stored

# Words that say nothing about code (fixed values).
STOP_WORDS = tuple("the a an is are to in on of for and or when does do how what why with by from get set case cases code data value result request".split())


def find_lines(docs: DataFrame, key: str, text: str, pattern: str, excerpt: int = 160) -> DataFrame:
    """Lines that match, with their number, hits and an excerpt. Texts without a hit are left out
    before their lines are made."""
    hits = docs.where(F.col(text).rlike(pattern))
    lines = hits.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).where(F.col("line").rlike(pattern))
    return lines.select(key, (F.col("pos") + 1).alias("line_no"), F.regexp_count("line", F.lit(pattern)).alias("hits"), F.substring(F.trim("line"), 1, excerpt).alias("excerpt"))


def identifiers(docs: DataFrame, key: str, text: str, pattern: str = "[A-Za-z_$][A-Za-z0-9_$]*") -> DataFrame:
    """(key, ident): every identifier in lower case."""
    return docs.select(key, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("ident")).withColumn("ident", F.lower("ident"))


def ident_freq(docs: DataFrame, key: str, text: str) -> DataFrame:
    return identifiers(docs, key, text).groupBy("ident").agg(F.count(F.lit(1)).alias("n"))


def cooccurrence(docs: DataFrame, key: str, text: str, terms: Sequence[str]) -> DataFrame:
    """How many of the terms each text holds, and how often."""
    counts = identifiers(docs, key, text).where(F.col("ident").isin(*terms)).groupBy(key, "ident").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.count(F.lit(1)).alias("score"), F.sum("n").alias("refs"))


def bm25(docs: DataFrame, key: str, text: str, terms: Sequence[str], k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Okapi scores of the texts that hold a term. Texts are split once: their lengths and hits are written as small
    rows, which give both the totals (one row) and the scores."""
    words = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0)), F.lower)
    count = lambda t: F.size(F.filter("hits", lambda x: x == t))
    split = docs.select(key, words.alias("w")).select(key, F.size("w").alias("len"), F.filter("w", lambda x: x.isin(*terms)).alias("hits"))
    per_text = stored(split.select(key, "len", *(count(t).alias(f"tf{i}") for i, t in enumerate(terms))), "bm25")
    totals = per_text.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf = F.col(f"tf{i}")
        idf = F.log(F.lit(1.0) + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    return per_text.crossJoin(F.broadcast(totals)).select(key, score.alias("score")).where("score > 0")  # totals: one row


def within_budget(ranked: DataFrame, key: str, score: str, size: str, budget: int, top: int, pool: int = 200) -> DataFrame:
    """Greedy selection by score: a slice that does not fit is passed over, not the end. The driver
    holds a pool of the best rows that fit what is left, and asks for the rows after it while fewer than
    `top` are taken. Each pool gives at least one row, so there are at most `top` and one of them."""
    rest = ranked.select(F.col(key).alias("k"), F.col(score).alias("s"), F.col(size).cast("long").alias("z"))
    used, taken, after = 0, [], F.lit(True)
    while len(taken) < top:
        best = rest.where(after & (F.col("z") <= budget - used)).orderBy(F.desc("s"), "k").limit(pool).collect()
        for row in best:
            if len(taken) < top and used + row["z"] <= budget:
                used += row["z"]
                taken.append(row["k"])
        if len(best) < pool:
            break
        last = best[-1]
        behind = F.col("k") > F.lit(last["k"])
        after = F.col("s").isNull() & behind if last["s"] is None else F.col("s").isNull() | (F.col("s") < F.lit(last["s"])) | ((F.col("s") == F.lit(last["s"])) & behind)
    schema = StructType([StructField("place", IntegerType()), StructField(key, ranked.schema[key].dataType)])
    return ranked.sparkSession.createDataFrame(list(enumerate(taken)), schema)


def spoken(text: Column) -> Column:
    """Lower-case words of letters; a lower letter or digit before a capital ends a word."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(text, "(?<=[a-z0-9])(?=[A-Z])", " "), F.lit("[A-Za-z]+"), F.lit(0)), F.lower)


def brief(symbols: DataFrame, files: DataFrame, docs: DataFrame, ranks: DataFrame, question: str, stop: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Production methods and functions with the score that a question of some words gives them:
    (sym_seq, path, name, line, name_score, rel, bm25, score), those that nothing speaks for left out. A question
    of stop words gives no row.

    symbols: name, path, line, kind, is_test, generated, sym_seq; files: path, text; docs: sym_seq, doc (one line
    on a symbol); ranks: node (lower-case name), rank. A term weighs less, the more symbols' names it matches."""
    pool = symbols.where("kind in ('method', 'function') and not is_test and not generated").select("sym_seq", "name", "path", "line")
    said = [t for t in dict.fromkeys(question.split()) if len(t) > 1 and t.lower() not in stop]
    terms = [t for t in dict.fromkeys("".join(c for c in t.lower() if c.isascii() and c.isalnum()) for t in said) if t]
    if not terms:
        zero = F.lit(0.0)
        return pool.select("sym_seq", "path", "name", "line", zero.alias("name_score"), zero.alias("rel"), zero.alias("bm25"), zero.alias("score")).limit(0)
    # One row with a number for each term.
    matched = symbols.agg(*(F.count_if(T.matches(F.col("name"), t)).alias(f"n{i}") for i, t in enumerate(terms))).first()
    weight = {t: 1.0 / (1.0 + math.log1p(matched[f"n{i}"])) for i, t in enumerate(terms)}

    def total(name: Column, exact: float) -> Column:
        """Weights of the terms that a name matches, those that are the whole name times `exact`."""
        found = F.lit(0.0)
        for t, w in weight.items():
            found = found + F.when(T.matches(name, t), w * F.when(T.collapsed(name) == t, exact).otherwise(1.0)).otherwise(0.0)
        return found

    idents = files.select("path", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0))).alias("ident"))
    counts = stored(idents.groupBy("path", "ident").agg(F.count(F.lit(1)).alias("n")), "idents")
    # The terms are held against each distinct identifier once.
    telling = counts.groupBy("ident").agg(F.sum("n").alias("n")).select("ident", total(F.col("ident"), 1.0).alias("w")).where("w > 0")
    relevant = counts.join(telling, "ident").groupBy("path").agg(F.sum(F.col("n") * F.col("w")).alias("rel"))
    freq = counts.groupBy(F.lower("ident").alias("node")).agg(F.least(F.sum("n"), F.lit(300)).alias("freq"))
    texts = pool.join(docs, "sym_seq", "left").select("sym_seq", F.concat_ws(" ", F.array_join(spoken(F.col("name")), " "), F.array_join(spoken(F.coalesce("doc", F.lit(""))), " ")).alias("said"))
    okapi = bm25(texts, "sym_seq", "said", terms)

    def scaled(df: DataFrame, column: str, name: str) -> DataFrame:
        most = df.agg(F.max(column).alias("__most"))  # one row
        return df.crossJoin(F.broadcast(most)).withColumn(name, F.when(F.col("__most") > 0, F.col(column) / F.col("__most")).otherwise(0.0)).drop("__most")

    joined = pool.withColumn("node", F.lower("name")).join(scaled(relevant, "rel", "rel"), "path", "left").join(scaled(okapi, "score", "bm25").drop("score"), "sym_seq", "left")
    joined = joined.join(freq, "node", "left").join(scaled(ranks.select("node", "rank"), "rank", "pr").drop("rank"), "node", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    scored = joined.select("sym_seq", "path", "name", "line", total(F.col("name"), 3.0).alias("name_score"), zero("rel").alias("rel"), zero("bm25").alias("bm25"), zero("freq").alias("freq"), zero("pr").alias("pr"))
    score = 100 * F.col("name_score") + 40 * F.col("rel") + 35 * F.col("bm25") + 0.05 * F.col("freq") + 30 * F.col("pr")
    return scored.where("name_score > 0 or rel >= 0.5 or bm25 > 0").select("sym_seq", "path", "name", "line", "name_score", "rel", "bm25", score.alias("score"))
