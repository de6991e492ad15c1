"""Names and paths of two tables held against each other: word-boundary matches, common roots, shortest labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.functions import text as T

#: Letters of the key that names and queries meet by.
KEY = 6


def _wanted(query: str) -> Column:
    """A query as one word: letters and digits in lower case."""
    return F.lower(F.regexp_replace(query, "[^A-Za-z0-9]", ""))


def matching(names: DataFrame, queries: DataFrame, name: str, query: str, on: list[str] | None = None) -> DataFrame:
    """Distinct (on..., name, query) where a run of words at the end of the name begins with the query's words: the
    match that text.matches makes for one query, for two tables. A name comes once for each of its suffixes, with its
    first KEY letters; a query of as many letters meets it by these. A shorter query first meets the distinct
    beginnings of suffixes that begin with it, each of which stands for a match. Empty queries match nothing."""
    on = on or []
    keyed = by_suffix(names.select(*on, name).distinct(), name, on)
    return matched(keyed, beginnings(keyed, on), queries, name, query, on)


def by_suffix(names: DataFrame, name: str, on: list[str]) -> DataFrame:
    """(on..., name, __s, __k): the suffixes of distinct names with the letters that queries meet them by."""
    return names.select(*on, name, F.explode(F.array_distinct(T.suffixes(F.col(name)))).alias("__s")).withColumn("__k", F.substring("__s", 1, KEY))


def beginnings(keyed: DataFrame, on: list[str]) -> DataFrame:
    """(on..., __k, __q): the keys that a shorter query begins."""
    heads = F.transform(F.sequence(F.lit(1), F.least(F.length("__k"), F.lit(KEY - 1))), lambda i: F.substring(F.col("__k"), F.lit(1), i))
    return keyed.select(*on, "__k").distinct().where("__k <> ''").select(*on, "__k", F.explode(heads).alias("__q"))


def matched(keyed: DataFrame, begun: DataFrame, queries: DataFrame, name: str, query: str, on: list[str]) -> DataFrame:
    """matching(), with what by_suffix and beginnings make of the names."""
    asked = queries.select(*on, query).distinct().withColumn("__q", _wanted(query)).where("__q <> ''")
    short = asked.where(F.length("__q") < KEY).join(begun, [*on, "__q"])
    long = asked.where(F.length("__q") >= KEY).withColumn("__k", F.substring("__q", 1, KEY))
    columns = [*on, query, "__q", "__k"]
    return keyed.join(long.select(columns).unionByName(short.select(columns)), [*on, "__k"]).where(F.startswith("__s", F.col("__q"))).select(*on, name, query).distinct()


def matching_exactly(names: DataFrame, queries: DataFrame, name: str, query: str, on: list[str] | None = None) -> DataFrame:
    """Distinct (on..., name, query) whose words are the same."""
    on = on or []
    return names.select(*on, name).distinct().withColumn("__k", T.collapsed(F.col(name))).join(queries.select(*on, query).distinct().withColumn("__k", _wanted(query)).where("__k <> ''"), [*on, "__k"]).select(*on, name, query)


def segments(path: str) -> Column:
    return F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")


def common_root(paths: DataFrame, path: str, by: list[str] | None = None) -> DataFrame:
    """(by..., root): the longest folder that all paths of a group are in. The first and the last folder in order
    agree on just what all agree on, so two values are kept for a group."""
    folder = F.slice(segments(path), F.lit(1), F.greatest(F.size(segments(path)) - 1, F.lit(0)))
    ends = paths.where(F.col(path).isNotNull() & (F.col(path) != "")).select(*(by or []), folder.alias("f")).groupBy(*(by or [])).agg(F.min("f").alias("least"), F.max("f").alias("most"))
    places = F.sequence(F.lit(1), F.greatest(F.least(F.size("least"), F.size("most")), F.lit(1)))
    differs = F.filter(places, lambda i: ~F.coalesce(F.try_element_at("least", i) == F.try_element_at("most", i), F.lit(False)))
    shared = F.when(F.size(differs) > 0, F.get(differs, F.lit(0)) - 1).otherwise(F.least(F.size("least"), F.size("most")))
    return ends.select(*(by or []), F.coalesce(F.array_join(F.slice("least", F.lit(1), F.greatest(shared, F.lit(0))), "/"), F.lit("")).alias("root"))


def labels(paths: DataFrame, path: str) -> DataFrame:
    """(path, label): the fewest last segments that no other path ends in, found length by length: paths whose
    label is taken lengthen it and are counted again."""
    left = paths.select(path).where(F.col(path).isNotNull() & (F.col(path) != "")).distinct().withColumn("__s", segments(path))
    ends = left.select(path, F.explode(F.transform(F.sequence(F.lit(1), F.size("__s")), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("__s", F.size("__s") - n + 1, n), "/").alias("label")))).alias("e")).select(path, "e.n", "e.label")
    alone = ends.groupBy("label").agg(F.count(F.lit(1)).alias("c"), F.min(path).alias("one")).where("c = 1").select("label", F.col("one").alias(path))
    short = ends.join(alone, [path, "label"]).groupBy(path).agg(F.min_by("label", "n").alias("short"))
    return left.select(path).join(short, path, "left").select(path, F.coalesce("short", path).alias("label"))
