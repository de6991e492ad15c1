import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from srcgraph.functions import text as T


def naive_tokens(name):
    return [t.lower() for t in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", name, re.A)]


NAMES = ["getHTTPResponse", "XMLParser2", "snake_case_name", "A", "", "__init__", "x9y", "OrderService.Total", "ünicode", "ABCdef", "ID"]


def test_tokens_and_suffixes_equal_naive_forms(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES], "n string").select("n", T.id_tokens(F.col("n")).alias("t"), T.suffixes(F.col("n")).alias("s"), T.collapsed(F.col("n")).alias("c")).collect()
    for r in rows:
        tokens = naive_tokens(r["n"])
        assert r["t"] == tokens and r["c"] == "".join(tokens)
        assert r["s"] == ["".join(tokens[i:]) for i in range(len(tokens))]


def test_boundary_match(spark):
    got = {r["n"]: r["m"] for r in spark.createDataFrame([(n,) for n in NAMES], "n string").select("n", T.matches(F.col("n"), "Resp").alias("m")).collect()}
    assert got["getHTTPResponse"] and not got["XMLParser2"]
    assert not any(r["m"] for r in spark.createDataFrame([(n,) for n in NAMES], "n string").select(T.matches(F.col("n"), "").alias("m")).collect())


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=20))
def test_token_estimate_is_half_even(spark, lengths):
    rows = spark.createDataFrame([("x" * n,) for n in lengths], "t string").select(F.length("t").alias("n"), T.token_estimate(F.col("t")).alias("k")).collect()
    assert all(r["k"] == max(1, round(r["n"] / 4)) for r in rows)


def test_paths(spark):
    paths = {"src/tests/a.py": True, "src/Order.cs": False, "a/My.Tests/x.cs": True, "pkg/test_x.py": True, "src/latest.py": False, "web/x.spec.ts": True, "src\\test\\a.cs": True}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", T.is_test_path(F.col("p")).alias("t")).collect()
    assert {r["p"]: r["t"] for r in rows} == paths


def test_conditions_compare_text_without_case_and_numbers_as_numbers(spark):
    df = spark.createDataFrame([("Add", 2), ("Total", 10), (None, None)], "name string, n int")
    count = lambda *c: df.where(T.all_of(c, df.columns)).count()
    assert count(("name", "~", "AD")) == 1 and count(("name", "=", "total")) == 1 and count(("name", "!=", "total")) == 2
    assert count(("n", ">", "9")) == 1 and count(("n", "<=", "10")) == 2 and count(("name", ">", "1")) == 0 and count(("n", ">", "abc")) == 0
    try:
        T.all_of([("nope", "=", "1")], df.columns)
        raise AssertionError
    except ValueError:
        pass
