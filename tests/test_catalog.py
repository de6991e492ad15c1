"""Every query of the catalogue against its SQL on DuckDB."""

import oracle
import pytest
from conftest import SF

from srcgraph.jobs import code, feeds, linked  # noqa: F401
from srcgraph.jobs.catalog import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert oracle.spark(QUERIES[name](spark, SF)) == oracle.duck(ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_budget_equals_a_plain_loop(spark):
    from pyspark.sql import functions as F

    from srcgraph.operators.search import within_budget

    rows = [(i, float((i * 37) % 11), (i * 53) % 400 + 1) for i in range(60)]
    got = [r["k"] for r in within_budget(spark.createDataFrame(rows, "k long, s double, z long"), "k", "s", "z", 900, 6).orderBy("place").collect()]
    used, want = 0, []
    for k, _, z in sorted(rows, key=lambda r: (-r[1], r[0])):
        if len(want) < 6 and used + z <= 900:
            want.append(k)
            used += z
    assert got == want
    empty = spark.createDataFrame([], "k long, s double, z long")
    assert within_budget(empty, "k", "s", "z", 900, 6).agg(F.count("k")).first()[0] == 0


def test_budget_looks_past_rows_that_do_not_fit(spark):
    from srcgraph.operators.search import within_budget

    # 250 rows over the budget, one of 500, then 250 over what it leaves, then three that fit.
    sizes = [901] * 250 + [500] + [401] * 250 + [200, 150, 50]
    rows = [(i, float(1000 - i), z) for i, z in enumerate(sizes)]
    got = within_budget(spark.createDataFrame(rows, "k long, s double, z long"), "k", "s", "z", 900, 6).orderBy("place").collect()
    assert [(r["place"], r["k"]) for r in got] == [(0, 250), (1, 501), (2, 502), (3, 503)]


def test_entry_gives_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
