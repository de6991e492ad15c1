import random
from collections import deque

from pyspark.sql import functions as F

from srcgraph.operators import resolve as R
from srcgraph.operators import walk as W


def graph(n=40, m=120, seed=1):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


def test_reach_equals_queue_search(spark):
    edges = graph()
    want, todo = {0: 0}, deque([0])
    while todo:
        x = todo.popleft()
        for a, b in edges:
            if a == x and b not in want and want[x] < 3:
                want[b] = want[x] + 1
                todo.append(b)
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r["node"]: r["depth"] for r in W.reach(df, spark.createDataFrame([(0,)], "node long"), 3).collect()}
    assert got == want
    many = W.reach(df, spark.createDataFrame([(0, 0), (1, 5)], "source long, node long"), 3, by="source")
    assert {r["node"]: r["depth"] for r in many.where("source = 0").collect()} == want


def test_cycles_end(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src long, dst long")
    assert W.reach(df, spark.createDataFrame([(1,)], "node long"), 50).count() == 3


def test_pagerank_keeps_its_mass_and_equals_a_plain_loop(spark):
    edges = graph(20, 60, 2)
    df = spark.createDataFrame([(a, b, 1) for a, b in edges], "src long, dst long, weight long")
    got = {r["node"]: r["rank"] for r in W.pagerank(df, rounds=10).collect()}
    nodes = sorted({x for e in edges for x in e})
    out = {x: sum(a == x for a, _ in edges) for x in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(10):
        loose = sum(rank[x] for x in nodes if not out[x])
        rank = {x: 0.15 / len(nodes) + 0.85 * (sum(rank[a] / out[a] for a, b in edges if b == x) + loose / len(nodes)) for x in nodes}
    assert abs(sum(got.values()) - 1) < 1e-9
    assert all(abs(got[x] - rank[x]) < 1e-9 for x in nodes)


def test_label_propagation_finds_two_cliques(spark):
    cliques = [(a, b, 1) for k in (0, 10) for a in range(k, k + 5) for b in range(a + 1, k + 5)] + [(0, 10, 1)]
    labels = {r["node"]: r["label"] for r in W.label_propagation(spark.createDataFrame(cliques, "a long, b long, weight long"), rounds=6).collect()}
    assert len({labels[i] for i in range(1, 5)}) == 1 and len({labels[i] for i in range(11, 15)}) == 1


SITE = "site_seq long, callee_l string, caller_path string, caller_container string, recv string, recv_kind int, recv_type string, argc int, verified boolean"
SYMBOL = "sym_seq long, name_l string, qualified string, path string, line int, container string, pmin int, pmax int, pflags int, is_test boolean, generated boolean, not_logic boolean"
SYMBOLS = [
    (1, "save", "A.Save", "a.cs", 5, "A", 1, 1, 0, False, False, False),
    (2, "save", "B.Save", "b.cs", 5, "B", 2, 2, 0, False, False, False),
    (3, "ext", "E.Ext", "e.cs", 5, None, 2, 2, 1, False, False, False),
    (4, "odd", "O.Odd", "o.cs", 5, None, -1, -1, 0, False, False, False),
]
SITES = [
    (1, "save", "x.cs", None, "a", 2, "A", 1, None),  # the declared type decides
    (2, "save", "x.cs", None, None, 1, None, 2, None),  # only arity
    (3, "save", "b.cs", None, None, 1, None, 2, None),  # arity and path
    (4, "save", "x.cs", "b", "this", 3, None, -1, None),  # own container, arity unknown
    (5, "ext", "x.cs", None, None, 1, None, 1, None),  # extension method
    (6, "odd", "x.cs", None, None, 1, None, 3, None),  # nothing known
    (7, "save", "x.cs", None, None, 1, None, 9, True),  # seen at run time
    (8, "none", "x.cs", None, None, 1, None, 1, None),  # no definition
]


def pairs(spark):
    return R.candidates(spark.createDataFrame(SITES, SITE), spark.createDataFrame(SYMBOLS, SYMBOL))


def test_tiers(spark):
    got = {(r["site_seq"], r["sym_seq"]): r["tier"] for r in pairs(spark).collect()}
    assert got == {(1, 1): 3, (1, 2): -1, (2, 1): -1, (2, 2): 1, (3, 1): -1, (3, 2): 2, (4, 1): 0, (4, 2): 3, (5, 3): 1, (6, 4): 0, (7, 1): 4, (7, 2): 4, (8, None): None}


def test_scoring_never_changes_the_edge_set(spark):
    assert R.edge_tiers(pairs(spark)).count() == len(SITES)
    assert {r["site_seq"]: r["tier"] for r in R.edge_tiers(pairs(spark)).collect()}[8] == 0


def test_best_definition_uses_tiers_only_behind_the_gate(spark):
    best = {r["site_seq"]: r["sym_seq"] for r in R.best_definition(pairs(spark)).collect()}
    assert best[1] == 1 and best[2] == 2 and best[3] == 2 and best[4] == 2 and best[7] == 1 and 8 not in best


def test_unanimous(spark):
    some = pairs(spark).where(F.col("site_seq").isin(3))
    assert [r["qualified"] for r in R.unanimous(some, "callee_l").collect()] == ["B.Save"]
    assert R.unanimous(pairs(spark), "callee_l").count() == 0
