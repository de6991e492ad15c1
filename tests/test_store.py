from srcgraph.operators import store as K
from srcgraph.operators import walk as W

FILES = "path string, content_hash string, language string, engine_version string, at int"


def test_versions_replace_each_other(spark, tmp_path):
    root = str(tmp_path / "t")
    K.publish(spark.createDataFrame([("a", 1)], "path string, at int"), root)
    K.publish(K.upsert(K.current(spark, root), spark.createDataFrame([("a", 2), ("b", 1)], "path string, at int"), ["path"], ["at"]), root)
    assert sorted(map(tuple, K.current(spark, root).collect())) == [("a", 2), ("b", 1)]


def test_prune_gc_and_reuse(spark):
    index = spark.createDataFrame([("src/a", "h1", "py", "1", 0), ("src/b", "h2", "py", "1", 0), ("lib/c", "h1", "cs", "0", 0)], FILES)
    seen = spark.createDataFrame([("src/b",)], "path string")
    left = K.pruned(index, seen, "src/")
    assert sorted(r["path"] for r in left.collect()) == ["lib/c", "src/b"]
    blobs = spark.createDataFrame([("h1",), ("h2",), ("h3",)], "content_hash string")
    assert sorted(r[0] for r in K.referenced(blobs, index).collect()) == ["h1", "h2"]
    files = spark.createDataFrame([("x", "h1", "py"), ("y", "h1", "cs"), ("z", "h9", "py")], "path string, content_hash string, language string")
    assert sorted(r["path"] for r in K.to_analyse(files, index, "1").collect()) == ["y", "z"]


def test_traces_mark_a_cycle_once_and_stop(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src long, dst long")
    got = sorted((r["path"], r["is_cycle"]) for r in W.trace(edges, spark.createDataFrame([(1,)], "node long"), 5).collect())
    assert got == [([1], False), ([1, 2], False), ([1, 2, 1], True), ([1, 2, 3], False)]


def test_blobs_are_written_once_and_recalled(spark, tmp_path):
    import hashlib

    import pytest

    root = str(tmp_path / "store")
    named = lambda *texts: spark.createDataFrame([(hashlib.sha256(t.encode()).hexdigest(), t) for t in texts], "content_hash string, text string")
    K.append_blobs(named("one", "two", "two"), root)
    K.append_blobs(named("two", "three"), root)  # as after a write that was cut off half-way
    assert sorted(r["text"] for r in spark.read.parquet(f"{root}/blobs").collect()) == ["one", "three", "two"]
    index = named("one", "one", "two").rdd.zipWithIndex().map(lambda x: (f"p{x[1]}", x[0][0])).toDF("path string, content_hash string")
    K.publish(index, root)
    assert sorted((r["path"], r["text"]) for r in K.entries(spark, root).collect()) == [("p0", "one"), ("p1", "one"), ("p2", "two")]
    left = K.cleared(K.current(spark, root), spark.createDataFrame([("p0",), ("p2",)], "path string"))
    K.publish(left, root)
    assert [r["text"] for r in K.referenced(spark.read.parquet(f"{root}/blobs"), K.current(spark, root)).collect()] == ["one"]
    assert K.recall(spark, root, hashlib.sha256(b"two").hexdigest()).first()["text"] == "two"
    with pytest.raises(KeyError):
        K.recall(spark, root, "0" * 64)
    with pytest.raises(ValueError, match="64 hex"):
        K.recall(spark, root, "xyz")


def test_a_version_without_its_pointer_is_not_seen(spark, tmp_path):
    root = str(tmp_path / "t")
    K.publish(spark.createDataFrame([("a", 1)], "path string, at int"), root)
    spark.createDataFrame([("b", 2)], "path string, at int").write.parquet(f"{root}/versions/halfway")
    assert [tuple(r) for r in K.current(spark, root).collect()] == [("a", 1)]
