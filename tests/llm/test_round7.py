"""Tests of the seventh round: what the driver holds of a sketch and of a sample."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import zstandard

from srcgraph.llm import ngram_join
from srcgraph.llm.base import _packed, gathered


def test_the_sketch_reaches_the_driver_as_levels(spark):
    """Its counts came whole, 32 MB whatever the corpus, which the driver's Python held twice and its JVM more often."""
    rng = np.random.default_rng(7)
    parts = [rng.integers(0, most, ngram_join.BUCKETS, dtype=np.uint32) for most in (3, 100, 5000)]
    press = zstandard.ZstdCompressor(level=1)
    rows = [(None, None, None, None, i, press.compress(s.tobytes())) for part in parts for i, s in enumerate(part.reshape(ngram_join.SLICES, -1)) if i != 5]
    sized = spark.createDataFrame([(1, 2, 3, 4, None, None), *rows], "doc_id long, n long, f1 long, f2 long, slice int, counts binary").repartition(7).cache()
    sized.count()
    counts = sum(p.astype(np.int64) for p in parts).reshape(ngram_join.SLICES, -1)
    counts[5] = 0
    wanted = np.minimum(np.floor(8 * np.log2(counts.ravel() + 1)), 255).astype(np.uint8), max(ngram_join.HOT, 16 * int(counts.mean()))
    tracemalloc.start()
    made = ngram_join.sketch_of(sized)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    levels, bound = made if isinstance(made, tuple) else ngram_join.levels_of(made)
    assert (levels == wanted[0]).all() and levels.dtype == np.uint8 and bound == wanted[1]
    assert most < 16 << 20
    empty, least = ngram_join.sketch_of(sized.where("slice is null"))
    assert not empty.any() and least == ngram_join.HOT


def test_a_gathered_sample_is_whole_and_travels_compressed(spark):
    rng = random.Random(7)
    words = [f"word{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(" ".join(rng.choices(words, k=rng.choice([0, 5, 400]))) + "ß\0", i % 2, i - 50) for i in range(3000)] + [(None, 0, 1)]
    df = spark.createDataFrame(rows, "text string, toxic int, n long").repartition(3)
    assert sorted(gathered(df), key=str) == sorted(rows, key=str)
    assert list(gathered(df.limit(0))) == []
    batch = pa.RecordBatch.from_pylist([{"text": r[0]} for r in rows])
    assert sum(b.nbytes for b in _packed(iter([batch]))) < batch.nbytes / 2
