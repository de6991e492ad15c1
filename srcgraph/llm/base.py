"""Helpers of the training-data operators: tables, scratch tables, Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.jobs import scratch
from srcgraph.jobs.scratch import dropped, scratch_dir  # noqa: F401  the operators take them from here

#: Rows and bytes of one slice of an Arrow batch; a single longer text still comes whole.
SLICE_ROWS, SLICE_BYTES, ARROW_ROWS = 512, 8 << 20, 1024
ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()),
    "array<long>": pa.list_(pa.int64()),
    "array<binary>": pa.list_(pa.binary()),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """scratch.stored, with batches of texts bounded."""
    bounded_batches(df.sparkSession)
    return scratch.stored(df, name)


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that one slice holds few bytes of text; a text that is longer comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column_at = batch.schema.get_field_index(column)
        start, size = 0, 0
        lengths = pc.binary_length(batch.column(column_at)).to_pylist()
        for i, n in enumerate(lengths):
            if i > start and size + (n or 0) > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
            if i - start + 1 >= SLICE_ROWS:
                yield batch.slice(start, i - start + 1)
                start, size = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["packed"])


def gathered(df: DataFrame) -> Iterator[tuple]:
    """The rows of a bounded table with texts, for the driver. Tasks compress them, so that its JVM, which holds what
    it gets some times over, passes on only that; they are unpacked batch by batch."""
    for packed in df.mapInArrow(_packed, "packed binary").toArrow().column(0):
        for batch in pa.ipc.open_stream(packed.as_buffer()):
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def released() -> None:
    """At a task's end, and where the driver has fitted a model: Python lives on, so free memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def bounded_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of ARROW_ROWS at most: both sides hold whole batches in memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def value_type(df: DataFrame, column: str) -> str:
    return "binary" if df.schema[column].dataType.typeName() == "binary" else "string"


def map_texts(df: DataFrame, keys: list[str], column: str, one: Callable[[str], tuple], schema: str) -> DataFrame:
    """Apply one(text) to each row's text in Arrow batches. schema names what `one` returns; the
    key columns go through. A null text counts as empty; a binary column comes as bytes."""
    kind = value_type(df, column)
    kept = df.select(*keys, F.coalesce(F.col(column).cast(kind), F.lit("").cast(kind)).alias("__text"))
    names, kinds = zip(*(part.strip().split(" ") for part in schema.split(",")), strict=True)
    out_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "__text"):
            rows = [one(text) for text in batch.column(len(keys)).to_pylist()]
            made = [pa.array(values, ARROW[kind]) for values, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), *made], names=[*keys, *names])
        released()

    return kept.mapInArrow(run, out_schema)
