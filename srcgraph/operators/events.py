"""Time-ordered and versioned tables: as-of joins, churn, upserts, snapshots, carried headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_before(df: DataFrame, by: str, order: str, marked: Column, value: Column) -> Column:
    """For each row the value of the last marked row at or before it, within its key."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last(F.when(marked, value), ignorenulls=True).over(w)


def next_after(df: DataFrame, by: str, order: str, value: Column) -> Column:
    return F.lead(value).over(Window.partitionBy(by).orderBy(order))


def carried(df: DataFrame, by: str, order: str, header: Column) -> Column:
    """The last header that is not null, up to this row."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last(header, ignorenulls=True).over(w)


def churn(touches: DataFrame, path: str, author: str, ts: str, size: Column) -> DataFrame:
    """Touches, authors, last touch and risk (touches x size) of each path."""
    return touches.groupBy(path).agg(
        F.count(F.lit(1)).alias("commits"), F.count_distinct(author).alias("authors"), F.max(ts).alias("last_touched"), (F.count(F.lit(1)) * F.max(size)).alias("risk")
    )


def upsert_counts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Add the counts of both tables by key."""
    return old.unionByName(new).groupBy(*keys).agg(F.sum("count").alias("count"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, state): unchanged, changed, new or gone, by content hash. Both tables: (key, hash)."""
    a, b = old.select(key, F.col("hash").alias("old_hash")), new.select(key, F.col("hash").alias("new_hash"))
    state = F.when(F.col("old_hash").isNull(), "new").when(F.col("new_hash").isNull(), "gone").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))
