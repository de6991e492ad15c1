"""Versioned tables on plain Parquet: latest rows win, unseen rows under a prefix go, content that
nothing names goes. A version is written whole beside the old one and then pointed to."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The latest row of each key over both tables. Combines before the shuffle."""
    rest = [c for c in old.columns if c not in keys and c not in order]
    newest = old.unionByName(new).groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__r"))
    return newest.select(*(F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in old.columns))


def pruned(index: DataFrame, seen: DataFrame, under: str, path: str = "path") -> DataFrame:
    """The index without the rows under a prefix that were not seen."""
    outside = ~F.startswith(path, F.lit(under))
    return index.where(outside).unionByName(index.where(~outside).join(seen.select(path), path, "left_semi").select(*index.columns))


def referenced(blobs: DataFrame, index: DataFrame, key: str = "content_hash") -> DataFrame:
    return blobs.join(index.select(key), key, "left_semi")


def to_analyse(files: DataFrame, index: DataFrame, version: str) -> DataFrame:
    """Files whose content, language and engine version no earlier row holds."""
    done = index.where(F.col("engine_version") == version).select("content_hash", "language")
    return files.join(done, ["content_hash", "language"], "left_anti")


def publish(df: DataFrame, root: str) -> str:
    """Write a new version under root, then the pointer to it."""
    version = uuid.uuid4().hex
    df.write.parquet(f"{root}/versions/{version}")
    df.sparkSession.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").parquet(f"{root}/current")
    return version


def current(spark: SparkSession, root: str) -> DataFrame:
    version = spark.read.parquet(f"{root}/current").first()[0]
    return spark.read.parquet(f"{root}/versions/{version}")


def append_blobs(blobs: DataFrame, root: str) -> None:
    """Add (content_hash, ...) rows that the store does not hold yet, each hash once. Write-once: what is there is
    never written again; an interrupted write leaves nothing that a reader sees, and running it again adds only
    what is missing."""
    folder = f"{root}/blobs"
    new = blobs.dropDuplicates(["content_hash"])
    if exists(blobs.sparkSession, folder):
        new = new.join(blobs.sparkSession.read.parquet(folder).select("content_hash"), "content_hash", "left_anti")
    new.write.mode("append").parquet(folder)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, on whatever file system its path names."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def entries(spark: SparkSession, root: str) -> DataFrame:
    """One row for each path of the current index, with its blob; paths may share one."""
    return current(spark, root).join(spark.read.parquet(f"{root}/blobs"), "content_hash")


def cleared(index: DataFrame, paths: DataFrame) -> DataFrame:
    """The index without some paths; their blobs stay where other paths name them (referenced())."""
    return index.join(paths.select("path"), "path", "left_anti")


def recall(spark: SparkSession, root: str, content_hash: str) -> DataFrame:
    """The blob of a hash: 64 hex digits, or ValueError; KeyError where the store does not hold it."""
    if not re.fullmatch("[0-9a-f]{64}", content_hash):
        raise ValueError(f"{content_hash!r} is no hash of 64 hex digits")
    found = spark.read.parquet(f"{root}/blobs").where(F.col("content_hash") == content_hash)
    if found.isEmpty():
        raise KeyError(content_hash)
    return found
