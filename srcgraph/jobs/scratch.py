"""Tables in the shared scratch folder: where iterative jobs cut their lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where that is unset, a temporary one serves a local
    master only: on a cluster, other machines would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared scratch folder and read it again: lineage ends here, and a
    lost executor costs nothing that was computed before."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: list[str], name: str, once: bool = False) -> DataFrame:
    """Like stored(), dealt by keys and sorted: joins on them need no further exchange of these rows. With `once`, equal
    rows are written once."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(n, *keys)
    (dealt.distinct() if once else dealt).write.bucketBy(n, *keys).sortBy(*keys).option("path", f"{scratch_dir(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def dropped(df: DataFrame) -> None:
    """Delete the files of a stored() table that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
