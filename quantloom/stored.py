"""Tables written once to the folder that all executors share, for operators that read a result more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where everything runs in this process (tests) may it be unset."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _own
    if _own is None:
        _own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own


def stored(df: DataFrame, name: str, block: int | None = None) -> DataFrame:
    """df as Parquet, read back: what follows doesn't compute it again, and a lost executor costs the running step only.

    The table stays for as long as the caller's lazy results may read it; drop() removes it.
    block: bytes of a row group, where rows are long.
    """
    path = f"{folder(df.sparkSession)}/quantloom-{uuid.uuid4().hex[:12]}-{name}"
    (df.write if block is None else df.write.option("parquet.block.size", block)).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop(df: DataFrame) -> None:
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
