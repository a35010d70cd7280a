"""What the operators of this subpackage share: where to write, how to cut lineage, and how to keep Arrow batches small."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than these six (space, tab to carriage return).
BLANKS = " \t\n\x0b\f\r"
WORD_BREAK = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only where everything runs in this process (tests) may it be unset."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _own
    if _own is None:
        _own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own


_own: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quantloom-{uuid.uuid4().hex[:12]}-{name}"


def written(df: DataFrame, name: str, block: int | None = None) -> DataFrame:
    """df as a table written to the shared folder and read back: lost executors don't cost what went before.

    block: bytes of a row group, where rows are so long that a reader must not take many at once.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    out = df.write if block is None else df.write.option("parquet.block.size", block)
    out.parquet(path)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._quantloom_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table made by written() that nothing will read again."""
    delete(df.sparkSession, df._quantloom_path)


def delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of finished steps, which it does as the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Rows in each Arrow batch of the jobs that run inside, for tables with very long rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts whose column holds about `most` bytes of text, or values in its lists, or one longer row: what is worked on at once stays small."""
    for b in batches:
        texts = b.column(column)
        length = pa.compute.list_value_length if pa.types.is_list(texts.type) else pa.compute.binary_length
        sizes = length(texts).fill_null(0).to_numpy(zero_copy_only=False)
        at = np.cumsum(sizes)
        i, before = 0, 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(at, before + most, "right")))
            yield b.slice(i, j - i)
            i, before = j, at[j - 1]


def let(value, body):
    """body(value) with value evaluated once a row, also when body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)
