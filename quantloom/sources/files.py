"""Tables in many files, one for each symbol: the symbol from the file's name, columns merged, files that can't be read listed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stored import stored

#: market_number_anything.parquet, as in sz_000001_indicator.parquet
SYMBOL = r"(?i)([a-z]+)_(\d+)(?:_[^/]*)?\.parquet$"


def symbol_of(path):
    """Six digits and the market in capitals; null where the name has another form."""
    market, number = F.regexp_extract(path, SYMBOL, 1), F.regexp_extract(path, SYMBOL, 2)
    return F.when(market != "", F.concat(F.lpad(number, 6, "0"), F.lit("."), F.upper(market)))


def checked(spark: SparkSession, folder: str) -> DataFrame:
    """path, size, problem (null where the file has the marks of Parquet at both ends and its footer can be parsed), columns.

    Files are read by Spark; a task holds one at a time. Only what is needed to tell is taken: a footer is parsed, not the data.
    """
    import io

    import pyarrow.parquet as pq

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, raw in zip(b["path"], b["content"], strict=True):
                problem, columns = None, []
                try:
                    columns = [f"{f.name}: {f.type}" for f in pq.read_schema(io.BytesIO(raw))]
                except Exception as e:  # whatever is wrong with a file is reported, not passed over
                    problem = f"{type(e).__name__}: {e}"[:300]
                out.append((path, len(raw), problem, columns))
            yield pd.DataFrame(out, columns=["path", "size", "problem", "columns"])

    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    empty = [(str(f.getPath()), 0, "no bytes", []) for f in found if f.isFile() and f.getLen() == 0 and f.getPath().getName().endswith(".parquet")]  # Spark's readers pass over these
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select("path", "content")
    schema = "path string, size bigint, problem string, columns array<string>"
    return files.mapInPandas(told, schema).unionByName(spark.createDataFrame(empty, schema))


def symbol_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All rows of a folder's Parquet files with `symbol` and `source_file`, and the table of files that couldn't be read, or have no symbol in their names.

    Files may have different columns: a column that a file lacks is null. Files that fail the check aren't read, so no row of a torn file comes.
    """
    files = stored(checked(spark, folder).withColumn("symbol", symbol_of("path")), "files")  # whole files are read for it once; Spark reads none above 2 GB so
    bad = files.withColumn("problem", F.coalesce("problem", F.when(F.col("symbol").isNull(), F.lit("no symbol in the file's name")))).where("problem is not null").select("path", "size", "problem")
    kinds = files.where("problem is null and symbol is not null").select("path", "columns").collect()  # a row a file
    if not kinds:
        return spark.createDataFrame([], "symbol string, source_file string"), bad
    rows = spark.read.option("mergeSchema", True).parquet(*[r["path"] for r in kinds]).select("*", F.col("_metadata.file_path").alias("source_file"))
    return rows.withColumn("symbol", symbol_of("source_file")), bad
