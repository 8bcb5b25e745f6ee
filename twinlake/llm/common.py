"""What the operators share: scratch tables in the cluster's shared folder, and batches for Arrow functions."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshots import shared_dir


class Scratch:
    """Intermediate tables, written once and read again: lineage ends there, and lost executors cost no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        path = f"{self.at}/{name}"
        df.write.option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_name(name: str, taken: list[str]) -> str:
    """The name, with as many "_" behind it as it takes to differ (in lower case, as Spark compares them)."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Short pieces of a batch, so that Python holds few texts at once."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def text_bytes(text: Column | str) -> Column:
    """UTF-8 length; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def words_count(text: Column | str) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
