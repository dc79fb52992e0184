"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z, and nothing else.
ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a local one is set only where that is unset and Spark is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it again: the lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the text column of each holds about limit bytes, or one row."""
    for batch in batches:
        col = batch.column(column)
        step = max(1, int(len(col) * limit / max(1, col.nbytes)))
        for at in range(0, len(col), step):
            yield batch.slice(at, step)


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


def hash_of(df: DataFrame, *without: str) -> Column:
    """A hash of a row's columns; maps, which Spark's hashes do not take, as JSON, of their sorted entries where keys can be sorted."""

    def value(f):
        column, kind = df[f"`{f.name}`"], f.dataType.simpleString()
        if kind.startswith("map<") and "map<" not in kind[4:]:
            return F.to_json(F.array_sort(F.map_entries(column)))
        return F.to_json(column) if "map<" in kind else column

    return F.xxhash64(*[value(f) for f in df.schema.fields if f.name not in without])
