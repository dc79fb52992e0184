"""Numbers of rows within their keys, whatever share of the rows one key has."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, keys: list[str], order: list[str], folder: str, name: str = "rank") -> DataFrame:
    """rows with `name` (long), from 1 within the columns `keys` by the columns `order`; null keys are keys, nulls come first.

    Rows are dealt by ranges of keys and order, so that a frequent key lies over several ranges, and written to the shared
    folder, as a range must stay what it is. Numbers are counted within ranges; what earlier ranges hold of a key comes on
    top. Only the first key of a range can have such rows, so there is at most one row of these for each range to broadcast.
    Rows with equal keys and order stand in one range, in any order. An empty table gives no rows.
    """
    spark, by, path = rows.sparkSession, [*keys, *order], f"{folder}/ranked-{uuid.uuid4().hex}"
    dealt = rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id())
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = dealt.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", before).where("_before > 0")
    counts = counts.select(F.col("_range").alias("_r"), "_before", *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)])
    within = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)], F.col("_range") == F.col("_r"))
    found = dealt.withColumn("_within", within).join(F.broadcast(counts), same, "left")
    return found.select(*rows.columns, (F.col("_within") + F.coalesce("_before", F.lit(0))).cast("long").alias(name))
