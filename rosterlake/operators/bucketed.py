"""Keyed tables as plain files that take changes in any order and rewrite only the buckets that change."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BucketedTable:
    """A row for each key in `path/_bucket=<n>/`, n being a hash of the key modulo `buckets`.

    Of all changes to a key the one that is last by `order` holds (of ties, one chosen by its values' hash), so batches may
    arrive in any order and more than once. Deleted keys stay as tombstones, so an older change cannot bring them back.
    A merge reads the buckets of its keys only, writes their new rows to a folder aside, and then overwrites those partitions
    dynamically; other buckets' files are not touched. It needs one writer at a time. Numbered batches leave a mark when they
    are done and are skipped if they come again; one that broke off midway is simply merged again. Null keys are keys.
    The columns _bucket, _deleted and _new are the table's own; values must be of types that can be ordered.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), list(keys), list(order), buckets

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def files(self, where=None) -> DataFrame | None:
        """Stored rows with tombstones; None before the first merge."""
        try:
            rows = self.spark.read.parquet(self.path)
        except AnalysisException:
            return None
        return rows if where is None else rows.where(where)

    def read(self) -> DataFrame:
        """The table."""
        rows = self.files()
        if rows is None:
            raise FileNotFoundError(f"nothing was merged into {self.path}")
        return rows.where("NOT _deleted").drop("_deleted", "_bucket")

    def last(self, rows: DataFrame, *more) -> DataFrame:
        """The row of each key that holds, and more aggregates."""
        values = [c for c in rows.columns if c != "_new"]
        rank = F.struct(*self.order, "_deleted", F.xxhash64(*values))
        return rows.groupBy(*[F.col(k) for k in self.keys]).agg(F.max_by(F.struct(*values), rank).alias("_r"), *more).select("_r.*", *[m for m in ("_old", "_in") if more])

    def done(self, number: int) -> bool:
        try:
            return not self.spark.read.schema("number long").json(f"{self.path}/_batches/{number}").isEmpty()
        except AnalysisException:
            return False

    def merge(self, changes: DataFrame, number: int | None = None, op: str | None = None) -> DataFrame | None:
        """Works changes in; rows whose `op` column is D delete their key. Gives keys and action of the changed keys.

        Actions: created, updated, deleted, unchanged (the same values) and stale (the stored row is newer). None if the
        batch with this number was merged before. The log is a stored table, `path/_log/<number>`, where there is a number.
        """
        if number is not None and self.done(number):
            return None
        gone = F.coalesce(F.col(op) == "D", F.lit(False)) if op else F.lit(False)
        changes = changes.withColumn("_deleted", gone)
        changes = changes.drop(op) if op else changes
        new = self.last(changes).withColumn("_bucket", self.bucket())
        touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # `buckets` at most
        if not touched:
            return None
        columns = [c for c in new.columns if c != "_bucket"]
        old = self.files(F.col("_bucket").isin(touched))
        sides = [new.select(*columns, F.lit(True).alias("_new"))]
        if old is not None:
            sides.append(old.select(*columns, F.lit(False).alias("_new")))
        both = reduce(DataFrame.unionByName, sides)
        stored = F.max(F.when(~F.col("_new"), F.struct(*columns))).alias("_old")
        rows = self.last(both, stored, F.max(F.when(F.col("_new"), F.struct(*columns))).alias("_in"))
        same = lambda x, cs: reduce(lambda a, b: a & b, [F.col(f"{x}.{c}").eqNullSafe(F.col(c)) for c in cs], F.lit(True))
        values = [c for c in columns if c not in self.order and c not in self.keys]
        had = F.col("_old").isNotNull() & ~F.col("_old._deleted")
        action = (
            F.when(F.col("_in").isNull(), None).when(F.col("_old").isNotNull() & same("_old", columns) & ~same("_in", columns), "stale")
            .when(F.col("_deleted"), F.when(had, "deleted").otherwise("unchanged")).when(~had, "created").when(same("_old", values), "unchanged").otherwise("updated")
        )
        aside = f"{self.path}/_aside/{'run' if number is None else number}"
        rows.select(*columns, action.alias("_action")).withColumn("_bucket", self.bucket()).write.mode("overwrite").parquet(aside)
        ready = self.spark.read.parquet(aside)
        log = f"{self.path}/_log/{'run' if number is None else number}"
        ready.where("_action IS NOT NULL").select(*self.keys, F.col("_action").alias("action")).write.mode("overwrite").parquet(log)
        # One task for each bucket writes one file; a bucket is a bounded part of the table.
        out = ready.drop("_action").repartition(len(touched), "_bucket")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path)
        if number is not None:
            self.spark.range(number, number + 1).select(F.col("id").alias("number")).write.mode("overwrite").json(f"{self.path}/_batches/{number}")
        remove(self.spark, aside)
        return self.spark.read.parquet(log)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of one's own."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
