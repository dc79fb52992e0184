"""Rules over streams whose rows meet in other batches than their own: orphans, duplicates, pairs that differ.

Each rule turns rows into statements (rule, kind, key, salt, side, what). A streaming aggregate keeps how many there are of
each, by side, and sends after every micro-batch the counts of what that batch touched. Counts only grow, so the largest of
each are what holds now, and `open_violations` is, after every batch, what the batch rule gives for all rows so far, whatever
the order of arrival, so no watermark decides when a missing parent is missing; `violation_changes` gives, by batch, +1 where
a violation appeared and -1 where a row that arrived later mended it. State is bounded by the number of keys (pairs: and of
different values a key has), not of rows, and statements are summed in their own tasks before they are sent to the state.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

STATEMENT = ("rule", "kind", "key", "salt", "side", "what")
#: Counts by side of what a micro-batch touched.
CHANGE = "rule string, kind string, key string, salt int, what string, n0 long, n1 long, batch long"
KEY = ("rule", "kind", "key", "salt")
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def statement(rows: DataFrame, rule: str, kind: str, keys: Sequence[str], side: int, what=None, salt=None) -> DataFrame:
    """A key of several columns is their JSON with nulls, so null is a value like others."""
    key = F.to_json(F.struct(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)]), {"ignoreNullFields": "false"})
    salt = F.lit(0) if salt is None else salt
    return rows.select(F.lit(rule).alias("rule"), F.lit(kind).alias("kind"), key.alias("key"), salt.alias("salt"), F.lit(side).alias("side"), (F.lit("") if what is None else what).alias("what"))


def orphan_statements(rule: str, children: DataFrame, parents: DataFrame, key: str, parent_key: str, salts: int = 1) -> DataFrame:
    """Children without a parent. A null key has none.

    salts: over how many groups the children of a frequent parent are dealt; parents stand in each of them.
    """
    dealt = F.pmod(F.xxhash64(*children.columns), F.lit(salts)).cast("int") if salts > 1 else None
    found = statement(children.where(F.col(key).isNotNull()), rule, "orphans", [key], 1, salt=dealt)
    lost = statement(children.where(F.col(key).isNull()), rule, "always", [key], 1, salt=F.lit(0))
    there = statement(parents.where(F.col(parent_key).isNotNull()), rule, "orphans", [parent_key], 0, salt=F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return reduce(DataFrame.unionByName, (found, lost, there))


def duplicate_statements(rule: str, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that stand in several rows: one violation for each such key."""
    return statement(rows, rule, "duplicates", keys, 0)


def mismatch_statements(rule: str, left: DataFrame, right: DataFrame, key: str, right_key: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pairs of a left and a right row of one key that differ in one of the column pairs, nulls being equal to each other."""
    value = lambda names: F.to_json(F.struct(*[F.col(n).cast("string").alias(f"v{i}") for i, n in enumerate(names)]), {"ignoreNullFields": "false"})
    one = statement(left.where(F.col(key).isNotNull()), rule, "mismatches", [key], 0, value([a for a, _ in pairs]))
    return one.unionByName(statement(right.where(F.col(right_key).isNotNull()), rule, "mismatches", [right_key], 1, value([b for _, b in pairs])))


@contextmanager
def state_store(spark: SparkSession):
    """The state store that keeps its rows on disk, for queries that start meanwhile."""
    before = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER[0], before)


def counts_of(statements: DataFrame) -> DataFrame:
    """n0, n1: the statements of each side, by rule, kind, key, salt and value."""
    side = lambda k: F.sum((F.col("side") == k).cast("long")).alias(f"n{k}")
    return statements.groupBy(*KEY, "what").agg(side(0), side(1))


def run_stateful_rules(statements: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Adds the counts that each micro-batch of everything that is there changed, as `out/batch=<number>`, and ends; a repeated batch replaces its own."""
    spark = statements.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(out)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with state_store(spark):
        q = counts_of(statements).writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    return q


def violations(n0: Column, n1: Column, same: Column) -> Column:
    """Open violations of a rule and key with n0 and n1 statements, of which `same` pairs have equal values."""
    kind, zero = F.col("kind"), F.lit(0).cast("long")
    return F.when(kind == "orphans", F.when(n0 > 0, zero).otherwise(n1)).when(kind == "duplicates", (n0 > 1).cast("long")).when(kind == "mismatches", n0 * n1 - same).otherwise(n1)


def open_violations(changes: DataFrame) -> DataFrame:
    """rule, key, violations that are open now."""
    now = changes.groupBy(*KEY, "what").agg(F.max("n0").alias("n0"), F.max("n1").alias("n1"))
    sums = now.groupBy(*KEY).agg(*[F.sum(x).alias(n) for n, x in (("n0", F.col("n0")), ("n1", F.col("n1")), ("same", F.col("n0") * F.col("n1")))])
    found = sums.select("rule", "key", violations(F.col("n0"), F.col("n1"), F.col("same")).alias("v")).where("v > 0")
    return found.groupBy("rule", "key").agg(F.sum("v").alias("violations"))


def violation_changes(changes: DataFrame) -> DataFrame:
    """rule, key, batch, delta: by how much each micro-batch changed the number of open violations."""
    value, zero = Window.partitionBy(*KEY, "what").orderBy("batch"), F.lit(0).cast("long")
    step = lambda x: x - F.coalesce(F.lag(x).over(value), zero)
    steps = changes.select(*KEY, "batch", step(F.col("n0")).alias("n0"), step(F.col("n1")).alias("n1"), step(F.col("n0") * F.col("n1")).alias("same"))
    sums = steps.groupBy(*KEY, "batch").agg(*[F.sum(n).alias(n) for n in ("n0", "n1", "same")])
    name = Window.partitionBy(*KEY).orderBy("batch")
    so_far = sums.withColumns({n: F.sum(n).over(name.rowsBetween(Window.unboundedPreceding, 0)) for n in ("n0", "n1", "same")})
    after = so_far.withColumn("v", violations(F.col("n0"), F.col("n1"), F.col("same")))
    deltas = after.select("rule", "key", "batch", (F.col("v") - F.coalesce(F.lag("v").over(name), zero)).alias("delta"))
    return deltas.groupBy("rule", "key", "batch").agg(F.sum("delta").alias("delta")).where("delta <> 0")
