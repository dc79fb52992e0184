"""Merges by bucket and rules with state, on streams of the given tables whose rows arrive in mixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import streaming
from ..operators import BucketedTable
from . import rule_bindings, views
from .job_bindings import scratch

c = F.col


def arriving(rows: DataFrame, path: str, batches: int = 3) -> DataFrame:
    """A stream of rows, mixed, over some micro-batches; each has files for a share of the tasks that read the rows."""
    width = -(-rows.rdd.getNumPartitions() // batches)
    rows.repartition(batches * width, F.xxhash64(*rows.columns)).write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", width).parquet(path)


def events(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type", F.when(c("event_type") == "error", "D").otherwise("U").alias("op"))


def p12_bucketed_feed(spark, sf_dir) -> DataFrame:
    """The last event of each user, kept by a stream; an error deletes the user until the next event."""
    path = scratch(spark)
    table = BucketedTable(spark, f"{path}/table", ["user_id"], ["event_id"], 16)
    streaming.merge_stream(arriving(events(spark, sf_dir), f"{path}/in"), table, f"{path}/check", "op")
    return table.read()


def k9_bucketed_upsert(spark, sf_dir) -> DataFrame:
    """Customers, then changes to every third of them and some new ones; rows, and what became of those that changed."""
    path = scratch(spark)
    table = BucketedTable(spark, f"{path}/table", ["c_custkey"], ["version"], 32)
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_acctbal", F.lit(1).alias("version"))
    table.merge(rows.where("c_custkey % 5 <> 0"), 1)
    third = rows.where("c_custkey % 3 = 0").withColumn("version", F.when(c("c_custkey") % 4 == 0, 0).otherwise(2))
    log = table.merge(third.withColumn("c_acctbal", F.when(c("c_custkey") % 2 == 0, c("c_acctbal") + 1).otherwise(c("c_acctbal"))), 2)
    return table.read().join(log, "c_custkey", "left")


K9 = """WITH a AS (SELECT c_custkey, c_name, c_acctbal, 1 AS version FROM customer WHERE c_custkey % 5 <> 0),
b AS (SELECT c_custkey, c_name, c_acctbal + CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS c_acctbal, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 2 END AS version FROM customer WHERE c_custkey % 3 = 0)
SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, coalesce(a.c_name, b.c_name) AS c_name,
 CASE WHEN b.version > coalesce(a.version, -1) THEN b.c_acctbal ELSE a.c_acctbal END AS c_acctbal, CAST(greatest(coalesce(a.version, 0), coalesce(b.version, 0)) AS INT) AS version,
 CASE WHEN b.c_custkey IS NULL THEN NULL WHEN a.c_custkey IS NULL THEN 'created' WHEN b.version < a.version THEN 'stale' WHEN b.c_acctbal = a.c_acctbal THEN 'unchanged' ELSE 'updated' END AS action
FROM a FULL JOIN b ON a.c_custkey = b.c_custkey"""

STATEFUL = ("R07", "R12", "R13", "R14", "R23", "P08b", "P08e", "W16")
VIEWS = ("employees", "attendance", "payroll", "employee_exits", "exit_interviews", "promotions")


def p12_stateful_rules(spark, sf_dir) -> DataFrame:
    """Rules whose rows arrive in different micro-batches; all counts at the end."""
    path = scratch(spark)
    names = {r.id: r.name for r in rule_bindings.all_rules()}
    t = {n: arriving(df, f"{path}/{n}") for n, df in views.tables(spark, sf_dir, *VIEWS).items()}
    key = "employee_id"
    statements = [streaming.orphan_statements(names[r], t[n], t[parent], key, key) for r, n, parent in (("R12", "attendance", "employees"), ("R13", "payroll", "employees"), ("R14", "employee_exits", "employees"), ("R23", "exit_interviews", "employee_exits"))]
    statements.append(streaming.orphan_statements(names["P08e"], t["employees"].where("manager_id IS NOT NULL"), t["employees"], "manager_id", key))
    statements.append(streaming.duplicate_statements(names["R07"], t["employees"], ["employee_number"]))
    statements.append(streaming.duplicate_statements(names["P08b"], t["promotions"], [key, "promotion_date"]))
    statements.append(streaming.mismatch_statements(names["W16"], t["exit_interviews"], t["employee_exits"], key, key, [("termination_date", "exit_date"), ("exit_reason", "exit_reason"), ("voluntary_exit", "voluntary_flag")]))
    whole = statements[0]
    for s in statements[1:]:
        whole = whole.unionByName(s)
    streaming.run_stateful_rules(whole, f"{path}/out", f"{path}/check")
    found = streaming.open_violations(spark.read.schema(streaming.CHANGE).parquet(f"{path}/out")).groupBy("rule").agg(F.sum("violations").alias("n"))
    every = spark.createDataFrame([(names[r],) for r in STATEFUL], "check_name string")
    return every.join(found, c("check_name") == c("rule"), "left").select("check_name", F.coalesce("n", F.lit(0).cast("long")).alias("record_count"))


DIRECT = {
    "P12_bucketed_feed": (p12_bucketed_feed, "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1 AND event_type <> 'error'"),
    "K9_bucketed_upsert": (k9_bucketed_upsert, K9),
    "P12_stateful_rules": (p12_stateful_rules, views.sql("SELECT check_name, record_count FROM (" + " UNION ALL ".join(rule_bindings.result_sql(r) for r in rule_bindings.all_rules() if r.id in STATEFUL) + ") AS r", *VIEWS)),
}


def bindings() -> tuple[dict, dict]:
    return {k: fn for k, (fn, _) in DIRECT.items()}, {k: text for k, (_, text) in DIRECT.items()}
