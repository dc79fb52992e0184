"""Structured Streaming forms of the checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import BucketedTable, upsert
from ..plans.rules import Rule, run_rules


def windowed_counts(events: DataFrame, at: str = "ts", by: str = "event_type", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, by, n, total of event-time windows; rows later than the watermark are dropped."""
    out = events.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), by, "n", "total")


def once(events: DataFrame, keys: list[str], at: str = "ts", late: str = "1 day") -> DataFrame:
    """The first of rows with equal keys within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def available_now(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes everything that is there to Parquet and ends."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
    q.awaitTermination()
    return q


def rules_on_stream(stream: DataFrame, name: str, rules: list[Rule], others: dict[str, DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs rules on every micro-batch and keeps the results by batch number, so a repeated batch replaces its own."""

    def each(batch: DataFrame, number: int) -> None:
        results = run_rules(rules, others | {name: batch})
        results.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def apply_changes(target: DataFrame, changes: DataFrame, keys: list[str], order: list[str], op: str = "op") -> DataFrame:
    """target after a feed of changes: of each key the last one counts; `D` deletes the row, anything else replaces or adds it."""
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*changes.columns), F.struct(*order)).alias("r")).select("r.*")
    same = [target[k].eqNullSafe(last[k]) for k in keys]
    return target.join(last, same, "left_anti").unionByName(last.where(F.col(op) != "D").select(*target.columns))


def change_stream(stream: DataFrame, keys: list[str], order: list[str], load: Callable[[], DataFrame], store: Callable[[DataFrame, int], None], checkpoint: str, op: str = "op") -> StreamingQuery:
    """Applies a change feed, batch by batch, to a table that load reads and store writes anew."""
    each = lambda batch, number: store(apply_changes(load(), batch, keys, order, op), number)
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def upsert_stream(stream: DataFrame, keys: list[str], order: list[str], load: Callable[[], DataFrame], store: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Merges the latest row of each key of every micro-batch into a table that load reads and store writes anew."""

    def each(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), F.struct(*order)).alias("r")).select("r.*")
        store(upsert(load(), last, keys)[0], number)

    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def merge_stream(stream: DataFrame, table: BucketedTable, checkpoint: str, op: str | None = None) -> StreamingQuery:
    """Merges every micro-batch into a table of buckets, by its number: only the buckets with changes are rewritten."""
    q = stream.writeStream.foreachBatch(lambda batch, number: table.merge(batch, number, op) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
