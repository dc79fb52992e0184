"""Insert, update or leave rows by key, on plain files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(new target, change log): rows of source replace those of target with their key, others of target stay.

    The log has the keys and an action: created, updated (a value differs, nulls being equal to each other) or unchanged.
    Duplicate keys of the source raise an error when the result is computed. Write the result to a new path and swap.
    """
    values = [c for c in source.columns if c not in keys]
    once = source.groupBy(*keys).agg(*[F.first(c).alias(c) for c in values], F.count(F.lit(1)).alias("_n"))
    once = once.withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit("a key stands twice in the source"))).otherwise(F.col("_n")))
    t = target.select(*[F.col(c).alias(f"t_{c}") for c in target.columns], F.lit(True).alias("_in_t"))
    cond = [F.col(f"t_{k}").eqNullSafe(F.col(k)) for k in keys]
    both = t.join(once, cond, "full_outer")
    changed = F.lit(False)
    for c in values:
        changed |= ~F.col(f"t_{c}").eqNullSafe(F.col(c))
    action = F.when(F.col("_n").isNull(), "kept").when(F.col("_in_t").isNull(), "created").when(changed, "updated").otherwise("unchanged")
    both = both.withColumn("action", action)
    pick = lambda c: F.when(F.col("_n").isNull(), F.col(f"t_{c}")).otherwise(F.col(c)) if c in source.columns else F.col(f"t_{c}")
    out = both.select(*[pick(c).alias(c) for c in target.columns])
    log = both.where("action <> 'kept'").select(*keys, "action")
    return out, log
