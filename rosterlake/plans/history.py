"""Histories that take changes in any order of arrival, and the joint timeline of several histories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Where values hold from, before anything is known to have changed them.
BEGINNING = "0001-01-01"


def islands(rows: DataFrame, key: str, at: str, tracked: Sequence[str]) -> DataFrame:
    """Versions from statements (key, at, s: the tracked values), one for each key and time, with `restated`.

    Neighbours with equal values are one island: it starts with its first statement, and the times of the others are kept.
    """
    w = Window.partitionBy(key).orderBy(at)
    starts = F.col("first") | ~F.col("s").eqNullSafe(F.col("before"))
    rows = rows.withColumn("before", F.lag("s").over(w)).withColumn("first", F.row_number().over(w) == 1)
    rows = rows.withColumn("island", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = rows.groupBy(key, "island").agg(F.min(at).alias("effective_from"), F.first("s").alias("s"), F.sort_array(F.collect_list(at)).alias("times"))
    to = F.lead("effective_from").over(Window.partitionBy(key).orderBy("effective_from"))
    return found.select(key, *[F.col(f"s.{c}").alias(c) for c in tracked], "effective_from", to.alias("effective_to"), to.isNull().alias("is_current"), F.col("island").cast("int").alias("version"), F.slice("times", 2, F.size("times")).alias("restated"))


def stated(changes: DataFrame, key: str, at: str, tracked: Sequence[str]) -> DataFrame:
    """key, at, s: one statement for each key and time, the largest by value where there are more; rows without a time say nothing."""
    return changes.where(F.col(at).isNotNull()).groupBy(key, at).agg(F.max(F.struct(*tracked)).alias("s"))


def versions_of(changes: DataFrame, key: str, at: str, tracked: Sequence[str]) -> DataFrame:
    """scd2 of a whole history, with `restated`: later times at which a version's values were said again.

    Those times cost little and make late changes exact: a change that falls between two statements of one version splits it,
    and what was said again after it starts a version of its own.
    """
    return islands(stated(changes, key, at, tracked), key, at, tracked)


def merge_changes(versions: DataFrame, changes: DataFrame, key: str, at: str, tracked: Sequence[str]) -> DataFrame:
    """versions (from versions_of) with changes worked in, whenever they arrive: what versions_of gives for all changes so far.

    Only the keys that changed are made anew. Their versions become statements again (one at each start and each restated
    time), meet the new ones, and fall into islands; a change may split a version, move its start back, fill a gap between
    two equal ones or do nothing. Repeated changes change nothing, so a batch may be merged twice. Null keys are a key.
    """
    changes = stated(changes, key, at, tracked)
    keys = changes.select(F.col(key).alias("_k")).distinct()
    same = F.col(key).eqNullSafe(F.col("_k"))
    times = F.concat(F.array("effective_from"), F.col("restated"))
    old = versions.join(keys, same, "left_semi").select(key, F.explode(times).alias(at), F.struct(*tracked).alias("s"))
    both = old.unionByName(changes).groupBy(key, at).agg(F.max("s").alias("s"))
    return versions.join(keys, same, "left_anti").unionByName(islands(both, key, at, tracked))


def timeline(base: DataFrame, key: str, histories: Mapping[str, tuple[DataFrame, str, Mapping[str, str]]]) -> DataFrame:
    """One history of all attributes: key, attributes, effective_from, effective_to, is_current, version.

    base has a row for each key with the values before any event. histories: name to (events, time, {attribute: column});
    each sets its own attributes, null being a value, too. Attributes of one instant change together, and what changes
    nothing makes no version. All histories are united, not joined: one window carries each history's last value along, so
    the work is one shuffle however many histories there are. Events of keys that base lacks have nulls before them.
    """
    names = {h: tuple(columns) for h, (_, _, columns) in histories.items()}
    every = [c for columns in names.values() for c in columns]
    kinds = {f.name: f.dataType for f in base.schema.fields}
    empty = lambda h: F.lit(None).cast("struct<" + ", ".join(f"{c}: {kinds[c].simpleString()}" for c in names[h]) + ">")
    parts = [base.select(key, F.lit(BEGINNING).cast("date").alias("at"), *[F.struct(*names[h]).alias(f"_{h}") for h in names])]
    for h, (events, at, columns) in histories.items():
        own = F.struct(*[F.col(x).cast(kinds[c]).alias(c) for c, x in columns.items()])
        said = events.where(F.col(at).isNotNull()).groupBy(key, F.col(at).alias("at")).agg(F.max(own).alias("own"))
        parts.append(said.select(key, "at", *[(F.col("own") if g == h else empty(g)).alias(f"_{g}") for g in names]))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.groupBy(key, "at").agg(*[F.max(f"_{h}").alias(f"_{h}") for h in names])
    so_far = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    state = rows.select(key, "at", *[F.last(f"_{h}", ignorenulls=True).over(so_far).alias(f"_{h}") for h in names])
    state = state.select(key, "at", F.struct(*[F.col(f"_{h}.{c}").alias(c) for h in names for c in names[h]]).alias("s"))
    return islands(state, key, "at", every).drop("restated")


def dealt(facts: DataFrame, versions: DataFrame, key: str, spread: Sequence[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with _salt: rows of a key with more than `limit` facts are dealt over several, where its versions stand again."""
    count = facts.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    pieces = count.select("_k", F.ceil(F.col("n") / limit).cast("int").alias("_pieces"))  # rows / limit keys at most
    same = F.col(key).eqNullSafe(F.col("_k"))
    many = F.coalesce("_pieces", F.lit(1))
    facts = facts.join(pieces, same, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), many).cast("int")).drop("_k", "_pieces")
    versions = versions.join(pieces, same, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), many - 1))).drop("_k", "_pieces")
    return facts, versions


def as_of(facts: DataFrame, versions: DataFrame, key: str, at: str, columns: Sequence[str], spread: Sequence[str], limit: int = 1_000_000) -> DataFrame:
    """facts with `columns` of the version that holds at their time; null before the first one, without a time and for unknown keys.

    Versions and facts are united and sorted by key and time, and each fact takes the last version before it: one sort
    instead of a range condition that would meet every version of a key. spread: columns that deal a frequent key's facts.
    """
    own = [c for c in facts.columns if c not in columns]
    facts, versions = dealt(facts.select(*own), versions, key, spread, limit)
    v = versions.select(key, "_salt", F.col("effective_from").cast("timestamp").alias("_at"), F.lit(0).alias("_kind"), F.struct(*columns).alias("_v"))
    f = facts.select(key, "_salt", F.col(at).cast("timestamp").alias("_at"), F.lit(1).alias("_kind"), F.struct(*own).alias("_f"))
    w = Window.partitionBy(key, "_salt").orderBy(F.asc_nulls_first("_at"), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = v.unionByName(f, allowMissingColumns=True).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_kind = 1")
    return found.select("_f.*", *[F.col(f"_v.{c}").alias(c) for c in columns])

