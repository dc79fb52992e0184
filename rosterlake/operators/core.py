"""Predicates, joins, aggregates and set operations that rules and pipelines are made of."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Predicates. A null predicate selects no row.


def not_equal(a: Column, b: Column) -> Column:
    """SQL inequality: unknown where a side is null."""
    return a != b


def differs(a: Column, b: Column) -> Column:
    """Null-safe inequality: nulls are equal to each other and to nothing else."""
    return ~a.eqNullSafe(b)


def outside_window(start: Column, end: Column, frm: Column, to: Column) -> Column:
    """NOT (frm <= start <= end <= to), with end = start where it is null; also true when start > end."""
    end = F.coalesce(end, start)
    return ~((frm <= start) & (start <= end) & (end <= to))


def outside_range(v: Column, low: Column, high: Column) -> Column:
    return (v < low) | (v > high)


# Joins


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str | None = None) -> DataFrame:
    """Rows of child without a row of parent; a null key has none."""
    keys = parent.select(F.col(pk or fk).alias("_pk"))
    return child.join(keys, child[fk] == keys["_pk"], "left_anti")


def having(a: DataFrame, b: DataFrame, key: str, other: str | None = None) -> DataFrame:
    """Rows of a with a row of b, each once."""
    keys = b.select(F.col(other or key).alias("_k"))
    return a.join(keys, a[key] == keys["_k"], "left_semi")


def with_attributes(df: DataFrame, dim: DataFrame, fk: str, pk: str, columns: Sequence[str], prefix: str = "") -> DataFrame:
    """df with columns of dim, null where it has no row."""
    right = dim.select(F.col(pk).alias("_pk"), *[F.col(c).alias(prefix + c) for c in columns])
    return df.join(right, df[fk] == right["_pk"], "left").drop("_pk")


def compare_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, side (left, right, both) of a full outer join of two key lists."""
    left, right = a.select(F.col(key).alias("l")).distinct(), b.select(F.col(key).alias("r")).distinct()
    side = F.when(F.col("r").isNull(), "left").when(F.col("l").isNull(), "right").otherwise("both")
    return left.join(right, F.col("l") == F.col("r"), "full_outer").select(F.coalesce("l", "r").alias(key), side.alias("side"))


def explode_days(df: DataFrame, start: Column, end: Column, name: str = "day") -> DataFrame:
    """A row for each day from start to end: the calendar side of a range join, without a theta join."""
    return df.where(start <= end).withColumn(name, F.explode(F.sequence(start, end)))


# Aggregates


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, row_count."""
    counts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def duplicates(df: DataFrame, keys: Sequence[str], counted: str | None = None) -> DataFrame:
    """Key values of more than one row, with record_count; nulls are one value."""
    return df.groupBy(*keys).agg(F.count(F.col(counted) if counted else F.lit(1)).alias("record_count")).where("record_count > 1")


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column_name, null_count of all columns in one scan."""
    columns = list(columns or df.columns)
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_count")) for c in columns])).alias("x")).select("x.*")


def single_value(c: str, expected: str) -> Column:
    """An aggregate: whether the non-null values of c, as text, are exactly the expected one."""
    s = F.col(c).cast("string")
    return F.coalesce((F.min(s) == expected) & (F.max(s) == expected), F.lit(False))


def latest_per_key(df: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """The last row of each key in the order of `by`; later columns break ties. One shuffle with partial results."""
    row = F.struct(*df.columns)
    return df.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, F.struct(*by)).alias("r")).select("r.*")


def matches_total(parts: Sequence[tuple[DataFrame, Column | None]], whole: DataFrame, base: int) -> DataFrame:
    """A marker row (base, added, total) when base plus the parts' rows is not the whole's count."""
    added = [df.agg(F.count_if(cond) if cond is not None else F.count(F.lit(1))).toDF("n") for df, cond in parts]
    total = reduce(DataFrame.unionAll, added).agg(F.sum("n").alias("added"))
    one = total.crossJoin(whole.agg(F.count(F.lit(1)).alias("total")))  # one row each
    return one.select(F.lit(base).cast("long").alias("base"), "added", "total").where("base + added <> total")


# Sets


def missing_rows(expected: DataFrame, actual: DataFrame) -> DataFrame:
    return expected.exceptAll(actual)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
