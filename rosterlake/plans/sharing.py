"""Views that may be shared: keyed tokens in place of names, and counts from which no small group can be worked out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.bucketed import remove

BLOCK = 64


def token(column: str, key: bytes) -> Column:
    """HMAC-SHA256 of a column's text in lower-case hex, by Spark's own sha2; null stays null.

    Without the key nobody can try names out, as with a plain hash; equal names keep equal tokens, so views can be joined.
    """
    if not 16 <= len(key) <= BLOCK:
        raise ValueError(f"a key has 16 to {BLOCK} bytes")
    inner, outer = (bytes(b ^ pad for b in key.ljust(BLOCK, b"\0")) for pad in (0x36, 0x5C))
    first = F.sha2(F.concat(F.lit(inner), F.encode(F.col(column).cast("string"), "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)


def safe_view(df: DataFrame, columns: Sequence[str], tokens: Sequence[str], key: bytes, row_filter: Column | None = None) -> DataFrame:
    """An approved product: some columns, some of them as tokens, some rows."""
    rows = df if row_filter is None else df.where(row_filter)
    return rows.select(*[token(c, key).alias(c) if c in tokens else F.col(c) for c in columns])


def safe_counts(df: DataFrame, row: str, column: str, least: int, folder: str) -> DataFrame:
    """row, column, total_of, n: counts of all groups and of their totals, n null where it is withheld.

    total_of: null for a group, else row, column or all.

    Groups of fewer than `least` rows are withheld. In each line (a row or a column with its total, and the totals themselves)
    the withheld numbers must be at least two and together `least` or more; else the line's smallest published number goes,
    too, totals last. Lines are looked at in turn until none has to change, so taking published numbers from a total, again
    and again, gives none of the withheld ones. Rounds work on the groups, never on the rows, and are kept in `folder` until
    the next. Null values are a group.
    """
    spark = df.sparkSession
    mark = lambda c: F.struct(F.col(c).isNull().alias("none"), F.col(c).cast("string").alias("value"))
    cells = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).alias("level"), F.lit(None).cast("string").alias("total_of"), mark(row).alias("a"), mark(column).alias("b"), F.col(row).alias("_row"), F.col(column).alias("_column"), "n")
    total = F.struct(F.lit(True).alias("none"), F.lit("total").alias("value"))
    kinds = dict(cells.dtypes)
    null = lambda c: F.lit(None).cast(kinds[c])
    rows = cells.groupBy("a", "_row").agg(F.sum("n").alias("n")).select(F.lit(1).alias("level"), F.lit("row").alias("total_of"), "a", total.alias("b"), "_row", null("_column").alias("_column"), "n")
    columns = cells.groupBy("b", "_column").agg(F.sum("n").alias("n")).select(F.lit(1).alias("level"), F.lit("column").alias("total_of"), total.alias("a"), "b", null("_row").alias("_row"), "_column", "n")
    whole = cells.agg(F.sum("n").alias("n")).where("n IS NOT NULL").select(F.lit(2).alias("level"), F.lit("all").alias("total_of"), total.alias("a"), total.alias("b"), null("_row").alias("_row"), null("_column").alias("_column"), "n")
    table = cells.unionByName(rows).unionByName(columns).unionByName(whole).withColumn("hidden", F.col("n") < least).withColumn("new", F.lit(True))
    schema, k, last = table.schema, 0, None
    while True:
        path = f"{folder}/cells-{k}"
        table.write.parquet(path)
        table, k = spark.read.schema(schema).parquet(path), k + 1
        if last:
            remove(spark, last)
        last = path
        if k > 1 and table.where("new").isEmpty():
            break
        table = table.withColumn("new", F.lit(False))
        for line, other in (("a", "b"), ("b", "a")):
            own = Window.partitionBy(line)
            count, held = F.sum(F.col("hidden").cast("int")).over(own), F.sum(F.when(F.col("hidden"), F.col("n")).otherwise(0)).over(own)
            next_ = F.row_number().over(own.orderBy("hidden", "level", "n", other)) == 1
            goes = (count > 0) & ((count == 1) | (held < least)) & next_ & ~F.col("hidden")
            table = table.withColumn("_goes", goes).withColumns({"hidden": F.col("hidden") | F.col("_goes"), "new": F.col("new") | F.col("_goes")}).drop("_goes")
    return table.select(F.col("_row").alias(row), F.col("_column").alias(column), "total_of", F.when(~F.col("hidden"), F.col("n")).alias("n"))
