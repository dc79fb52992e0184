"""Values brought to a governed lookup though they are spelt in other ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plain_text(c: Column) -> Column:
    """Lower case, one space for any run of white space, hyphens and underscores, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), r"[\s_-]+", " "))


def grams(text: str) -> Column:
    """The numbered pairs of neighbouring characters of a column, ends included: length + 1 different ones."""
    padded = F.concat(F.lit("\x02"), F.col(text), F.lit("\x03"))
    pairs = F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, F.lit(2)))
    number = lambda g, i: F.size(F.filter(F.slice(pairs, 1, i + 1), lambda h: h == g))
    return F.transform(pairs, lambda g, i: F.concat(g, number(g, i).cast("string")))


def spellings(values: DataFrame, column: str, lookup: DataFrame, name: str, code: str) -> DataFrame:
    """value, code, distance of the distinct values of a column that have a name in the lookup; the nearest, then the smallest code.

    A value may be floor((length + 1) / 4) edits from a name, both as plain text. An edit breaks two pairs of neighbouring
    characters at most, so a name within d edits has one of any 2 d + 1 of the value's pairs; the 2 d + 1 that are rarest among
    the names are looked up, which loses nothing, and only what they find is measured. Each value is looked up once, however
    many rows have it.
    """
    names = lookup.where(F.col(name).isNotNull()).select(plain_text(F.col(name)).alias("name"), F.col(code).alias("code")).groupBy("name").agg(F.min("code").alias("code"))
    distinct = values.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct().withColumn("text", plain_text(F.col("value")))
    exact = distinct.join(names, distinct["text"] == names["name"]).select("value", "code", F.lit(0).alias("distance"))
    limit = F.floor((F.length("text") + 1) / 4).cast("int")
    rest = distinct.join(names, distinct["text"] == names["name"], "left_anti").withColumn("limit", limit).where("limit > 0")
    held = names.select("name", "code", F.explode(grams("name")).alias("g"))
    seen = held.groupBy(F.col("g").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    asked = rest.select("value", "text", "limit", F.explode(grams("text")).alias("g"))
    asked = asked.join(seen, asked["g"] == seen["h"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    k = F.row_number().over(Window.partitionBy("value").orderBy("n", "g"))  # as many rows as the value is long
    asked = asked.withColumn("k", k).where((F.col("k") <= 2 * F.col("limit") + 1) & (F.col("n") > 0))
    pairs = asked.join(held.select("g", "name", "code"), "g").select("value", "text", "limit", "name", "code").distinct()
    far = F.levenshtein("text", "name")
    near = pairs.withColumn("distance", far).where("distance <= limit")
    best = near.groupBy("value").agg(F.min(F.struct("distance", "code")).alias("b")).select("value", "b.code", "b.distance")
    return exact.unionByName(best)


def conformed(rows: DataFrame, column: str, lookup: DataFrame, name: str, code: str, to: str = "code") -> DataFrame:
    """rows with the lookup's code for the column's value and the distance; both null where no name is near, or the value is null."""
    found = spellings(rows, column, lookup, name, code).select(F.col("value").alias("_value"), F.col("code").alias(to), "distance")
    return rows.join(found, rows[column] == found["_value"], "left").drop("_value")
