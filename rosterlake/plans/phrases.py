"""Word pairs that belong together, and phrases that tell a text from others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_WORD = r"[^\p{L}\p{N}]+"


def words(text: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), NO_WORD), lambda w: w != "")


def neighbours(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, a, b: each word of a text with the next one."""
    rows = texts.select(F.col(key).alias(key), words(text).alias("w"))
    at = F.sequence(F.lit(1), F.size("w") - 1)
    pairs = F.when(F.size("w") > 1, F.transform(at, lambda i: F.struct(F.element_at("w", i).alias("a"), F.element_at("w", i + 1).alias("b"))))
    return rows.select(key, F.explode(pairs).alias("p")).select(key, "p.a", "p.b")


def collocations(texts: DataFrame, key: str, text: str, least: int = 5) -> DataFrame:
    """a, b, n, likelihood_ratio of word pairs that stand `least` times or more: how far from chance their neighbourhood is.

    Pairs are counted before anything is joined; counts of first and second words are sums of those, so the words of all
    texts are shuffled once, as partial counts. Nulls and texts of one word have no pairs.
    """
    counted = neighbours(texts, key, text).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    first = counted.groupBy(F.col("a").alias("fa")).agg(F.sum("n").alias("na"))
    second = counted.groupBy(F.col("b").alias("sb")).agg(F.sum("n").alias("nb"))
    total = counted.agg(F.sum("n").alias("total"))  # one row
    rows = counted.where(F.col("n") >= least).join(first, F.col("a") == F.col("fa")).join(second, F.col("b") == F.col("sb")).crossJoin(F.broadcast(total))
    d = lambda c: F.col(c).cast("double")
    n, na, nb, all_ = d("n"), d("na"), d("nb"), d("total")
    part = lambda k, r, c: F.when(k > 0, k * F.log(k * all_ / (r * c))).otherwise(0.0)
    ratio = 2 * (part(n, na, nb) + part(na - n, na, all_ - nb) + part(nb - n, all_ - na, nb) + part(all_ - na - nb + n, all_ - na, all_ - nb))
    return rows.select("a", "b", "n", ratio.alias("likelihood_ratio"))


def keyphrases(texts: DataFrame, key: str, text: str, k: int = 3, most: float = 0.5) -> DataFrame:
    """key, rank, phrase, weight: of each text up to k pairs of words of highest tf-idf that share no word with each other.

    Pairs that more than `most` of all texts have are left out. Taken greedily by weight, then by the alphabet, within each
    text's own list of pairs, which is no longer than the text.
    """
    pairs = neighbours(texts, key, text).groupBy(key, "a", "b").agg(F.count(F.lit(1)).alias("tf"))
    df = pairs.groupBy(F.col("a").alias("da"), F.col("b").alias("db")).agg(F.count(F.lit(1)).alias("df"))
    total = texts.agg(F.count_distinct(key).alias("total"))  # one row
    rows = pairs.join(df.crossJoin(F.broadcast(total)).where(F.col("df") <= F.col("total") * most), (F.col("a") == F.col("da")) & (F.col("b") == F.col("db")))
    weight = F.round(F.col("tf") * F.log(F.col("total") / F.col("df")), 6)
    found = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct((-weight).alias("w"), "a", "b"))).alias("all"))
    start = F.array().cast("array<struct<w: double, a: string, b: string>>")
    meets = lambda chosen, x: F.exists(chosen, lambda y: (y["a"] == x["a"]) | (y["a"] == x["b"]) | (y["b"] == x["a"]) | (y["b"] == x["b"]))
    chosen = F.aggregate("all", start, lambda s, x: F.when((F.size(s) < k) & ~meets(s, x), F.array_append(s, x)).otherwise(s))
    out = found.select(key, F.posexplode(chosen).alias("i", "x"))
    return out.select(key, (F.col("i") + 1).alias("rank"), F.concat_ws(" ", "x.a", "x.b").alias("phrase"), (-F.col("x.w")).alias("weight"))

