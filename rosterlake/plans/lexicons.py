"""Lexicons learnt from labelled texts, kept as tables, and texts scored by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .phrases import words


def term_presence(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, word: each different word of a text once."""
    return texts.select(F.col(key).alias(key), F.explode(F.array_distinct(words(text))).alias("word"))


def learnt_lexicon(texts: DataFrame, labels: DataFrame, key: str, text: str, label: str, least: int = 5, scale: int = 100) -> DataFrame:
    """word, weight, positives, negatives of the words that `least` labelled texts or more have.

    weight: scale times the logarithm of how much likelier a positive text (label 1) is to have the word than a negative one,
    rounded, with one text added on either side; words that tell nothing have 0. Texts are reduced to counts by word before
    anything is shuffled, so frequent words cost no more than others. Texts without a label, without words or with a null
    label teach nothing.
    """
    known = labels.where(F.col(label).isNotNull()).select(F.col(key).alias("_key"), (F.col(label) == 1).alias("_positive"))
    rows = texts.join(known, texts[key] == known["_key"])
    seen = rows.select(key, "_positive", text)
    total = seen.agg(F.count_if("_positive").alias("all_p"), F.count_if(~F.col("_positive")).alias("all_n"))  # one row
    terms = seen.select("_positive", F.explode(F.array_distinct(words(text))).alias("word"))
    counted = terms.groupBy("word").agg(F.count_if("_positive").alias("positives"), F.count_if(~F.col("_positive")).alias("negatives"))
    counted = counted.where(F.col("positives") + F.col("negatives") >= least).crossJoin(F.broadcast(total))
    odds = ((F.col("positives") + 1) / (F.col("all_p") + 2)) / ((F.col("negatives") + 1) / (F.col("all_n") + 2))
    return counted.select("word", F.round(scale * F.log(odds)).cast("long").alias("weight"), "positives", "negatives")


def scored(texts: DataFrame, lexicon: DataFrame, key: str, text: str) -> DataFrame:
    """key, score (mean weight of the text's different words that the lexicon has, else 0), hits.

    The lexicon is a table like any other: Spark broadcasts it while it is small, else joins by word. Rows of one key are one
    text. A null key is scored, too.
    """
    hits = term_presence(texts, key, text).distinct().join(lexicon.select("word", "weight"), "word")
    found = hits.groupBy(key).agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("hits")).withColumnRenamed(key, "_key")
    keys = texts.select(key).distinct()
    zero = F.lit(0).cast("long")
    rows = keys.join(found, keys[key].eqNullSafe(found["_key"]), "left")
    return rows.select(key, F.when(F.col("hits") > 0, F.col("total") / F.col("hits")).otherwise(0.0).alias("score"), F.coalesce("hits", zero).alias("hits"))
