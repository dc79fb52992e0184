"""How good predictions are: ranking, calibration and errors, from counts by score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_score(rows: DataFrame, score: str, label: str, digits: int) -> DataFrame:
    """score (rounded), positives, negatives. Rows without a score or a label are left out."""
    known = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    return known.groupBy(F.round(F.col(score).cast("double"), digits).alias("score")).agg(F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) != 1).alias("negatives"))


def ranking(rows: DataFrame, score: str, label: str, digits: int = 4) -> DataFrame:
    """positives, negatives, auc, best_cut, best_youden: one row.

    auc: the share of pairs of a positive and a negative row that the score orders rightly, ties counting half; null without
    such pairs. No pairs are made: rows are counted by their score, rounded to `digits`, and a running sum over those scores
    knows how many negatives are below. best_cut: the smallest score from which on calling rows positive has the highest
    true rate less false rate (best_youden).
    """
    scores = by_score(rows, score, label, digits)
    up = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each rounded score
    s = scores.select("score", "positives", "negatives", F.sum("negatives").over(up).alias("n_upto"), F.sum("positives").over(up).alias("p_upto"))
    total = scores.agg(F.sum("positives").alias("all_p"), F.sum("negatives").alias("all_n"))  # one row
    p, n = F.col("positives").cast("double"), F.col("negatives").cast("double")
    s = s.crossJoin(F.broadcast(total)).withColumns({"right": p * (F.col("n_upto") - n) + p * n / 2, "youden": (F.col("all_p") - F.col("p_upto") + p) / F.nullif("all_p", F.lit(0)) - (F.col("all_n") - F.col("n_upto") + n) / F.nullif("all_n", F.lit(0))})
    zero = F.lit(0).cast("long")
    out = s.agg(F.coalesce(F.max("all_p"), zero).alias("positives"), F.coalesce(F.max("all_n"), zero).alias("negatives"), F.sum("right").alias("right"), F.max(F.struct(F.round("youden", 12).alias("y"), (-F.col("score")).alias("s"))).alias("best"))
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return out.select("positives", "negatives", F.when(pairs > 0, F.col("right") / pairs).alias("auc"), F.when(pairs > 0, -F.col("best.s")).alias("best_cut"), F.when(pairs > 0, F.col("best.y")).alias("best_youden"))


def calibration(rows: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """bin (0 to bins - 1), rows, mean_score, share (of positives), gap: by equal ranges of a probability."""
    known = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    out = known.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col(score).cast("double")).alias("mean_score"), F.avg((F.col(label) == 1).cast("double")).alias("share"))
    return out.withColumn("gap", F.abs(F.col("mean_score") - F.col("share")))


def probability_errors(rows: DataFrame, score: str, label: str, bins: int = 10, least: float = 1e-12) -> DataFrame:
    """rows, log_loss, brier, calibration_error (gaps weighted by rows): one row; null without rows."""
    known = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    p, y = F.greatest(F.least(F.col(score).cast("double"), F.lit(1 - least)), F.lit(least)), (F.col(label) == 1).cast("double")
    one = known.agg(F.count(F.lit(1)).alias("rows"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"), F.avg((p - y) * (p - y)).alias("brier"))
    gaps = calibration(rows, score, label, bins).agg((F.sum(F.col("gap") * F.col("rows")) / F.sum("rows")).alias("calibration_error"))
    return one.crossJoin(F.broadcast(gaps))  # one row each


def number_errors(rows: DataFrame, predicted: str, label: str) -> DataFrame:
    """rows, mean_error, root_mean_square, explained (share of the label's variance): one row."""
    known = rows.where(F.col(predicted).isNotNull() & F.col(label).isNotNull())
    y, off = F.col(label).cast("double"), F.col(predicted).cast("double") - F.col(label).cast("double")
    out = known.agg(F.count(F.lit(1)).alias("rows"), F.avg(F.abs(off)).alias("mean_error"), F.avg(off * off).alias("square"), F.var_pop(y).alias("spread"))
    return out.select("rows", "mean_error", F.sqrt("square").alias("root_mean_square"), F.when(F.col("spread") > 0, 1 - F.col("square") / F.col("spread")).alias("explained"))


def halves(rows: DataFrame, key: str, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Rows to learn from and rows to be judged by, the same in every run: by a hash of the key."""
    half = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(2))
    return rows.where(half == 0), rows.where(half == 1)
