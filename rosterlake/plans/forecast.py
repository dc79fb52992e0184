"""Forecasts with trend and season: exponential smoothing as a fold over each key's months."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEASON, LEVEL, TREND, SEASONAL = 12, 0.3, 0.05, 0.2


def whole_series(series: DataFrame, key: str) -> DataFrame:
    """key, first (its first month), x: the values of all months from the first to the last, 0 where a month has no row.

    series: key, month (a whole number), value. A key's months are one array, bounded by the months that there are.
    """
    rows = series.groupBy(key, "month").agg(F.sum(F.col("value").cast("double")).alias("value"))
    found = rows.groupBy(key).agg(F.min("month").alias("first"), F.max("month").alias("last"), F.map_from_entries(F.collect_list(F.struct("month", F.coalesce("value", F.lit(0.0)).alias("value")))).alias("m"))
    return found.select(key, "first", F.transform(F.sequence("first", "last"), lambda t: F.coalesce(F.element_at("m", t), F.lit(0.0))).alias("x"))


def smoothed(series: DataFrame, key: str, season: int = SEASON, level: float = LEVEL, trend: float = TREND, seasonal: float = SEASONAL) -> DataFrame:
    """key, first, n (months), state: level, trend, season, and of one-step forecasts: how many, sums of errors and squares.

    Additive Holt-Winters. The first two seasons give the start (level: mean of the first; trend: difference of the two means
    by month; season: the first one's distances from its mean); then each month is forecast from those before it, its error is
    kept, and the state moves on, which is a rolling origin over all months. A key of fewer than two seasons has no season
    and no trend: its level starts with its first month, and every later one is forecast by it.
    """
    rows, m = whole_series(series, key), season
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.lit(float(m))
    x, n = F.col("x"), F.size("x")
    long = n >= 2 * m
    one = mean(F.slice(x, 1, m))
    rows = rows.select(key, "first", n.alias("n"), x, long.alias("long"), F.when(long, one).otherwise(F.get(x, F.lit(0))).alias("l"), F.when(long, (mean(F.slice(x, m + 1, m)) - one) / m).otherwise(0.0).alias("b"))
    zero = F.array_repeat(F.lit(0.0), m)
    rows = rows.withColumn("s", F.when(F.col("long"), F.transform(F.slice("x", 1, m), lambda v: v - F.col("l"))).otherwise(zero))
    start = F.struct(F.col("l").alias("level"), F.col("b").alias("trend"), F.col("s").alias("season"), F.when(F.col("long"), m).otherwise(1).alias("t"), F.lit(0).alias("made"), F.lit(0.0).alias("off"), F.lit(0.0).alias("square"))
    rest = F.when(F.col("long"), F.slice("x", m + 1, n)).otherwise(F.slice("x", 2, n))
    b_, s_ = F.when(F.col("long"), trend).otherwise(0.0), F.when(F.col("long"), seasonal).otherwise(0.0)

    def step(a, v):
        old = F.get(a["season"], a["t"] % m)
        guess = a["level"] + a["trend"] + old
        high = level * (v - old) + (1 - level) * (a["level"] + a["trend"])
        rise = b_ * (high - a["level"]) + (1 - b_) * a["trend"]
        new = s_ * (v - high) + (1 - s_) * old
        moved = F.transform(a["season"], lambda w, i: F.when(i == a["t"] % m, new).otherwise(w))
        return F.struct(high.alias("level"), rise.alias("trend"), moved.alias("season"), (a["t"] + 1).alias("t"), (a["made"] + 1).alias("made"), (a["off"] + F.abs(v - guess)).alias("off"), (a["square"] + (v - guess) * (v - guess)).alias("square"))

    return rows.select(key, "first", "n", F.aggregate(rest, start, step).alias("state"))


def seasonal_forecast(series: DataFrame, key: str, ahead: int = 12, season: int = SEASON, **weights: float) -> DataFrame:
    """key, month, forecast of the months after each key's last one."""
    rows = smoothed(series, key, season, **weights).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(ahead))))
    s = F.col("state")
    value = s["level"] + F.col("h") * s["trend"] + F.get(s["season"], (s["t"] + F.col("h") - 1) % season)
    return rows.select(key, (F.col("first") + F.col("n") + F.col("h") - 1).alias("month"), value.alias("forecast"))


def rolling_errors(series: DataFrame, key: str, season: int = SEASON, **weights: float) -> DataFrame:
    """key, forecasts, mean_error, root_mean_square: of each month's forecast from the months before it; null without any."""
    s, n = F.col("state"), F.col("state.made")
    return smoothed(series, key, season, **weights).select(key, n.cast("long").alias("forecasts"), F.when(n > 0, s["off"] / n).alias("mean_error"), F.when(n > 0, F.sqrt(s["square"] / n)).alias("root_mean_square"))
