"""Time until an event where some have not had it yet: curves, comparisons of groups, a hazard model and its concordance."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spans(rows: DataFrame, start: str, end: Column, event: Column, *columns: str) -> DataFrame:
    """columns, time (days from start to end, none below 0), event; rows without both dates say nothing."""
    time = F.greatest(F.date_diff(end, F.col(start)), F.lit(0))
    return rows.select(*columns, time.alias("time"), F.coalesce(event, F.lit(False)).alias("event")).where("time IS NOT NULL")


def counts(durations: DataFrame, group: str) -> DataFrame:
    """group, time, events, censored, at_risk: a row for each day that a group has; who leaves on a day is at risk on it."""
    rows = durations.groupBy(group, "time").agg(F.count_if("event").alias("events"), F.count_if(~F.col("event")).alias("censored"))
    later = Window.partitionBy(group).orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("at_risk", F.sum(F.col("events") + F.col("censored")).over(later))


def kaplan_meier(durations: DataFrame, group: str) -> DataFrame:
    """group, time, at_risk, events, censored, survival and its standard error (Greenwood), for each day of a group.

    Rows are counted by day before any window, so a group of any size is as many rows as it has days. On days on which only
    some are lost from sight the curve stays level; where all at risk have the event it ends at 0 with error 0.
    """
    rows = counts(durations, group)
    so_far = Window.partitionBy(group).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    d, n = F.col("events").cast("double"), F.col("at_risk").cast("double")
    survival = F.product(1 - d / n).over(so_far)
    spread = F.sum(F.when(d < n, d / (n * (n - d))).otherwise(0.0)).over(so_far)
    return rows.select(group, "time", "at_risk", "events", "censored", survival.alias("survival"), (survival * F.sqrt(spread)).alias("error"))


def median_time(curve: DataFrame, group: str) -> DataFrame:
    """group, median: the first day on which at most half are left; null where more than half are to the end.

    Exactly half is half, whatever a product of doubles has lost: shares are compared to 12 digits.
    """
    return curve.groupBy(group).agg(F.min(F.when(F.round("survival", 12) <= 0.5, F.col("time"))).alias("median"))


def compared(durations: DataFrame, group: str) -> DataFrame:
    """group, observed events, and those expected if all groups had one hazard (as in a log-rank test).

    Each row is expected to have as many events as the common hazard has added up to by its own time, so days are joined by
    equality and no group meets days that it has no row on.
    """
    own = counts(durations, group)
    days = own.groupBy("time").agg(F.sum("events").alias("d"), F.sum(F.col("events") + F.col("censored")).alias("n"))
    down, up = (Window.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.desc("time"), F.asc("time")))  # a row for each day
    hazard = days.withColumn("n", F.sum("n").over(down)).select(F.col("time").alias("t"), F.sum(F.col("d") / F.col("n")).over(up).alias("hazard"))
    rows = own.join(hazard, own["time"] == hazard["t"])
    return rows.groupBy(group).agg(F.sum("events").alias("observed"), F.sum((F.col("events") + F.col("censored")) * F.col("hazard")).alias("expected"))


def hazard_model(durations: DataFrame, columns: Sequence[str]):
    """A Weibull model of the time (accelerated failure time) on numeric columns; rows with a null are left out."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import AFTSurvivalRegression

    rows = durations.dropna(subset=[*columns, "time"]).withColumns({"label": F.greatest("time", F.lit(1)).cast("double"), "censor": F.col("event").cast("double")})
    return AFTSurvivalRegression(maxIter=50).fit(VectorAssembler(inputCols=list(columns), outputCol="features").transform(rows))


def expected_time(rows: DataFrame, model, columns: Sequence[str]) -> DataFrame:
    """rows with expected_days, the model's scale of their time as a plain expression; null where a column is."""
    terms = [F.col(c).cast("double") * float(w) for c, w in zip(columns, model.coefficients)]
    return rows.withColumn("expected_days", F.exp(reduce(lambda a, b: a + b, terms, F.lit(float(model.intercept)))))


def concordance(rows: DataFrame, predicted: str, bins: int = 32) -> DataFrame:
    """pairs, concordance: of all pairs whose order is known (the earlier one had the event), the share that `predicted` orders alike.

    Predictions are put into `bins` quantiles, and pairs of one bin count half. Counted by day and bin, so no pairs are made:
    those that last longer than a day, by bin, are a running sum over days. Days of one length bound the only window.
    """
    cuts = rows.agg(F.percentile_approx(predicted, [i / bins for i in range(1, bins)], 10_000).alias("cuts"))  # one row
    at = F.size(F.filter("cuts", lambda c: c < F.col(predicted)))
    dealt = rows.where(F.col(predicted).isNotNull()).crossJoin(F.broadcast(cuts)).withColumn("bin", at)
    every = [F.count_if(F.col("bin") == i).alias(f"n{i}") for i in range(bins)] + [F.count_if((F.col("bin") == i) & F.col("event")).alias(f"e{i}") for i in range(bins)]
    days = dealt.groupBy("time").agg(*every)
    later = Window.orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each day
    lasting = days.select("time", *[f"e{i}" for i in range(bins)], *[F.coalesce(F.sum(f"n{i}").over(later), F.lit(0).cast("long")).alias(f"l{i}") for i in range(bins)])
    total = lambda xs: reduce(lambda a, b: a + b, xs, F.lit(0.0))
    pairs = total(F.col(f"e{i}") for i in range(bins)) * total(F.col(f"l{i}") for i in range(bins))
    right = total(F.col(f"e{i}") * (total(F.col(f"l{j}") for j in range(i + 1, bins)) + F.col(f"l{i}") * 0.5) for i in range(bins))
    return lasting.agg(F.sum(pairs).cast("long").alias("pairs"), F.sum(right).alias("_right")).select("pairs", F.when(F.col("pairs") > 0, F.col("_right") / F.col("pairs")).alias("concordance"))
