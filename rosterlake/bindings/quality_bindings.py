"""Learnt lexicons, the quality of predictions, and the whole refresh behind its gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import jobs, lake, lexicons, operational, quality
from ..plans.rules import RuleFailure
from ..sources import lake as sources
from . import job_bindings, views
from .job_bindings import AS_OF, scratch

c = F.col


# Lexicons


def lexicon(t) -> DataFrame:
    return lexicons.learnt_lexicon(t["documents"], t["labels"], "doc_id", "text", "quality")


def sentiment(t) -> DataFrame:
    """The lexicon is written as a table and read again, as a maintained one would be."""
    spark = t["documents"].sparkSession
    path = scratch(spark)
    lexicon(t).write.parquet(path)
    return lexicons.scored(t["documents"], spark.read.parquet(path), "doc_id", "text").select("doc_id", F.round("score", 6).alias("score"), "hits")


LEXICON = r"""WITH w AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> ''))) AS word FROM documents),
k AS (SELECT doc_id, quality = 1 AS good FROM labels WHERE quality IS NOT NULL), n AS (SELECT count(*) FILTER (WHERE good) AS p, count(*) FILTER (WHERE NOT good) AS q FROM k JOIN documents USING (doc_id)),
l AS (SELECT word, count(*) FILTER (WHERE good) AS positives, count(*) FILTER (WHERE NOT good) AS negatives FROM w JOIN k USING (doc_id) GROUP BY 1 HAVING count(*) >= 5),
x AS (SELECT word, CAST(round(100 * ln(((positives + 1) / (p + 2)) / ((negatives + 1) / (q + 2)))) AS BIGINT) AS weight, positives, negatives FROM l, n)"""
LEXICON_ROWS = LEXICON + " SELECT word, weight, positives, negatives FROM x"
SENTIMENT = LEXICON + ", h AS (SELECT doc_id, sum(weight) AS total, count(*) AS hits FROM w JOIN x USING (word) GROUP BY 1) SELECT doc_id, round(coalesce(total / hits, 0), 6) AS score, coalesce(hits, 0) AS hits FROM documents LEFT JOIN h USING (doc_id)"


# Quality of predictions


def absence_ranking(t) -> DataFrame:
    """How well the share of absences tells who left."""
    rows = lake.attrition_features(t["employees"], t["attendance"], AS_OF).withColumn("score", c("absences") / F.nullif("days", F.lit(0)))
    out = quality.ranking(rows, "score", "label")
    return out.select("positives", "negatives", F.round("auc", 6).alias("auc"), F.round("best_cut", 4).alias("best_cut"), F.round("best_youden", 6).alias("best_youden"))


def absence_calibration(t) -> DataFrame:
    rows = lake.attrition_features(t["employees"], t["attendance"], AS_OF).withColumn("score", c("absences") / F.nullif("days", F.lit(0)))
    out = quality.calibration(rows, "score", "label").crossJoin(F.broadcast(quality.probability_errors(rows, "score", "label").withColumnRenamed("rows", "all_rows")))
    return out.select("bin", "rows", *[F.round(x, 6).alias(x) for x in ("mean_score", "share", "gap", "log_loss", "brier", "calibration_error")], "all_rows")


SCORES = "WITH a AS (SELECT employee_id, count(*) AS days, count(*) FILTER (WHERE status = 'Absent') AS absences FROM attendance GROUP BY 1), s AS (SELECT CAST(employment_status = 'Terminated' AS INT) AS y, absences / days AS p FROM employees JOIN a USING (employee_id))"
#: All pairs of a row that left and one that did not, and all cuts.
RANKING = SCORES + """, r AS (SELECT y, round(p, 4) AS p FROM s), pairs AS (SELECT avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) AS auc FROM r AS a, r AS b WHERE a.y = 1 AND b.y = 0),
n AS (SELECT count(*) FILTER (WHERE y = 1) AS positives, count(*) FILTER (WHERE y = 0) AS negatives FROM r),
cuts AS (SELECT cut, round((SELECT count(*) FROM r WHERE y = 1 AND p >= cut) / positives - (SELECT count(*) FROM r WHERE y = 0 AND p >= cut) / negatives, 12) AS youden FROM (SELECT DISTINCT p AS cut FROM r), n)
SELECT positives, negatives, round(auc, 6) AS auc, (SELECT min(cut) FROM cuts WHERE youden = (SELECT max(youden) FROM cuts)) AS best_cut, round((SELECT max(youden) FROM cuts), 6) AS best_youden FROM n, pairs"""
CALIBRATION = SCORES + """, b AS (SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS rows, avg(p) AS mean_score, avg(y) AS share, abs(avg(p) - avg(y)) AS gap FROM s GROUP BY 1),
q AS (SELECT y, greatest(least(p, 1 - 1e-12), 1e-12) AS p FROM s), e AS (SELECT count(*) AS all_rows, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS log_loss, avg((p - y) * (p - y)) AS brier FROM q)
SELECT bin, rows, round(mean_score, 6) AS mean_score, round(share, 6) AS share, round(gap, 6) AS gap, round(log_loss, 6) AS log_loss, round(brier, 6) AS brier, round((SELECT sum(gap * rows) / sum(rows) FROM b), 6) AS calibration_error, all_rows FROM b, e"""

MODELS = ("employees", "attendance", "leave_requests", "employee_surveys", "promotions", "transfers", "performance_reviews", "training")


def model_quality(t) -> DataFrame:
    """Of each model, learnt on one half of the employees, how it does on the other."""
    parts = None
    for name, features, columns in (("attrition", lake.attrition_features(t["employees"], t["attendance"], AS_OF), lake.FEATURES), ("burnout", job_bindings.p10_burnout(t), lake.BURNOUT), ("promotion", job_bindings.p10_promotion(t), lake.PROMOTION)):
        learn, judge = quality.halves(features, "employee_id")
        risk = lake.attrition_risk(judge, lake.attrition_model(learn, columns))
        one = quality.ranking(risk, "risk", "label").select(F.lit(name).alias("model"), (c("positives") + c("negatives")).alias("rows"), F.round("auc", 4).alias("auc")).crossJoin(F.broadcast(quality.probability_errors(risk, "risk", "label").select(F.round("brier", 4).alias("error"), F.round("calibration_error", 4).alias("calibration_error"))))
        parts = one if parts is None else parts.unionByName(one)
    learn, judge = quality.halves(job_bindings.p10_performance(t), "employee_id")
    rating = quality.number_errors(lake.expected(judge, lake.rating_model(learn)), "expected", "label")
    return parts.unionByName(rating.select(F.lit("rating").alias("model"), "rows", F.round("mean_error", 4).alias("error")), allowMissingColumns=True)


# The whole refresh


def whole_refresh(spark, sf_dir) -> DataFrame:
    """Rules, gate, extract, validation and publishing in one call: once with rules that pass, once with one that fails."""
    employees = views.tables(spark, sf_dir, "employees", "departments")
    rows = []
    for case, ids in (("passes", ("R01", "R07", "R08", "R16")), ("stops", ("R01", "R09"))):
        rules = [r for r in operational.operational_rules(AS_OF) if r.id in ids]
        root, target, report = scratch(spark), scratch(spark), scratch(spark)
        raw = {"source": sources.FileSource(spark, sf_dir), "root": root, "lake": target, "tables": ["customer", "nation"], "system": "warehouse", "schema": "public"}
        said = None
        try:
            jobs.full_refresh(spark, employees, AS_OF, report, rules, **raw)
        except RuleFailure as e:
            said = str(e)
        checks = spark.read.schema("check_name string, passed boolean, record_count long, severity string").json(f"{report}/json")
        seen = checks.agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("p")).first()
        published = 0 if said else sum(spark.read.parquet(f"{target}/raw/{n}").count() for n in raw["tables"])
        rows.append((case, seen.n, seen.p, published, said))
    return spark.createDataFrame(rows, "case string, checks long, passed long, published_rows long, said string")


DIRECT = {
    "L3_whole_refresh": (whole_refresh, "SELECT 'passes' AS \"case\", CAST(4 AS BIGINT) AS checks, CAST(4 AS BIGINT) AS passed, (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) AS published_rows, CAST(NULL AS VARCHAR) AS said UNION ALL SELECT 'stops', 2, 1, 0, 'failed checks: No employees with missing department'"),
}
BOUND = {
    "P09_learnt_lexicon": (("documents", "labels"), lexicon, LEXICON_ROWS),
    "P09_learnt_sentiment": (("documents", "labels"), sentiment, SENTIMENT),
    "P10_absence_ranking": (("employees", "attendance"), absence_ranking, RANKING),
    "P10_absence_calibration": (("employees", "attendance"), absence_calibration, CALIBRATION),
    "P10_model_quality": (MODELS, model_quality, None),
}


def bindings() -> tuple[dict, dict]:
    q = {k: fn for k, (fn, _) in DIRECT.items()}
    o = {k: text for k, (_, text) in DIRECT.items()}
    for key, (needs, fn, text) in BOUND.items():
        q[key] = lambda spark, sf_dir, f=fn, n=needs: f(views.tables(spark, sf_dir, *n))
        if text:
            o[key] = views.sql(text, *[n for n in needs if n in views.VIEWS])
    return q, o
