"""Survival, seasons, phrases, spellings, lineage and shared cells on the HR views."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import conform, forecast, lake, lineage, phrases, sharing, survival
from . import views
from .job_bindings import scratch

AS_OF = date(2024, 6, 30)
c = F.col


def tenure(t) -> DataFrame:
    """Time until an employee leaves; those who are there are seen until AS_OF."""
    left = c("termination_date").isNotNull() & (c("termination_date") <= F.lit(AS_OF))
    return survival.spans(t["employees"], "hire_date", F.least(F.coalesce("termination_date", F.lit(AS_OF)), F.lit(AS_OF)), left, "employee_id", "department_id", "role_id", "annual_salary")


def vacancies(t) -> DataFrame:
    """Time until a vacancy is filled; open ones are seen until they close."""
    filled = c("recruitment_status") == "Filled"
    return survival.spans(t["recruitment"], "opening_date", F.when(filled, c("hire_date")).otherwise(c("closing_date")), filled, "department_id", "recruitment_id", "role_id")


def curve(rows: DataFrame) -> DataFrame:
    return survival.kaplan_meier(rows, "department_id").select("department_id", "time", "at_risk", "events", "censored", F.round("survival", 6).alias("survival"), F.round("error", 6).alias("error"))


def compare(rows: DataFrame) -> DataFrame:
    medians = survival.median_time(survival.kaplan_meier(rows, "department_id"), "department_id")
    return survival.compared(rows, "department_id").join(medians, "department_id").select("department_id", "observed", F.round("expected", 6).alias("expected"), "median")


TENURE = "SELECT department_id, CAST(greatest(date_diff('day', hire_date, least(coalesce(termination_date, DATE '2024-06-30'), DATE '2024-06-30')), 0) AS INT) AS time, termination_date IS NOT NULL AND termination_date <= DATE '2024-06-30' AS event FROM employees"
VACANCIES = "SELECT department_id, CAST(greatest(date_diff('day', opening_date, CASE WHEN recruitment_status = 'Filled' THEN hire_date ELSE closing_date END), 0) AS INT) AS time, recruitment_status = 'Filled' AS event FROM recruitment"
#: At risk and the product are counted anew for each day.
CURVE = """WITH s AS ({rows}), d AS (SELECT department_id, time, count(*) FILTER (WHERE event) AS events, count(*) FILTER (WHERE NOT event) AS censored FROM s GROUP BY 1, 2),
r AS (SELECT d.*, (SELECT count(*) FROM s WHERE s.department_id = d.department_id AND s.time >= d.time) AS at_risk FROM d),
k AS (SELECT a.department_id, a.time, a.at_risk, a.events, a.censored, product(1 - b.events / b.at_risk) AS survival, sum(CASE WHEN b.events < b.at_risk THEN b.events / (CAST(b.at_risk AS DOUBLE) * (b.at_risk - b.events)) ELSE 0 END) AS spread
 FROM r AS a JOIN r AS b ON a.department_id = b.department_id AND b.time <= a.time GROUP BY ALL)"""
CURVE_ROWS = CURVE + " SELECT department_id, time, at_risk, events, censored, round(survival, 6) AS survival, round(survival * sqrt(spread), 6) AS error FROM k"
COMPARE = CURVE + """, a AS (SELECT time, sum(events) AS d, (SELECT count(*) FROM s WHERE s.time >= d.time) AS n FROM d GROUP BY time HAVING sum(events) > 0),
e AS (SELECT g.department_id, sum(a.d * (SELECT count(*) FROM s WHERE s.department_id = g.department_id AND s.time >= a.time) / a.n) AS expected FROM (SELECT DISTINCT department_id FROM s) AS g, a GROUP BY 1)
SELECT department_id, CAST(sum(events) AS BIGINT) AS observed, round(any_value(expected), 6) AS expected, min(time) FILTER (WHERE round(survival, 12) <= 0.5) AS median FROM k JOIN e USING (department_id) GROUP BY 1"""


def hazard(t) -> DataFrame:
    """Days that a model expects vacancies to stand open, and its concordance on the half that it has not seen."""
    roles = t["job_roles"].select("role_id", c("salary_band_min").cast("double").alias("band"))
    rows = vacancies(t).join(roles, "role_id", "left").withColumns({"band": F.coalesce(c("band"), F.lit(0.0)) / 10_000, "unit": (c("department_id") % 5).cast("double")})
    columns = ("band", "unit")
    half = F.pmod(F.xxhash64("recruitment_id"), F.lit(2))
    model = survival.hazard_model(rows.where(half == 0), columns)
    found = survival.expected_time(rows, model, columns)
    kept = survival.concordance(found.where(half == 1), "expected_days")
    return found.crossJoin(F.broadcast(kept)).select("recruitment_id", "time", "event", F.round("expected_days", 3).alias("expected_days"), F.round("concordance", 4).alias("concordance"))


def pay(t) -> DataFrame:
    rows = t["payroll"].join(t["employees"].select("employee_id", "department_id"), "employee_id")
    return lake.monthly(rows, "department_id", "pay_period_start", c("gross_pay").cast("double") / 1000)


def pay_forecast(t) -> DataFrame:
    rows = forecast.seasonal_forecast(pay(t), "department_id", 6)
    return rows.select("department_id", F.make_date(F.floor(c("month") / 12).cast("int"), (c("month") % 12 + 1).cast("int"), F.lit(1)).alias("month_start"), F.round("forecast", 3).alias("forecast"))


def pay_errors(t) -> DataFrame:
    rows = forecast.rolling_errors(pay(t), "department_id")
    return rows.select("department_id", "forecasts", F.round("mean_error", 3).alias("mean_error"), F.round("root_mean_square", 3).alias("root_mean_square"))


SMOOTHED = f"""WITH RECURSIVE s AS (SELECT department_id, year(pay_period_start) * 12 + month(pay_period_start) - 1 AS month, sum(CAST(gross_pay AS DOUBLE) / 1000) AS value FROM payroll JOIN employees USING (employee_id) GROUP BY 1, 2),
b AS (SELECT department_id, min(month) AS first, max(month) AS last FROM s GROUP BY 1),
x AS (SELECT department_id, first, list(coalesce(value, 0) ORDER BY g.month) AS x FROM (SELECT department_id, first, unnest(range(first, last + 1)) AS month FROM b) AS g LEFT JOIN s USING (department_id, month) GROUP BY 1, 2),
h AS (
 SELECT department_id, first, x, 12 AS t, list_avg(x[1:12]) AS level, (list_avg(x[13:24]) - list_avg(x[1:12])) / 12 AS trend, list_transform(x[1:12], lambda v: v - list_avg(x[1:12])) AS season, 0 AS made, 0::DOUBLE AS off, 0::DOUBLE AS square FROM x WHERE len(x) >= 24
 UNION ALL
 SELECT department_id, first, x, t + 1, high, rise, list_concat(season[1:t % 12], [{forecast.SEASONAL}::DOUBLE * (v - high) + (1 - {forecast.SEASONAL}::DOUBLE) * old], season[t % 12 + 2:12]), made + 1, off + abs(v - level - trend - old), square + (v - level - trend - old) * (v - level - trend - old)
 FROM (SELECT *, {forecast.TREND}::DOUBLE * (high - level) + (1 - {forecast.TREND}::DOUBLE) * trend AS rise FROM (SELECT *, {forecast.LEVEL}::DOUBLE * (v - old) + (1 - {forecast.LEVEL}::DOUBLE) * (level + trend) AS high FROM (SELECT *, x[t + 1] AS v, season[t % 12 + 1] AS old FROM h WHERE t < len(x))))),
e AS (SELECT * FROM h WHERE t = len(x))"""
FORECAST = SMOOTHED + " SELECT department_id, make_date((first + t + k - 1) // 12, (first + t + k - 1) % 12 + 1, 1) AS month_start, round(level + k * trend + season[(t + k - 1) % 12 + 1], 3) AS forecast FROM e, (SELECT unnest(range(1, 7)) AS k)"
ERRORS = SMOOTHED + " SELECT department_id, CAST(made AS BIGINT) AS forecasts, round(off / made, 3) AS mean_error, round(sqrt(square / made), 3) AS root_mean_square FROM e"

#: Names of nations as people write them: as they are, in other case and spacing, a letter missing, a letter wrong, doubled, or something else.
SPELT = """SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN n_name WHEN 1 THEN '  ' || lower(replace(n_name, '_', ' - ')) WHEN 2 THEN substr(n_name, 1, 3) || substr(n_name, 5)
 WHEN 3 THEN substr(n_name, 1, 2) || 'x' || substr(n_name, 4) WHEN 4 THEN upper(n_name) || substr(n_name, length(n_name), 1) WHEN 5 THEN 'unheard of ' || CAST(c_custkey AS VARCHAR(12)) END AS spelt FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def spelt(t) -> DataFrame:
    rows = t["customer"].sparkSession.sql(SPELT)
    return conform.conformed(rows, "spelt", t["nation"], "n_name", "n_nationkey", "nation_code").select("c_custkey", "nation_code", "distance")


#: Every value with every name.
SPELLINGS = "WITH x AS (" + SPELT + r"""), v AS (SELECT DISTINCT spelt, trim(regexp_replace(lower(spelt), '[\s_-]+', ' ', 'g')) AS t FROM x WHERE spelt IS NOT NULL),
m AS (SELECT spelt, n_nationkey, levenshtein(t, trim(regexp_replace(lower(n_name), '[\s_-]+', ' ', 'g'))) AS d, t FROM v, nation),
b AS (SELECT spelt, n_nationkey, d, row_number() OVER (PARTITION BY spelt ORDER BY d, n_nationkey) AS k FROM m WHERE d <= (length(t) + 1) // 4)
SELECT c_custkey, n_nationkey AS nation_code, CAST(d AS INT) AS distance FROM x LEFT JOIN b ON x.spelt = b.spelt AND k = 1"""


def working_lineage(t) -> DataFrame:
    """What lateness by department is made of: a view of events, a view of customers, joined and aggregated."""
    report = lake.working_time(t["attendance"], t["employees"]).select("department_id", "days", "late", "utilisation")
    return lineage.checked_lineage(report, {"events": t["events"], "customer": t["customer"]})


WORKING = """WITH e AS (SELECT count(*) AS rows, count(ts) AS ts, count(event_id) AS event_id, count(event_type) AS event_type, count(user_id) AS user_id FROM events), c AS (SELECT count(*) AS rows, count(c_nationkey) AS c_nationkey, count(c_custkey) AS c_custkey FROM customer)
SELECT v.output, v.source, v.source_column, v.role, CASE v.source WHEN 'events' THEN e.rows ELSE c.rows END AS rows,
 CASE v.source_column WHEN 'ts' THEN e.ts WHEN 'event_id' THEN e.event_id WHEN 'event_type' THEN e.event_type WHEN 'user_id' THEN e.user_id WHEN 'c_nationkey' THEN c.c_nationkey ELSE c.c_custkey END AS filled
FROM e, c, (VALUES ('department_id', 'customer', 'c_nationkey', 'value'), ('late', 'events', 'ts', 'value'), ('late', 'events', 'event_type', 'value'),
 ('utilisation', 'events', 'ts', 'value'), ('utilisation', 'events', 'event_id', 'value'), ('utilisation', 'events', 'event_type', 'value'),
 (NULL, 'events', 'ts', 'rows'), (NULL, 'events', 'event_id', 'rows'), (NULL, 'events', 'event_type', 'rows'), (NULL, 'events', 'user_id', 'rows'), (NULL, 'customer', 'c_custkey', 'rows'), (NULL, 'customer', 'c_nationkey', 'rows')) AS v(output, source, source_column, role)"""

#: A key for these queries; a real one comes from where secrets are kept.
KEY = b"key of the tests"


def keyed(t) -> DataFrame:
    return sharing.safe_view(t["customer"], ("c_custkey", "c_name", "c_nationkey"), ("c_name",), KEY, c("c_acctbal") > 0)


KEYED = "SELECT c_custkey, sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode(c_name)))) AS c_name, c_nationkey FROM customer WHERE c_acctbal > 0".format(
    outer=bytes(b ^ 0x5C for b in KEY.ljust(64, b"\0")).hex(), inner=bytes(b ^ 0x36 for b in KEY.ljust(64, b"\0")).hex()
)


def cells(t) -> DataFrame:
    rows = t["employees"].select("department_id", "role_id")
    return sharing.safe_counts(rows, "department_id", "role_id", 4, scratch(rows.sparkSession))


NEAR = r"""WITH w AS (SELECT conv_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM conversations),
p AS (SELECT conv_id, unnest(list_transform(range(1, len(w)), lambda i: {'a': w[i], 'b': w[i + 1]}), recursive := true) FROM w WHERE len(w) > 1)"""
COLLOCATIONS = NEAR + """, n AS (SELECT a, b, count(*) AS n FROM p GROUP BY 1, 2), x AS (SELECT n.*, CAST(sum(n) OVER (PARTITION BY a) AS DOUBLE) AS na, CAST(sum(n) OVER (PARTITION BY b) AS DOUBLE) AS nb, CAST(sum(n) OVER () AS DOUBLE) AS t FROM n)
SELECT a, b, n, round(2 * (n * ln(n * t / (na * nb)) + CASE WHEN na > n THEN (na - n) * ln((na - n) * t / (na * (t - nb))) ELSE 0 END + CASE WHEN nb > n THEN (nb - n) * ln((nb - n) * t / ((t - na) * nb)) ELSE 0 END + CASE WHEN t - na - nb + n > 0 THEN (t - na - nb + n) * ln((t - na - nb + n) * t / ((t - na) * (t - nb))) ELSE 0 END), 4) AS likelihood_ratio FROM x WHERE n >= 5"""
KEYPHRASES = NEAR + """, f AS (SELECT conv_id, a, b, count(*) AS tf FROM p GROUP BY ALL), d AS (SELECT a, b, count(*) AS df FROM f GROUP BY ALL), t AS (SELECT count(DISTINCT conv_id) AS t FROM conversations),
g AS (SELECT conv_id, list({'w': -round(tf * ln(t / df), 6), 'a': a, 'b': b} ORDER BY -round(tf * ln(t / df), 6), a, b) AS l FROM f JOIN d USING (a, b), t WHERE df <= t * 0.5 GROUP BY 1),
k AS (SELECT conv_id, list_reduce(list_transform(l, lambda x: [x]), lambda s, x: CASE WHEN len(s) < 3 AND len(list_filter(s, lambda y: y.a IN (x[1].a, x[1].b) OR y.b IN (x[1].a, x[1].b))) = 0 THEN list_concat(s, x) ELSE s END) AS s FROM g)
SELECT conv_id, CAST(i AS INT) AS rank, s[i].a || ' ' || s[i].b AS phrase, -s[i].w AS weight FROM (SELECT conv_id, s, unnest(range(1, len(s) + 1)) AS i FROM k)"""

BOUND = {
    "P02_fuzzy_conformity": (("customer", "nation"), spelt, SPELLINGS),
    "P09_collocations": (("conversations",), lambda t: phrases.collocations(t["conversations"], "conv_id", "text").withColumn("likelihood_ratio", F.round("likelihood_ratio", 4)), COLLOCATIONS),
    "P09_keyphrases": (("conversations",), lambda t: phrases.keyphrases(t["conversations"], "conv_id", "text"), KEYPHRASES),
    "P11_column_lineage": (("events", "customer", "attendance", "employees"), working_lineage, WORKING),
    "P13_keyed_tokens": (("customer",), keyed, KEYED),
    "P13_safe_counts": (("employees",), cells, None),
    "P10_survival_curve": (("employees",), lambda t: curve(tenure(t)), CURVE_ROWS.format(rows=TENURE)),
    "P10_survival_compared": (("employees",), lambda t: compare(tenure(t)), COMPARE.format(rows=TENURE)),
    "P10_vacancy_curve": (("recruitment",), lambda t: curve(vacancies(t)), CURVE_ROWS.format(rows=VACANCIES)),
    "P10_vacancy_compared": (("recruitment",), lambda t: compare(vacancies(t)), COMPARE.format(rows=VACANCIES)),
    "P10_vacancy_hazard": (("recruitment", "job_roles"), hazard, None),
    "P10_seasonal_forecast": (("payroll", "employees"), pay_forecast, FORECAST),
    "P10_rolling_errors": (("payroll", "employees"), pay_errors, ERRORS),
}


def bindings() -> tuple[dict, dict]:
    q, o = {}, {}
    for key, (needs, fn, text) in BOUND.items():
        q[key] = lambda spark, sf_dir, f=fn, n=needs: f(views.tables(spark, sf_dir, *n))
        if text:
            o[key] = views.sql(text, *[n for n in needs if n in views.VIEWS])
    return q, o
