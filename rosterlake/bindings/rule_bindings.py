"""Rules on the HR views."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import fused, operational, reference_rules
from ..plans.rules import Rule, run_rules, summary
from . import views

AS_OF = date(2024, 6, 30)
EVENT = "(SELECT '{rule}' AS rule, {key} AS event_id, f.employee_id, coalesce({start}, {end}) AS s, coalesce({end}, {start}) AS e, hire_date, coalesce(termination_date, DATE '2024-06-30') AS u FROM {table} AS f JOIN employees USING (employee_id))"
LATEST = "(SELECT *, row_number() OVER (PARTITION BY employee_id ORDER BY {by} DESC, {key} DESC) AS k FROM {table})"

#: SQL of the violating rows of each rule, as a FROM clause with its conditions.
FROM = {
    "R01": "employees", "R02": "attendance", "R03": "payroll", "R04": "employee_exits",
    "R05": "employees WHERE manager_id IS NULL",
    "R06": "employees WHERE manager_id IS NULL AND NOT is_manager",
    "R07": "(SELECT employee_number FROM employees GROUP BY 1 HAVING count(employee_id) > 1)",
    "R08": "(SELECT email FROM employees GROUP BY 1 HAVING count(employee_id) > 1)",
    "R09": "employees AS e WHERE NOT EXISTS (SELECT 1 FROM departments AS d WHERE d.department_id = e.department_id)",
    "R10": "employees AS e WHERE NOT EXISTS (SELECT 1 FROM job_roles AS d WHERE d.role_id = e.role_id)",
    "R11": "employees AS e WHERE NOT EXISTS (SELECT 1 FROM locations AS d WHERE d.location_id = e.location_id)",
    "R12": "attendance AS a WHERE NOT EXISTS (SELECT 1 FROM employees AS e WHERE e.employee_id = a.employee_id)",
    "R13": "payroll AS a WHERE NOT EXISTS (SELECT 1 FROM employees AS e WHERE e.employee_id = a.employee_id)",
    "R14": "employee_exits AS a WHERE NOT EXISTS (SELECT 1 FROM employees AS e WHERE e.employee_id = a.employee_id)",
    "R15": "employees WHERE annual_salary < 0",
    "R16": "employees WHERE termination_date < hire_date",
    "R17": "payroll WHERE gross_pay < 0 OR net_pay < 0 OR base_salary < 0",
    "R18": "employees AS e WHERE is_active AND employee_id IN (SELECT employee_id FROM employee_exits)",
    "R19": "(SELECT DISTINCT e.employee_id FROM employees AS e JOIN employee_exits AS x USING (employee_id) WHERE x.exit_date < e.hire_date)",
    "R20": "(SELECT DISTINCT e.employee_id FROM employees AS e JOIN employee_exits AS x USING (employee_id) WHERE e.termination_date IS NULL OR e.termination_date <> x.exit_date)",
    "R21": "employees WHERE employment_status <> 'Terminated' AND employee_id IN (SELECT employee_id FROM employee_exits)",
    "R22": "employees AS e WHERE (NOT is_active OR termination_date IS NOT NULL OR employment_status = 'Terminated') AND NOT EXISTS (SELECT 1 FROM employee_exits AS x WHERE x.employee_id = e.employee_id)",
    "R23": "exit_interviews AS i WHERE NOT EXISTS (SELECT 1 FROM employee_exits AS x WHERE x.employee_id = i.employee_id)",
    "R24": "exit_interviews WHERE employee_id IN (SELECT employee_id FROM employees WHERE is_active)",
    "R25": "promotions AS p JOIN job_roles AS r ON p.new_role_id = r.role_id WHERE new_salary < salary_band_min OR new_salary > salary_band_max",
    "R26": "promotions AS p JOIN job_roles AS r ON p.new_role_id = r.role_id WHERE salary_band_min > salary_band_max",
    "R27": "recruitment AS r WHERE recruitment_status = 'Filled' AND NOT EXISTS (SELECT 1 FROM employees AS e WHERE e.employee_id = r.successful_employee_id)",
    "R28": "recruitment WHERE recruitment_status = 'Open' AND successful_employee_id IN (SELECT employee_id FROM employees)",
    "R29": "recruitment AS r JOIN employees AS e ON e.employee_id = r.successful_employee_id WHERE r.hire_date IS DISTINCT FROM e.hire_date",
    "R30": "(SELECT 1 AS x WHERE 2000 + (SELECT count(*) FROM recruitment WHERE recruitment_status = 'Filled') <> (SELECT count(*) FROM employees))",
    "R31": LATEST.format(by="promotion_date", key="promotion_id", table="promotions") + " AS p JOIN employees AS e USING (employee_id) WHERE k = 1 AND (p.new_role_id IS DISTINCT FROM e.role_id OR p.new_salary IS DISTINCT FROM e.annual_salary)",
    "R32": LATEST.format(by="transfer_date", key="transfer_id", table="transfers") + " AS p JOIN employees AS e USING (employee_id) WHERE k = 1 AND (p.new_department_id IS DISTINCT FROM e.department_id OR p.new_location_id IS DISTINCT FROM e.location_id OR p.new_manager_id IS DISTINCT FROM e.manager_id)",
    "R42": "promotions AS p JOIN job_roles AS r ON p.new_role_id = r.role_id WHERE new_salary < salary_band_min",
    "R43": "promotions AS p JOIN job_roles AS r ON p.new_role_id = r.role_id WHERE new_salary > salary_band_max",
    "W16": "exit_interviews AS i JOIN employee_exits AS x USING (employee_id) WHERE i.termination_date IS DISTINCT FROM x.exit_date OR i.exit_reason IS DISTINCT FROM x.exit_reason OR i.voluntary_exit IS DISTINCT FROM x.voluntary_flag",
    "P08a": "employees WHERE hire_date > DATE '2024-06-30'",
    "P08b": "(SELECT employee_id, promotion_date FROM promotions GROUP BY 1, 2 HAVING count(*) > 1)",
    "P08c": "attendance WHERE ((clock_in_sec IS NULL) <> (clock_out_sec IS NULL)) OR (status = 'Absent' AND clock_in_sec IS NOT NULL)",
    "P08d": "performance_reviews WHERE overall_rating < 1 OR overall_rating > 5",
    "P08e": "employees AS e WHERE manager_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM employees AS m WHERE m.employee_id = e.manager_id)",
}
for _rule, _table, _key, _start, _end in operational.WINDOWS:
    FROM[_rule] = EVENT.format(rule=_rule, key=_key, start=_start, end=_end, table=_table) + " AS w WHERE NOT (hire_date <= s AND s <= e AND e <= u)"


def all_rules() -> list[Rule]:
    return operational.operational_rules(AS_OF) + operational.optional_rules() + operational.extra_rules(AS_OF)


def result_sql(rule: Rule) -> str:
    low, high = rule.allowed
    passed = f"n >= {low}" if high is None else f"n BETWEEN {low} AND {high}"
    name = rule.name.replace("'", "''")
    return f"SELECT '{name}' AS check_name, ({passed}) AS passed, n AS record_count, '{rule.severity}' AS severity FROM (SELECT count(*) AS n FROM {FROM[rule.id]}) AS c_{rule.id}"


def one(rule: Rule):
    return lambda spark, sf_dir: rule.result(views.tables(spark, sf_dir, *rule.needs))


def q1_counts(spark, sf_dir) -> DataFrame:
    from ..operators import table_counts

    return table_counts(views.tables(spark, sf_dir, *COUNTED))


COUNTED = ("employees", "attendance", "payroll", "leave_requests", "recruitment", "promotions", "transfers", "training", "performance_reviews", "employee_surveys", "manager_feedback", "employee_exits", "exit_interviews")
ALL_VIEWS = tuple(dict.fromkeys(n for r in operational.operational_rules(AS_OF) for n in r.needs))


def q2_run_rules(spark, sf_dir) -> DataFrame:
    return run_rules(operational.operational_rules(AS_OF), views.tables(spark, sf_dir, *ALL_VIEWS))


def q2_fused(spark, sf_dir) -> DataFrame:
    return fused.run_fused(views.tables(spark, sf_dir, *ALL_VIEWS), AS_OF)


def q3_summary(spark, sf_dir) -> DataFrame:
    return summary(q2_fused(spark, sf_dir))


def window_rows(spark, sf_dir) -> DataFrame:
    t = views.tables(spark, sf_dir, "employees", *(w[1] for w in operational.WINDOWS))
    return operational.window_violations(t, AS_OF).groupBy("rule").agg(F.count(F.lit(1)).alias("violations"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


REFERENCE = {
    "D01_empty": (("public_holidays",), lambda t: reference_rules.not_empty(t["public_holidays"].where("holiday_name = 'none'"), "public_holidays"), "SELECT 'public_holidays' AS dataset, 'D01' AS rule, CAST(NULL AS VARCHAR) AS record_key, CAST(NULL AS VARCHAR) AS field, '0' AS value WHERE NOT EXISTS (SELECT 1 FROM public_holidays WHERE holiday_name = 'none')"),
    "D02_required": (("departments",), lambda t: reference_rules.required(t["departments"], "departments", "department_name", ("department_name", "cost_center", "business_unit")), "SELECT 'departments' AS dataset, 'D02' AS rule, department_name AS record_key, 'cost_center' AS field, cost_center AS value FROM departments WHERE trim(cost_center) = ''"),
    "D03_unique": (("public_holidays",), lambda t: reference_rules.unique(t["public_holidays"], "public_holidays", ("holiday_code", "month_day")), "SELECT 'public_holidays' AS dataset, 'D03' AS rule, month_day AS record_key, 'month_day' AS field, CAST(count(*) AS VARCHAR) AS value FROM public_holidays GROUP BY month_day HAVING count(*) > 1"),
    "D04_booleans": (("exit_reasons",), lambda t: reference_rules.real_booleans(t["exit_reasons"].withColumn("voluntary", F.when(F.col("weight") < 3, "yes").otherwise("TRUE")), "exit_reasons", "exit_reason_name", ("voluntary",)), "SELECT 'exit_reasons' AS dataset, 'D04' AS rule, exit_reason_name AS record_key, 'voluntary' AS field, 'yes' AS value FROM exit_reasons WHERE weight < 3"),
    "D05_codes": (("exit_reasons",), lambda t: reference_rules.codes(t["exit_reasons"], "exit_reasons", "exit_reason_name", "exit_reason_code"), "SELECT 'exit_reasons' AS dataset, 'D05' AS rule, exit_reason_name AS record_key, 'exit_reason_code' AS field, exit_reason_code AS value FROM exit_reasons WHERE NOT regexp_full_match(exit_reason_code, '[A-Z0-9_]*[A-Z0-9][A-Z0-9_]*')"),
    "D06_parents": (("departments", "business_units"), lambda t: reference_rules.parent_names(t["departments"], t["business_units"], "departments", "department_name", "business_unit", "unit_name"), "SELECT 'departments' AS dataset, 'D06' AS rule, department_name AS record_key, 'business_unit' AS field, business_unit AS value FROM departments WHERE business_unit NOT IN (SELECT unit_name FROM business_units)"),
    "D07_bands": (("job_roles",), lambda t: reference_rules.salary_bands(t["job_roles"]), "SELECT 'job_roles' AS dataset, 'D07 order' AS rule, role_name AS record_key, 'salary_band_min' AS field, CAST(salary_band_min AS VARCHAR) AS value FROM job_roles WHERE salary_band_min > salary_band_max"),
    "D08_weights": (("attendance_statuses",), lambda t: reference_rules.weights(t["attendance_statuses"], "attendance_statuses", "attendance_status_code"), "SELECT 'attendance_statuses' AS dataset, 'D08' AS rule, attendance_status_code AS record_key, 'weight' AS field, CAST(weight AS VARCHAR) AS value FROM attendance_statuses WHERE weight <= 0"),
    "D09_absent": (("attendance_statuses",), lambda t: reference_rules.absent_status(t["attendance_statuses"]), "SELECT 'attendance_statuses' AS dataset, 'D09' AS rule, 'Absent' AS record_key, 'attendance_status_name' AS field, CAST(n AS VARCHAR) AS value FROM (SELECT count(*) AS n FROM attendance_statuses WHERE attendance_status_name = 'Absent') AS c WHERE n <> 1 UNION ALL SELECT 'attendance_statuses', 'D09', attendance_status_code, 'requires_clock_times', 'true' FROM attendance_statuses WHERE attendance_status_name = 'Absent' AND requires_clock_times UNION ALL SELECT 'attendance_statuses', 'D09', attendance_status_code, 'absence_reason_required', 'false' FROM attendance_statuses WHERE attendance_status_name = 'Absent' AND NOT absence_reason_required"),
    "D10_reasons": (("exit_reasons",), lambda t: reference_rules.exit_reasons(t["exit_reasons"]).groupBy("rule").agg(F.count(F.lit(1)).alias("violations")), "SELECT 'D10 empty' AS rule, count(*) AS violations FROM exit_reasons WHERE coalesce(len(reasons), 0) = 0 UNION ALL SELECT 'D10 blank', count(*) FROM exit_reasons WHERE len(list_filter(reasons, lambda x: trim(x) = '')) > 0 UNION ALL SELECT 'D10 twice', count(*) FROM exit_reasons WHERE len(reasons) <> len(list_distinct(reasons)) UNION ALL SELECT 'D10 weight', count(*) FROM exit_reasons WHERE weight <= 0"),
    "D11_holidays": (("public_holidays",), lambda t: reference_rules.holidays(t["public_holidays"]), "SELECT 'public_holidays' AS dataset, 'D11' AS rule, holiday_code AS record_key, 'month_day' AS field, month_day AS value FROM public_holidays WHERE try_strptime('1900-' || month_day, '%Y-%m-%d') IS NULL UNION ALL SELECT 'public_holidays', 'D11', holiday_code, 'country_code', country_code FROM public_holidays WHERE length(trim(country_code)) <> 2 OR country_code <> upper(country_code)"),
}


def bindings() -> tuple[dict, dict]:
    q, o = {}, {}
    for rule in all_rules():
        key = f"{rule.id}_{'_'.join(rule.name.lower().replace('-', ' ').split()[:5])}"
        q[key], o[key] = one(rule), views.sql(result_sql(rule), *rule.needs)
    every = " UNION ALL ".join(result_sql(r) for r in operational.operational_rules(AS_OF))
    q |= {"Q1_table_counts": q1_counts, "Q2_run_rules": q2_run_rules, "Q2_run_rules_fused": q2_fused, "Q3_summary": q3_summary, "R33_R41_window_violations": window_rows}
    o["Q1_table_counts"] = views.sql(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in COUNTED), *COUNTED)
    o["Q2_run_rules"] = o["Q2_run_rules_fused"] = views.sql(every, *ALL_VIEWS)
    o["Q3_summary"] = views.sql(f"SELECT count(*) AS total, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed, count(*) FILTER (WHERE NOT passed AND severity = 'CRITICAL') AS failed_critical FROM ({every}) AS r", *ALL_VIEWS)
    o["R33_R41_window_violations"] = views.sql("SELECT rule, count(*) AS violations, CAST(min(event_id) AS BIGINT) AS first_event, CAST(max(event_id) AS BIGINT) AS last_event FROM (" + " UNION ALL ".join(f"SELECT rule, CAST(event_id AS BIGINT) AS event_id FROM {FROM[w[0]]}" for w in operational.WINDOWS) + ") AS v GROUP BY rule", "employees", *(w[1] for w in operational.WINDOWS))
    for key, (needs, fn, text) in REFERENCE.items():
        q[key] = lambda spark, sf_dir, f=fn, n=needs: f(views.tables(spark, sf_dir, *n))
        o[key] = views.sql(text, *[n for n in needs if n in views.VIEWS])
    return q, o
