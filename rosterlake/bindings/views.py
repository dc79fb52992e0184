"""HR-shaped views over the given tables. The same text runs in Spark SQL and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations", "labels")

VIEWS = {
    "employees": """SELECT CAST(c_custkey AS INT) AS employee_id, c_name AS employee_number,
       lower(replace(c_name, '#', '.')) || '@example.com' AS email,
       DATE '2016-01-01' + CAST(c_custkey % 1500 AS INT) AS hire_date,
       CASE WHEN c_custkey % 20 = 7 THEN DATE '2016-01-01' + CAST(c_custkey % 1500 + 400 AS INT) END AS termination_date,
       CASE WHEN c_custkey % 20 = 7 THEN 'Terminated' ELSE 'Active' END AS employment_status,
       CAST(c_acctbal * 10 AS DECIMAL(12,2)) AS annual_salary,
       CAST(c_nationkey AS INT) AS department_id, CAST(c_custkey % 11 AS INT) AS role_id,
       CAST(c_nationkey % 5 AS INT) AS location_id,
       CASE WHEN c_custkey = 0 THEN NULL ELSE CAST(floor((c_custkey - 1) / 8.0) AS INT) END AS manager_id,
       c_custkey % 8 = 0 AS is_manager,
       (c_custkey % 20 <> 7 OR c_custkey % 60 = 7) AS is_active
       FROM customer""",
    "job_roles": """SELECT CAST(n_nationkey AS INT) AS role_id, n_name AS role_name,
       CASE n_nationkey % 3 WHEN 0 THEN 'Associate' WHEN 1 THEN 'Senior Associate' ELSE 'Manager' END AS grade,
       CAST(20000 + 5000 * n_nationkey AS DECIMAL(12,2)) AS salary_band_min,
       CAST(CASE WHEN n_nationkey = 9 THEN 10000 ELSE 90000 + 10000 * n_nationkey END AS DECIMAL(12,2)) AS salary_band_max
       FROM nation WHERE n_nationkey < 10""",
    "employee_exits": """SELECT CAST(c_custkey AS INT) AS exit_event_id, CAST(c_custkey AS INT) AS employee_id,
       DATE '2016-01-01' + CAST(c_custkey % 1500 + CASE WHEN c_custkey % 100 = 7 THEN 401 ELSE 400 END AS INT) AS exit_date,
       CASE WHEN c_custkey % 40 = 7 THEN 'Resignation' ELSE 'Redundancy' END AS exit_type,
       CASE WHEN c_custkey % 40 = 7 THEN 'Career' ELSE 'Cost' END AS exit_reason,
       c_custkey % 40 = 7 AS voluntary_flag
       FROM customer WHERE c_custkey % 20 = 7 AND c_custkey % 80 <> 27""",
    "exit_interviews": """SELECT CAST(c_custkey AS INT) AS exit_interview_id, CAST(c_custkey AS INT) AS employee_id,
       DATE '2016-01-01' + CAST(c_custkey % 1500 + 400 AS INT) AS termination_date,
       CASE WHEN c_custkey % 200 = 7 THEN NULL WHEN c_custkey % 40 = 7 THEN 'Career' ELSE 'Cost' END AS exit_reason,
       c_custkey % 40 = 7 AS voluntary_exit
       FROM customer WHERE c_custkey % 20 = 7 OR c_custkey % 130 = 1""",
    "promotions": """SELECT CAST(o_orderkey AS INT) AS promotion_id, CAST(o_custkey AS INT) AS employee_id,
       CAST(o_orderkey % 10 AS INT) AS new_role_id, CAST(o_orderdate AS DATE) AS promotion_date,
       CAST(o_totalprice AS DECIMAL(12,2)) AS new_salary
       FROM orders WHERE o_orderstatus = 'P'""",
    "transfers": """SELECT CAST(o_orderkey AS INT) AS transfer_id, CAST(o_custkey AS INT) AS employee_id,
       CAST(o_orderkey % 25 AS INT) AS new_department_id, CAST(o_orderkey % 5 AS INT) AS new_location_id,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(floor((o_custkey - 1) / 8.0) AS INT) END AS new_manager_id,
       CAST(o_orderdate AS DATE) AS transfer_date
       FROM orders WHERE o_orderstatus = 'F'""",
    "leave_requests": """SELECT CAST(o_orderkey AS INT) AS leave_id, CAST(o_custkey AS INT) AS employee_id,
       CAST(o_orderdate AS DATE) AS start_date, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 15 - 2 AS INT) AS end_date,
       CAST(o_orderkey % 15 AS INT) AS requested_days, CAST(o_orderkey % 9 - 1 AS INT) AS available_days
       FROM orders WHERE o_orderstatus = 'O'""",
    "attendance": """SELECT CAST(event_id AS INT) AS attendance_id, CAST(user_id AS INT) AS employee_id, CAST(ts AS DATE) AS work_date,
       CASE event_type WHEN 'error' THEN 'Absent' WHEN 'click' THEN 'Remote' ELSE 'Present' END AS status,
       CASE WHEN event_type <> 'error' THEN CAST(hour(ts) * 3600 + minute(ts) * 60 AS INT) END AS clock_in_sec,
       CASE WHEN event_type <> 'error' THEN CAST((hour(ts) * 3600 + minute(ts) * 60 + 18000 + (event_id % 300) * 60) % 86400 AS INT) END AS clock_out_sec
       FROM events""",
    "payroll": """SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS payroll_id, CAST(l_orderkey % 2000 AS INT) AS employee_id, CAST(l_shipdate AS DATE) AS pay_period_start,
       CAST(l_shipdate AS DATE) + CAST(29 AS INT) AS pay_period_end,
       CAST(l_extendedprice AS DECIMAL(12,2)) AS base_salary, CAST(l_extendedprice AS DECIMAL(12,2)) AS gross_pay,
       CAST(CASE WHEN l_linenumber = 7 THEN -1 ELSE 1 END * l_extendedprice AS DECIMAL(12,2)) AS net_pay
       FROM lineitem""",
    "training": """SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS training_id, CAST(l_orderkey % 2000 AS INT) AS employee_id,
       CASE WHEN l_linenumber <> 3 THEN CAST(l_shipdate AS DATE) END AS start_date,
       CASE WHEN l_linenumber <> 2 THEN CAST(l_shipdate AS DATE) + CAST(20 AS INT) END AS completion_date,
       l_returnflag AS course_category
       FROM lineitem""",
    "performance_reviews": """SELECT CAST(event_id AS INT) AS review_id, CAST(user_id AS INT) AS employee_id, CAST(ts AS DATE) AS review_date,
       CAST(1 + (event_id % 9) * 0.5 AS DECIMAL(3,2)) AS productivity_score, CAST(1 + (event_id % 7) * 0.55 AS DECIMAL(3,2)) AS quality_score,
       CAST(3 + (event_id % 5) * 0.5 AS DECIMAL(3,2)) AS teamwork_score,
       CASE WHEN event_id % 4 = 0 THEN CAST(1 + (event_id % 11) * 0.4 AS DECIMAL(3,2)) END AS leadership_score,
       CAST((event_id % 56) * 0.1 AS DECIMAL(3,2)) AS overall_rating
       FROM events WHERE event_type = 'view' OR event_id % 3 = 0""",
    "employee_surveys": """SELECT CAST(event_id AS INT) AS survey_id, CAST(user_id AS INT) AS employee_id, CAST(ts AS DATE) AS survey_date,
       CAST(1 + (event_id % 5) AS DECIMAL(4,2)) AS engagement_score, CAST(1 + (event_id % 9) * 0.5 AS DECIMAL(4,2)) AS satisfaction_score,
       CAST(2 + (event_id % 4) AS DECIMAL(4,2)) AS wellbeing_score, CAST(2 + (event_id % 3) AS DECIMAL(4,2)) AS manager_support_score,
       CAST(2 + (event_id % 6) * 0.5 AS DECIMAL(4,2)) AS work_life_balance_score, CAST(2 + (event_id % 13) * 0.25 AS DECIMAL(4,2)) AS career_growth_score
       FROM events WHERE event_id % 2 = 0""",
    "manager_feedback": """SELECT CAST(event_id AS INT) AS feedback_id, CAST(user_id AS INT) AS employee_id, CAST(ts AS DATE) AS feedback_date,
       CAST(1 + (event_id % 17) * 0.25 AS DECIMAL(4,2)) AS feedback_score
       FROM events WHERE event_id % 5 = 1""",
    "recruitment": """SELECT CAST(p_partkey AS INT) AS recruitment_id, CAST(p_partkey % 25 AS INT) AS department_id, CAST(p_partkey % 11 AS INT) AS role_id, p_name AS candidate_name,
       CASE WHEN p_size % 4 = 0 THEN 'Open' ELSE 'Filled' END AS recruitment_status,
       CASE WHEN p_size % 5 <> 3 THEN CAST(p_partkey AS INT) END AS successful_employee_id,
       DATE '2016-01-01' + CAST(p_partkey % 1499 AS INT) AS hire_date,
       DATE '2016-01-01' + CAST(p_partkey % 1499 - p_size AS INT) AS opening_date,
       DATE '2016-01-01' + CAST(p_partkey % 1499 + p_size - 20 AS INT) AS closing_date
       FROM part""",
    "departments": """SELECT CAST(n_nationkey AS INT) AS department_id, n_name AS department_name,
       CASE WHEN n_nationkey % 12 = 5 THEN 'Nowhere' ELSE r_name END AS business_unit, CASE WHEN n_nationkey % 9 = 4 THEN '  ' ELSE 'CC' || CAST(n_nationkey AS VARCHAR(10)) END AS cost_center
       FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 3""",
    "business_units": "SELECT r_name AS unit_name, CASE WHEN r_regionkey = 2 THEN NULL ELSE r_name || ' unit' END AS description FROM region",
    "locations": "SELECT DISTINCT CAST(n_nationkey % 5 AS INT) AS location_id FROM nation WHERE n_nationkey % 5 <> 4",
    "public_holidays": """SELECT 'H_' || CAST(n_nationkey AS VARCHAR(10)) AS holiday_code, n_name AS holiday_name,
       CASE n_nationkey % 5 WHEN 0 THEN '12-25' WHEN 1 THEN '02-29' WHEN 2 THEN '01-01' WHEN 3 THEN '13-01' ELSE '05-06' END AS month_day,
       CASE WHEN n_nationkey % 7 = 0 THEN 'gb' WHEN n_nationkey % 7 = 1 THEN 'GBR' ELSE 'GB' END AS country_code, n_nationkey % 2 = 0 AS active
       FROM nation""",
    "attendance_statuses": """SELECT upper(n_name) AS attendance_status_code, CASE WHEN n_nationkey < 2 THEN 'Absent' ELSE n_name END AS attendance_status_name,
       CAST(n_nationkey - 3 AS INT) AS weight, n_nationkey % 2 = 0 AS requires_clock_times, n_nationkey % 3 = 0 AS absence_reason_required FROM nation""",
    "exit_reasons": """SELECT CASE WHEN n_nationkey % 6 = 0 THEN lower(n_name) WHEN n_nationkey % 6 = 1 THEN '_' ELSE n_name END AS exit_reason_code, n_name AS exit_reason_name,
       n_nationkey % 2 = 0 AS voluntary, CAST(n_nationkey - 1 AS INT) AS weight,
       CASE n_nationkey % 4 WHEN 0 THEN array('a', 'a') WHEN 1 THEN array('a', ' ') WHEN 2 THEN array('a', 'b') END AS reasons FROM nation""",
}


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The given base tables and views."""
    for t in BASE:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return {n: spark.sql(VIEWS[n]) if n in VIEWS else spark.table(n) for n in (names or (*BASE, *VIEWS))}


def sql(body: str, *names: str) -> str:
    """body with the named views as common table expressions, in DuckDB's spelling."""
    ctes = ", ".join(f"{n} AS ({VIEWS[n].replace('array(', 'list_value(')})" for n in names)
    if not ctes:
        return body
    if body.lstrip().upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {body.lstrip()[len('WITH RECURSIVE'):]}"
    return f"WITH {ctes}, {body.lstrip()[len('WITH'):]}" if body.lstrip().upper().startswith("WITH ") else f"WITH {ctes} {body}"
