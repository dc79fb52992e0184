"""Generic operators, scalar functions and HR calculations on the given tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as X
from .. import operators as ops
from ..plans import derive
from . import views
from .job_bindings import scratch

AS_OF = date(2024, 6, 30)
c = F.col


def upserted(t) -> tuple[DataFrame, DataFrame]:
    target = t["customer"].select(c("c_custkey").alias("k"), c("c_name").alias("name"), c("c_acctbal").alias("v")).where("k % 3 <> 0")
    source = t["customer"].select(c("c_custkey").alias("k"), c("c_name").alias("name"), F.when(c("c_custkey") % 5 == 0, c("c_acctbal") + 1).otherwise(c("c_acctbal")).alias("v")).where("k % 2 = 0")
    return ops.upsert(target, source, ["k"])


SCORES = ("productivity_score", "quality_score", "teamwork_score", "leadership_score")


def rates():
    return F.lit(0.01).cast("decimal(6,4)") * (c("promotion_id") % 20)


SALARY = "least(salary_band_max, greatest(salary_band_min, new_salary * (1 + CAST(0.01 * (promotion_id % 20) AS DECIMAL(6,4)))))"

#: key: (tables, query, SQL)
BOUND = {
    # Predicates
    "F1_is_null": (("employees",), lambda t: t["employees"].agg(F.count_if(c("manager_id").isNull()).alias("no_manager"), F.count_if(c("termination_date").isNotNull()).alias("ended")), "SELECT count(*) FILTER (WHERE manager_id IS NULL) AS no_manager, count(*) FILTER (WHERE termination_date IS NOT NULL) AS ended FROM employees"),
    "F2_compare_const": (("customer",), lambda t: t["customer"].where(c("c_acctbal") < 0).select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_acctbal < 0"),
    "F3_compare_columns": (("job_roles",), lambda t: t["job_roles"].where(c("salary_band_min") > c("salary_band_max")).select("role_id"), "SELECT role_id FROM job_roles WHERE salary_band_min > salary_band_max"),
    "F4_bool_is": (("employees",), lambda t: t["employees"].where(c("is_active")).select("employee_id"), "SELECT employee_id FROM employees WHERE is_active"),
    "F5_or_and_filter": (("customer",), lambda t: t["customer"].where((c("c_acctbal") < 0) | (c("c_nationkey") == 3)).where(c("c_custkey") > 10).select("c_custkey"), "SELECT c_custkey FROM customer WHERE (c_acctbal < 0 OR c_nationkey = 3) AND c_custkey > 10"),
    "F6_sql_not_equal": (("recruitment",), lambda t: t["recruitment"].where(ops.not_equal(c("successful_employee_id"), F.lit(5))).select("recruitment_id"), "SELECT recruitment_id FROM recruitment WHERE successful_employee_id <> 5"),
    "F7_null_safe_not_equal": (("recruitment",), lambda t: t["recruitment"].where(ops.differs(c("successful_employee_id"), F.lit(5))).select("recruitment_id"), "SELECT recruitment_id FROM recruitment WHERE successful_employee_id IS DISTINCT FROM 5"),
    "F8_not_between_chain": (("lineitem", "orders"), lambda t: t["lineitem"].join(t["orders"], c("l_orderkey") == c("o_orderkey")).where(ops.outside_window(c("l_shipdate"), c("l_shipdate"), c("o_orderdate"), F.lit("2001-01-01").cast("timestamp"))).groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n")), "SELECT l_linenumber, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT (o_orderdate <= l_shipdate AND l_shipdate <= TIMESTAMP '2001-01-01') GROUP BY 1"),
    "F9_in_range": (("part",), lambda t: t["part"].where(ops.outside_range(c("p_retailprice"), F.lit(950.0), F.lit(1500.0))).select("p_partkey"), "SELECT p_partkey FROM part WHERE p_retailprice < 950 OR p_retailprice > 1500"),
    "F10_project": (("part",), lambda t: t["part"].groupBy(c("p_brand").alias("brand")).agg(F.max("p_size").alias("largest")), "SELECT p_brand AS brand, max(p_size) AS largest FROM part GROUP BY 1"),
    "F11_in_set": (("orders",), lambda t: t["orders"].where(c("o_orderstatus").isin("F", "P")).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")), "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1"),
    # Joins
    "J1_semi_join_filtered": (("customer", "orders"), lambda t: ops.having(t["customer"], t["orders"].where("o_orderstatus = 'P'"), "c_custkey", "o_custkey").select("c_custkey", "c_name"), "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"),
    "J2_inner_join_dim": (("promotions", "job_roles"), lambda t: t["promotions"].join(t["job_roles"], c("new_role_id") == c("role_id")).select("promotion_id", "role_name"), "SELECT promotion_id, role_name FROM promotions JOIN job_roles ON new_role_id = role_id"),
    "J3_anti_join": (("documents", "labels"), lambda t: ops.orphans(t["documents"], t["labels"], "doc_id").select("doc_id"), "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "J4_fk_lookup_attr": (("attendance", "employees"), lambda t: ops.with_attributes(t["attendance"], t["employees"], "employee_id", "employee_id", ("hire_date",)).select("attendance_id", "hire_date"), "SELECT attendance_id, hire_date FROM attendance LEFT JOIN employees USING (employee_id)"),
    "J5_self_join_manager": (("employees",), lambda t: ops.with_attributes(t["employees"], t["employees"], "manager_id", "employee_id", ("employee_number",), "manager_").select("employee_id", "manager_employee_number"), "SELECT e.employee_id, m.employee_number AS manager_employee_number FROM employees AS e LEFT JOIN employees AS m ON e.manager_id = m.employee_id"),
    "J6_latest_join_current": (("transfers", "employees"), lambda t: ops.latest_per_key(t["transfers"], "employee_id", ("transfer_date", "transfer_id")).join(t["employees"].select("employee_id", "department_id"), "employee_id").select("employee_id", "department_id", "new_department_id"), "SELECT employee_id, department_id, new_department_id FROM (SELECT *, row_number() OVER (PARTITION BY employee_id ORDER BY transfer_date DESC, transfer_id DESC) AS k FROM transfers) JOIN employees USING (employee_id) WHERE k = 1"),
    "J7_full_outer_diff": (("documents", "labels"), lambda t: ops.compare_keys(t["documents"].where("doc_id % 7 <> 0"), t["labels"], "doc_id"), "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'left' WHEN d.doc_id IS NULL THEN 'right' ELSE 'both' END AS side FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 7 <> 0) AS d FULL JOIN (SELECT DISTINCT doc_id FROM labels) AS l ON d.doc_id = l.doc_id"),
    "J8_range_join_calendar": (("leave_requests",), lambda t: ops.explode_days(t["leave_requests"], c("start_date"), c("end_date")).groupBy("day").agg(F.count(F.lit(1)).alias("away")), "SELECT CAST(day AS DATE) AS day, count(*) AS away FROM (SELECT unnest(generate_series(CAST(start_date AS TIMESTAMP), CAST(end_date AS TIMESTAMP), INTERVAL 1 DAY)) AS day FROM leave_requests WHERE start_date <= end_date) GROUP BY 1"),
    # Aggregates
    "A1_count_rows": (("orders", "lineitem"), lambda t: ops.table_counts({"orders": t["orders"], "lineitem": t["lineitem"]}), "SELECT 'orders' AS table_name, count(*) AS row_count FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem"),
    "A2_group_count_having": (("lineitem",), lambda t: ops.duplicates(t["lineitem"], ["l_orderkey", "l_linenumber"]), "SELECT l_orderkey, l_linenumber, count(*) AS record_count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"),
    "A3_distinct_keys": (("promotions",), lambda t: t["promotions"].select("employee_id").distinct(), "SELECT DISTINCT employee_id FROM promotions"),
    "A4_count_where": (("recruitment",), lambda t: t["recruitment"].agg(F.count_if(c("recruitment_status") == "Filled").alias("filled")), "SELECT count(*) FILTER (WHERE recruitment_status = 'Filled') AS filled FROM recruitment"),
    "A5_scalar_compare": (("recruitment", "employees"), lambda t: ops.matches_total([(t["recruitment"], c("recruitment_status") == "Filled")], t["employees"], 2000), "SELECT * FROM (SELECT CAST(2000 AS BIGINT) AS base, (SELECT count(*) FROM recruitment WHERE recruitment_status = 'Filled') AS added, (SELECT count(*) FROM employees) AS total) WHERE base + added <> total"),
    "A6_counter_duplicates": (("exit_reasons",), lambda t: t["exit_reasons"].where(F.size("reasons") != F.size(F.array_distinct("reasons"))).select("exit_reason_name"), "SELECT exit_reason_name FROM exit_reasons WHERE len(reasons) <> len(list_distinct(reasons))"),
    "A7_null_count": (("training",), lambda t: ops.null_counts(t["training"], ("start_date", "completion_date", "employee_id")), "SELECT 'start_date' AS column_name, count(*) FILTER (WHERE start_date IS NULL) AS null_count FROM training UNION ALL SELECT 'completion_date', count(*) FILTER (WHERE completion_date IS NULL) FROM training UNION ALL SELECT 'employee_id', count(*) FILTER (WHERE employee_id IS NULL) FROM training"),
    "A8_distinct_values": (("orders",), lambda t: t["orders"].groupBy("o_orderstatus").agg(ops.single_value("o_orderstatus", "F").alias("only_f")), "SELECT o_orderstatus, o_orderstatus = 'F' AS only_f FROM orders GROUP BY 1"),
    "A9_sums_and_counts": (("part",), lambda t: t["part"].agg(F.sum("p_size").alias("bytes"), F.count_if(c("p_size") > 25).alias("large"), F.count_if(c("p_size") <= 25).alias("small")), "SELECT CAST(sum(p_size) AS BIGINT) AS bytes, count(*) FILTER (WHERE p_size > 25) AS large, count(*) FILTER (WHERE p_size <= 25) AS small FROM part"),
    "A10_max_per_group": (("events",), lambda t: t["events"].groupBy("user_id").agg(F.max("ts").alias("last")), "SELECT user_id, max(ts) AS last FROM events GROUP BY 1"),
    "N1_latest_per_key": (("events",), lambda t: ops.latest_per_key(t["events"], "user_id", ("ts", "event_id")).select("user_id", "event_id", "event_type"), "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1"),
    "T1_order_desc_first": (("events",), lambda t: t["events"].orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select("event_id"), "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1"),
    "T2_max_by_key": (("orders",), lambda t: t["orders"].groupBy("o_orderstatus").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest")), "SELECT o_orderstatus, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest FROM orders GROUP BY 1"),
    "T3_sorted_list": (("nation",), lambda t: t["nation"].groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names")), "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1"),
    "U1_set_difference": (("documents", "labels"), lambda t: ops.missing_rows(t["documents"].select("doc_id"), t["labels"].select("doc_id")), "SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels"),
    "U2_set_intersection": (("exit_reasons",), lambda t: t["exit_reasons"].select("exit_reason_name", F.size(F.array_intersect("reasons", F.array(F.lit("b"), F.lit(" ")))).alias("held")).where("held > 0"), "SELECT exit_reason_name, CAST(len(list_intersect(reasons, ['b', ' '])) AS INT) AS held FROM exit_reasons WHERE len(list_intersect(reasons, ['b', ' '])) > 0"),
    "U3_union_results": (("customer", "supplier"), lambda t: ops.union_all([t["customer"].select(c("c_name").alias("name")), t["supplier"].select(c("s_name").alias("name"))]), "SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier"),
    # Scalars
    "X1_blank": (("departments",), lambda t: t["departments"].select("department_id", X.is_blank(c("cost_center")).alias("blank")), "SELECT department_id, trim(cost_center) = '' AS blank FROM departments"),
    "X2_code": (("exit_reasons",), lambda t: t["exit_reasons"].select("exit_reason_name", X.is_code(c("exit_reason_code")).alias("ok")), "SELECT exit_reason_name, regexp_full_match(exit_reason_code, '[A-Z0-9_]*[A-Z0-9][A-Z0-9_]*') AS ok FROM exit_reasons"),
    "X3_type_tests": (("events",), lambda t: t["events"].select("event_id", F.get_json_object("props", "$.k").try_cast("int").isNotNull().alias("whole"), c("event_type").try_cast("double").isNotNull().alias("number")), "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) IS NOT NULL AS whole, TRY_CAST(event_type AS DOUBLE) IS NOT NULL AS number FROM events"),
    "X4_month_day": (("public_holidays",), lambda t: t["public_holidays"].select("holiday_code", X.is_month_day(c("month_day")).alias("ok")), "SELECT holiday_code, try_strptime('1900-' || month_day, '%Y-%m-%d') IS NOT NULL AS ok FROM public_holidays"),
    "X5_country_code": (("public_holidays",), lambda t: t["public_holidays"].select("holiday_code", X.is_country_code(c("country_code")).alias("ok")), "SELECT holiday_code, length(trim(country_code)) = 2 AND country_code = upper(country_code) AS ok FROM public_holidays"),
    "X6_round_half_even": (("part",), lambda t: t["part"].select("p_partkey", X.round_half_even((c("p_partkey").cast("decimal(12,3)") / 8).cast("decimal(12,3)"), 2).cast("decimal(12,2)").alias("v")), "SELECT p_partkey, CAST(round_even(CAST(p_partkey AS DOUBLE) / 8, 2) AS DECIMAL(12,2)) AS v FROM part"),
    "X7_round_half_up": (("part",), lambda t: t["part"].select("p_partkey", X.round_half_up((c("p_partkey").cast("decimal(12,3)") / 8).cast("decimal(12,3)"), 2).cast("decimal(12,2)").alias("v")), "SELECT p_partkey, CAST(round(CAST(p_partkey AS DECIMAL(15,3)) * 0.125, 2) AS DECIMAL(12,2)) AS v FROM part"),
    "X8_X9_open_end": (("employees",), lambda t: derive.employment_window(t["employees"], AS_OF), "SELECT employee_id, hire_date AS window_start, coalesce(termination_date, DATE '2024-06-30') AS window_end FROM employees"),
    "X10_path_parts": (("orders",), lambda t: t["orders"].select("o_orderkey", X.path_part(F.concat(F.lit("raw/batch_id="), c("o_orderstatus"), F.lit("/extraction_id="), c("o_custkey").cast("string"), F.lit("/part-0.parquet")), "extraction_id").alias("part"), X.join_path(F.lit("/a/"), c("o_orderstatus")).alias("joined")), "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS part, 'a/' || o_orderstatus AS joined FROM orders"),
    "X11_prefix_suffix": (("part",), lambda t: t["part"].where(c("p_type").startswith("ECO") | c("p_name").endswith("ring")).select("p_partkey"), "SELECT p_partkey FROM part WHERE p_type LIKE 'ECO%' OR p_name LIKE '%ring'"),
    "X12_month_day_of": (("orders",), lambda t: t["orders"].select("o_orderkey", X.month_day(c("o_orderdate")).alias("md")), "SELECT o_orderkey, strftime(o_orderdate, '%m-%d') AS md FROM orders"),
    "X13_weekend": (("orders",), lambda t: t["orders"].select("o_orderkey", X.is_weekend(c("o_orderdate")).alias("weekend")), "SELECT o_orderkey, isodow(o_orderdate) >= 6 AS weekend FROM orders"),
    "X14_only_alnum": (("customer",), lambda t: t["customer"].select("c_custkey", X.only_alnum(c("c_name")).alias("v")), "SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS v FROM customer"),
    "X15_clamp": (("customer",), lambda t: t["customer"].select("c_custkey", X.clamp(c("c_acctbal"), 0.0, 5000.0).alias("v")), "SELECT c_custkey, greatest(0.0::DOUBLE, least(5000.0::DOUBLE, c_acctbal)) AS v FROM customer"),
    # Upsert
    "K9_upsert": (("customer",), lambda t: upserted(t)[0], "SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS v FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0"),
    "K9_upsert_log": (("customer",), lambda t: upserted(t)[1], "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'created' WHEN c_custkey % 5 = 0 THEN 'updated' ELSE 'unchanged' END AS action FROM customer WHERE c_custkey % 2 = 0"),
    # HR calculations
    "W01_employment_window": (("employees",), lambda t: derive.employment_window(t["employees"], AS_OF), "SELECT employee_id, hire_date AS window_start, coalesce(termination_date, DATE '2024-06-30') AS window_end FROM employees"),
    "W02_month_spine": (("orders",), lambda t: derive.month_spine(t["orders"], "o_orderdate"), "SELECT CAST(m AS DATE) AS month_start, last_day(CAST(m AS DATE)) AS month_end FROM (SELECT unnest(generate_series(CAST(make_date(CAST(year(d) - 3 AS INT), 1, 1) AS TIMESTAMP), CAST(d AS TIMESTAMP), INTERVAL 1 MONTH)) AS m FROM (SELECT CAST(max(o_orderdate) AS DATE) AS d FROM orders))"),
    "W03_prorated_pay": (("employees",), lambda t: derive.prorated_pay(t["employees"], date(2019, 6, 30)).groupBy("month_start").agg(F.count(F.lit(1)).alias("people"), F.sum("days_employed").alias("days"), F.sum("payable").cast("decimal(18,2)").alias("payable")), "WITH m AS (SELECT CAST(m AS DATE) AS month_start, last_day(CAST(m AS DATE)) AS month_end FROM (SELECT unnest(generate_series(TIMESTAMP '2016-01-01', TIMESTAMP '2019-06-30', INTERVAL 1 MONTH)) AS m)), d AS (SELECT month_start, annual_salary, date_diff('day', greatest(hire_date, month_start), least(month_end, coalesce(termination_date, DATE '2019-06-30'), DATE '2019-06-30')) + 1 AS days, day(month_end) AS len FROM employees JOIN m ON hire_date <= month_end AND coalesce(termination_date, DATE '2019-06-30') >= month_start) SELECT month_start, count(*) AS people, CAST(sum(days) AS BIGINT) AS days, CAST(sum(sign(annual_salary) * ((CAST(abs(annual_salary) * 100 AS HUGEINT) * days * 2 + 12 * len) // (24 * len))) / 100.0 AS DECIMAL(18,2)) AS payable FROM d WHERE days > 0 GROUP BY 1"),
    "W04_overtime_pay": (("payroll", "employees"), lambda t: t["payroll"].join(t["employees"], "employee_id").groupBy("employee_id").agg(F.round(F.sum(derive.overtime_pay(c("payroll_id") % 9, c("base_salary"), (c("annual_salary") / 12).cast("double"), c("annual_salary"))), 0).alias("pay")), "SELECT employee_id, round(sum(CASE WHEN annual_salary = 0 THEN 1.0 ELSE CAST(base_salary AS DOUBLE) / (CAST(annual_salary AS DOUBLE) / 12) END * (payroll_id % 9) * (CAST(annual_salary AS DOUBLE) / 52 / 37.5) * 1.5), 0) AS pay FROM payroll JOIN employees USING (employee_id) GROUP BY 1"),
    "W05_payroll_lines": (("payroll",), lambda t: derive.payroll_lines(t["payroll"].select("payroll_id", "pay_period_start", "base_salary", (c("base_salary") * 0).cast("decimal(12,2)").alias("overtime_pay"))).groupBy("pay_period_start").agg(*[F.sum(x).cast("decimal(18,2)").alias(x) for x in ("bonus", "pension_contribution", "tax_amount", "deductions", "gross_pay", "net_pay")]), "SELECT pay_period_start, " + ", ".join(f"CAST(sum(round(CAST(base_salary AS DECIMAL(18,6)) * CAST({r} AS DECIMAL(4,2)), 2)) AS DECIMAL(18,2)) AS {n}" for n, r in (("bonus", 0.03), ("pension_contribution", 0.05), ("tax_amount", 0.2), ("deductions", 0.25), ("gross_pay", 1.03), ("net_pay", 0.78))) + " FROM payroll GROUP BY 1"),
    "W06_working_days": (("leave_requests", "public_holidays"), lambda t: derive.working_days(t["leave_requests"], t["public_holidays"], "start_date", "end_date").select("leave_id", "working_days"), "WITH d AS (SELECT leave_id, unnest(generate_series(CAST(start_date AS TIMESTAMP), CAST(end_date AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM leave_requests WHERE start_date <= end_date), n AS (SELECT leave_id, count(*) AS n FROM d WHERE isodow(d) < 6 AND strftime(d, '%m-%d') NOT IN (SELECT month_day FROM public_holidays WHERE active) GROUP BY 1) SELECT leave_id, CAST(coalesce(n, 0) AS INT) AS working_days FROM leave_requests LEFT JOIN n USING (leave_id)"),
    "W07_W08_hours": (("attendance",), lambda t: t["attendance"].select("attendance_id", derive.hours_worked(c("clock_in_sec"), c("clock_out_sec")).alias("hours")).withColumn("overtime", derive.overtime_hours(c("hours"))), "SELECT attendance_id, h AS hours, CAST(greatest(h - 7.5, 0) AS DECIMAL(5,2)) AS overtime FROM (SELECT attendance_id, CAST(coalesce(round_even(((clock_out_sec - clock_in_sec + 86400) % 86400) / 3600.0, 2), 0) AS DECIMAL(5,2)) AS h FROM attendance)"),
    "W09_overall_rating": (("performance_reviews",), lambda t: t["performance_reviews"].select("review_id", derive.overall_rating(*map(c, SCORES)).alias("overall"), derive.promotion_recommended(derive.overall_rating(*map(c, SCORES))).alias("recommended")), "SELECT review_id, CAST(o AS DECIMAL(3,2)) AS overall, o >= 4.5 AS recommended FROM (SELECT review_id, CASE WHEN leadership_score IS NULL THEN (m + 1) // 3 ELSE CASE WHEN m % 4 < 2 THEN m // 4 WHEN m % 4 > 2 THEN m // 4 + 1 ELSE m // 4 + (m // 4) % 2 END END / 100.0 AS o FROM (SELECT *, CAST(100 * (productivity_score + quality_score + teamwork_score + coalesce(leadership_score, 0)) AS INT) AS m FROM performance_reviews))"),
    "W10_review_focus": (("performance_reviews",), lambda t: t["performance_reviews"].select("review_id", derive.review_focus(*map(c, SCORES)).alias("f")).select("review_id", "f.*"), "SELECT review_id, CASE hi WHEN productivity_score THEN 'productivity' WHEN quality_score THEN 'quality' WHEN teamwork_score THEN 'teamwork' ELSE 'leadership' END AS strongest, w AS weakest, CASE WHEN hi - lo <= 0.30 THEN 'balanced' WHEN lo >= 4 THEN 'strategic' ELSE w END AS focus FROM (SELECT *, CASE lo WHEN productivity_score THEN 'productivity' WHEN quality_score THEN 'quality' WHEN teamwork_score THEN 'teamwork' ELSE 'leadership' END AS w FROM (SELECT *, greatest(productivity_score, quality_score, teamwork_score, leadership_score) AS hi, least(productivity_score, quality_score, teamwork_score, leadership_score) AS lo FROM performance_reviews))"),
    "W12_salary_in_band": (("promotions", "job_roles"), lambda t: t["promotions"].join(t["job_roles"], c("new_role_id") == c("role_id")).select("promotion_id", derive.salary_in_band(c("new_salary"), rates(), c("salary_band_min"), c("salary_band_max"))["new_salary"].alias("v")), f"SELECT promotion_id, CAST((x // 10000 + CASE WHEN x % 10000 > 5000 OR (x % 10000 = 5000 AND (x // 10000) % 2 = 1) THEN 1 ELSE 0 END) / 100.0 AS DECIMAL(12,2)) AS v FROM (SELECT promotion_id, CAST(({SALARY}) * 1000000 AS HUGEINT) AS x FROM promotions JOIN job_roles ON new_role_id = role_id)"),
    "W13_eligible_roles": (("employees", "job_roles"), lambda t: derive.eligible_roles(t["employees"], t["job_roles"]), "WITH r AS (SELECT role_id, CASE grade WHEN 'Associate' THEN 1 WHEN 'Senior Associate' THEN 2 ELSE 3 END AS g FROM job_roles) SELECT employee_id, e.role_id, n.role_id AS new_role_id FROM employees AS e JOIN r ON r.role_id = e.role_id JOIN r AS n ON n.g > r.g"),
    "W14_increase_band": (("part",), lambda t: t["part"].select("p_partkey", derive.increase_band(c("p_size")).alias("band")), "SELECT p_partkey, CASE WHEN p_size >= 15 THEN 'high' WHEN p_size >= 10 THEN 'moderate' ELSE 'progression' END AS band FROM part"),
    "W15_apply_events": (("employees", "promotions", "transfers", "employee_exits", "job_roles"), lambda t: derive.apply_events(t["employees"], t["promotions"], t["transfers"], t["employee_exits"], t["job_roles"]).select("employee_id", "role_id", "annual_salary", "is_manager", "department_id", "manager_id", "termination_date", "is_active"), "WITH p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY employee_id ORDER BY promotion_date DESC, promotion_id DESC) AS k FROM promotions) WHERE k = 1), m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY employee_id ORDER BY transfer_date DESC, transfer_id DESC) AS k FROM transfers) WHERE k = 1) SELECT e.employee_id, coalesce(p.new_role_id, e.role_id) AS role_id, coalesce(p.new_salary, e.annual_salary) AS annual_salary, coalesce(r.grade = 'Manager', e.is_manager) AS is_manager, coalesce(m.new_department_id, e.department_id) AS department_id, CASE WHEN m.employee_id IS NULL THEN e.manager_id ELSE m.new_manager_id END AS manager_id, coalesce(x.exit_date, e.termination_date) AS termination_date, CASE WHEN x.employee_id IS NULL THEN e.is_active ELSE false END AS is_active FROM employees AS e LEFT JOIN p USING (employee_id) LEFT JOIN m ON m.employee_id = e.employee_id LEFT JOIN employee_exits AS x ON x.employee_id = e.employee_id LEFT JOIN job_roles AS r ON r.role_id = p.new_role_id"),
    "W17_sentiment": (("employee_surveys",), lambda t: t["employee_surveys"].select("survey_id", derive.survey_sentiment(c("satisfaction_score")).alias("label"), derive.feedback_tone(c("satisfaction_score")).alias("tone")), "SELECT survey_id, CASE WHEN satisfaction_score >= 3.5 THEN 'Positive' ELSE 'Neutral' END AS label, CASE WHEN satisfaction_score >= 4.5 THEN 'high' WHEN satisfaction_score >= 3.5 THEN 'positive' ELSE 'development' END AS tone FROM employee_surveys"),
    "W18_survey_theme": (("employee_surveys",), lambda t: t["employee_surveys"].select("survey_id", derive.survey_theme(*(c(x) for x in ("career_growth_score", "manager_support_score", "wellbeing_score", "work_life_balance_score", "engagement_score", "satisfaction_score"))).alias("theme")), "SELECT survey_id, CASE WHEN career_growth_score < 3 THEN 'growth' WHEN manager_support_score < 3 THEN 'manager' WHEN wellbeing_score < 3 OR work_life_balance_score < 3 THEN 'wellbeing' WHEN (engagement_score + satisfaction_score) / 2 >= 4 THEN 'positive' WHEN (engagement_score + satisfaction_score) / 2 >= 3.25 THEN 'neutral' ELSE 'development' END AS theme FROM employee_surveys"),
    "W19_unique_emails": (("recruitment",), lambda t: derive.unique_emails(t["recruitment"], scratch(t["recruitment"].sparkSession), "candidate_name", "recruitment_id").select("recruitment_id", "first_name", "last_name", "email"), "WITH b AS (SELECT recruitment_id, string_split(candidate_name, ' ') AS w FROM recruitment), n AS (SELECT recruitment_id, w[1] AS first_name, w[-1] AS last_name, lower(w[1] || '.' || w[-1]) AS base, row_number() OVER (PARTITION BY lower(w[1] || '.' || w[-1]) ORDER BY recruitment_id) AS k FROM b) SELECT recruitment_id, first_name, last_name, base || CASE WHEN k > 1 THEN CAST(k AS VARCHAR) ELSE '' END || '@example.com' AS email FROM n"),
    "W20_pick_manager": (("employees",), lambda t: derive.pick_manager(t["employees"]), "WITH m AS (SELECT employee_id AS mid, department_id AS d FROM employees WHERE is_manager AND is_active) SELECT e.employee_id, coalesce((SELECT min(mid) FROM m WHERE m.d = e.department_id AND mid <> e.employee_id), (SELECT min(mid) FROM m WHERE mid <> e.employee_id)) AS manager_id FROM employees AS e"),
    "W21_leave_days": (("leave_requests",), lambda t: t["leave_requests"].select("leave_id", derive.leave_days(c("requested_days"), c("available_days")).alias("days")), "SELECT leave_id, greatest(least(requested_days, available_days), 0) AS days FROM leave_requests"),
    "W22_time_to_hire": (("recruitment",), lambda t: derive.time_to_hire(t["recruitment"]).select("recruitment_id", "closing_date", "days_to_hire"), "SELECT recruitment_id, least(closing_date, hire_date) AS closing_date, CAST(date_diff('day', opening_date, hire_date) AS INT) AS days_to_hire FROM recruitment"),
    "W23_hierarchy_levels": (("employees",), lambda t: derive.hierarchy_levels(t["employees"], scratch(t["employees"].sparkSession)), "WITH RECURSIVE h AS (SELECT employee_id, 0 AS level FROM employees WHERE manager_id IS NULL UNION ALL SELECT e.employee_id, h.level + 1 FROM employees AS e JOIN h ON e.manager_id = h.employee_id) SELECT employee_id, CAST(level AS INT) AS level FROM h"),
    "W24_unknown_values": (("training", "orders"), lambda t: derive.unknown_values(t["training"], "course_category", t["orders"].select(c("o_orderstatus").alias("category")).distinct(), "category").groupBy("course_category").agg(F.count(F.lit(1)).alias("n")), "SELECT course_category, count(*) AS n FROM training WHERE course_category NOT IN (SELECT o_orderstatus FROM orders) GROUP BY 1"),
    "W25_hires_to_employees": (("recruitment", "job_roles", "employees"), lambda t: derive.hires_to_employees(t["recruitment"], t["job_roles"], t["employees"], scratch(t["recruitment"].sparkSession)).select("recruitment_id", "employee_number", "is_manager", "currency", "manager_id"), "WITH m AS (SELECT department_id, min(employee_id) AS own FROM employees WHERE is_manager AND is_active GROUP BY 1) SELECT recruitment_id, 'EMP' || lpad(CAST(recruitment_id + 1 AS VARCHAR), 6, '0') AS employee_number, coalesce(grade = 'Manager', false) AS is_manager, 'GBP' AS currency, coalesce(own, (SELECT min(own) FROM m)) AS manager_id FROM recruitment LEFT JOIN job_roles USING (role_id) LEFT JOIN m USING (department_id) WHERE recruitment_status = 'Filled'"),
    "W26_transfer_options": (("employees", "locations"), lambda t: derive.transfer_options(t["employees"], t["locations"], "location_id", "location_id"), "SELECT employee_id, e.location_id, l.location_id AS new_location_id FROM employees AS e JOIN locations AS l ON e.location_id IS DISTINCT FROM l.location_id"),
    "W26_department_options": (("employees", "departments"), lambda t: derive.transfer_options(t["employees"], t["departments"], "department_id", "department_id"), "SELECT employee_id, e.department_id, d.department_id AS new_department_id FROM employees AS e JOIN departments AS d ON e.department_id IS DISTINCT FROM d.department_id"),
    "W26_other_manager": (("employees",), lambda t: derive.other_manager(t["employees"]), "SELECT e.employee_id, (SELECT min(m.employee_id) FROM employees AS m WHERE m.is_manager AND m.is_active AND m.employee_id <> e.employee_id AND m.employee_id IS DISTINCT FROM e.manager_id) AS new_manager_id FROM employees AS e"),
    "W27_eligibility": (("employees",), lambda t: derive.eligible(t["employees"], F.lit(date(2018, 6, 30)), 180).select("employee_id"), "SELECT employee_id FROM employees WHERE date_diff('day', hire_date, DATE '2018-06-30') >= 180 AND (termination_date IS NULL OR DATE '2018-06-30' <= termination_date) AND NOT is_manager"),
}


def bindings() -> tuple[dict, dict]:
    q, o = {}, {}
    for key, (needs, fn, text) in BOUND.items():
        q[key] = lambda spark, sf_dir, f=fn, n=needs: f(views.tables(spark, sf_dir, *n))
        o[key] = views.sql(text, *[n for n in needs if n in views.VIEWS])
    return q, o
