"""Gold facts with all keys of their dimensions, taken from one timeline of each employee's attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import history
from .lake import surrogate

#: Attributes that change over time.
ATTRIBUTES = ("department_id", "location_id", "manager_id", "role_id", "annual_salary")

#: Facts: table, own key, employee's key, date, {measure: SQL}.
FACTS = {
    "workforce": ("employees", "employee_id", "employee_id", "hire_date", {"annual_salary": "annual_salary", "active": "CAST(is_active AS INT)"}),
    "payroll": ("payroll", "payroll_id", "employee_id", "pay_period_start", {"gross_pay": "gross_pay", "net_pay": "net_pay", "deducted": "gross_pay - net_pay"}),
    "attendance": ("attendance", "attendance_id", "employee_id", "work_date", {"absent": "CAST(status = 'Absent' AS INT)", "worked_seconds": "CAST((clock_out_sec - clock_in_sec + 86400) % 86400 AS INT)"}),
    "performance": ("performance_reviews", "review_id", "employee_id", "review_date", {"overall_rating": "overall_rating", "productivity_score": "productivity_score", "quality_score": "quality_score"}),
    "recruitment": ("recruitment", "recruitment_id", "successful_employee_id", "hire_date", {"filled": "CAST(recruitment_status = 'Filled' AS INT)", "days_to_hire": "CAST(hire_date - opening_date AS INT)"}),
    "training": ("training", "training_id", "employee_id", "start_date", {"completed": "CAST(completion_date IS NOT NULL AS INT)", "days": "CAST(completion_date - start_date AS INT)"}),
    "surveys": ("employee_surveys", "survey_id", "employee_id", "survey_date", {"engagement_score": "engagement_score", "wellbeing_score": "wellbeing_score"}),
    "attrition": ("employee_exits", "exit_event_id", "employee_id", "exit_date", {"voluntary": "CAST(voluntary_flag AS INT)"}),
    "leave": ("leave_requests", "leave_id", "employee_id", "start_date", {"requested_days": "requested_days", "available_days": "available_days"}),
    "promotions": ("promotions", "promotion_id", "employee_id", "promotion_date", {"new_salary": "new_salary"}),
}
#: Dimensions whose keys only some facts have: name to (fact, business key).
OWN_KEYS = {"course": ("training", ("course_category",)), "exit_reason": ("attrition", ("exit_type", "exit_reason"))}


def employee_timeline(tables: dict[str, DataFrame]) -> DataFrame:
    """All ATTRIBUTES of each employee over time: those of the employee's row until transfers and promotions change them."""
    moves = {"department_id": "new_department_id", "location_id": "new_location_id", "manager_id": "new_manager_id"}
    raises = {"role_id": "new_role_id", "annual_salary": "new_salary"}
    return history.timeline(tables["employees"].select("employee_id", *ATTRIBUTES), "employee_id", {"moves": (tables["transfers"], "transfer_date", moves), "raises": (tables["promotions"], "promotion_date", raises)})


def employee_versions(tables: dict[str, DataFrame], timeline: DataFrame) -> DataFrame:
    """The employee dimension by version: names of the department, unit and role that an employee had then."""
    people = tables["employees"].select("employee_id", "employee_number", "hire_date")
    places = tables["departments"].select("department_id", "department_name", "business_unit")
    roles = tables["job_roles"].select("role_id", "role_name", "grade")
    rows = timeline.join(people, "employee_id", "left").join(places, "department_id", "left").join(roles, "role_id", "left")
    names = ("employee_number", "hire_date", "department_id", "department_name", "business_unit", "location_id", "manager_id", "role_id", "role_name", "grade", "annual_salary", "effective_from", "effective_to", "is_current", "version")
    return rows.select(surrogate("employee_id", "effective_from").alias("employee_version_key"), "employee_id", *names)


def star_fact(name: str, tables: dict[str, DataFrame], timeline: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """fact_id, a key for each of the seven dimensions, employee_version_key, date_key, salary_then and the measures.

    Department, location, manager and role are those of the fact's date. Keys are null where there is nothing: a course only
    trainings have, a reason only exits, a fact without an employee or a date has no version.
    """
    table, own, who, at, measures = FACTS[name]
    extra = {c for fact, columns in OWN_KEYS.values() if fact == name for c in columns}
    rows = tables[table].selectExpr(f"{own} AS fact_id", f"{who} AS employee_id", f"CAST({at} AS DATE) AS at", *sorted(extra), *[f"{e} AS m_{m}" for m, e in measures.items()])
    rows = history.as_of(rows, timeline, "employee_id", "at", (*ATTRIBUTES, "effective_from"), ("fact_id",), limit)
    key = lambda *c: F.when(F.coalesce(*c).isNotNull(), surrogate(*c))
    keys = {"employee": ("employee_id",), "department": ("department_id",), "location": ("location_id",), "job_role": ("role_id",), "manager": ("manager_id",)}
    found = [key(*c).alias(f"{n}_key") for n, c in keys.items()]
    found += [(key(*c) if fact == name else F.lit(None).cast("long")).alias(f"{n}_key") for n, (fact, c) in OWN_KEYS.items()]
    version = F.when(F.col("effective_from").isNotNull(), surrogate("employee_id", "effective_from"))
    return rows.select("fact_id", *found, version.alias("employee_version_key"), F.date_format("at", "yyyyMMdd").cast("int").alias("date_key"), F.col("annual_salary").alias("salary_then"), *[F.col(f"m_{m}").alias(m) for m in measures])
