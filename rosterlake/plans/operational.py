"""The workforce rules. Names and order are fixed values: reports are compared by them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import round_half_even
from ..operators import differs, duplicates, having, latest_per_key, matches_total, not_equal, orphans, outside_range, outside_window, union_all, with_attributes
from .rules import Rule, Tables

INITIAL_WORKFORCE = 2000
#: Fact tables with their key and the dates that must lie in the employment window.
WINDOWS = (
    ("R33", "attendance", "attendance_id", "work_date", "work_date"),
    ("R34", "payroll", "payroll_id", "pay_period_start", "pay_period_end"),
    ("R35", "leave_requests", "leave_id", "start_date", "end_date"),
    ("R36", "training", "training_id", "start_date", "completion_date"),
    ("R37", "performance_reviews", "review_id", "review_date", "review_date"),
    ("R38", "employee_surveys", "survey_id", "survey_date", "survey_date"),
    ("R39", "manager_feedback", "feedback_id", "feedback_date", "feedback_date"),
    ("R40", "promotions", "promotion_id", "promotion_date", "promotion_date"),
    ("R41", "transfers", "transfer_id", "transfer_date", "transfer_date"),
)
WINDOW_NAMES = ("attendance", "payroll", "leave", "training", "performance reviews", "surveys", "manager feedback", "promotions", "transfers")


def window_events(t: Tables, only: tuple[str, ...] | None = None) -> DataFrame:
    """rule, event_id, employee_id, start, end of the given rules' facts, narrow enough for one shared join."""
    parts = []
    for rule, name, key, start, end in WINDOWS:
        if name in t and (only is None or rule in only):
            first = F.coalesce(start, end)
            parts.append(t[name].select(F.lit(rule).alias("rule"), F.col(key).cast("long").alias("event_id"), "employee_id", first.alias("start"), F.coalesce(end, first).alias("end")))
    return union_all(parts)


def window_violations(t: Tables, as_of: date, only: tuple[str, ...] | None = None, null_is_violation: bool = False) -> DataFrame:
    """Events outside their employee's window, for all rules at once. Orphans belong to the orphan rules."""
    people = t["employees"].select(F.col("employee_id").alias("e"), "hire_date", F.coalesce("termination_date", F.lit(as_of)).alias("until"))
    events = window_events(t, only)
    bad = outside_window(F.col("start"), F.col("end"), F.col("hire_date"), F.col("until"))
    if null_is_violation:
        bad = bad | F.col("start").isNull()
    return events.join(people, events["employee_id"] == people["e"]).where(bad).select("rule", "event_id", "employee_id", "start", "end")


def promoted(t: Tables) -> DataFrame:
    return with_attributes(t["promotions"], t["job_roles"], "new_role_id", "role_id", ("salary_band_min", "salary_band_max"))


def exits_of(t: Tables) -> DataFrame:
    """employees with their exit_date; each exit once."""
    x = t["employee_exits"].select(F.col("employee_id").alias("x"), "exit_date")
    return t["employees"].join(x, t["employees"]["employee_id"] == x["x"]).drop("x")


def employees_where(t: Tables, cond: Column) -> DataFrame:
    return exits_of(t).where(cond).select("employee_id").distinct()


def stale(t: Tables, events: str, by: tuple[str, str], pairs: tuple[tuple[str, str], ...], rounded: tuple[str, ...] = ()) -> DataFrame:
    """Employees whose current values are not those of their latest event."""
    last = latest_per_key(t[events], "employee_id", by).select(F.col("employee_id").alias("e"), *[F.col(new).alias(f"_{new}") for new, _ in pairs])
    both = t["employees"].join(last, t["employees"]["employee_id"] == last["e"])
    cond = F.lit(False)
    for new, current in pairs:
        a, b = F.col(f"_{new}"), F.col(current)
        cond |= differs(round_half_even(a), round_half_even(b)) if new in rounded else differs(a, b)
    return both.where(cond).select("employee_id")


def recruited(t: Tables) -> DataFrame:
    return with_attributes(t["recruitment"], t["employees"], "successful_employee_id", "employee_id", ("employee_id", "hire_date"), "e_")


def operational_rules(as_of: date, initial: int = INITIAL_WORKFORCE) -> list[Rule]:
    c = F.col
    some, one = (1, None), (1, 1)
    rules = [
        Rule("R01", "Employees count greater than zero", lambda t: t["employees"], ("employees",), allowed=some),
        Rule("R02", "Attendance count greater than zero", lambda t: t["attendance"], ("attendance",), allowed=some),
        Rule("R03", "Payroll count greater than zero", lambda t: t["payroll"], ("payroll",), allowed=some),
        Rule("R04", "Employee exits count greater than zero", lambda t: t["employee_exits"], ("employee_exits",), allowed=some),
        Rule("R05", "Exactly one employee has no manager", lambda t: t["employees"].where(c("manager_id").isNull()), ("employees",), allowed=one),
        Rule("R06", "No non-manager employees without manager", lambda t: t["employees"].where(c("manager_id").isNull() & ~c("is_manager")), ("employees",)),
        Rule("R07", "No duplicate employee numbers", lambda t: duplicates(t["employees"], ["employee_number"], "employee_id"), ("employees",)),
        Rule("R08", "No duplicate employee emails", lambda t: duplicates(t["employees"], ["email"], "employee_id"), ("employees",)),
        Rule("R09", "No employees with missing department", lambda t: orphans(t["employees"], t["departments"], "department_id"), ("employees", "departments")),
        Rule("R10", "No employees with missing job role", lambda t: orphans(t["employees"], t["job_roles"], "role_id"), ("employees", "job_roles")),
        Rule("R11", "No employees with missing location", lambda t: orphans(t["employees"], t["locations"], "location_id"), ("employees", "locations")),
        Rule("R12", "No orphan attendance records", lambda t: orphans(t["attendance"], t["employees"], "employee_id"), ("attendance", "employees")),
        Rule("R13", "No orphan payroll records", lambda t: orphans(t["payroll"], t["employees"], "employee_id"), ("payroll", "employees")),
        Rule("R14", "No orphan employee exit records", lambda t: orphans(t["employee_exits"], t["employees"], "employee_id"), ("employee_exits", "employees")),
        Rule("R15", "No employees with negative salary", lambda t: t["employees"].where(c("annual_salary") < 0), ("employees",)),
        Rule("R16", "No employees with termination before hire date", lambda t: t["employees"].where(c("termination_date") < c("hire_date")), ("employees",)),
        Rule("R17", "No negative payroll records", lambda t: t["payroll"].where((c("gross_pay") < 0) | (c("net_pay") < 0) | (c("base_salary") < 0)), ("payroll",)),
        Rule("R18", "No active employees with exit events", lambda t: having(t["employees"].where("is_active"), t["employee_exits"], "employee_id"), ("employees", "employee_exits")),
        Rule("R19", "No employee exit events before hire date", lambda t: employees_where(t, c("exit_date") < c("hire_date")), ("employees", "employee_exits")),
        Rule("R20", "Employee termination dates match exit event dates", lambda t: employees_where(t, c("termination_date").isNull() | not_equal(c("termination_date"), c("exit_date"))), ("employees", "employee_exits")),
        Rule("R21", "Exited employees have terminated employment status", lambda t: having(t["employees"].where(not_equal(c("employment_status"), F.lit("Terminated"))), t["employee_exits"], "employee_id"), ("employees", "employee_exits")),
        Rule("R22", "No terminated employees without exit events", lambda t: orphans(t["employees"].where(~c("is_active") | c("termination_date").isNotNull() | (c("employment_status") == "Terminated")), t["employee_exits"], "employee_id"), ("employees", "employee_exits")),
        Rule("R23", "No exit interviews without employee exit events", lambda t: orphans(t["exit_interviews"], t["employee_exits"], "employee_id"), ("exit_interviews", "employee_exits")),
        Rule("R24", "No exit interviews for active employees", lambda t: having(t["exit_interviews"], t["employees"].where("is_active"), "employee_id"), ("exit_interviews", "employees")),
        Rule("R25", "No promotion salaries outside new role salary band", lambda t: promoted(t).where(outside_range(c("new_salary"), c("salary_band_min"), c("salary_band_max"))), ("promotions", "job_roles")),
        Rule("R26", "No promotions with invalid new role salary band", lambda t: promoted(t).where(c("salary_band_min") > c("salary_band_max")), ("promotions", "job_roles")),
        Rule("R27", "No filled recruitment records without successful employees", lambda t: orphans(t["recruitment"].where("recruitment_status = 'Filled'"), t["employees"], "successful_employee_id", "employee_id"), ("recruitment", "employees")),
        Rule("R28", "No open recruitment records linked to employees", lambda t: having(t["recruitment"].where("recruitment_status = 'Open'"), t["employees"], "successful_employee_id", "employee_id"), ("recruitment", "employees")),
        Rule("R29", "Successful recruits match recruitment hire dates", lambda t: recruited(t).where(c("e_employee_id").isNotNull() & differs(c("hire_date"), c("e_hire_date"))), ("recruitment", "employees")),
        Rule("R30", "Employee count equals initial workforce plus filled recruitments", lambda t: matches_total([(t["recruitment"], c("recruitment_status") == "Filled")], t["employees"], initial), ("recruitment", "employees")),
        Rule("R31", "Employee current role and salary match latest promotion", lambda t: stale(t, "promotions", ("promotion_date", "promotion_id"), (("new_role_id", "role_id"), ("new_salary", "annual_salary")), ("new_salary",)), ("promotions", "employees")),
        Rule("R32", "Employee current department location and manager match latest transfer", lambda t: stale(t, "transfers", ("transfer_date", "transfer_id"), (("new_department_id", "department_id"), ("new_location_id", "location_id"), ("new_manager_id", "manager_id"))), ("transfers", "employees")),
    ]
    for (rule, table, *_), word in zip(WINDOWS, WINDOW_NAMES):
        rules.append(Rule(rule, f"No {word} outside employee employment window", lambda t, r=rule: window_violations(t, as_of, (r,)), (table, "employees")))
    return rules


def optional_rules() -> list[Rule]:
    """Off by default."""
    c = F.col
    return [
        Rule("R42", "promotions_below_band", lambda t: promoted(t).where(c("new_salary") < c("salary_band_min")), ("promotions", "job_roles")),
        Rule("R43", "promotions_above_band", lambda t: promoted(t).where(c("new_salary") > c("salary_band_max")), ("promotions", "job_roles")),
    ]


def extra_rules(as_of: date) -> list[Rule]:
    c = F.col
    return [
        Rule("W16", "Exit interviews match exit events", lambda t: interview_mismatches(t), ("exit_interviews", "employee_exits"), "WARNING"),
        Rule("P08a", "No future hire dates", lambda t: t["employees"].where(c("hire_date") > F.lit(as_of)), ("employees",), "WARNING"),
        Rule("P08b", "No duplicate promotions", lambda t: duplicates(t["promotions"], ["employee_id", "promotion_date"]), ("promotions",), "WARNING"),
        Rule("P08c", "No attendance errors", lambda t: t["attendance"].where((c("clock_in_sec").isNull() != c("clock_out_sec").isNull()) | ((c("status") == "Absent") & c("clock_in_sec").isNotNull())), ("attendance",), "WARNING"),
        Rule("P08d", "No invalid ratings", lambda t: t["performance_reviews"].where(outside_range(c("overall_rating"), F.lit(1), F.lit(5))), ("performance_reviews",), "WARNING"),
        Rule("P08e", "No missing managers", lambda t: orphans(t["employees"].where("manager_id IS NOT NULL"), t["employees"], "manager_id", "employee_id"), ("employees",), "WARNING"),
    ]


def interview_mismatches(t: Tables) -> DataFrame:
    x = t["employee_exits"].select(F.col("employee_id").alias("x"), "exit_date", F.col("exit_reason").alias("x_reason"), "voluntary_flag")
    both = t["exit_interviews"].join(x, t["exit_interviews"]["employee_id"] == x["x"])
    return both.where(differs(F.col("termination_date"), F.col("exit_date")) | differs(F.col("exit_reason"), F.col("x_reason")) | differs(F.col("voluntary_exit"), F.col("voluntary_flag"))).select("exit_interview_id", "employee_id")
