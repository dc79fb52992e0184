"""The same results as run_rules, from three aggregates that read each fact table once.

- People: a row for each employee with what its exits, interviews, latest promotion and latest transfer say, each of them
  aggregated by employee before the join. One count over it answers the rules on employees.
- Events: all dated facts and recruitments, narrow, in one join with employees; orphans, windows and totals are counts.
- Duplicates: both unique columns of employees in one aggregate.

Employee ids are a key of employees. Lookups (departments, roles, locations) are joined by their distinct ids.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import round_half_even
from ..operators import differs, not_equal, outside_range, outside_window, union_all
from .operational import INITIAL_WORKFORCE, WINDOWS, operational_rules, promoted
from .rules import Rule, Tables, run_rules

c = F.col


def rule_result(rule: Rule, n: Column) -> Column:
    low, high = rule.allowed
    return F.struct(F.lit(rule.name).alias("check_name"), ((n >= low) if high is None else n.between(low, high)).alias("passed"), n.cast("long").alias("record_count"), F.lit(rule.severity).alias("severity"))


def known(df: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """df with `has_<key>`: whether the lookup has its key."""
    ids = lookup.select(c(key).alias("_id")).distinct().withColumn(f"has_{key}", F.lit(True))
    return df.join(ids, df[key] == ids["_id"], "left").drop("_id")


def latest(df: DataFrame, by: tuple[str, str], values: tuple[str, ...], *sums: Column) -> DataFrame:
    """_id, last (values of the last row) and the sums, for each employee."""
    return df.groupBy(c("employee_id").alias("_id")).agg(F.max(F.struct(*by, *values)).alias("last"), *sums)


def people(t: Tables) -> DataFrame:
    """Counts of the rules on employees, exits, interviews, promotions' bands and latest events: one row."""
    exits = t["employee_exits"].groupBy(c("employee_id").alias("x_id")).agg(F.count(F.lit(1)).alias("exits"), F.min("exit_date").alias("first_exit"), F.max("exit_date").alias("last_exit"))
    talks = t["exit_interviews"].groupBy(c("employee_id").alias("i_id")).agg(F.count(F.lit(1)).alias("talks"))
    low, high, salary = c("salary_band_min"), c("salary_band_max"), c("new_salary")
    raised = latest(promoted(t), ("promotion_date", "promotion_id"), ("new_role_id", "new_salary"), F.count_if(outside_range(salary, low, high)).alias("off_band"), F.count_if(low > high).alias("bad_band")).select(c("_id").alias("p_id"), c("last").alias("p"), "off_band", "bad_band")
    moved = latest(t["transfers"], ("transfer_date", "transfer_id"), ("new_department_id", "new_location_id", "new_manager_id")).select(c("_id").alias("t_id"), c("last").alias("t"))
    e = t["employees"].select("employee_id", "manager_id", "is_manager", "annual_salary", "hire_date", "termination_date", "employment_status", "is_active", "department_id", "role_id", "location_id", F.lit(True).alias("here"))
    for key, lookup in (("department_id", "departments"), ("role_id", "job_roles"), ("location_id", "locations")):
        e = known(e, t[lookup], key)
    rows = e.join(exits, e["employee_id"] == exits["x_id"], "full").join(talks, F.coalesce("employee_id", "x_id") == c("i_id"), "full")
    rows = rows.join(raised, F.coalesce("employee_id", "x_id", "i_id") == c("p_id"), "full").join(moved, c("employee_id") == c("t_id"), "left")
    here, left = F.coalesce("here", F.lit(False)), c("exits").isNotNull()
    gone = ~c("is_active") | c("termination_date").isNotNull() | (c("employment_status") == "Terminated")
    role_or_pay = differs(c("p.new_role_id"), c("role_id")) | differs(round_half_even(c("p.new_salary")), round_half_even(c("annual_salary")))
    place = differs(c("t.new_department_id"), c("department_id")) | differs(c("t.new_location_id"), c("location_id")) | differs(c("t.new_manager_id"), c("manager_id"))
    counts = {
        "R01": here, "R05": here & c("manager_id").isNull(), "R06": here & c("manager_id").isNull() & ~c("is_manager"),
        "R09": here & c("has_department_id").isNull(), "R10": here & c("has_role_id").isNull(), "R11": here & c("has_location_id").isNull(),
        "R15": here & (c("annual_salary") < 0), "R16": here & (c("termination_date") < c("hire_date")),
        "R18": here & left & c("is_active"), "R19": here & left & (c("first_exit") < c("hire_date")),
        "R20": here & left & (c("termination_date").isNull() | not_equal(c("termination_date"), c("first_exit")) | not_equal(c("termination_date"), c("last_exit"))),
        "R21": here & left & not_equal(c("employment_status"), F.lit("Terminated")), "R22": here & ~left & gone,
        "R31": here & c("p_id").isNotNull() & role_or_pay, "R32": here & c("t_id").isNotNull() & place,
    }
    sums = {"R04": (F.lit(True), "exits"), "R14": (~here, "exits"), "R23": (~left, "talks"), "R24": (here & c("is_active"), "talks"), "R25": (F.lit(True), "off_band"), "R26": (F.lit(True), "bad_band")}
    return rows.agg(*[F.count_if(cond).alias(r) for r, cond in counts.items()], *[F.coalesce(F.sum(F.when(cond, c(n))), F.lit(0)).alias(r) for r, (cond, n) in sums.items()])


def events(t: Tables, as_of: date) -> DataFrame:
    """Counts of the rules on dated facts and recruitments: one row."""
    parts = []
    for rule, name, _, start, end in WINDOWS:
        negative = (c("gross_pay") < 0) | (c("net_pay") < 0) | (c("base_salary") < 0) if name == "payroll" else F.lit(False)
        first = F.coalesce(start, end)
        parts.append(t[name].select(F.lit(rule).alias("rule"), "employee_id", first.alias("start"), F.coalesce(end, first).alias("end"), negative.alias("marked")))
    status = c("recruitment_status")
    kind = F.when(status == "Filled", "filled").when(status == "Open", "open").otherwise("other")
    parts.append(t["recruitment"].select(kind.alias("rule"), c("successful_employee_id").alias("employee_id"), c("hire_date").alias("start"), c("hire_date").alias("end"), F.lit(False).alias("marked")))
    staff = t["employees"].select(c("employee_id").alias("e"), c("hire_date").alias("hired"), F.coalesce("termination_date", F.lit(as_of)).alias("until"))
    facts = union_all(parts)
    rows = facts.join(staff, facts["employee_id"] == staff["e"], "left")
    is_a, found = lambda *r: c("rule").isin(*r), c("e").isNotNull()
    counts = {
        "R02": is_a("R33"), "R03": is_a("R34"), "R12": is_a("R33") & ~found, "R13": is_a("R34") & ~found, "R17": c("marked"),
        "R27": is_a("filled") & ~found, "R28": is_a("open") & found, "R29": is_a("filled", "open", "other") & found & differs(c("start"), c("hired")), "filled": is_a("filled"),
    }
    counts |= {r: is_a(r) & found & outside_window(c("start"), c("end"), c("hired"), c("until")) for r, *_ in WINDOWS}
    return rows.agg(*[F.count_if(cond).alias(r) for r, cond in counts.items()])


def twice(employees: DataFrame) -> DataFrame:
    """Counts of employee numbers and emails that several employees have: one row."""
    cells = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), c(f).cast("string").alias("value")) for r, f in (("R07", "employee_number"), ("R08", "email"))])).alias("x")
    many = employees.select("employee_id", cells).groupBy("x").agg(F.count("employee_id").alias("n")).where("n > 1")
    return many.agg(*[F.count_if(c("x.rule") == r).alias(r) for r in ("R07", "R08")])


def run_fused(t: Tables, as_of: date, initial: int = INITIAL_WORKFORCE) -> DataFrame:
    """Results of all operational rules; where a table is missing, of those whose tables are there, each by itself."""
    rules = operational_rules(as_of, initial)
    if not {n for r in rules for n in r.needs} <= t.keys():
        return run_rules(rules, t)
    row = people(t).crossJoin(events(t, as_of)).crossJoin(twice(t["employees"]))  # one row each
    row = row.withColumn("R30", (c("R01") != c("filled") + initial).cast("long"))
    return row.select(F.explode(F.array(*[rule_result(r, c(r.id)) for r in rules])).alias("x")).select("x.*")
