"""HR calculations on tables. `as_of` stands for today."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clamp, first_true, is_weekend, month_day, only_alnum, round_half_even, round_half_up, split_name
from ..operators import latest_per_key, orphans, ranked

DEC = "decimal(12,2)"
# Fixed values of pay and ratings.
BONUS, PENSION, TAX, OVERTIME, WEEK_HOURS, DAY_HOURS = 0.03, 0.05, 0.20, 1.5, 37.5, 7.5
GRADES = {"Associate": 1, "Senior Associate": 2, "Manager": 3}


def employment_window(employees: DataFrame, as_of: date) -> DataFrame:
    """employee_id, window_start, window_end."""
    return employees.select("employee_id", F.col("hire_date").alias("window_start"), F.coalesce("termination_date", F.lit(as_of)).alias("window_end"))


def month_spine(rows: DataFrame, at: str, years: int = 3) -> DataFrame:
    """month_start, month_end from January of the year `years` before the last date of rows to that date."""
    last = rows.agg(F.max(F.col(at).cast("date")).alias("last")).where("last IS NOT NULL")
    first = F.make_date(F.year("last") - years, F.lit(1), F.lit(1))
    months = last.select(F.explode(F.sequence(first, F.col("last"), F.expr("INTERVAL 1 MONTH"))).alias("month_start"))
    return months.select("month_start", F.last_day("month_start").alias("month_end"))


def prorated_pay(employees: DataFrame, as_of: date, years: int = 3) -> DataFrame:
    """employee_id, month_start, days_employed, payable of each month in which an employee works.

    Months are made for each employee from their own window, so there is no join with a calendar.
    """
    first = F.lit(date(as_of.year - years, 1, 1))
    frm, to = F.greatest(F.col("hire_date"), first), F.least(F.coalesce("termination_date", F.lit(as_of)), F.lit(as_of))
    rows = employees.select("employee_id", "annual_salary", frm.alias("frm"), to.alias("to")).where("frm <= to")
    rows = rows.withColumn("month_start", F.explode(F.sequence(F.trunc("frm", "month"), F.trunc("to", "month"), F.expr("INTERVAL 1 MONTH"))))
    end = F.last_day("month_start")
    days = F.date_diff(F.least(end, F.col("to")), F.greatest("month_start", "frm")) + 1
    payable = F.col("annual_salary").cast(DEC) * days.cast("decimal(3,0)") / (12 * F.dayofmonth(end)).cast("decimal(4,0)")
    return rows.select("employee_id", "month_start", days.alias("days_employed"), round_half_up(payable, 2).cast(DEC).alias("payable"))


def overtime_pay(hours: Column, base: Column, monthly: Column, annual: Column) -> Column:
    ratio = F.when(monthly == 0, F.lit(1.0)).otherwise(base.cast("double") / monthly.cast("double"))
    return hours.cast("double") * ratio * (annual.cast("double") / 52 / WEEK_HOURS) * OVERTIME


def payroll_lines(rows: DataFrame, base: str = "base_salary", overtime: str = "overtime_pay") -> DataFrame:
    """Adds bonus, pension, tax, deductions, gross and net; sums use unrounded parts."""
    b, o = F.col(base).cast("decimal(18,6)"), F.col(overtime).cast("decimal(18,6)")
    rate = lambda x: F.lit(x).cast("decimal(4,2)")
    gross, off = b + o + b * rate(BONUS), b * rate(PENSION) + b * rate(TAX)
    parts = {"bonus": b * rate(BONUS), "pension_contribution": b * rate(PENSION), "tax_amount": b * rate(TAX), "deductions": off, "gross_pay": gross, "net_pay": gross - off}
    return rows.withColumns({k: round_half_up(v, 2).cast(DEC) for k, v in parts.items()})


def working_days(windows: DataFrame, holidays: DataFrame, start: str, end: str) -> DataFrame:
    """Adds working_days: days of the window but weekends and active yearly holidays. Holidays are a small lookup."""
    days = F.sequence(F.col(start), F.col(end))
    off = holidays.where("active").agg(F.collect_set("month_day").alias("_off"))
    with_off = windows.crossJoin(F.broadcast(off))  # one row
    n = F.size(F.filter(days, lambda d: ~is_weekend(d) & ~F.array_contains("_off", month_day(d))))
    return with_off.withColumn("working_days", F.when(F.col(start) <= F.col(end), n).otherwise(0)).drop("_off")


def hours_worked(clock_in: Column, clock_out: Column) -> Column:
    """Hours from seconds of the day, over midnight if the end is smaller; 0 when a clock is null."""
    return F.coalesce(round_half_even(F.pmod(clock_out - clock_in, F.lit(86400)).cast("decimal(10,4)") / F.lit(3600).cast("decimal(6,0)"), 2), F.lit(0)).cast("decimal(5,2)")


def overtime_hours(hours: Column) -> Column:
    return F.greatest(hours - F.lit(DAY_HOURS).cast("decimal(4,2)"), F.lit(0)).cast("decimal(5,2)")


SCORES = ("productivity", "quality", "teamwork", "leadership")


def overall_rating(*scores: Column) -> Column:
    """Mean of the scores that are not null."""
    some = F.array_compact(F.array(*[s.cast("decimal(5,2)") for s in scores]))
    total = F.aggregate(some, F.lit(0).cast("decimal(12,2)"), lambda a, x: (a + x).cast("decimal(12,2)"))
    return round_half_even(total / F.size(some), 2).cast("decimal(3,2)")


def review_focus(*scores: Column) -> Column:
    """strongest, weakest and focus; ties go to the first score in order."""
    named = F.array_compact(F.array(*[F.when(s.isNotNull(), F.struct(s.cast("double").alias("v"), F.lit(-i).alias("i"), F.lit(n).alias("n"))) for i, (n, s) in enumerate(zip(SCORES, scores))]))
    low = F.array_min(F.transform(named, lambda x: F.struct(x["v"].alias("v"), (-x["i"]).alias("i"), x["n"].alias("n"))))
    high = F.array_max(named)
    focus = F.when(high["v"] - low["v"] <= 0.30 + 1e-9, "balanced").when(low["v"] >= 4.0, "strategic").otherwise(low["n"])
    return F.struct(high["n"].alias("strongest"), low["n"].alias("weakest"), focus.alias("focus"))


def promotion_recommended(overall: Column) -> Column:
    return overall >= 4.5


def salary_in_band(old: Column, rate: Column, low: Column, high: Column) -> Column:
    """new_salary, amount and percent of a raise that stays in the band."""
    new = round_half_even(clamp(old.cast("decimal(18,6)") * (1 + rate.cast("decimal(6,4)")), low.cast("decimal(18,6)"), high.cast("decimal(18,6)")), 2).cast(DEC)
    amount = (new - old).cast(DEC)
    percent = F.when(old != 0, round_half_even((amount * 100).cast("decimal(18,4)") / old, 2).cast("decimal(12,2)"))
    return F.struct(new.alias("new_salary"), amount.alias("amount"), percent.alias("percent"))


def grade_rank(grade: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for name, rank in GRADES.items():
        out = out.when(grade == name, rank)
    return out


def eligible_roles(employees: DataFrame, roles: DataFrame) -> DataFrame:
    """employee_id, role_id, new_role_id of strictly higher grade. Roles are a lookup of fixed size."""
    now = roles.select("role_id", grade_rank(F.col("grade")).alias("rank"))
    more = now.select(F.col("role_id").alias("new_role_id"), F.col("rank").alias("new_rank"))
    return employees.join(now, "role_id").join(more, F.col("new_rank") > F.col("rank")).select("employee_id", "role_id", "new_role_id")


def increase_band(percent: Column) -> Column:
    return first_true([(percent >= 15, "high"), (percent >= 10, "moderate")], "progression")


def apply_events(employees: DataFrame, promotions: DataFrame, transfers: DataFrame, exits: DataFrame, roles: DataFrame) -> DataFrame:
    """employees after their latest promotion, transfer and exit."""
    p = latest_per_key(promotions, "employee_id", ("promotion_date", "promotion_id")).select("employee_id", "new_role_id", "new_salary")
    p = p.join(roles.select(F.col("role_id").alias("new_role_id"), (F.col("grade") == "Manager").alias("p_manager")), "new_role_id", "left")
    t = latest_per_key(transfers, "employee_id", ("transfer_date", "transfer_id")).select("employee_id", "new_department_id", "new_location_id", "new_manager_id", F.lit(True).alias("moved"))
    x = latest_per_key(exits, "employee_id", ("exit_date", "exit_event_id")).select("employee_id", "exit_date")
    left = F.col("exit_date").isNotNull()
    new = {
        "role_id": F.coalesce("new_role_id", "role_id"), "annual_salary": F.coalesce("new_salary", "annual_salary"), "is_manager": F.coalesce("p_manager", "is_manager"),
        "department_id": F.coalesce("new_department_id", "department_id"), "location_id": F.coalesce("new_location_id", "location_id"), "manager_id": F.when(F.col("moved"), F.col("new_manager_id")).otherwise(F.col("manager_id")),
        "termination_date": F.coalesce("exit_date", "termination_date"), "employment_status": F.when(left, "Terminated").otherwise(F.col("employment_status")), "is_active": F.when(left, False).otherwise(F.col("is_active")),
    }
    return employees.join(p, "employee_id", "left").join(t, "employee_id", "left").join(x, "employee_id", "left").withColumns(new).select(*employees.columns)


def survey_sentiment(score: Column) -> Column:
    return F.when(score >= 3.5, "Positive").otherwise("Neutral")


def feedback_tone(score: Column) -> Column:
    return first_true([(score >= 4.5, "high"), (score >= 3.5, "positive")], "development")


def survey_theme(growth: Column, manager: Column, wellbeing: Column, balance: Column, engagement: Column, satisfaction: Column) -> Column:
    """The first theme whose condition holds."""
    mean = (engagement + satisfaction) / 2
    return first_true([(growth < 3, "growth"), (manager < 3, "manager"), ((wellbeing < 3) | (balance < 3), "wellbeing"), (mean >= 4, "positive"), (mean >= 3.25, "neutral")], "development")


def unique_emails(people: DataFrame, folder: str, name: str = "name", key: str = "employee_id", domain: str = "example.com") -> DataFrame:
    """Adds first_name, last_name and email; a taken address gets the next number that no other person's name ends in.

    Names that differ in final digits alone share their numbers: `a.b2` is not given to the second `a.b` where someone's
    name makes it. The first of a name, by key, has it without a number. The numbers of a stem are the places of its repeats
    in one order with the numbers that names end in, each of which moves later repeats by one; so nothing is collected for
    a stem, and one that all names share, as names without Latin letters do, is counted over many tasks.
    """
    first, last = split_name(F.col(name))
    base = F.concat_ws(".", only_alnum(first), only_alnum(last))
    rows = people.withColumns({"first_name": first, "last_name": last, "_base": base, "_stem": F.regexp_replace(base, "[0-9]+$", "")})
    number = F.regexp_extract("_base", "([1-9][0-9]{0,8})$", 1)
    own = F.when((number != "") & (F.concat("_stem", number) == F.col("_base")), number.cast("long"))
    named = ranked(rows, ["_stem", "_base"], [key], folder, "_n")
    again = ranked(named.where("_n > 1").drop("_n"), ["_stem"], ["_base", key], folder, "_k")
    taken = ranked(rows.select("_stem", own.alias("_own")).where("_own > 1").distinct(), ["_stem"], ["_own"], folder, "_j")
    # Repeats begin with 2, so repeat k has k + 1 at first; j numbers up to a taken one leave own - j free below it.
    both = again.withColumns({"_at": F.col("_k") + 1, "_is_taken": F.lit(0)})
    both = both.unionByName(taken.select("_stem", (F.col("_own") - F.col("_j")).alias("_at"), F.lit(1).alias("_is_taken")), allowMissingColumns=True)
    placed = ranked(both, ["_stem"], ["_at", "_is_taken"], folder, "_place").where("_is_taken = 0")
    addresses = named.where("_n = 1").withColumn("_a", F.col("_base")).unionByName(placed.withColumn("_a", F.concat("_stem", (F.col("_place") + 1).cast("string"))), allowMissingColumns=True)
    return addresses.select(*people.columns, "first_name", "last_name", F.concat("_a", F.lit("@" + domain)).alias("email"))


def pick_manager(employees: DataFrame) -> DataFrame:
    """employee_id, manager_id: the active manager with the smallest id, of the same department if there is one.

    One candidate for each department and one for all is enough, so nothing is paired with all managers.
    """
    managers = employees.where("is_manager AND is_active")
    two = lambda w: F.row_number().over(w)
    ranked = managers.select("department_id", "employee_id", two(Window.partitionBy("department_id").orderBy("employee_id")).alias("k")).where("k <= 2")
    own = ranked.groupBy("department_id").agg(F.sort_array(F.collect_list("employee_id")).alias("ids"))
    overall = managers.select("employee_id").orderBy("employee_id").limit(2).agg(F.sort_array(F.collect_list("employee_id")).alias("others"))
    rows = employees.select("employee_id", "department_id").join(own, "department_id", "left").crossJoin(F.broadcast(overall))
    other = lambda a: F.get(F.filter(F.col(a), lambda m: m != F.col("employee_id")), F.lit(0))
    return rows.select("employee_id", F.coalesce(other("ids"), other("others")).alias("manager_id"))


def leave_days(requested: Column, available: Column) -> Column:
    return F.greatest(F.least(requested, available), F.lit(0))


def time_to_hire(rows: DataFrame) -> DataFrame:
    """closing_date no later than hire_date, and days from opening to hire."""
    return rows.withColumns({"closing_date": F.least("closing_date", "hire_date"), "days_to_hire": F.date_diff("hire_date", "opening_date")})


def hierarchy_levels(employees: DataFrame, folder: str, depth: int | None = None) -> DataFrame:
    """employee_id, level (0 without a manager) down to the last level, or `depth` levels if given.

    Each level is one join on the manager, written to the shared folder. Employee ids are unique. Whoever is on or below a
    cycle, or below a manager who is no employee, has no level and no row; hierarchy.reporting_lines names them all.
    """
    spark = employees.sparkSession
    people = employees.select("employee_id", "manager_id")
    level, k, paths = people.where("manager_id IS NULL").select("employee_id", F.lit(0).alias("level")), 0, []
    schema = level.schema
    while True:
        paths.append(f"{folder}/level-{k}")
        level.write.parquet(paths[-1])
        level, k = spark.read.schema(schema).parquet(paths[-1]), k + 1
        if k == depth or level.isEmpty():
            return spark.read.schema(schema).parquet(*paths)
        above = level.select(F.col("employee_id").alias("m"))
        level = people.join(above, people["manager_id"] == above["m"]).select("employee_id", F.lit(k).alias("level"))


def unknown_values(df: DataFrame, column: str, lookup: DataFrame, name: str) -> DataFrame:
    """Rows whose value is not in the lookup; null values are not known either."""
    return orphans(df, lookup, column, name)


def manager_for(rows: DataFrame, employees: DataFrame) -> DataFrame:
    """rows with manager_id: the active manager with the smallest id, of the row's department if there is one."""
    managers = employees.where("is_manager AND is_active")
    own = managers.groupBy(F.col("department_id").alias("_d")).agg(F.min("employee_id").alias("_own"))
    overall = managers.agg(F.min("employee_id").alias("_any"))  # one row
    return rows.join(own, rows["department_id"] == own["_d"], "left").crossJoin(F.broadcast(overall)).withColumn("manager_id", F.coalesce("_own", "_any")).drop("_d", "_own", "_any")


def hires_to_employees(recruitment: DataFrame, roles: DataFrame, employees: DataFrame, folder: str, first_number: int = 1) -> DataFrame:
    """One employee row for each filled vacancy, with a manager among the employees."""
    hires = recruitment.where("recruitment_status = 'Filled'").join(roles.select("role_id", "grade"), "role_id", "left")
    hires = manager_for(unique_emails(hires, folder, "candidate_name", "recruitment_id"), employees)
    number = F.concat(F.lit("EMP"), F.lpad((F.col("recruitment_id") + first_number).cast("string"), 6, "0"))
    return hires.select(F.col("recruitment_id"), number.alias("employee_number"), "email", "first_name", "last_name", "hire_date", "department_id", "role_id", "manager_id", F.coalesce(F.col("grade") == "Manager", F.lit(False)).alias("is_manager"), F.lit("Active").alias("employment_status"), F.lit(True).alias("is_active"), F.lit("GBP").alias("currency"))


def transfer_options(employees: DataFrame, places: DataFrame, current: str, option: str) -> DataFrame:
    """employee_id and every other place; places are a lookup of fixed size."""
    p = places.select(F.col(option).alias(f"new_{option}"))
    return employees.select("employee_id", current).join(p, ~F.col(current).eqNullSafe(F.col(f"new_{option}")))


def other_manager(employees: DataFrame) -> DataFrame:
    """employee_id, new_manager_id: the active manager with the smallest id that is neither the current one nor the employee.

    Three candidates are enough for everyone, so nobody is paired with all managers; null if there is none.
    """
    first = employees.where("is_manager AND is_active").select("employee_id").orderBy("employee_id").limit(3).agg(F.sort_array(F.collect_list("employee_id")).alias("_m"))
    fits = F.filter("_m", lambda m: (m != F.col("employee_id")) & ~m.eqNullSafe(F.col("manager_id")))
    return employees.crossJoin(F.broadcast(first)).select("employee_id", F.get(fits, F.lit(0)).alias("new_manager_id"))


def eligible(employees: DataFrame, on: Column, days: int, managers: bool = False) -> DataFrame:
    """Employees that at a date have served the given days and are still employed."""
    ok = (F.date_diff(on, F.col("hire_date")) >= days) & (F.col("termination_date").isNull() | (on <= F.col("termination_date")))
    return employees.where(ok if managers else ok & ~F.col("is_manager"))
