"""Checks of reference tables. Violations are rows (dataset, rule, record_key, field, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import is_blank, is_code, is_country_code, is_month_day
from ..operators import orphans, union_all

COLUMNS = "dataset string, rule string, record_key string, field string, value string"
# What each reference table must have.
REQUIRED = {
    "business_units": ("unit_name", "description"),
    "departments": ("department_name", "cost_center", "business_unit"),
    "locations": ("country", "city", "office_name", "timezone"),
    "job_roles": ("role_name", "grade", "salary_band_min", "salary_band_max"),
    "attendance_statuses": ("attendance_status_code", "attendance_status_name", "weight", "requires_clock_times", "absence_reason_required"),
    "genders": ("gender_code", "gender_name"),
    "leave_types": ("leave_type_code", "leave_type_name", "description", "paid", "requires_approval"),
    "employment_types": ("employment_type_code", "employment_type_name", "description"),
    "exit_reasons": ("exit_reason_code", "exit_reason_name", "voluntary", "weight", "reasons"),
    "training_categories": ("training_category_code", "training_category_name", "description"),
    "public_holidays": ("holiday_code", "holiday_name", "month_day", "country_code", "active"),
    "absence_reasons": ("absence_reason_code", "absence_reason_name", "description"),
}
# Fields without repeated values.
UNIQUE = {
    "business_units": ("unit_name",),
    "departments": ("department_name", "cost_center"),
    "locations": ("office_name",),
    "job_roles": ("role_name",),
    "attendance_statuses": ("attendance_status_code", "attendance_status_name"),
    "genders": ("gender_code", "gender_name"),
    "leave_types": ("leave_type_code", "leave_type_name"),
    "employment_types": ("employment_type_code", "employment_type_name"),
    "exit_reasons": ("exit_reason_code", "exit_reason_name"),
    "training_categories": ("training_category_code", "training_category_name"),
    "public_holidays": ("holiday_code", "holiday_name", "month_day"),
    "absence_reasons": ("absence_reason_code", "absence_reason_name"),
}
BOOLEANS = ("paid", "requires_approval", "requires_clock_times", "absence_reason_required", "voluntary", "active")


def found(df: DataFrame, dataset: str, rule: str, key: str, tests: dict[str, Column]) -> DataFrame:
    """A row for each field of each record whose test holds, in one scan."""
    cells = F.array(*[F.when(test, F.struct(F.lit(f).alias("field"), (F.col(f).cast("string") if f in df.columns else F.lit(None).cast("string")).alias("value"))) for f, test in tests.items()])
    rows = df.select(F.col(key).cast("string").alias("record_key"), F.explode(F.array_compact(cells)).alias("x"))
    return rows.select(F.lit(dataset).alias("dataset"), F.lit(rule).alias("rule"), "record_key", "x.field", "x.value")


def blank(df: DataFrame, field: str) -> Column:
    if field not in df.columns:
        return F.lit(True)
    kind = dict(df.dtypes)[field]
    return F.col(field).isNull() | is_blank(F.col(field)) if kind == "string" else F.col(field).isNull()


def not_empty(df: DataFrame, dataset: str) -> DataFrame:
    """One violation when the table has no rows."""
    n = df.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    return n.select(F.lit(dataset).alias("dataset"), F.lit("D01").alias("rule"), F.lit(None).cast("string").alias("record_key"), F.lit(None).cast("string").alias("field"), F.col("n").cast("string").alias("value"))


def required(df: DataFrame, dataset: str, key: str, fields: tuple[str, ...]) -> DataFrame:
    return found(df, dataset, "D02", key, {f: blank(df, f) for f in fields})


def unique(df: DataFrame, dataset: str, fields: tuple[str, ...]) -> DataFrame:
    def one(f: str) -> DataFrame:
        twice = df.groupBy(F.col(f).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return twice.select(F.lit(dataset).alias("dataset"), F.lit("D03").alias("rule"), F.col("value").alias("record_key"), F.lit(f).alias("field"), F.col("n").cast("string").alias("value"))

    return union_all([one(f) for f in fields])


def real_booleans(df: DataFrame, dataset: str, key: str, fields: tuple[str, ...]) -> DataFrame:
    """Text must spell true or false; a column of Boolean type always passes."""
    ok = lambda f: F.lower(F.col(f).cast("string")).isin("true", "false")
    return found(df, dataset, "D04", key, {f: ~F.coalesce(ok(f), F.lit(False)) for f in fields})


def codes(df: DataFrame, dataset: str, key: str, field: str) -> DataFrame:
    return found(df, dataset, "D05", key, {field: ~F.coalesce(is_code(F.col(field)), F.lit(False))})


def parent_names(df: DataFrame, parent: DataFrame, dataset: str, key: str, fk: str, pk: str) -> DataFrame:
    return found(orphans(df, parent, fk, pk), dataset, "D06", key, {fk: F.lit(True)})


def salary_bands(df: DataFrame, dataset: str = "job_roles", key: str = "role_name") -> DataFrame:
    """Up to four violations: a bound that is no number, a bound below zero, and a minimum above the maximum."""
    low, high = (F.expr(f"try_cast({c} AS decimal(14,2))") for c in ("salary_band_min", "salary_band_max"))
    parts = [
        found(df, dataset, "D07 number", key, {"salary_band_min": low.isNull(), "salary_band_max": high.isNull()}),
        found(df, dataset, "D07 sign", key, {"salary_band_min": low < 0, "salary_band_max": high < 0}),
        found(df, dataset, "D07 order", key, {"salary_band_min": low > high}),
    ]
    return union_all(parts)


def weights(df: DataFrame, dataset: str, key: str, field: str = "weight") -> DataFrame:
    n = F.expr(f"try_cast({field} AS decimal(20,6))")
    return found(df, dataset, "D08", key, {field: n.isNull() | (n != F.floor(n)) | (n <= 0)})


def absent_status(df: DataFrame) -> DataFrame:
    """Exactly one status is Absent; it has no clock times and needs a reason."""
    is_absent = F.col("attendance_status_name") == "Absent"
    n = df.agg(F.count_if(is_absent).alias("n")).where("n <> 1")
    count = n.select(F.lit("attendance_statuses").alias("dataset"), F.lit("D09").alias("rule"), F.lit("Absent").alias("record_key"), F.lit("attendance_status_name").alias("field"), F.col("n").cast("string").alias("value"))
    flags = found(df.where(is_absent), "attendance_statuses", "D09", "attendance_status_code", {"requires_clock_times": F.col("requires_clock_times"), "absence_reason_required": ~F.col("absence_reason_required")})
    return count.unionByName(flags)


def exit_reasons(df: DataFrame) -> DataFrame:
    r = F.col("reasons")
    tests = {
        "D10 empty": F.coalesce(F.size(r) <= 0, F.lit(True)),
        "D10 blank": F.exists(r, lambda x: x.isNull() | is_blank(x)),
        "D10 twice": F.size(r) != F.size(F.array_distinct(r)),
    }
    parts = [found(df, "exit_reasons", rule, "exit_reason_code", {"reasons": test}) for rule, test in tests.items()]
    if "weight" in df.columns:
        weight = F.expr("try_cast(weight AS double)")
        parts.append(found(df.where("weight IS NOT NULL"), "exit_reasons", "D10 weight", "exit_reason_code", {"weight": weight.isNull() | (weight <= 0)}))
    return union_all(parts)


def holidays(df: DataFrame) -> DataFrame:
    c = F.col
    tests = {"month_day": ~F.coalesce(is_month_day(c("month_day")), F.lit(False)), "country_code": ~F.coalesce(is_country_code(c("country_code")), F.lit(False)), "active": c("active").isNull()}
    return found(df, "public_holidays", "D11", "holiday_code", tests)


def check_reference(tables: dict[str, DataFrame]) -> DataFrame:
    """All violations of all given tables."""
    parts = []
    for name, df in tables.items():
        key = REQUIRED[name][0]
        parts += [not_empty(df, name), required(df, name, key, REQUIRED[name]), unique(df, name, tuple(f for f in UNIQUE[name] if f in df.columns) or (key,))]
        if flags := tuple(f for f in BOOLEANS if f in df.columns):
            parts.append(real_booleans(df, name, key, flags))
        if key.endswith("_code"):
            parts.append(codes(df, name, key, key))
    if {"departments", "business_units"} <= tables.keys():
        parts.append(parent_names(tables["departments"], tables["business_units"], "departments", "department_name", "business_unit", "unit_name"))
    for name, check in (("job_roles", salary_bands), ("attendance_statuses", absent_status), ("exit_reasons", exit_reasons), ("public_holidays", holidays)):
        if name in tables:
            parts.append(check(tables[name]))
    if "attendance_statuses" in tables:
        parts.append(weights(tables["attendance_statuses"], "attendance_statuses", "attendance_status_code"))
    return union_all(parts)
