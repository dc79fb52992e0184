from datetime import date

import pytest
from pyspark.sql import functions as F

from rosterlake import functions as X
from rosterlake import operators as ops
from rosterlake.plans import operational
from rosterlake.plans.rules import RuleFailure, gate, run_rules

AS_OF = date(2024, 6, 30)
EMPLOYEES = "employee_id int, hire_date date, termination_date date, manager_id int, department_id int, location_id int"


def rule(name):
    return next(r for r in operational.operational_rules(AS_OF) if r.id == name)


def test_rule_list():
    rules = operational.operational_rules(AS_OF)
    assert [r.id for r in rules] == [f"R{i:02d}" for i in range(1, 42)]
    assert rules[4].name == "Exactly one employee has no manager"
    assert rules[40].name == "No transfers outside employee employment window"
    assert all(r.severity == "CRITICAL" for r in rules)


def test_window_edges(spark):
    people = spark.createDataFrame([(1, date(2024, 1, 1), None, None, 1, 1), (2, date(2024, 1, 1), date(2024, 2, 1), 1, 1, 1)], EMPLOYEES)
    leave = spark.createDataFrame([(1, 1, AS_OF, AS_OF), (2, 1, date(2024, 3, 2), date(2024, 3, 1)), (3, 2, date(2024, 1, 31), date(2024, 2, 2)), (4, 9, AS_OF, AS_OF), (5, 1, None, None)], "leave_id int, employee_id int, start_date date, end_date date")
    got = operational.window_violations({"employees": people, "leave_requests": leave}, AS_OF)
    assert sorted(r.event_id for r in got.collect()) == [2, 3]


def test_orphans_and_ties(spark):
    child = spark.createDataFrame([(1, 5), (2, None), (3, 6)], "id int, fk int")
    parent = spark.createDataFrame([(5,)], "pk int")
    assert sorted(r.id for r in ops.orphans(child, parent, "fk", "pk").collect()) == [2, 3]
    events = spark.createDataFrame([(1, date(2024, 1, 1), 1, "a"), (1, date(2024, 1, 1), 2, "b")], "k int, d date, i int, v string")
    assert [r.v for r in ops.latest_per_key(events, "k", ("d", "i")).collect()] == ["b"]


def test_null_manager_is_no_difference(spark):
    people = spark.createDataFrame([(1, date(2020, 1, 1), None, None, 3, 4)], EMPLOYEES)
    moves = spark.createDataFrame([(1, 1, 3, 4, None, AS_OF)], "transfer_id int, employee_id int, new_department_id int, new_location_id int, new_manager_id int, transfer_date date")
    assert rule("R32").violations({"employees": people, "transfers": moves}).count() == 0


def test_gate(spark):
    t = {"employees": spark.createDataFrame([(1, None, None, None, 1, 1)], EMPLOYEES).limit(0)}
    results = run_rules([rule("R01"), rule("R05")], t)
    with pytest.raises(RuleFailure, match="Employees count"):
        gate(results)


def test_scalars(spark):
    df = spark.createDataFrame([("1-1", "A_1", " \t "), ("02-29", "_", "x"), ("12-25", "a", None)], "md string, code string, text string")
    rows = df.select(X.is_month_day(F.col("md")).alias("m"), X.is_code(F.col("code")).alias("c"), X.is_blank(F.col("text")).alias("b")).collect()
    assert [tuple(r) for r in rows] == [(True, True, True), (False, False, False), (True, False, None)]


def test_upsert_twice_is_unchanged(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(2, None), (3, "z")], "k int, v string")
    new, log = ops.upsert(a, b, ["k"])
    assert sorted((r.k, r.action) for r in log.collect()) == [(2, "unchanged"), (3, "created")]
    assert {r.action for r in ops.upsert(new, b, ["k"])[1].collect()} == {"unchanged"}
