"""Sources, sinks and jobs where they must fail."""

import datetime

import pytest

from rosterlake import streaming
from rosterlake.operators import upsert
from rosterlake.plans import fused, jobs, lake, raw_batch, reference_rules
from rosterlake.plans.rules import RuleFailure
from rosterlake.sources import lake as sources
from rosterlake.sources import sinks


def test_session_settings(spark):
    sources.configure(spark)
    assert all(spark.conf.get(k) == v for k, v in sources.SESSION.items())
    with pytest.raises(RuntimeError, match="S3A"):
        sources.configure(spark, {"endpoint": "http://localhost"})
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")


@pytest.mark.parametrize("text,said", [("", "empty"), ("  ", "empty"), ('{"gender_code": "F"}', "no list"), ("[1, 2]", "no objects"), ('["x"]', "no objects"), ("[null]", "no objects"), ('[{"gender_code"', "malformed")])
def test_reference_faults(spark, tmp_path, text, said):
    (tmp_path / "genders.json").write_text(text)
    with pytest.raises(ValueError, match=said):
        sources.read_reference(spark, str(tmp_path), "genders")


def test_reference_sets(spark, tmp_path):
    for name, schema in sources.REFERENCE_SETS.items():
        fields = [f.split(" ") for f in schema.split(", ")]
        (tmp_path / f"{name}.json").write_text('[{' + ", ".join(f'"{n}": ' + ('["a"]' if t.startswith("array") else '"x"') for n, t in fields) + "}]")
    got = sources.read_references(spark, str(tmp_path))
    assert len(got) == 12 and got.keys() == reference_rules.REQUIRED.keys() == reference_rules.UNIQUE.keys()
    assert all(set(reference_rules.REQUIRED[n]) <= set(df.columns) and df.count() == 1 for n, df in got.items())


def test_failed_batch_leaves_a_manifest(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in/a.parquet")
    with pytest.raises(RuntimeError, match="nothing"):
        sinks.extract_batch(spark, sources.FileSource(spark, f"{tmp_path}/in"), f"{tmp_path}/out", ["nothing", "a"], "x", "y")
    row = sources.read_manifest(spark, f"{tmp_path}/out/_manifests").first()
    assert (row.successful_tables, len(row.failed_tables), row.tables[0].row_count) == (1, 1, 3)
    with pytest.raises(RuntimeError, match="not valid"):
        sinks.publish_batch(spark, f"{tmp_path}/out", f"{tmp_path}/lake", row.asDict(recursive=True), spark.createDataFrame([], raw_batch.RESULT))
    with pytest.raises(LookupError):
        sources.require_table(sources.FileSource(spark, f"{tmp_path}/in"), "nothing")
    with pytest.raises(ValueError):
        sources.count_rows(sources.FileSource(spark, f"{tmp_path}/in"), "a", ("b",))


def test_broken_page_is_one_tables_fault(spark, tmp_path):
    for n in ("a", "b"):
        spark.range(1000).coalesce(1).write.option("compression", "none").parquet(f"{tmp_path}/in/{n}.parquet")
    sinks.extract_batch(spark, sources.FileSource(spark, f"{tmp_path}/in"), f"{tmp_path}/out", ["a", "b"], "x", "y")
    [file] = (tmp_path / "out" / "a").rglob("part-*.parquet")
    raw = bytearray(file.read_bytes())
    end = len(raw) - 8 - int.from_bytes(raw[-8:-4], "little")
    raw[4:end] = b"\xff" * (end - 4)  # all pages; the footer stays
    file.write_bytes(raw)
    [crc] = (tmp_path / "out" / "a").rglob(".part-*.crc")
    crc.unlink()
    row = sources.read_manifest(spark, f"{tmp_path}/out/_manifests").first()
    got = {r.table_name: r for r in raw_batch.validate_batch(spark, f"{tmp_path}/out", row, "x", "y", ["a", "b"]).collect()}
    assert not got["a"].passed and got["b"].passed
    with pytest.raises(ValueError, match="a: "):
        raw_batch.require_valid(spark.createDataFrame(list(got.values()), raw_batch.RESULT))


def test_bronze_structure(spark):
    from pyspark.sql.types import StructType

    raw = spark.createDataFrame([("1", "x"), (None, "2")], "a string, b string")
    said = lake.structural_errors(raw, StructType.fromDDL("a int, b int, c int"))
    assert said == ["missing column c", "b has values that are no int: 1"]


def test_reference_refresh_needs_known_units(spark):
    units = spark.createDataFrame([("U", 7)], "unit_name string, business_unit_id long")
    stored = spark.createDataFrame([("D", "1", 7)], "department_name string, cost_center string, business_unit_id long")
    incoming = lambda unit, cost: {"departments": spark.createDataFrame([("D", "1", "U"), ("E", cost, unit)], "department_name string, cost_center string, business_unit string")}
    new, log = jobs.refresh_reference({"departments": stored, "business_units": units}, incoming("U", "2"), {"departments": "department_name"})["departments"]
    assert sorted(map(tuple, new.collect())) == [("D", "1", 7), ("E", "2", 7)] and {tuple(r) for r in log.collect()} == {("D", "unchanged"), ("E", "created")}
    for unit, cost in (("V", "2"), ("U", "1")):  # no such unit; a cost center twice
        with pytest.raises(RuleFailure):
            jobs.refresh_reference({"departments": stored, "business_units": units}, incoming(unit, cost), {"departments": "department_name"})


def test_changes_and_upserts(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    feed = spark.createDataFrame([(1, "x", 1, "U"), (1, "y", 2, "U"), (2, "b", 3, "D"), (4, "d", 4, "U"), (4, "d", 5, "D"), (5, "e", 6, "U")], "k long, v string, at long, op string")
    assert sorted(map(tuple, streaming.apply_changes(table, feed, ["k"], ["at"]).collect())) == [(1, "y"), (3, "c"), (5, "e")]
    with pytest.raises(Exception, match="twice"):
        upsert(table, table.unionAll(table), ["k"])[0].collect()


def test_fused_rules_without_all_tables(spark):
    people = spark.createDataFrame([(1, "n1", "e1", None, True, 10.0)], "employee_id int, employee_number string, email string, manager_id int, is_manager boolean, annual_salary double").selectExpr("*", "DATE '2020-01-01' AS hire_date", "CAST(NULL AS DATE) AS termination_date", "true AS is_active", "'Active' AS employment_status")
    got = {r.check_name: r.passed for r in fused.run_fused({"employees": people}, datetime.date(2024, 6, 30)).collect()}
    assert len(got) == 7 and all(got.values())
