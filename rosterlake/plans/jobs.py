"""Jobs: rules with reports and gate, raw batches, reference refresh."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import upsert
from ..sources.lake import FileSource, read_latest, read_manifest
from ..sources.sinks import extract_batch, publish_batch, write_report
from .fused import run_fused
from .raw_batch import require_valid, validate_batch
from .reference_rules import check_reference
from .rules import Rule, RuleFailure, gate, run_rules


def validate(tables: dict[str, DataFrame], as_of: date, report: str, rules: list[Rule] | None = None) -> DataFrame:
    """Runs the rules (all 41 if none are named), writes the report, then raises if a critical rule failed."""
    results = run_fused(tables, as_of) if rules is None else run_rules(rules, tables)
    write_report(results, report)
    kept = results.sparkSession.read.schema(results.schema).json(f"{report}/json")
    gate(kept)
    return kept


def raw_pipeline(spark: SparkSession, source: FileSource, root: str, lake: str, tables: list[str], system: str, schema: str) -> dict:
    """Extract, validate, publish; stops at the first failure."""
    manifest = extract_batch(spark, source, root, tables, system, schema)
    row = read_manifest(spark, f"{root}/_manifests", manifest["batch_id"]).first()
    results = validate_batch(spark, root, row, system, schema, tables, source)
    require_valid(results)
    return publish_batch(spark, root, lake, manifest, results)


def full_refresh(spark: SparkSession, checked: dict[str, DataFrame], as_of: date, report: str, rules: list[Rule] | None = None, **raw) -> dict:
    """Rules on the checked tables and their report, the gate, then extract, validation and publishing; a failed rule leaves nothing extracted."""
    validate(checked, as_of, report, rules)
    return raw_pipeline(spark, **raw)


def with_unit_ids(departments: DataFrame, units: DataFrame) -> DataFrame:
    """Departments with business_unit_id in place of the unit's name; null where no unit has it."""
    ids = units.select(F.col("unit_name").alias("_unit"), "business_unit_id")
    return departments.join(ids, departments["business_unit"] == ids["_unit"], "left").drop("_unit", "business_unit")


def refresh_reference(current: dict[str, DataFrame], incoming: dict[str, DataFrame], keys: dict[str, str]) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Checks the incoming reference tables, then upserts each; raises on any violation, before anything is changed.

    Departments name their business unit; where the stored table has business_unit_id, it is taken from the stored units.
    """
    bad = check_reference(incoming).limit(20).collect()
    if bad:
        raise RuleFailure("; ".join(f"{r.dataset}.{r.field} {r.rule} {r.record_key}" for r in bad))
    if "departments" in incoming and "business_unit_id" in current["departments"].columns:
        units = current["business_units"]
        names = units.join(incoming["departments"].select("business_unit").distinct(), units["unit_name"] == F.col("business_unit"), "right").where("business_unit_id IS NULL").limit(20).collect()
        if names:
            raise RuleFailure("business units without an id: " + ", ".join(str(r.business_unit) for r in names))
        incoming = incoming | {"departments": with_unit_ids(incoming["departments"], units)}
    return {name: upsert(current[name], df, [keys[name]]) for name, df in incoming.items()}


def latest_raw(spark: SparkSession, root: str, table: str):
    return read_latest(spark, f"{root}/{table}")
