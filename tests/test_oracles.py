"""Queries against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [
    "Q2_run_rules_fused", "Q3_summary", "R31_employee_current_role_and_salary", "D10_reasons", "J3_anti_join", "N1_latest_per_key", "K6_K7_L2_publish", "K8_report", "K9_upsert", "S10_reference_sets",
    "V01_manifest_keys", "V01_V14_validate_batch", "V02_V12_failing_batches", "V14_summary_and_gate", "L1_validate", "L3_full_refresh", "L4_reference_refresh", "W03_prorated_pay", "W15_apply_events", "W25_hires_to_employees", "W26_other_manager",
    "P04_scd2", "P04_scd2_incremental", "P05_dim_manager", "P06_fact_surveys", "P07_headcount", "P07_movement", "P07_working_time", "P09_keywords", "P10_burnout_features", "P10_promotion_features", "P10_performance_features", "P10_payroll_forecast", "P11_assets", "P12_stream_windows", "P12_stream_upsert",
    "S1_jdbc_scan", "S1_jdbc_pushdown", "S2_jdbc_tables", "S9_jdbc_count", "K9_bucketed_upsert", "P12_bucketed_feed", "P12_stateful_rules", "L3_whole_refresh", "W23_reporting_lines", "W23_chains_and_cycles", "P02_fuzzy_conformity",
    "P04_late_department", "P04_late_manager", "P04_late_role", "P04_timeline", "P05_dim_employee_history", "P06_star_workforce", "P06_star_training", "P06_star_attrition", "P06_star_recruitment", "P09_collocations", "P09_keyphrases", "P09_learnt_lexicon",
    "P09_learnt_sentiment", "P10_survival_curve", "P10_vacancy_curve", "P10_vacancy_compared", "P10_seasonal_forecast", "P10_rolling_errors", "P10_absence_ranking", "P10_absence_calibration", "P11_column_lineage", "P13_keyed_tokens",
]


def rows(df):
    text = lambda v: None if pd.isna(v) else f"{float(v):.4f}" if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ in ("Decimal", "int64", "int32", "float64") else str(v).replace(" 00:00:00", "")
    return sorted(tuple(map(str, map(text, r))) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(entry.queries()[name](spark, SF).toPandas()) == rows(db.execute(entry.oracle_sql()[name]).df())
