"""Validation of a raw batch against its manifest and its source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import single_value
from ..sources.sinks import LINEAGE

INDEX_COLUMNS = ("index", "__index_level_0__")
RESULT = "table_name string, passed boolean, manifest_row_count long, parquet_row_count long, source_row_count long, errors array<string>"


def batch_errors(manifest, system: str, schema: str, expected: list[str]) -> list[str]:
    """Errors of the manifest itself (one row)."""
    out = []
    if manifest.source_system != system or manifest.source_schema != schema:
        out.append(f"source is {manifest.source_system}.{manifest.source_schema}, not {system}.{schema}")
    if manifest.failed_tables:
        out.append("failed tables: " + ", ".join(manifest.failed_tables))
    names = {t.table_name for t in manifest.tables}
    if missing := sorted(set(expected) - names):
        out.append("missing tables: " + ", ".join(missing))
    if more := sorted(names - set(expected)):
        out.append("unexpected tables: " + ", ".join(more))
    return out


def column_errors(schema: StructType) -> list[str]:
    names = schema.fieldNames()
    out = [f"missing column {c}" for c in LINEAGE if c not in names]
    return out + [f"index column {c}" for c in names if c in INDEX_COLUMNS or c.startswith("Unnamed:")]


def table_result(df: DataFrame, entry, system: str, schema: str, source_rows: int | None) -> DataFrame:
    """One row for a table: all its checks are one aggregate over one scan. entry is the manifest's row of it."""
    wrong = column_errors(df.schema)
    n = F.col("n")
    aggs, tests = [F.count(F.lit(1)).alias("n")], []
    expected = {"_source_system": system, "_source_schema": schema, "_source_table": entry.table_name, "_batch_id": entry.batch_id, "_extraction_id": entry.extraction_id}
    for c, value in expected.items():
        if c in df.columns:
            aggs.append(single_value(c, value).alias(f"v{c}"))
            tests.append(F.when((n > 0) & ~F.col(f"v{c}"), F.lit(f"{c} is not always {value}")))
    for c in LINEAGE:
        if c in df.columns:
            aggs.append(F.count_if(F.col(c).isNull()).alias(f"z{c}"))
            tests.append(F.when(F.col(f"z{c}") > 0, F.concat(F.lit(f"{c} is null in rows: "), F.col(f"z{c}").cast("string"))))
    tests.append(F.when(n != entry.row_count, F.concat(F.lit(f"the manifest has {entry.row_count} rows, the files "), n.cast("string"))))
    if source_rows is not None:
        tests.append(F.when(n != source_rows, F.concat(F.lit(f"the source has {source_rows} rows, the files "), n.cast("string"))))
    errors = F.array_compact(F.array(*[F.lit(e) for e in wrong], *tests))
    row = df.agg(*aggs).select(F.lit(entry.table_name).alias("table_name"), F.lit(entry.row_count).cast("long").alias("manifest_row_count"), n.alias("parquet_row_count"), F.lit(source_rows).cast("long").alias("source_row_count"), errors.alias("errors"))
    return row.select("table_name", (F.size("errors") == 0).alias("passed"), "manifest_row_count", "parquet_row_count", "source_row_count", "errors")


def validate_batch(spark: SparkSession, root: str, manifest, system: str, schema: str, expected: list[str], source=None) -> DataFrame:
    """Results of all tables, and a row for the batch's own errors, if any.

    A folder that is missing or cannot be read, by its schema or a broken page, is an error row of its table; the others go on.
    """
    done = [("(batch)", False, None, None, None, e)] if (e := batch_errors(manifest, system, schema, expected)) else []
    for t in manifest.tables:
        try:
            df = spark.read.option("basePath", f"{root}/{t.table_name}").parquet(t.output_path).drop("extraction_date", "batch_id", "extraction_id")
            # One row for each table of the manifest.
            done.append(tuple(table_result(df, t, system, schema, source.count(t.table_name) if source else None).first()))
        except Exception as x:  # noqa: BLE001  missing or broken files are a result, not a crash
            done.append((t.table_name, False, t.row_count, None, None, [f"cannot be read: {type(x).__name__}"]))
    return spark.createDataFrame(done, RESULT)


def batch_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("tables_checked"), F.count_if("passed").alias("tables_passed"), F.count_if(~F.col("passed")).alias("tables_failed"))


def require_valid(results: DataFrame) -> None:
    bad = results.where("NOT passed").orderBy("table_name").collect()
    if bad:
        raise ValueError("; ".join(f"{r.table_name}: {', '.join(r.errors)}" for r in bad))
