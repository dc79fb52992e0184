"""Raw extracts, manifests, gated publishing and reports."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .lake import MANIFEST, list_files

LINEAGE = ("_source_system", "_source_schema", "_source_table", "_batch_id", "_extraction_id", "_extracted_at_utc")
PARTITIONS = ("extraction_date", "batch_id", "extraction_id")
UPLOAD = "batch_id string, source_system string, destination string, uploaded_at_utc string, uploaded_files int, uploaded_bytes bigint, files array<struct<table_name: string, path: string, file_size_bytes: bigint>>"


def stamp_lineage(df: DataFrame, system: str, schema: str, table: str, batch_id: str, extraction_id: str, at: datetime) -> DataFrame:
    values = (system, schema, table, batch_id, extraction_id, at)
    return df.withColumns({name: F.lit(v) for name, v in zip(LINEAGE, values)})


def write_raw(df: DataFrame, root: str, table: str) -> int:
    """Appends a stamped frame in folders by date, batch and extraction; returns the rows, counted while writing."""
    seen = Observation()
    parts = df.withColumns({"extraction_date": F.to_date("_extracted_at_utc"), "batch_id": F.col("_batch_id"), "extraction_id": F.col("_extraction_id")})
    parts.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").option("compression", "snappy").partitionBy(*PARTITIONS).parquet(f"{root}/{table}")
    return seen.get["n"]


def extract_table(source, root: str, table: str, batch_id: str, system: str, schema: str, now: datetime | None = None) -> dict:
    at, extraction_id = now or datetime.now(timezone.utc).replace(tzinfo=None), str(uuid.uuid4())
    df = stamp_lineage(source.read(table), system, schema, table, batch_id, extraction_id, at)
    rows = write_raw(df, root, table)
    path = f"{root}/{table}/extraction_date={at:%Y-%m-%d}/batch_id={batch_id}/extraction_id={extraction_id}"
    return {"table_name": table, "row_count": rows, "column_count": len(df.columns), "batch_id": batch_id, "extraction_id": extraction_id, "extracted_at_utc": at.isoformat(), "output_path": path}


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    spark.createDataFrame([manifest], MANIFEST).coalesce(1).write.mode("append").json(path)


def extract_batch(spark: SparkSession, source, root: str, tables: list[str], system: str, schema: str) -> dict:
    """All tables under one batch id. A failed table is listed and the others go on; the manifest is written, then it raises."""
    batch_id, started = str(uuid.uuid4()), datetime.now(timezone.utc).isoformat()
    done, failed = [], []
    for name in tables:
        try:
            done.append(extract_table(source, root, name, batch_id, system, schema))
        except Exception as e:  # noqa: BLE001  any failure of one table is reported with the batch
            failed.append(f"{name}: {type(e).__name__}")
    manifest = {"batch_id": batch_id, "source_system": system, "source_schema": schema, "batch_started_at_utc": started, "batch_completed_at_utc": datetime.now(timezone.utc).isoformat(), "successful_tables": len(done), "failed_tables": failed, "tables": done}
    write_manifest(spark, f"{root}/_manifests", manifest)
    if failed:
        raise RuntimeError(f"batch {batch_id}: {', '.join(failed)}")
    return manifest


def publish_batch(spark: SparkSession, root: str, lake: str, manifest: dict, results: DataFrame) -> dict:
    """Copies a valid batch to the lake, compares rows, and writes the extraction manifest and then the upload manifest.

    Of each table, the number of rows and the sum of their hashes must be those of the batch, and no file may be empty;
    only the folders of this batch are read.
    """
    bad = [r.table_name for r in results.where("NOT passed").select("table_name").collect()]
    if bad or manifest["failed_tables"]:
        raise RuntimeError(f"batch {manifest['batch_id']} is not valid: {', '.join(bad + list(manifest['failed_tables']))}")
    files = None
    for t in manifest["tables"]:
        rows = spark.read.option("basePath", f"{root}/{t['table_name']}").parquet(t["output_path"])
        target = f"{lake}/raw/{t['table_name']}"
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(target)
        arrived = f"{target}/{t['output_path'].removeprefix(root + '/' + t['table_name'] + '/')}"
        copied = fingerprint(spark.read.parquet(arrived))
        if copied.n != t["row_count"] or copied != fingerprint(spark.read.parquet(t["output_path"])):
            raise RuntimeError(f"{t['table_name']}: {copied.n} rows arrived, not the {t['row_count']} of the batch")
        found = list_files(spark, arrived).withColumn("table_name", F.lit(t["table_name"]))
        files = found if files is None else files.unionByName(found)
    named = files.select("table_name", "path", F.col("length").alias("file_size_bytes"))
    if not named.where("file_size_bytes = 0").isEmpty():
        raise RuntimeError(f"batch {manifest['batch_id']}: an empty file arrived")
    write_manifest(spark, f"{lake}/_manifests", manifest)
    upload = upload_manifest(named, manifest["batch_id"], manifest["source_system"], lake)
    upload.write.mode("append").json(f"{lake}/_uploads")
    return upload.first().asDict(recursive=True)


def fingerprint(df: DataFrame):
    """n and a sum over all rows that does not depend on their order."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("hashes")).first()


def upload_manifest(files: DataFrame, batch_id: str, system: str, destination: str) -> DataFrame:
    """One row with the totals and the list of files of a batch."""
    got = files.agg(F.count(F.lit(1)).cast("int").alias("uploaded_files"), F.coalesce(F.sum("file_size_bytes"), F.lit(0)).cast("long").alias("uploaded_bytes"), F.sort_array(F.collect_list(F.struct("table_name", "path", "file_size_bytes"))).alias("files"))
    return got.select(F.lit(batch_id).alias("batch_id"), F.lit(system).alias("source_system"), F.lit(destination).alias("destination"), F.current_timestamp().cast("string").alias("uploaded_at_utc"), "uploaded_files", "uploaded_bytes", "files")


def write_report(results: DataFrame, path: str) -> None:
    columns = results.select("check_name", "passed", "record_count", "severity")
    columns.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    columns.coalesce(1).write.mode("overwrite").json(f"{path}/json")
