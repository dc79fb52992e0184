"""Reading source tables, raw batches and manifests."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import path_part
from .jdbc import JdbcSource

MANIFEST_KEYS = ("batch_id", "source_system", "source_schema", "tables")
MANIFEST = (
    "batch_id string, source_system string, source_schema string, batch_started_at_utc string, batch_completed_at_utc string, successful_tables int, failed_tables array<string>, "
    "tables array<struct<table_name: string, row_count: bigint, column_count: int, batch_id: string, extraction_id: string, extracted_at_utc: string, output_path: string>>"
)


class FileSource:
    """Tables as Parquet folders or files `root/<table>.parquet`."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def count(self, name: str) -> int:
        return self.read(name).count()

    def tables(self) -> DataFrame:
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(self.root).select("path")
        return found.select(F.regexp_extract("path", r"/([^/]+)\.parquet(?:/|$)", 1).alias("table_name")).where("table_name <> ''").distinct()


def require_table(source, name: str) -> None:
    if source.tables().where(F.col("table_name") == name).isEmpty():
        raise LookupError(f"the source has no table {name}")


def count_rows(source: FileSource | JdbcSource, name: str, allowed: tuple[str, ...] | None = None) -> int:
    """A table's rows: from the files' footers, or counted by the database, so that one row travels."""
    if allowed is not None and name not in allowed:
        raise ValueError(f"{name} is no table that may be counted")
    return source.count(name)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, modificationTime, length of all Parquet files below root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime", "length")
    return files.where(F.lower("path").endswith(".parquet"))


def with_batch_ids(files: DataFrame) -> DataFrame:
    """Adds prefix, extraction_date, batch_id (the extraction's id where a path has none) and extraction_id."""
    extraction = path_part(F.col("path"), "extraction_id")
    return files.withColumns({
        "prefix": F.regexp_extract("path", "^(.*/)[^/]*$", 1),
        "extraction_date": path_part(F.col("path"), "extraction_date"),
        "batch_id": F.coalesce(path_part(F.col("path"), "batch_id"), extraction),
        "extraction_id": extraction,
    })


def batches(files: DataFrame) -> DataFrame:
    """One row for each folder: ids, last_modified, file_count, paths."""
    found = with_batch_ids(files).groupBy("prefix", "extraction_date", "batch_id", "extraction_id")
    return found.agg(F.max("modificationTime").alias("last_modified"), F.count(F.lit(1)).alias("file_count"), F.sort_array(F.collect_list("path")).alias("paths"))


def latest_batch(files: DataFrame) -> DataFrame:
    """The newest folder by its files' times, the larger prefix if times are equal; ids are not compared."""
    return batches(files).orderBy(F.desc("last_modified"), F.desc("prefix")).limit(1)


def read_batch(spark: SparkSession, table_root: str, prefix: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.option("basePath", table_root).parquet(prefix)


def read_latest(spark: SparkSession, table_root: str, schema: StructType | None = None):
    """(rows, batch) of a table's newest batch."""
    batch = latest_batch(list_files(spark, table_root)).first()
    if batch is None:
        raise FileNotFoundError(f"no Parquet files below {table_root}")
    return read_batch(spark, table_root, batch.prefix, schema), batch


def read_manifest(spark: SparkSession, root: str, batch_id: str | None = None) -> DataFrame:
    """The manifest of a batch, or the newest one; fails when required keys are missing."""
    rows = spark.read.schema(MANIFEST).json(root).withColumn("_time", F.col("_metadata.file_modification_time"))
    rows = rows.where(F.col("batch_id") == batch_id) if batch_id else rows
    row = rows.orderBy(F.desc("_time"), F.desc("batch_id")).limit(1).drop("_time")
    found = row.select(*[F.col(k).isNull().alias(k) for k in MANIFEST_KEYS]).first()  # one row
    if found and (missing := [k for k in MANIFEST_KEYS if found[k]]):
        raise ValueError("the manifest lacks " + ", ".join(missing))
    return row


def manifest_tables(manifest: DataFrame) -> DataFrame:
    return manifest.select(F.explode("tables").alias("t")).select("t.*")


# The reference sets and their fields.
REFERENCE_SETS = {
    "business_units": "unit_name string, description string",
    "departments": "department_name string, cost_center string, business_unit string",
    "locations": "country string, city string, office_name string, timezone string",
    "job_roles": "role_name string, grade string, salary_band_min string, salary_band_max string",
    "attendance_statuses": "attendance_status_code string, attendance_status_name string, weight string, requires_clock_times string, absence_reason_required string",
    "genders": "gender_code string, gender_name string",
    "leave_types": "leave_type_code string, leave_type_name string, description string, paid string, requires_approval string",
    "employment_types": "employment_type_code string, employment_type_name string, description string",
    "exit_reasons": "exit_reason_code string, exit_reason_name string, voluntary string, weight string, reasons array<string>",
    "training_categories": "training_category_code string, training_category_name string, description string",
    "public_holidays": "holiday_code string, holiday_name string, month_day string, country_code string, active string",
    "absence_reasons": "absence_reason_code string, absence_reason_name string, description string",
}


def read_reference(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A reference set, a JSON list of objects at root/<name>.json, as text fields that the reference checks judge.

    Raises for an unknown name, a missing or empty file, malformed JSON, and anything but a list of objects.
    """
    if name not in REFERENCE_SETS:
        raise LookupError(f"unknown reference set {name}; there are: {', '.join(sorted(REFERENCE_SETS))}")
    try:
        text = spark.read.text(f"{root}/{name}.json", wholetext=True).where(F.trim("value") != "")
    except AnalysisException as e:
        raise FileNotFoundError(f"no reference set at {root}/{name}.json") from e
    parts = text.select(F.from_json("value", "array<string>").alias("records"), F.ltrim("value").startswith("[").alias("is_list"))
    seen = parts.agg(F.count(F.lit(1)).alias("n"), F.bool_and("is_list").alias("lists"), F.bool_or(F.col("records").isNull()).alias("broken"), F.bool_or(F.exists("records", lambda r: r.isNull() | ~F.ltrim(r).startswith("{"))).alias("others")).first()
    for fault, said in ((not seen.n, "is empty"), (seen.lists is False, "is no list"), (seen.broken, "is malformed"), (seen.others, "holds records that are no objects")):
        if fault:
            raise ValueError(f"reference set {name} {said}")
    return parts.select(F.explode("records").alias("r")).select(F.from_json("r", REFERENCE_SETS[name]).alias("r")).select("r.*")


def read_references(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: read_reference(spark, root, name) for name in REFERENCE_SETS}


SESSION = {"spark.sql.session.timeZone": "UTC", "spark.sql.parquet.mergeSchema": "false", "spark.sql.parquet.filterPushdown": "true", "spark.sql.sources.partitionOverwriteMode": "dynamic"}


def configure(spark: SparkSession, object_store: dict[str, str] | None = None) -> SparkSession:
    """Session settings; object_store gives endpoint, region and the like, as fs.s3a.* keys without their prefix."""
    for k, v in SESSION.items():
        spark.conf.set(k, v)
    if object_store:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for k, v in object_store.items():
            conf.set(f"fs.s3a.{k}", v)
        if conf.getClassByNameOrNull("org.apache.hadoop.fs.s3a.S3AFileSystem") is None:
            raise RuntimeError("the S3A connector is not on the class path")
    return spark
