"""Sources, sinks, raw batches, lake jobs and streams on the given tables."""

from __future__ import annotations

import tempfile
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import streaming
from ..plans import derive, jobs, lake, operational, raw_batch
from ..plans.rules import RuleFailure, run_rules
from ..sources import lake as sources
from ..sources import sinks
from . import rule_bindings, views

AS_OF = date(2024, 6, 30)
c = F.col


def scratch(spark: SparkSession) -> str:
    """A folder of this run in the cluster's shared folder; a local one where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lake-{uuid.uuid4().hex}"


def extracted(spark: SparkSession, sf_dir: str, table: str) -> tuple[str, dict]:
    """A raw batch of one table."""
    root = scratch(spark)
    return root, sinks.extract_batch(spark, sources.FileSource(spark, sf_dir), root, [table], "warehouse", "public")


def s1_scan(spark, sf_dir) -> DataFrame:
    return sources.FileSource(spark, sf_dir).read("orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last"))


def s2_tables(spark, sf_dir) -> DataFrame:
    return sources.FileSource(spark, sf_dir).tables().where(c("table_name").isin("orders", "customer", "lineitem"))


def s3_s7_latest(spark, sf_dir) -> DataFrame:
    """Two batches; the rows of the newest one."""
    root, _ = extracted(spark, sf_dir, "nation")
    source = sources.FileSource(spark, sf_dir)
    sinks.extract_table(source, root, "nation", "second", "warehouse", "public")
    rows, batch = sources.read_latest(spark, f"{root}/nation")
    return rows.select("n_nationkey", "n_name", c("batch_id").cast("string").alias("batch_id"), F.lit(batch.file_count > 0).alias("has_files"))


def s8_manifest(spark, sf_dir) -> DataFrame:
    root, manifest = extracted(spark, sf_dir, "orders")
    return sources.manifest_tables(sources.read_manifest(spark, f"{root}/_manifests", manifest["batch_id"])).select("table_name", "row_count", "column_count")


def k1_k3_extract(spark, sf_dir) -> DataFrame:
    root, _ = extracted(spark, sf_dir, "customer")
    rows = spark.read.parquet(f"{root}/customer")
    return rows.groupBy("_source_system", "_source_table").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_batch_id").alias("batches"), F.count("_extracted_at_utc").alias("stamped"))


def k6_publish(spark, sf_dir) -> DataFrame:
    """Extract, validate, publish, and read what arrived."""
    root, manifest = extracted(spark, sf_dir, "part")
    row = sources.read_manifest(spark, f"{root}/_manifests").first()
    results = raw_batch.validate_batch(spark, root, row, "warehouse", "public", ["part"], sources.FileSource(spark, sf_dir))
    target = scratch(spark)
    sinks.publish_batch(spark, root, target, manifest, results)
    return spark.read.parquet(f"{target}/raw/part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


def k8_report(spark, sf_dir) -> DataFrame:
    t = views.tables(spark, sf_dir, "employees")
    rules = [r for r in operational.operational_rules(AS_OF) if r.needs == ("employees",)]
    path = scratch(spark)
    sinks.write_report(run_rules(rules, t), path)
    return spark.read.schema("check_name string, passed boolean, record_count long, severity string").option("header", True).csv(f"{path}/csv")


def v_results(spark, sf_dir) -> DataFrame:
    """A batch whose manifest says one row too many."""
    root, manifest = extracted(spark, sf_dir, "supplier")
    row = sources.read_manifest(spark, f"{root}/_manifests", manifest["batch_id"]).withColumn("tables", F.transform("tables", lambda x: x.withField("row_count", x["row_count"] + 1))).first()
    out = raw_batch.validate_batch(spark, root, row, "warehouse", "public", ["supplier", "nation"], sources.FileSource(spark, sf_dir))
    return out.select("table_name", "passed", "manifest_row_count", "parquet_row_count", "source_row_count", F.size("errors").alias("errors"))


def v01_keys(spark, sf_dir) -> DataFrame:
    """Which of two manifests can be read: that of a batch of orders, and the same without its source."""
    root, manifest = extracted(spark, sf_dir, "orders")
    rows = []
    for name, found in (("whole", manifest), ("lacking", {k: v for k, v in manifest.items() if k != "source_system"} | {"source_system": None})):
        sinks.write_manifest(spark, f"{root}/{name}", found)
        try:
            n = sources.manifest_tables(sources.read_manifest(spark, f"{root}/{name}")).first().row_count
            rows.append((name, n, None))
        except ValueError as e:
            rows.append((name, None, str(e)))
    return spark.createDataFrame(rows, "manifest string, row_count long, error string")


def v_cases(spark, sf_dir) -> DataFrame:
    """What validation says of batches of suppliers with one fault each: case, table_name, passed, rows read, error."""
    base, manifest = extracted(spark, sf_dir, "supplier")
    good = manifest["tables"][0]
    parts = ["extraction_date", "batch_id", "extraction_id"]
    whole = spark.read.parquet(good["output_path"])
    results = []  # a row or two for each case

    def case(name: str, rows: DataFrame | None = None, broken: bool = False, source=None, **changed) -> None:
        root, entry = base, dict(good)
        if rows is not None or broken:
            root = scratch(spark)
            entry["output_path"] = f"{root}/supplier/" + "/".join(f"{p}=x" for p in parts)
        if rows is not None:
            rows.write.parquet(entry["output_path"])
        if broken:
            spark.range(1).selectExpr("'no Parquet' AS value").write.text(entry["output_path"])
        tables = changed.pop("tables", [entry])
        sinks.write_manifest(spark, f"{root}/case-{name}", manifest | {"tables": tables} | changed)
        row = sources.read_manifest(spark, f"{root}/case-{name}").first()
        got = raw_batch.validate_batch(spark, root, row, "warehouse", "public", ["supplier"], source)
        got = got.select(F.lit(name).alias("case"), "table_name", "passed", "parquet_row_count", F.size("errors").alias("errors"), F.regexp_extract(F.get("errors", F.lit(0)), "^[^:,]*", 0).alias("error"))
        results.extend(map(tuple, got.collect()))

    case("V02", source_schema="other")
    case("V03", failed_tables=["part: IOError"])
    case("V04", tables=[good, dict(good, table_name="part")])
    case("V05", tables=[dict(good, output_path=f"{base}/nowhere")])
    case("V06", broken=True)
    case("V07", whole.drop("_batch_id"))
    case("V08", whole.withColumn("__index_level_0__", F.lit(1)).withColumn("Unnamed: 0", F.lit(1)))
    case("V09", tables=[dict(good, row_count=good["row_count"] + 2)])
    case("V10", whole.withColumn("_source_system", F.when(c("s_suppkey") % 2 == 0, "elsewhere").otherwise(c("_source_system"))))
    case("V11", whole.withColumn("_extracted_at_utc", F.when(c("s_suppkey") % 2 == 0, c("_extracted_at_utc"))))
    case("V12", source=sources.FileSource(spark, sf_dir), rows=whole.where("s_suppkey % 2 = 0"))
    return spark.createDataFrame(results, "case string, table_name string, passed boolean, parquet_row_count long, errors int, error string")


V_CASES = """WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE s_suppkey % 2 = 0) AS even FROM supplier)
 SELECT v."case", v.table_name, v.passed, CASE v.rows WHEN 'n' THEN n WHEN 'even' THEN even END AS parquet_row_count, CAST(v.errors AS INT) AS errors, CASE v.error WHEN '+2' THEN 'the manifest has ' || (n + 2) || ' rows' WHEN '+0' THEN 'the manifest has ' || n || ' rows' ELSE v.error END AS error FROM n, (VALUES
 ('V02', '(batch)', false, NULL, 1, 'source is warehouse.other'), ('V02', 'supplier', true, 'n', 0, NULL),
 ('V03', '(batch)', false, NULL, 1, 'failed tables'), ('V03', 'supplier', true, 'n', 0, NULL),
 ('V04', '(batch)', false, NULL, 1, 'unexpected tables'), ('V04', 'supplier', true, 'n', 0, NULL), ('V04', 'part', false, NULL, 1, 'cannot be read'),
 ('V05', 'supplier', false, NULL, 1, 'cannot be read'), ('V06', 'supplier', false, NULL, 1, 'cannot be read'),
 ('V07', 'supplier', false, 'n', 1, 'missing column _batch_id'), ('V08', 'supplier', false, 'n', 2, 'index column __index_level_0__'),
 ('V09', 'supplier', false, 'n', 1, '+2'), ('V10', 'supplier', false, 'n', 1, '_source_system is not always warehouse'),
 ('V11', 'supplier', false, 'n', 1, '_extracted_at_utc is null in rows'), ('V12', 'supplier', false, 'even', 2, '+0')) AS v("case", table_name, passed, rows, errors, error)"""


def v14_raise(spark, sf_dir) -> DataFrame:
    """The summary of a batch with a fault, and whether the gate names the table."""
    root, manifest = extracted(spark, sf_dir, "region")
    row = sources.read_manifest(spark, f"{root}/_manifests").withColumn("tables", F.transform("tables", lambda x: x.withField("row_count", x["row_count"] + 1))).first()
    results = raw_batch.validate_batch(spark, root, row, "warehouse", "public", ["region"])
    try:
        raw_batch.require_valid(results)
        said = "nothing"
    except ValueError as e:
        said = str(e).split(":")[0]
    return raw_batch.batch_summary(results).withColumn("raised", F.lit(said))


def s9_count(spark, sf_dir) -> DataFrame:
    source = sources.FileSource(spark, sf_dir)
    return spark.createDataFrame([(n, sources.count_rows(source, n, ("orders", "customer"))) for n in ("orders", "customer")], "table_name string, row_count long")


def reference_files(t, folder: str) -> None:
    """Some of the views as reference sets: JSON lists."""
    for name in ("public_holidays", "exit_reasons", "business_units", "departments"):
        if name in t:
            names = [f.split(" ")[0] for f in sources.REFERENCE_SETS[name].split(", ")]
            t[name].select(F.struct(*[x for x in names if x in t[name].columns]).alias("r")).agg(F.to_json(F.collect_list("r")).alias("value")).write.text(f"{folder}/{name}.json")


def s10_reference(t) -> DataFrame:
    spark = t["public_holidays"].sparkSession
    folder = scratch(spark)
    reference_files(t, folder)
    rows = sources.read_reference(spark, folder, "exit_reasons").select("exit_reason_name", "weight", F.size("reasons").alias("reasons"))
    for name in ("weather", "genders"):
        try:
            sources.read_reference(spark, folder, name)
        except (LookupError, FileNotFoundError) as e:
            rows = rows.unionByName(spark.createDataFrame([(f"{name}: {type(e).__name__}", None, None)], "exit_reason_name string, weight string, reasons int"))
    return rows


def l1_validate(t) -> DataFrame:
    """The report that the job leaves behind, though it raises for critical failures."""
    spark = t["employees"].sparkSession
    path = scratch(spark)
    try:
        jobs.validate(t, AS_OF, path)
    except RuleFailure:
        pass
    return spark.read.schema("check_name string, passed boolean, record_count long, severity string").json(f"{path}/json")


def l3_refresh(spark, sf_dir) -> DataFrame:
    """Rules that pass, then extract, validate and publish; what arrived."""
    employees = views.tables(spark, sf_dir, "employees")
    root, target = scratch(spark), scratch(spark)
    rules = [r for r in operational.operational_rules(AS_OF) if r.id in ("R01", "R07", "R08")]
    jobs.gate(run_rules(rules, employees))
    done = jobs.raw_pipeline(spark, sources.FileSource(spark, sf_dir), root, target, ["nation", "region"], "warehouse", "public")
    got = [spark.read.parquet(f"{target}/raw/{n}").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n in ("nation", "region")]
    manifests = sources.manifest_tables(sources.read_manifest(spark, f"{target}/_manifests", done["batch_id"])).select("table_name", "row_count")
    return got[0].unionByName(got[1]).join(manifests, "table_name").select("table_name", "rows", "row_count")


def l4_refresh(t) -> DataFrame:
    """Clean departments with their units' ids against stored ones, of which one is old and one is missing."""
    spark = t["departments"].sparkSession
    units = t["business_units"].select("unit_name", F.length("unit_name").cast("long").alias("business_unit_id"))
    incoming = t["departments"].where("trim(cost_center) <> '' AND business_unit <> 'Nowhere'").select("department_name", "cost_center", "business_unit")
    folder = scratch(spark)
    reference_files({"departments": incoming}, folder)
    incoming = sources.read_reference(spark, folder, "departments")
    stored = jobs.with_unit_ids(incoming, units).where("department_name <> 'CHINA' AND department_name <> 'NATION_1'").withColumn("cost_center", F.when(c("department_name").endswith("A"), "old").otherwise(c("cost_center")))
    new, log = jobs.refresh_reference({"departments": stored, "business_units": units}, {"departments": incoming}, {"departments": "department_name"})["departments"]
    return new.join(log, "department_name").select("department_name", "cost_center", "business_unit_id", "action")


L4 = """SELECT department_name, cost_center, CAST(length(business_unit) AS BIGINT) AS business_unit_id,
 CASE WHEN department_name IN ('CHINA', 'NATION_1') THEN 'created' WHEN department_name LIKE '%A' THEN 'updated' ELSE 'unchanged' END AS action
 FROM departments WHERE trim(cost_center) <> '' AND business_unit <> 'Nowhere'"""


def l5_latest(spark, sf_dir) -> DataFrame:
    root, _ = extracted(spark, sf_dir, "customer")
    rows, batch = jobs.latest_raw(spark, root, "customer")
    return rows.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).withColumn("files", F.lit(batch.file_count > 0))


def p1_bronze(spark, sf_dir) -> DataFrame:
    """The same batch written twice."""
    root, _ = extracted(spark, sf_dir, "orders")
    raw = spark.read.option("basePath", f"{root}/orders").parquet(f"{root}/orders")
    schema = StructType.fromDDL("o_orderkey int, o_totalprice decimal(12,2), o_orderdate date")
    if faults := lake.structural_errors(raw, schema):
        raise ValueError("; ".join(faults))
    path = scratch(spark)
    for _ in range(2):
        lake.write_bronze(lake.bronze(raw, schema), path)
    return spark.read.parquet(path).groupBy("o_orderdate").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").cast("decimal(18,2)").alias("total"))


def scd(t) -> DataFrame:
    return lake.scd2(t["transfers"], "employee_id", "transfer_date", ("new_department_id", "new_location_id"))


SCD_OF = ("employee_id", "transfer_date", ("new_department_id", "new_location_id"))
SCD = """WITH r AS (SELECT employee_id, transfer_date AS d, max((new_department_id, new_location_id)) AS s FROM transfers GROUP BY 1, 2),
 l AS (SELECT *, lag(s) OVER w AS p, row_number() OVER w AS k FROM r WINDOW w AS (PARTITION BY employee_id ORDER BY d)),
 v AS (SELECT employee_id, s[1] AS new_department_id, s[2] AS new_location_id, d AS effective_from, lead(d) OVER w AS effective_to, row_number() OVER w AS version FROM l WHERE k = 1 OR s IS DISTINCT FROM p WINDOW w AS (PARTITION BY employee_id ORDER BY d))"""


def streamed(spark, sf_dir, once: bool) -> DataFrame:
    path = scratch(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", c("ts").cast("timestamp"))
    events.repartitionByRange(4, "ts").write.parquet(f"{path}/in")  # several files
    stream = spark.readStream.schema(events.schema).parquet(f"{path}/in")
    if once:
        out = streaming.once(stream.union(stream), ["event_id"]).select("event_id", "user_id")
        streaming.available_now(out, f"{path}/out", f"{path}/check")
    else:
        streaming.available_now(streaming.windowed_counts(stream), f"{path}/out", f"{path}/check")
    return spark.read.parquet(f"{path}/out")


def p12_windows(spark, sf_dir) -> DataFrame:
    """The windows that the watermark has closed; a stream leaves the last ones open."""
    return streamed(spark, sf_dir, False).select("window_start", "event_type", "n")


def changed_by_stream(spark, sf_dir, deletes: bool) -> DataFrame:
    """A table of users kept up to date by the stream of events, as an upsert or as a change feed with deletions."""
    path = scratch(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type", F.when(c("event_type") == "error", "D").otherwise("U").alias("op"))
    events.repartition(3, "event_id").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    kept = ["user_id", "event_id", "event_type"]
    versions = [f"{path}/table-start"]
    # Before the stream, users have no event.
    events.select("user_id").distinct().select("user_id", F.lit(-1).cast("long").alias("event_id"), F.lit("none").alias("event_type")).write.parquet(versions[0])
    load = lambda: spark.read.parquet(versions[-1])

    def store(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/table-{number}")
        versions.append(f"{path}/table-{number}")

    if deletes:
        streaming.change_stream(stream, ["user_id"], ["event_id"], load, store, f"{path}/check")
        return load().select(F.col("user_id") % 10 == 0).toDF("tenth").groupBy("tenth").agg(F.count(F.lit(1)).alias("users"))
    streaming.upsert_stream(stream.select(*kept), ["user_id"], ["event_id"], load, store, f"{path}/check")
    return load().groupBy(F.col("event_id") >= 0).agg(F.count(F.lit(1)).alias("users")).toDF("seen", "users")


def p12_upsert(spark, sf_dir) -> DataFrame:
    return changed_by_stream(spark, sf_dir, False)


def p12_once(spark, sf_dir) -> DataFrame:
    return streamed(spark, sf_dir, True)


def p12_rules(spark, sf_dir) -> DataFrame:
    path = scratch(spark)
    t = views.tables(spark, sf_dir, "employees", "attendance")
    t["attendance"].write.parquet(f"{path}/in")
    stream = spark.readStream.schema(t["attendance"].schema).parquet(f"{path}/in")
    rules = [r for r in operational.operational_rules(AS_OF) if r.id in ("R02", "R12", "R33")]
    streaming.rules_on_stream(stream, "attendance", rules, {"employees": t["employees"]}, f"{path}/out", f"{path}/check")
    return spark.read.parquet(f"{path}/out").groupBy("check_name").agg(F.sum("record_count").alias("record_count"))


def p9_sentiment(t) -> DataFrame:
    lexicon = t["region"].sparkSession.createDataFrame([("the", 1), ("and", -1), ("of", 2)], "word string, weight long")
    return lake.lexicon_sentiment(t["documents"], lexicon, "doc_id", "text")


def p10_model(t) -> DataFrame:
    features = lake.attrition_features(t["employees"], t["attendance"], AS_OF)
    return lake.attrition_risk(features, lake.attrition_model(features)).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("risk"), 4).alias("risk"))


MIDDLE, TURN = date(2024, 1, 16), date(1998, 7, 1)


def p10_burnout(t) -> DataFrame:
    return lake.burnout_features(t["employees"], t["attendance"], t["leave_requests"], t["employee_surveys"], MIDDLE)


def p10_promotion(t) -> DataFrame:
    return lake.promotion_features(t["employees"], t["promotions"], t["transfers"], t["leave_requests"], TURN)


def p10_performance(t) -> DataFrame:
    return lake.performance_features(t["employees"], t["performance_reviews"], t["attendance"], t["training"], MIDDLE)


def p10_risk(t, make, columns) -> DataFrame:
    features = make(t)
    return lake.attrition_risk(features, lake.attrition_model(features, columns)).select("employee_id", "label", F.round("risk", 4).alias("risk"))


def p10_ratings(t) -> DataFrame:
    features = p10_performance(t)
    return lake.expected(features, lake.rating_model(features)).select("employee_id", "label", F.round("expected", 4).alias("expected"))


def p10_forecast(t) -> DataFrame:
    pay = t["payroll"].join(t["employees"].select("employee_id", "department_id"), "employee_id")
    return lake.trend_forecast(lake.monthly(pay, "department_id", "pay_period_start", c("gross_pay") / 1000), "department_id")


BURNOUT = """WITH a AS (SELECT employee_id, count(*) AS days, count(*) FILTER (WHERE status = 'Absent') AS absences, round(coalesce(sum((clock_out_sec - clock_in_sec + 86400) % 86400), 0) / 3600, 6) AS hours FROM attendance WHERE work_date < DATE '2024-01-16' GROUP BY 1),
l AS (SELECT employee_id, count(*) AS leaves FROM leave_requests WHERE start_date < DATE '2024-01-16' GROUP BY 1),
w AS (SELECT employee_id, round(avg(CAST(wellbeing_score AS DOUBLE)) FILTER (WHERE survey_date < DATE '2024-01-16'), 6) AS wellbeing, round(avg(CAST(wellbeing_score AS DOUBLE)) FILTER (WHERE survey_date >= DATE '2024-01-16'), 6) AS later FROM employee_surveys GROUP BY 1)
SELECT e.employee_id, coalesce(days, 0) AS days, coalesce(absences, 0) AS absences, coalesce(hours, 0) AS hours, coalesce(leaves, 0) AS leaves, coalesce(wellbeing, 2.5) AS wellbeing, CAST(later <= 2.5 AS INT) AS label
FROM employees AS e LEFT JOIN a USING (employee_id) LEFT JOIN l USING (employee_id) JOIN w USING (employee_id) WHERE later IS NOT NULL"""
PROMOTION = """WITH p AS (SELECT employee_id, count(*) FILTER (WHERE promotion_date < DATE '1998-07-01') AS promotions, count(*) FILTER (WHERE promotion_date >= DATE '1998-07-01') AS later FROM promotions GROUP BY 1),
m AS (SELECT employee_id, count(*) AS transfers FROM transfers WHERE transfer_date < DATE '1998-07-01' GROUP BY 1),
l AS (SELECT employee_id, count(*) AS leaves FROM leave_requests WHERE start_date < DATE '1998-07-01' GROUP BY 1)
SELECT e.employee_id, CAST(date_diff('day', hire_date, DATE '1998-07-01') AS INT) AS tenure_days, CAST(annual_salary AS DOUBLE) AS salary, coalesce(promotions, 0) AS promotions, coalesce(transfers, 0) AS transfers, coalesce(leaves, 0) AS leaves, CAST(coalesce(later, 0) > 0 AS INT) AS label
FROM employees AS e LEFT JOIN p USING (employee_id) LEFT JOIN m USING (employee_id) LEFT JOIN l USING (employee_id)"""
PERFORMANCE = """WITH r AS (SELECT employee_id, round(avg(CAST(overall_rating AS DOUBLE)) FILTER (WHERE review_date < DATE '2024-01-16'), 6) AS rating, count(*) FILTER (WHERE review_date < DATE '2024-01-16') AS reviews, round(avg(CAST(overall_rating AS DOUBLE)) FILTER (WHERE review_date >= DATE '2024-01-16'), 6) AS label FROM performance_reviews GROUP BY 1),
a AS (SELECT employee_id, count(*) FILTER (WHERE status = 'Absent') AS absences FROM attendance WHERE work_date < DATE '2024-01-16' GROUP BY 1),
c AS (SELECT employee_id, count(*) AS courses FROM training WHERE completion_date < DATE '2024-01-16' GROUP BY 1)
SELECT e.employee_id, rating, reviews, coalesce(absences, 0) AS absences, coalesce(courses, 0) AS courses, label
FROM employees AS e JOIN r USING (employee_id) LEFT JOIN a USING (employee_id) LEFT JOIN c USING (employee_id) WHERE rating IS NOT NULL AND label IS NOT NULL"""
FORECAST = """WITH s AS (SELECT department_id, year(pay_period_start) * 12 + month(pay_period_start) - 1 AS month, CAST(sum(gross_pay) AS DOUBLE) / 1000 AS value FROM payroll JOIN employees USING (employee_id) GROUP BY 1, 2),
f AS (SELECT department_id, CASE WHEN count(*) > 1 THEN regr_slope(value, month) ELSE 0 END AS slope, avg(value) AS mean_value, avg(month) AS mean_month, max(month) AS last FROM s GROUP BY 1),
x AS (SELECT *, last + k AS month FROM f, (VALUES (1), (2), (3)) AS n(k))
SELECT department_id, make_date(month // 12, month % 12 + 1, 1) AS month_start, round(mean_value + slope * (month - mean_month), 3) AS forecast FROM x"""


def facts(t) -> DataFrame:
    rows = lake.point_in_time(t["attendance"], scd(t), "employee_id", "work_date", ("new_department_id",))
    return rows.groupBy("at_new_department_id").agg(F.count(F.lit(1)).alias("n"), F.sum("attendance_id").alias("ids"))


def p9_emotions(t) -> DataFrame:
    lexicon = t["documents"].sparkSession.createDataFrame([("the", "calm"), ("and", "joy"), ("of", "calm")], "word string, label string")
    return lake.lexicon_labels(t["documents"], lexicon, "doc_id", "text")


def p9_themes(t) -> DataFrame:
    theme = derive.survey_theme(*(c(x) for x in ("career_growth_score", "manager_support_score", "wellbeing_score", "work_life_balance_score", "engagement_score", "satisfaction_score")))
    rows = t["employee_surveys"].select("employee_id", theme.alias("theme")).join(t["employees"].select("employee_id", "department_id"), "employee_id")
    return rows.groupBy("department_id", "theme").agg(F.count(F.lit(1)).alias("surveys"))


ASSETS = {"employees": "customer", "attendance": "events", "payroll": "lineitem", "promotions": "orders"}
ASSET_COLUMNS = {"employees": 13, "attendance": 6, "payroll": 7, "promotions": 5}


def p11_assets(t) -> DataFrame:
    """Size, source and check results of four tables."""
    rules = operational.operational_rules(AS_OF)
    return lake.asset_report({n: t[n] for n in ASSETS}, jobs.run_fused(t, AS_OF), {r.name: r.needs for r in rules}, ASSETS)


P11 = "WITH r AS (" + " UNION ALL ".join(rule_bindings.result_sql(r) for r in operational.operational_rules(AS_OF)) + "), u AS (SELECT * FROM (VALUES " + ", ".join(f"('{r.name}', '{n}')" for r in operational.operational_rules(AS_OF) for n in r.needs) + ") AS v(check_name, used)), k AS (SELECT used, count(*) AS checks, count(*) FILTER (WHERE NOT passed) AS failed FROM r JOIN u USING (check_name) GROUP BY 1), s AS (" + " UNION ALL ".join(f"SELECT '{n}' AS asset, '{source}' AS source, CAST({ASSET_COLUMNS[n]} AS INT) AS columns, count(*) AS row_count FROM {n}" for n, source in ASSETS.items()) + ") SELECT asset, source, columns, row_count, coalesce(checks, 0) AS checks, coalesce(failed, 0) AS failed FROM s LEFT JOIN k ON k.used = s.asset"


def key_sql(*columns: str) -> str:
    """The surrogate key of a business key."""
    text = ", ".join(f"coalesce(CAST({x} AS VARCHAR), '')" for x in columns)
    return f"CAST('0x' || substr(md5(concat_ws('|', {text})), 1, 15) AS BIGINT)"


def dimension_sql(name: str) -> str:
    table, keys, columns = lake.DIMENSIONS[name]
    return f"SELECT DISTINCT {key_sql(*keys)} AS {name}_key, {', '.join((*keys, *columns))} FROM {table}" + " WHERE is_manager" * (name == "manager")


def fact_sql(name: str) -> str:
    table, own, who, at, measures = lake.FACTS[name]
    more = "".join(f", f.{m}" for m in measures)
    return SCD + f" SELECT f.{own} AS fact_id, CASE WHEN f.{who} IS NOT NULL THEN {key_sql('f.' + who)} END AS employee_key, CASE WHEN v.new_department_id IS NOT NULL THEN {key_sql('v.new_department_id')} END AS department_key, CAST(strftime(f.{at}, '%Y%m%d') AS INT) AS date_key{more} FROM {table} AS f LEFT JOIN v ON f.{who} = v.employee_id AND f.{at} >= v.effective_from AND (v.effective_to IS NULL OR f.{at} < v.effective_to)"


DIRECT = {
    "S1_scan_source_table": (s1_scan, "SELECT o_orderstatus, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY 1"),
    "S2_source_tables": (s2_tables, "SELECT unnest(['orders', 'customer', 'lineitem']) AS table_name"),
    "S3_S7_read_latest": (s3_s7_latest, "SELECT n_nationkey, n_name, 'second' AS batch_id, true AS has_files FROM nation"),
    "S8_read_manifest": (s8_manifest, "SELECT 'orders' AS table_name, count(*) AS row_count, CAST(12 AS INT) AS column_count FROM orders"),
    "K1_K3_extract": (k1_k3_extract, "SELECT 'warehouse' AS _source_system, 'customer' AS _source_table, count(*) AS n, CAST(1 AS BIGINT) AS batches, count(*) AS stamped FROM customer"),
    "K6_K7_L2_publish": (k6_publish, "SELECT p_brand, count(*) AS n FROM part GROUP BY 1"),
    "K8_report": (k8_report, views.sql(" UNION ALL ".join(rule_bindings.result_sql(r) for r in operational.operational_rules(AS_OF) if r.needs == ("employees",)), "employees")),
    "S9_source_row_count": (s9_count, "SELECT 'orders' AS table_name, count(*) AS row_count FROM orders UNION ALL SELECT 'customer', count(*) FROM customer"),
    "V01_manifest_keys": (v01_keys, "SELECT 'whole' AS manifest, count(*) AS row_count, CAST(NULL AS VARCHAR) AS error FROM orders UNION ALL SELECT 'lacking', NULL, 'the manifest lacks source_system'"),
    "V02_V12_failing_batches": (v_cases, V_CASES),
    "V14_summary_and_gate": (v14_raise, "SELECT CAST(1 AS BIGINT) AS tables_checked, CAST(0 AS BIGINT) AS tables_passed, CAST(1 AS BIGINT) AS tables_failed, 'region' AS raised"),
    "L3_full_refresh": (l3_refresh, "SELECT 'nation' AS table_name, count(*) AS rows, count(*) AS row_count FROM nation UNION ALL SELECT 'region', count(*), count(*) FROM region"),
    "L5_read_latest_raw": (l5_latest, "SELECT c_mktsegment, count(*) AS n, true AS files FROM customer GROUP BY 1"),
    "P12_stream_upsert": (p12_upsert, "SELECT true AS seen, count(DISTINCT user_id) AS users FROM events"),
    "V01_V14_validate_batch": (v_results, "SELECT 'supplier' AS table_name, false AS passed, count(*) + 1 AS manifest_row_count, count(*) AS parquet_row_count, count(*) AS source_row_count, 1 AS errors FROM supplier UNION ALL SELECT '(batch)', false, NULL, NULL, NULL, 1"),
    "P01_bronze": (p1_bronze, "SELECT CAST(o_orderdate AS DATE) AS o_orderdate, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS total FROM orders GROUP BY 1"),
    "P12_stream_windows": (p12_windows, "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events) GROUP BY 1, 2"),
    "P12_stream_once": (p12_once, "SELECT event_id, user_id FROM events"),
    "P12_stream_rules": (p12_rules, views.sql("SELECT check_name, record_count FROM (" + " UNION ALL ".join(rule_bindings.result_sql(r) for r in operational.operational_rules(AS_OF) if r.id in ("R02", "R12", "R33")) + ") AS r", "employees", "attendance")),
}

BOUND = {
    "P02_silver": (("customer",), lambda t: lake.silver(t["customer"].select((c("c_custkey") % 400).alias("k"), "c_custkey", F.concat(F.lit(" "), c("c_mktsegment")).alias("seg")), "k", ("c_custkey",), {"seg": "none"}, (), ("seg",)), "SELECT k, c_custkey, upper(substr(seg, 1, 1)) || lower(substr(seg, 2)) AS seg FROM (SELECT c_custkey % 400 AS k, c_custkey, c_mktsegment AS seg, row_number() OVER (PARTITION BY c_custkey % 400 ORDER BY c_custkey DESC) AS r FROM customer) WHERE r = 1"),
    "P03_dim_date": (("orders",), lambda t: lake.dim_date(t["orders"], "o_orderdate", ("12-25", "01-01")), "SELECT CAST(strftime(d, '%Y%m%d') AS INT) AS date_key, CAST(d AS DATE) AS date, CAST(day(d) AS INT) AS day, CAST(weekofyear(d) AS INT) AS week, CAST(month(d) AS INT) AS month, CAST(quarter(d) AS INT) AS quarter, CAST(year(d) AS INT) AS year, CAST(year(d) - CASE WHEN month(d) < 4 THEN 1 ELSE 0 END AS INT) AS financial_year, CAST(((month(d) + 8) % 12) // 3 + 1 AS INT) AS financial_quarter, isodow(d) < 6 AS is_weekday, strftime(d, '%m-%d') IN ('12-25', '01-01') AS is_holiday FROM (SELECT unnest(generate_series(CAST(CAST(a AS DATE) AS TIMESTAMP), CAST(CAST(b AS DATE) AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM (SELECT min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders))"),
    "P04_scd2_incremental": (("transfers",), lambda t: lake.scd2_merge(lake.scd2(t["transfers"].where("transfer_date < DATE '1996-01-01'"), *SCD_OF), t["transfers"].where("transfer_date >= DATE '1996-01-01'"), *SCD_OF), SCD + " SELECT employee_id, new_department_id, new_location_id, effective_from, effective_to, effective_to IS NULL AS is_current, CAST(version AS INT) AS version FROM v"),
    "S10_reference_sets": (("public_holidays", "exit_reasons"), s10_reference, "SELECT exit_reason_name, CAST(weight AS VARCHAR) AS weight, CAST(len(reasons) AS INT) AS reasons FROM exit_reasons UNION ALL SELECT 'weather: LookupError', NULL, NULL UNION ALL SELECT 'genders: FileNotFoundError', NULL, NULL"),
    "L1_validate": (rule_bindings.ALL_VIEWS, l1_validate, " UNION ALL ".join(rule_bindings.result_sql(r) for r in operational.operational_rules(AS_OF))),
    "L4_reference_refresh": (("departments", "business_units"), l4_refresh, L4),
    "P07_movement": (("transfers", "employees"), lambda t: lake.movement(t["transfers"], t["employees"]), "WITH m AS (SELECT *, lag(new_department_id) OVER (PARTITION BY employee_id ORDER BY transfer_date, transfer_id) AS old FROM transfers), e AS (SELECT new_department_id AS d, transfer_date, 1 AS i, 0 AS o FROM m WHERE new_department_id IS DISTINCT FROM old UNION ALL SELECT old, transfer_date, 0, 1 FROM m WHERE new_department_id IS DISTINCT FROM old AND old IS NOT NULL) SELECT d AS department_id, CAST(year(transfer_date) AS INT) AS year, CAST(sum(i) AS BIGINT) AS arrivals, CAST(sum(o) AS BIGINT) AS departures FROM e GROUP BY ALL"),
    "P07_working_time": (("attendance", "employees"), lambda t: lake.working_time(t["attendance"], t["employees"]), "SELECT department_id, count(*) AS days, count(*) FILTER (WHERE clock_in_sec > 32400) AS late, CAST(sum(w) AS BIGINT) AS worked_seconds, CAST(sum(greatest(w - 27000, 0)) AS BIGINT) AS overtime_seconds, round(sum(w) / (count(*) * 27000), 6) AS utilisation FROM (SELECT *, (clock_out_sec - clock_in_sec + 86400) % 86400 AS w FROM attendance WHERE clock_in_sec IS NOT NULL) JOIN employees USING (employee_id) GROUP BY 1"),
    "P07_hiring_time": (("recruitment",), lambda t: lake.hiring_time(t["recruitment"]), "SELECT department_id, count(*) AS hires, round(avg(d), 6) AS mean_days, CAST(max(d) AS INT) AS longest FROM (SELECT department_id, date_diff('day', opening_date, hire_date) AS d FROM recruitment WHERE recruitment_status = 'Filled') GROUP BY 1"),
    "P09_keywords": (("conversations",), lambda t: lake.keywords(t["conversations"], "conv_id", "text").withColumn("rank", c("rank").cast("int")), r"WITH n AS (SELECT conv_id, term, count(*) AS n FROM (SELECT conv_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM conversations) WHERE term <> '' GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM n GROUP BY 1), r AS (SELECT conv_id, term, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, df, term) AS rank FROM n JOIN d USING (term) WHERE df <= (SELECT count(DISTINCT conv_id) FROM conversations) * 0.5) SELECT conv_id, CAST(rank AS INT) AS rank, term FROM r WHERE rank <= 5"),
    "P09_emotions": (("documents",), p9_emotions, r"SELECT doc_id, CASE WHEN w IN ('the', 'of') THEN 'calm' ELSE 'joy' END AS label, count(*) AS hits FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS w FROM documents) WHERE w IN ('the', 'of', 'and') GROUP BY ALL"),
    "P09_themes": (("employee_surveys", "employees"), p9_themes, "WITH s AS (SELECT employee_id, CASE WHEN career_growth_score < 3 THEN 'growth' WHEN manager_support_score < 3 THEN 'manager' WHEN wellbeing_score < 3 OR work_life_balance_score < 3 THEN 'wellbeing' WHEN (engagement_score + satisfaction_score) / 2 >= 4 THEN 'positive' WHEN (engagement_score + satisfaction_score) / 2 >= 3.25 THEN 'neutral' ELSE 'development' END AS theme FROM employee_surveys) SELECT department_id, theme, count(*) AS surveys FROM s JOIN employees USING (employee_id) GROUP BY ALL"),
    "P09_topics": (("documents",), lambda t: lake.topics(t["documents"], "doc_id", "text"), None),
    "P11_assets": (rule_bindings.ALL_VIEWS, p11_assets, P11),
    "P04_scd2": (("transfers",), scd, SCD + " SELECT employee_id, new_department_id, new_location_id, effective_from, effective_to, effective_to IS NULL AS is_current, CAST(version AS INT) AS version FROM v"),
    "P06_point_in_time": (("attendance", "transfers"), facts, SCD + " SELECT v.new_department_id AS at_new_department_id, count(*) AS n, CAST(sum(attendance_id) AS BIGINT) AS ids FROM attendance AS a LEFT JOIN v ON a.employee_id = v.employee_id AND a.work_date >= v.effective_from AND (v.effective_to IS NULL OR a.work_date < v.effective_to) GROUP BY 1"),
    "P07_headcount": (("employees",), lambda t: lake.headcount(t["employees"], derive.month_spine(t["employees"], "hire_date")), "WITH m AS (SELECT CAST(m AS DATE) AS s, last_day(CAST(m AS DATE)) AS e FROM (SELECT unnest(generate_series(CAST(make_date(CAST(year(d) - 3 AS INT), 1, 1) AS TIMESTAMP), CAST(d AS TIMESTAMP), INTERVAL 1 MONTH)) AS m FROM (SELECT max(hire_date) AS d FROM employees))) SELECT s AS month_start, (SELECT count(*) FROM employees WHERE hire_date <= e AND (termination_date IS NULL OR termination_date > e)) AS headcount, (SELECT count(*) FROM employees WHERE hire_date BETWEEN s AND e) AS hires, (SELECT count(*) FROM employees WHERE termination_date BETWEEN s AND e) AS leavers FROM m"),
    "P07_absenteeism": (("attendance", "employees"), lambda t: lake.absenteeism(t["attendance"], t["employees"]), "SELECT department_id, count(*) AS days, count(*) FILTER (WHERE status = 'Absent') AS absences, round(count(*) FILTER (WHERE status = 'Absent') / count(*), 6) AS rate FROM attendance JOIN employees USING (employee_id) GROUP BY ROLLUP (department_id)"),
    "P07_turnover": (("employee_exits", "employees"), lambda t: lake.turnover(t["employee_exits"], t["employees"]), "SELECT CAST(year(exit_date) AS INT) AS year, count(*) FILTER (WHERE voluntary_flag) AS voluntary, count(*) FILTER (WHERE NOT voluntary_flag) AS involuntary FROM employee_exits GROUP BY 1"),
    "P07_payroll_cube": (("payroll", "employees"), lambda t: lake.payroll_cube(t["payroll"], t["employees"]).withColumn("gross_pay", c("gross_pay").cast("decimal(18,2)")), "SELECT department_id, CAST(year(pay_period_start) AS INT) AS year, CAST(sum(gross_pay) AS DECIMAL(18,2)) AS gross_pay, count(*) AS payslips FROM payroll JOIN employees USING (employee_id) GROUP BY CUBE (department_id, year(pay_period_start))"),
    "P07_hire_success": (("recruitment",), lambda t: lake.hire_success(t["recruitment"]), "SELECT recruitment_status, count(*) AS vacancies, count(successful_employee_id) AS with_employee FROM recruitment GROUP BY 1"),
    "P07_completion": (("training",), lambda t: lake.completion_rate(t["training"]), "SELECT CAST(year(coalesce(start_date, completion_date)) AS INT) AS year, count(*) AS courses, count(completion_date) AS completed, round(count(completion_date) / count(*), 6) AS rate FROM training GROUP BY 1"),
    "P07_engagement": (("employee_surveys", "employees"), lambda t: lake.engagement(t["employee_surveys"], t["employees"]).withColumn("engagement", c("engagement").cast("double")), "SELECT department_id, count(*) AS responses, count(DISTINCT employee_id) AS participants, round(avg(CAST(engagement_score AS DOUBLE)), 6) AS engagement FROM employee_surveys JOIN employees USING (employee_id) GROUP BY 1"),
    "P09_term_counts": (("conversations",), lambda t: lake.term_counts(t["conversations"], "conv_id", "text"), r"SELECT term, count(DISTINCT conv_id) AS documents, count(*) AS occurrences FROM (SELECT conv_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM conversations) WHERE term <> '' GROUP BY 1"),
    "P09_sentiment": (("documents", "region"), p9_sentiment, r"SELECT doc_id, CAST(coalesce(sum(CASE w WHEN 'the' THEN 1 WHEN 'and' THEN -1 WHEN 'of' THEN 2 END), 0) AS BIGINT) AS score, count(*) FILTER (WHERE w IN ('the', 'and', 'of')) AS hits FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS w FROM documents) GROUP BY 1"),
    "P10_features": (("employees", "attendance"), lambda t: lake.attrition_features(t["employees"], t["attendance"], AS_OF), "WITH a AS (SELECT employee_id, count(*) AS days, count(*) FILTER (WHERE status = 'Absent') AS absences FROM attendance GROUP BY 1) SELECT e.employee_id, CAST(date_diff('day', hire_date, least(coalesce(termination_date, DATE '2024-06-30'), DATE '2024-06-30')) AS INT) AS tenure_days, CAST(annual_salary AS DOUBLE) AS salary, coalesce(days, 0) AS days, coalesce(absences, 0) AS absences, CAST(employment_status = 'Terminated' AS INT) AS label FROM employees AS e LEFT JOIN a USING (employee_id)"),
    "P10_model": (("employees", "attendance"), p10_model, None),
    "P10_burnout_features": (("employees", "attendance", "leave_requests", "employee_surveys"), p10_burnout, BURNOUT),
    "P10_promotion_features": (("employees", "promotions", "transfers", "leave_requests"), p10_promotion, PROMOTION),
    "P10_performance_features": (("employees", "performance_reviews", "attendance", "training"), p10_performance, PERFORMANCE),
    "P10_burnout_risk": (("employees", "attendance", "leave_requests", "employee_surveys"), lambda t: p10_risk(t, p10_burnout, lake.BURNOUT), None),
    "P10_promotion_chance": (("employees", "promotions", "transfers", "leave_requests"), lambda t: p10_risk(t, p10_promotion, lake.PROMOTION), None),
    "P10_expected_rating": (("employees", "performance_reviews", "attendance", "training"), p10_ratings, None),
    "P10_payroll_forecast": (("payroll", "employees"), p10_forecast, FORECAST),
    "P11_catalogue": (("orders", "customer"), lambda t: lake.catalogue({"orders": t["orders"], "customer": t["customer"]}).groupBy("asset").agg(F.count(F.lit(1)).alias("columns"), F.min("column_name").alias("first")), "SELECT 'orders' AS asset, CAST(6 AS BIGINT) AS columns, 'o_custkey' AS first UNION ALL SELECT 'customer', 5, 'c_acctbal'"),
    "P13_shared_view": (("customer",), lambda t: lake.shared_view(t["customer"], ("c_custkey", "c_name", "c_nationkey"), ("c_name",), c("c_acctbal") > 0), "SELECT c_custkey, sha256(c_name) AS c_name, c_nationkey FROM customer WHERE c_acctbal > 0"),
}


for _name, (_table, *_) in lake.DIMENSIONS.items():
    BOUND[f"P05_dim_{_name}"] = ((_table,), lambda t, n=_name: lake.gold_dimension(n, t), dimension_sql(_name))
for _name, (_table, *_) in lake.FACTS.items():
    BOUND[f"P06_fact_{_name}"] = (tuple(dict.fromkeys((_table, "transfers"))), lambda t, n=_name: lake.gold_fact(n, t, scd(t)), fact_sql(_name))


def bindings() -> tuple[dict, dict]:
    q = {k: fn for k, (fn, _) in DIRECT.items()}
    o = {k: text for k, (_, text) in DIRECT.items() if text}
    for key, (needs, fn, text) in BOUND.items():
        q[key] = lambda spark, sf_dir, f=fn, n=needs: f(views.tables(spark, sf_dir, *n))
        if text:
            o[key] = views.sql(text, *[n for n in needs if n in views.VIEWS])
    return q, o


