"""Bronze, silver, slowly changing dimensions, facts and marts."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import is_weekend, month_day
from ..operators import latest_per_key


def structural_errors(raw: DataFrame, schema: StructType) -> list[str]:
    """What keeps raw rows from the declared schema: columns that are missing, or values that its types cannot hold."""
    missing = [f"missing column {f.name}" for f in schema.fields if f.name not in raw.columns]
    there = [f for f in schema.fields if f.name in raw.columns]
    lost = lambda f: F.count_if(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull())
    row = raw.agg(*[lost(f).alias(f.name) for f in there]).first() if there else {}
    return missing + [f"{f.name} has values that are no {f.dataType.simpleString()}: {row[f.name]}" for f in there if row[f.name]]


def bronze(raw: DataFrame, schema: StructType) -> DataFrame:
    """Casts to the declared schema and adds ingestion columns; other columns are kept as they are."""
    declared = {f.name: F.col(f.name).cast(f.dataType) for f in schema.fields}
    added = {"_bronze_ingested_at": F.current_timestamp(), "_source_file": F.col("_metadata.file_path")}
    if "_extracted_at_utc" in raw.columns:
        added["_extraction_date"] = F.to_date("_extracted_at_utc")
    return raw.withColumns(declared).withColumns(added)


def write_bronze(df: DataFrame, path: str, batch: str = "batch_id") -> None:
    """A rerun of a batch replaces that batch."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(batch).parquet(path)


def silver(df: DataFrame, key: str, order: Sequence[str], defaults: dict | None = None, codes: Sequence[str] = (), names: Sequence[str] = ()) -> DataFrame:
    """One row for each business key, trimmed text, upper-case codes, single spaces and hyphens in names, defaults for nulls."""
    out = latest_per_key(df, key, order)
    text = {c: F.trim(F.col(c)) for c, t in out.dtypes if t == "string"}
    out = out.withColumns(text)
    out = out.withColumns({c: F.upper(F.col(c)) for c in codes} | {c: F.initcap(F.regexp_replace(F.col(c), r"[\s-]+", " ")) for c in names})
    return out.na.fill(defaults) if defaults else out


def dim_date(facts: DataFrame, at: str, holidays: Sequence[str] = (), year_starts: int = 4) -> DataFrame:
    """A row for each day from the first to the last date of the facts; the financial year starts with month year_starts and has the number of the year it starts in."""
    d = F.col("date")
    bounds = facts.agg(F.min(F.col(at).cast("date")).alias("low"), F.max(F.col(at).cast("date")).alias("high")).where("low IS NOT NULL")
    rows = bounds.select(F.explode(F.sequence("low", "high")).alias("date"))
    fy = F.year(d) - (F.month(d) < year_starts).cast("int")
    return rows.select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"), "date", F.dayofmonth(d).alias("day"), F.weekofyear(d).alias("week"), F.month(d).alias("month"), F.quarter(d).alias("quarter"), F.year(d).alias("year"),
        fy.alias("financial_year"), (F.floor(F.pmod(F.month(d) - year_starts, F.lit(12)) / 3) + 1).cast("int").alias("financial_quarter"), (~is_weekend(d)).alias("is_weekday"), month_day(d).isin(*holidays).alias("is_holiday"),
    )


def scd2(history: DataFrame, key: str, at: str, tracked: Sequence[str]) -> DataFrame:
    """Versions of a key's tracked values: effective_from, effective_to (exclusive, null if current), is_current, version.

    Rows that change nothing are merged into the version before; of rows of one time the last by value counts.
    """
    w = Window.partitionBy(key).orderBy(at)
    state = F.struct(*tracked)
    rows = history.groupBy(key, at).agg(F.max(state).alias("s"))
    rows = rows.withColumn("before", F.lag("s").over(w)).withColumn("first", F.row_number().over(w) == 1)
    rows = rows.where(F.col("first") | ~F.col("s").eqNullSafe(F.col("before")))
    to = F.lead(at).over(w)
    return rows.select(key, *[F.col(f"s.{c}").alias(c) for c in tracked], F.col(at).alias("effective_from"), to.alias("effective_to"), to.isNull().alias("is_current"), F.row_number().over(w).alias("version"))


def scd2_merge(versions: DataFrame, changes: DataFrame, key: str, at: str, tracked: Sequence[str]) -> DataFrame:
    """versions (from scd2) with later changes worked in; only the versions of changed keys are made anew.

    Changes come after the rows that made the versions; an earlier one is placed among the versions, whose merged rows are gone.
    """
    keys = changes.select(F.col(key).alias("_k")).distinct()
    same = F.col(key).eqNullSafe(F.col("_k"))
    again = versions.join(keys, same, "left_semi").select(key, *tracked, F.col("effective_from").alias(at))
    return versions.join(keys, same, "left_anti").unionByName(scd2(again.unionByName(changes.select(key, *tracked, at)), key, at, tracked))


def surrogate(*keys: str) -> Column:
    """60 bits of a digest of the business key, the same in every run; a null part counts as empty."""
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def dimension(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str) -> DataFrame:
    """A dimension with a surrogate key from its business key."""
    return df.select(surrogate(*keys).alias(f"{name}_key"), *keys, *columns).distinct()


def point_in_time(facts: DataFrame, versions: DataFrame, key: str, at: str, columns: Sequence[str]) -> DataFrame:
    """facts with the version that was valid at their date: an equi-join on the key with a range condition."""
    v = versions.select(F.col(key).alias("_k"), "effective_from", "effective_to", *[F.col(c).alias(f"at_{c}") for c in columns])
    valid = (facts[key] == v["_k"]) & (facts[at] >= v["effective_from"]) & (v["effective_to"].isNull() | (facts[at] < v["effective_to"]))
    return facts.join(v, valid, "left").drop("_k", "effective_from", "effective_to")


#: Dimensions: table, business key, columns.
DIMENSIONS = {
    "employee": ("employees", ("employee_id",), ("employee_number", "email", "hire_date")),
    "department": ("departments", ("department_id",), ("department_name", "business_unit", "cost_center")),
    "location": ("locations", ("location_id",), ()),
    "job_role": ("job_roles", ("role_id",), ("role_name", "grade")),
    "manager": ("employees", ("employee_id",), ("employee_number", "department_id")),
    "course": ("training", ("course_category",), ()),
    "exit_reason": ("employee_exits", ("exit_type", "exit_reason"), ("voluntary_flag",)),
}


def gold_dimension(name: str, tables: dict[str, DataFrame]) -> DataFrame:
    table, keys, columns = DIMENSIONS[name]
    rows = tables[table].where("is_manager") if name == "manager" else tables[table]
    return dimension(rows, keys, columns, name)


#: Facts: table, own key, employee's key, date, measures.
FACTS = {
    "workforce": ("employees", "employee_id", "employee_id", "hire_date", ("annual_salary",)),
    "payroll": ("payroll", "payroll_id", "employee_id", "pay_period_start", ("gross_pay", "net_pay")),
    "attendance": ("attendance", "attendance_id", "employee_id", "work_date", ("clock_in_sec",)),
    "performance": ("performance_reviews", "review_id", "employee_id", "review_date", ("overall_rating",)),
    "recruitment": ("recruitment", "recruitment_id", "successful_employee_id", "hire_date", ()),
    "training": ("training", "training_id", "employee_id", "start_date", ()),
    "surveys": ("employee_surveys", "survey_id", "employee_id", "survey_date", ("engagement_score",)),
    "attrition": ("employee_exits", "exit_event_id", "employee_id", "exit_date", ()),
    "leave": ("leave_requests", "leave_id", "employee_id", "start_date", ("requested_days",)),
    "promotions": ("promotions", "promotion_id", "employee_id", "promotion_date", ("new_salary",)),
}


def gold_fact(name: str, tables: dict[str, DataFrame], versions: DataFrame) -> DataFrame:
    """fact_id, employee_key, department_key (of the version valid at the date), date_key, measures."""
    table, own, who, at, measures = FACTS[name]
    rows = tables[table].select(F.col(own).alias("fact_id"), F.col(who).alias("employee_id"), F.col(at).alias("at"), *measures)
    rows = point_in_time(rows, versions, "employee_id", "at", ("new_department_id",)).withColumnRenamed("at_new_department_id", "department_id")
    key = lambda c: F.when(F.col(c).isNotNull(), surrogate(c))
    return rows.select("fact_id", key("employee_id").alias("employee_key"), key("department_id").alias("department_key"), F.date_format("at", "yyyyMMdd").cast("int").alias("date_key"), *measures)


# Marts


def movement(transfers: DataFrame, employees: DataFrame) -> DataFrame:
    """department_id, year, arrivals and departures by transfer; one is left for the next by the same employee's order."""
    order = Window.partitionBy("employee_id").orderBy("transfer_date", "transfer_id")
    rows = transfers.withColumn("old", F.lag("new_department_id").over(order)).where(~F.col("new_department_id").eqNullSafe(F.col("old")))
    ends = F.array(F.struct(F.col("new_department_id").alias("department_id"), F.lit(1).alias("arrived"), F.lit(0).alias("left")), F.struct(F.col("old").alias("department_id"), F.lit(0).alias("arrived"), F.lit(1).alias("left")))
    out = rows.select(F.year("transfer_date").alias("year"), F.explode(ends).alias("x")).select("year", "x.*").where("department_id IS NOT NULL")
    return out.groupBy("department_id", "year").agg(F.sum("arrived").alias("arrivals"), F.sum("left").alias("departures"))


def working_time(attendance: DataFrame, employees: DataFrame, late_after: int = 9 * 3600, day_seconds: int = 27_000) -> DataFrame:
    """By department: days worked, late starts, seconds worked and over time, utilisation (worked by contracted time)."""
    rows = attendance.where("clock_in_sec IS NOT NULL AND clock_out_sec IS NOT NULL").join(employees.select("employee_id", "department_id"), "employee_id")
    worked = F.pmod(F.col("clock_out_sec") - F.col("clock_in_sec"), F.lit(86400)).cast("long")
    out = rows.withColumn("worked", worked).groupBy("department_id").agg(F.count(F.lit(1)).alias("days"), F.count_if(F.col("clock_in_sec") > late_after).alias("late"), F.sum("worked").alias("worked_seconds"), F.sum(F.greatest(F.col("worked") - day_seconds, F.lit(0).cast("long"))).alias("overtime_seconds"))
    return out.withColumn("utilisation", F.round(F.col("worked_seconds") / (F.col("days") * day_seconds), 6))


def hiring_time(recruitment: DataFrame) -> DataFrame:
    """By department: hires, and mean and longest days from opening to hire."""
    days = F.date_diff("hire_date", "opening_date")
    return recruitment.where("recruitment_status = 'Filled'").groupBy("department_id").agg(F.count(F.lit(1)).alias("hires"), F.round(F.avg(days), 6).alias("mean_days"), F.max(days).alias("longest"))


def headcount(employees: DataFrame, months: DataFrame) -> DataFrame:
    """month_start, headcount on its last day, hires and leavers in it: running sums of starts and ends, no range join."""
    starts = employees.select(F.trunc("hire_date", "month").alias("m"), F.lit(1).alias("hire"), F.lit(0).alias("leave"))
    ends = employees.where("termination_date IS NOT NULL").select(F.trunc("termination_date", "month").alias("m"), F.lit(0).alias("hire"), F.lit(1).alias("leave"))
    flows = starts.unionByName(ends).groupBy("m").agg(F.sum("hire").alias("hires"), F.sum("leave").alias("leavers"))
    spine = months.select(F.col("month_start").alias("m"), F.lit(0).cast("long").alias("hires"), F.lit(0).cast("long").alias("leavers"), F.lit(1).alias("shown"))
    rows = flows.withColumn("shown", F.lit(0)).unionByName(spine).groupBy("m").agg(F.sum("hires").alias("hires"), F.sum("leavers").alias("leavers"), F.max("shown").alias("shown"))
    total = F.sum(F.col("hires") - F.col("leavers")).over(Window.orderBy("m").rowsBetween(Window.unboundedPreceding, 0))  # a row for each month
    return rows.withColumn("headcount", total).where("shown = 1").select(F.col("m").alias("month_start"), "headcount", "hires", "leavers")


def absenteeism(attendance: DataFrame, employees: DataFrame) -> DataFrame:
    """Days, absences and their rate by department, and for all (department_id null)."""
    rows = attendance.join(employees.select("employee_id", "department_id"), "employee_id")
    out = rows.rollup("department_id").agg(F.count(F.lit(1)).alias("days"), F.count_if(F.col("status") == "Absent").alias("absences"))
    return out.withColumn("rate", F.round(F.col("absences") / F.col("days"), 6))


def turnover(exits: DataFrame, employees: DataFrame) -> DataFrame:
    """Voluntary and involuntary exits by year."""
    return exits.groupBy(F.year("exit_date").alias("year")).agg(F.count_if("voluntary_flag").alias("voluntary"), F.count_if(~F.col("voluntary_flag")).alias("involuntary"))


def payroll_cube(payroll: DataFrame, employees: DataFrame) -> DataFrame:
    """Gross pay by department and year, with all subtotals."""
    rows = payroll.join(employees.select("employee_id", "department_id", "location_id"), "employee_id")
    return rows.cube("department_id", F.year("pay_period_start").alias("year")).agg(F.sum("gross_pay").alias("gross_pay"), F.count(F.lit(1)).alias("payslips"))


def hire_success(recruitment: DataFrame) -> DataFrame:
    return recruitment.groupBy("recruitment_status").agg(F.count(F.lit(1)).alias("vacancies"), F.count("successful_employee_id").alias("with_employee"))


def completion_rate(training: DataFrame) -> DataFrame:
    out = training.groupBy(F.year(F.coalesce("start_date", "completion_date")).alias("year")).agg(F.count(F.lit(1)).alias("courses"), F.count("completion_date").alias("completed"))
    return out.withColumn("rate", F.round(F.col("completed") / F.col("courses"), 6))


def engagement(surveys: DataFrame, employees: DataFrame) -> DataFrame:
    """Responses, participants and mean score by department."""
    rows = surveys.join(employees.select("employee_id", "department_id"), "employee_id")
    return rows.groupBy("department_id").agg(F.count(F.lit(1)).alias("responses"), F.count_distinct("employee_id").alias("participants"), F.round(F.avg("engagement_score"), 6).alias("engagement"))


# Text, models and views


def term_counts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """term, documents, occurrences of lower-case words."""
    words = texts.select(key, F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+")).alias("term")).where("term <> ''")
    return words.groupBy("term", key).agg(F.count(F.lit(1)).alias("n")).groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("occurrences"))


def lexicon_sentiment(texts: DataFrame, lexicon: DataFrame, key: str, text: str) -> DataFrame:
    """key, score (sum of word weights), hits. Texts without a word of the lexicon have score 0."""
    words = texts.select(F.col(key).alias("k"), F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+")).alias("word"))
    hits = words.join(lexicon, "word").groupBy("k").agg(F.sum("weight").alias("score"), F.count(F.lit(1)).alias("hits"))
    zero = F.lit(0).cast("long")
    return texts.select(key).join(hits, texts[key] == hits["k"], "left").select(key, F.coalesce("score", zero).alias("score"), F.coalesce("hits", zero).alias("hits"))


def keywords(texts: DataFrame, key: str, text: str, k: int = 5, most: float = 0.5) -> DataFrame:
    """key, rank, term: of each text the k most frequent terms that at most `most` of all texts have, rarer ones first in ties."""
    words = texts.select(F.col(key).alias("k"), F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+")).alias("term")).where("term <> ''")
    counts = words.groupBy("k", "term").agg(F.count(F.lit(1)).alias("n"))
    df = counts.groupBy(F.col("term").alias("t")).agg(F.count(F.lit(1)).alias("df"))
    total = texts.agg(F.count_distinct(key).alias("total"))  # one row
    rows = counts.join(df.crossJoin(F.broadcast(total)).where(F.col("df") <= F.col("total") * most), F.col("term") == F.col("t"))
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("n"), "df", "term"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("k").alias(key), "rank", "term")


def lexicon_labels(texts: DataFrame, lexicon: DataFrame, key: str, text: str) -> DataFrame:
    """key, label, hits: how many words of a text the lexicon (word, label) gives each label, such as an emotion or a theme."""
    words = texts.select(F.col(key), F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+")).alias("word"))
    return words.join(lexicon, "word").groupBy(key, "label").agg(F.count(F.lit(1)).alias("hits"))


def checkpointed(df: DataFrame) -> DataFrame:
    """df as it is, worked out once, in the session's checkpoint folder; a local one where Spark is local and none is set."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="spark-scratch-"))
    return df.checkpoint()


def topics(texts: DataFrame, key: str, text: str, k: int = 5, terms: int = 1000, seed: int = 1) -> DataFrame:
    """key, topic: the heaviest of k topics that an online LDA model finds over the `terms` most frequent words.

    Only words of two texts or more count, of equally frequent ones the smaller goes first; a text without any (null or empty
    ones too) has a null topic, the first of equally heavy ones goes. Without such words at all every topic is null. Words are
    split twice, for their counts and for vectors; these are checkpointed in their partitions and order, as the model's
    samples depend on both.
    """
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizerModel
    from pyspark.ml.functions import vector_to_array

    words = texts.select(key, F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "").alias("words"))
    found = words.select(F.monotonically_increasing_id().alias("row"), "words").select("row", F.explode("words").alias("word"))
    frequent = found.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"), F.max("row").alias("last")).where("first < last")
    vocabulary = [r.word for r in frequent.orderBy(F.desc("n"), "word").limit(terms).select("word").collect()]
    if not vocabulary:
        return texts.select(key, F.lit(None).cast("int").alias("topic"))
    counted = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="words", outputCol="features")
    vectors = checkpointed(counted.transform(words).select(key, "features"))
    mixed = LDA(k=k, maxIter=5, optimizer="online", seed=seed).fit(vectors).transform(vectors)
    weights = vector_to_array("topicDistribution")
    heaviest = (F.array_position(weights, F.array_max(weights)) - 1).cast("int")
    return mixed.select(key, F.when(F.array_max(weights) > 0, heaviest).alias("topic"))


def attrition_features(employees: DataFrame, attendance: DataFrame, as_of: date) -> DataFrame:
    """employee_id, tenure_days, salary, days, absences, label (1: left)."""
    seen = attendance.groupBy(F.col("employee_id").alias("e")).agg(F.count(F.lit(1)).alias("days"), F.count_if(F.col("status") == "Absent").alias("absences"))
    end = F.least(F.coalesce("termination_date", F.lit(as_of)), F.lit(as_of))
    rows = employees.join(seen, employees["employee_id"] == seen["e"], "left")
    zero = F.lit(0).cast("long")
    return rows.select("employee_id", F.date_diff(end, "hire_date").alias("tenure_days"), F.col("annual_salary").cast("double").alias("salary"), F.coalesce("days", zero).alias("days"), F.coalesce("absences", zero).alias("absences"), (F.col("employment_status") == "Terminated").cast("int").alias("label"))


FEATURES = ("tenure_days", "salary", "days", "absences")
BURNOUT = ("days", "absences", "hours", "leaves", "wellbeing")
PROMOTION = ("tenure_days", "salary", "promotions", "transfers", "leaves")
PERFORMANCE = ("rating", "reviews", "absences", "courses")


def with_history(employees: DataFrame, *parts: DataFrame) -> DataFrame:
    """employees with the columns of parts, each of a row for an employee_id; a count that is missing is 0, a mean stays null."""
    for part in parts:
        rows = part.withColumnRenamed("employee_id", "_e")
        employees = employees.join(rows, employees["employee_id"] == rows["_e"], "left").drop("_e")
        employees = employees.withColumns({n: F.coalesce(n, F.lit(0).cast("long")) for n, kind in part.dtypes if kind == "bigint"})
    return employees


def past(rows: DataFrame, at: str, since: date, *aggregates: Column) -> DataFrame:
    """employee_id and the aggregates of an employee's rows before a day."""
    return rows.where(F.col(at) < F.lit(since)).groupBy("employee_id").agg(*aggregates)


def mean_of(column: str) -> Column:
    return F.round(F.avg(F.col(column).cast("double")), 6)


def burnout_features(employees: DataFrame, attendance: DataFrame, leave: DataFrame, surveys: DataFrame, since: date, low: float = 2.5) -> DataFrame:
    """employee_id, BURNOUT, label (1: mean wellbeing of the surveys from `since` on is at most `low`).

    Features come from before `since`; employees without a later survey have no label and no row. Without an earlier survey
    wellbeing is `low`; a row with a missing clock time adds no hours.
    """
    count = F.count(F.lit(1))
    worked = F.pmod(F.col("clock_out_sec") - F.col("clock_in_sec"), F.lit(86400))
    seen = past(attendance, "work_date", since, count.alias("days"), F.count_if(F.col("status") == "Absent").alias("absences"), F.round(F.coalesce(F.sum(worked), F.lit(0)) / 3600, 6).alias("hours"))
    before = past(surveys, "survey_date", since, mean_of("wellbeing_score").alias("wellbeing"))
    later = surveys.where(F.col("survey_date") >= F.lit(since)).groupBy("employee_id").agg(mean_of("wellbeing_score").alias("later"))
    rows = with_history(employees.select("employee_id"), seen, past(leave, "start_date", since, count.alias("leaves")), before, later).where("later IS NOT NULL")
    return rows.select("employee_id", "days", "absences", F.coalesce("hours", F.lit(0.0)).alias("hours"), "leaves", F.coalesce("wellbeing", F.lit(low)).alias("wellbeing"), (F.col("later") <= low).cast("int").alias("label"))


def promotion_features(employees: DataFrame, promotions: DataFrame, transfers: DataFrame, leave: DataFrame, since: date) -> DataFrame:
    """employee_id, PROMOTION, label (1: promoted on `since` or later); tenure is negative for those hired later."""
    count = F.count(F.lit(1))
    parts = (past(promotions, "promotion_date", since, count.alias("promotions")), past(transfers, "transfer_date", since, count.alias("transfers")), past(leave, "start_date", since, count.alias("leaves")))
    later = promotions.where(F.col("promotion_date") >= F.lit(since)).groupBy("employee_id").agg(count.alias("later"))
    rows = with_history(employees.select("employee_id", "hire_date", "annual_salary"), *parts, later)
    return rows.select("employee_id", F.date_diff(F.lit(since), "hire_date").alias("tenure_days"), F.col("annual_salary").cast("double").alias("salary"), "promotions", "transfers", "leaves", (F.col("later") > 0).cast("int").alias("label"))


def performance_features(employees: DataFrame, reviews: DataFrame, attendance: DataFrame, training: DataFrame, since: date) -> DataFrame:
    """employee_id, PERFORMANCE, label (mean rating of the reviews from `since` on) of employees with reviews before and after."""
    count = F.count(F.lit(1))
    before = past(reviews, "review_date", since, mean_of("overall_rating").alias("rating"), count.alias("reviews"))
    later = reviews.where(F.col("review_date") >= F.lit(since)).groupBy("employee_id").agg(mean_of("overall_rating").alias("label"))
    parts = (before, past(attendance, "work_date", since, F.count_if(F.col("status") == "Absent").alias("absences")), past(training, "completion_date", since, count.alias("courses")), later)
    return with_history(employees.select("employee_id"), *parts).where("rating IS NOT NULL AND label IS NOT NULL").select("employee_id", *PERFORMANCE, "label")


def complete(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows that a model can learn from, as a vector and a label."""
    from pyspark.ml.feature import VectorAssembler

    rows = features.dropna(subset=[*columns, "label"])
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(rows)


def attrition_model(features: DataFrame, columns: Sequence[str] = FEATURES) -> dict[str, float]:
    """Coefficients of a logistic regression of label (0, 1) on the columns, and its intercept under the name ''.

    Rows with a null are left out; without any row that is whole, Spark raises an error.
    """
    from pyspark.ml.classification import LogisticRegression

    model = LogisticRegression(maxIter=20).fit(complete(features, columns))
    return dict(zip(columns, map(float, model.coefficients))) | {"": float(model.intercept)}


def rating_model(features: DataFrame, columns: Sequence[str] = PERFORMANCE) -> dict[str, float]:
    """The same of a linear regression of a number."""
    from pyspark.ml.regression import LinearRegression

    model = LinearRegression(regParam=1e-6).fit(complete(features, columns))
    return dict(zip(columns, map(float, model.coefficients))) | {"": float(model.intercept)}


def expected(features: DataFrame, model: dict[str, float], name: str = "expected") -> DataFrame:
    """features with a linear model's value, as a plain expression; null where a feature is null."""
    score = F.lit(model[""])
    for c, weight in model.items():
        if c:
            score = score + F.col(c) * weight
    return features.withColumn(name, score)


def attrition_risk(features: DataFrame, model: dict[str, float]) -> DataFrame:
    """features with risk, a logistic model's probability."""
    return expected(features, model, "risk").withColumn("risk", 1 / (1 + F.exp(-F.col("risk"))))


def monthly(rows: DataFrame, key: str, at: str, value: Column) -> DataFrame:
    """key, month (months since the year 0), value summed; rows without a date are left out."""
    month = F.year(at) * 12 + F.month(at) - 1
    return rows.where(F.col(at).isNotNull()).groupBy(key, month.alias("month")).agg(F.sum(value).alias("value"))


def trend_forecast(series: DataFrame, key: str, ahead: int = 3) -> DataFrame:
    """key, month_start, forecast: the least-squares line of a key's months, drawn `ahead` months beyond its last one.

    A key of one month keeps its value. Months without rows are not in the series, so they pull no line down.
    """
    value, month = F.col("value").cast("double"), F.col("month").cast("double")
    fit = series.groupBy(key).agg(F.regr_slope(value, month).alias("slope"), F.avg(value).alias("mean_value"), F.avg(month).alias("mean_month"), F.max("month").alias("last"))
    rows = fit.withColumn("month", F.explode(F.sequence(F.col("last") + 1, F.col("last") + ahead)))
    start = F.make_date(F.floor(F.col("month") / 12).cast("int"), (F.col("month") % 12 + 1).cast("int"), F.lit(1))
    rise = F.coalesce(F.nanvl("slope", F.lit(0.0)), F.lit(0.0)) * (F.col("month") - F.col("mean_month"))
    return rows.select(key, start.alias("month_start"), F.round(F.col("mean_value") + rise, 3).alias("forecast"))


def catalogue(tables: dict[str, DataFrame]) -> DataFrame:
    """asset, position, column_name, data_type of all columns."""
    rows = [(name, i, f.name, f.dataType.simpleString()) for name, df in tables.items() for i, f in enumerate(df.schema.fields)]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "asset string, position int, column_name string, data_type string")


def asset_report(tables: dict[str, DataFrame], results: DataFrame, uses: dict[str, tuple[str, ...]], lineage: dict[str, str]) -> DataFrame:
    """asset, source, columns, row_count, checks and failed checks that use it: one row for each table."""
    spark = results.sparkSession
    about = spark.createDataFrame([(n, lineage.get(n), len(df.columns)) for n, df in tables.items()], "asset string, source string, columns int")
    sizes = None
    for n, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("a"), "row_count")
        sizes = one if sizes is None else sizes.unionByName(one)
    used = spark.createDataFrame([(name, n) for name, names in uses.items() for n in names], "check_name string, used string")
    checks = results.join(used, "check_name").groupBy("used").agg(F.count(F.lit(1)).alias("checks"), F.count_if(~F.col("passed")).alias("failed"))
    zero = F.lit(0).cast("long")
    out = about.join(sizes, about["asset"] == sizes["a"]).join(checks, about["asset"] == checks["used"], "left")
    return out.select("asset", "source", "columns", "row_count", F.coalesce("checks", zero).alias("checks"), F.coalesce("failed", zero).alias("failed"))


def shared_view(df: DataFrame, columns: Sequence[str], masked: Sequence[str] = (), row_filter: Column | None = None) -> DataFrame:
    """An approved product: some columns, some of them as hashes, some rows."""
    rows = df if row_filter is None else df.where(row_filter)
    return rows.select(*[F.sha2(F.col(c).cast("string"), 256).alias(c) if c in masked else F.col(c) for c in columns])
