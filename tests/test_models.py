"""Models on small rows: topics of known groups, risks and ratings of rows that were held out, features and trends of odd rows."""

import random
from datetime import date

from pyspark.sql import functions as F

from rosterlake.plans import lake

GROUPS = ("pay salary bonus pension tax payslip", "leave holiday absence rota shift overtime")


def test_topics_part_known_groups(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(GROUPS[i % 2].split(), k=30))) for i in range(200)] + [(200, None), (201, ""), (202, "once")]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.topic for r in lake.topics(texts, "doc_id", "text", k=2).collect()}
    assert len(got) == 203 and got[200] is got[201] is got[202] is None
    agree = sum(got[i] == i % 2 for i in range(200))
    assert max(agree, 200 - agree) >= 190


def test_topics_split_texts_twice_and_cut_ties_by_word(spark):
    rng, split = random.Random(4), spark.sparkContext.accumulator(0)

    def seen(text):
        split.add(1)
        return text

    rows = [(i, " ".join(rng.choices(GROUPS[i % 2].split(), k=9))) for i in range(60)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text", F.udf(seen)("text"))
    assert len(lake.topics(texts, "doc_id", "text", k=2).collect()) == 60
    assert split.value == 2 * 60
    ties = spark.createDataFrame([(0, "b c"), (1, "b"), (2, "a"), (3, "a c"), (4, "d d d")], "doc_id long, text string")
    assert {r.doc_id for r in lake.topics(ties, "doc_id", "text", k=2, terms=1).collect() if r.topic is not None} == {2, 3}


def test_topics_without_words(spark):
    texts = spark.createDataFrame([(1, None), (2, "alone"), (None, "")], "doc_id long, text string")
    assert {tuple(r) for r in lake.topics(texts, "doc_id", "text").collect()} == {(1, None), (2, None), (None, None)}
    assert lake.topics(texts.limit(0), "doc_id", "text").count() == 0


def test_attrition_of_held_out_rows(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        left = int(rng.random() < 0.4)
        rows.append((i, rng.randint(100, 500) + 900 * (1 - left), 30000.0 + rng.randint(0, 9000), 200, rng.randint(0, 6) + 8 * left, left))
    features = spark.createDataFrame(rows, "employee_id long, tenure_days int, salary double, days long, absences long, label int")
    model = lake.attrition_model(features.where("employee_id < 200"))
    risk = {r.employee_id: (r.label, r.risk) for r in lake.attrition_risk(features.where("employee_id >= 200"), model).collect()}
    right = sum((p >= 0.5) == bool(label) for label, p in risk.values())
    assert len(risk) == 200 and right >= 190


def test_ratings_of_held_out_rows(spark):
    rng = random.Random(7)
    rows = []
    for i in range(300):
        rating, absences = rng.uniform(1, 5), rng.randint(0, 9)
        rows.append((i, rating, rng.randint(1, 6), absences, rng.randint(0, 4), 0.5 + 0.8 * rating - 0.05 * absences + rng.uniform(-0.05, 0.05)))
    features = spark.createDataFrame([*rows, (300, None, 1, 0, 0, 2.0)], "employee_id long, rating double, reviews long, absences long, courses long, label double")
    model = lake.rating_model(features.where("employee_id < 150 OR employee_id = 300"))
    got = {r.employee_id: r for r in lake.expected(features, model).collect()}
    assert max(abs(got[i].expected - got[i].label) for i in range(150, 300)) < 0.1
    assert got[300].expected is None


def test_features_take_nothing_from_later(spark):
    """Rows of the first half alone give the features, those of the second half the label."""
    since = date(2024, 1, 16)
    early, late = date(2024, 1, 10), date(2024, 1, 16)
    employees = spark.createDataFrame([(1,), (2,), (3,), (None,)], "employee_id int")
    attendance = spark.createDataFrame([(1, early, "Present", 0, 7200), (1, early, "Absent", None, None), (1, late, "Absent", 0, 3600), (None, early, "Present", 0, 3600)], "employee_id int, work_date date, status string, clock_in_sec int, clock_out_sec int")
    leave = spark.createDataFrame([(2, early), (2, late)], "employee_id int, start_date date")
    surveys = spark.createDataFrame([(1, early, 4.0), (1, late, 2.0), (2, late, 5.0), (3, early, 1.0)], "employee_id int, survey_date date, wellbeing_score double")
    got = sorted(tuple(r) for r in lake.burnout_features(employees, attendance, leave, surveys, since).collect())
    assert got == [(1, 2, 1, 2.0, 0, 4.0, 1), (2, 0, 0, 0.0, 1, 2.5, 0)]
    assert lake.burnout_features(employees, attendance.limit(0), leave.limit(0), surveys.limit(0), since).count() == 0


def test_trends(spark):
    rows = [(1, date(2023, 11, 5), 10.0), (1, date(2023, 11, 6), 2.0), (1, date(2023, 12, 1), 14.0), (2, date(2024, 3, 1), 7.0), (2, None, 9.0), (None, date(2024, 1, 1), 1.0)]
    series = lake.monthly(spark.createDataFrame(rows, "k int, at date, v double"), "k", "at", lake.F.col("v"))
    got = {tuple(r) for r in lake.trend_forecast(series, "k", 2).collect()}
    assert got == {(1, date(2024, 1, 1), 16.0), (1, date(2024, 2, 1), 18.0), (2, date(2024, 4, 1), 7.0), (2, date(2024, 5, 1), 7.0), (None, date(2024, 2, 1), 1.0), (None, date(2024, 3, 1), 1.0)}
