"""Ranking, calibration, errors and learnt lexicons against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rosterlake.plans import lexicons, quality


def test_ranking_and_errors(spark):
    r = random.Random(4)
    rows = [(k, round(r.random(), 2), int(r.random() < 0.3)) for k in range(250)] + [(900, None, 1), (901, 0.5, None), (902, 1.0, 1), (903, 0.0, 0)]
    frame = spark.createDataFrame(rows, "k int, p double, y int")
    known = [(p, y) for _, p, y in rows if p is not None and y is not None]
    good, bad = [p for p, y in known if y], [p for p, y in known if not y]
    got = quality.ranking(frame, "p", "y").first()
    assert (got.positives, got.negatives) == (len(good), len(bad))
    assert math.isclose(got.auc, sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad)))
    youden = {c: round(sum(p >= c for p in good) / len(good) - sum(p >= c for p in bad) / len(bad), 12) for c, _ in known}
    assert math.isclose(got.best_youden, max(youden.values())) and got.best_cut == min(c for c, v in youden.items() if v == max(youden.values()))
    one = quality.probability_errors(frame, "p", "y").first()
    clip = lambda p: min(max(p, 1e-12), 1 - 1e-12)
    assert one.rows == len(known) and math.isclose(one.log_loss, sum(-math.log(clip(p) if y else 1 - clip(p)) for p, y in known) / len(known)) and math.isclose(one.brier, sum((p - y) ** 2 for p, y in known) / len(known))
    gap = 0
    for b in quality.calibration(frame, "p", "y").collect():
        own = [(p, y) for p, y in known if min(int(p * 10), 9) == b.bin]
        assert b.rows == len(own) and math.isclose(b.mean_score, sum(p for p, _ in own) / len(own)) and math.isclose(b.share, sum(y for _, y in own) / len(own))
        gap += abs(sum(p - y for p, y in own))
    assert math.isclose(one.calibration_error, gap / len(known))


def test_quality_of_nothing_and_of_one_class(spark):
    none = spark.createDataFrame([], "p double, y int")
    assert tuple(quality.ranking(none, "p", "y").first()) == (0, 0, None, None, None)
    assert quality.probability_errors(none, "p", "y").first().brier is None and quality.calibration(none, "p", "y").count() == 0
    assert quality.ranking(spark.createDataFrame([(0.3, 1), (0.4, 1)], "p double, y int"), "p", "y").first().auc is None
    rows = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (None, 4.0), (2.0, 1.0)], "p double, y double")
    got = quality.number_errors(rows, "p", "y").first()
    assert got.rows == 3 and math.isclose(got.mean_error, 2 / 3) and math.isclose(got.root_mean_square, math.sqrt(2 / 3)) and abs(got.explained) < 1e-12
    a, b = quality.halves(spark.range(1000), "id")
    assert 400 < a.count() < 600 and a.count() + b.count() == 1000 and a.join(b, "id").count() == 0


def test_learnt_lexicon(spark):
    r = random.Random(9)
    texts = [(k, " ".join(r.choices(["fine", "good", "plain", "word"] if k % 2 else ["Bad", "poor", "plain", "word"], k=8))) for k in range(60)] + [(100, None), (101, ""), (102, "good good unseen"), (None, "poor"), (103, "nothing known")]
    labels = [(k, k % 2) for k in range(50)] + [(100, 1), (101, 0), (55, None), (999, 1)]
    t, l = spark.createDataFrame(texts, "id int, t string").withColumn("weight", F.lit("clash")), spark.createDataFrame(labels, "id int, y int")
    found = {x.word: x for x in lexicons.learnt_lexicon(t, l, "id", "t", "y", least=3).collect()}
    assert set(found) == {"fine", "good", "bad", "poor", "plain", "word"}
    own = {k: set((x or "").lower().split()) for k, x in texts}
    y = {k: v for k, v in labels if v is not None and k in own}
    for w, x in found.items():
        p, q = sum(w in own[k] for k, v in y.items() if v == 1), sum(w in own[k] for k, v in y.items() if v == 0)
        odds = ((p + 1) / (sum(v == 1 for v in y.values()) + 2)) / ((q + 1) / (sum(v == 0 for v in y.values()) + 2))
        assert (x.positives, x.negatives) == (p, q) and x.weight == math.floor(abs(100 * math.log(odds)) + 0.5) * (1 if odds > 1 else -1)
    scores = {x.id: (x.score, x.hits) for x in lexicons.scored(t, spark.createDataFrame([tuple(x)[:2] for x in found.values()], "word string, weight long"), "id", "t").collect()}
    assert scores[102] == (found["good"].weight, 1) and scores[None] == (found["poor"].weight, 1) and scores[100] == scores[101] == scores[103] == (0.0, 0)
    held = [(scores[k][0] > 0) == bool(k % 2) for k in range(50, 60)]
    assert all(held) and len(scores) == len(texts)
    assert lexicons.learnt_lexicon(t.limit(0), l, "id", "t", "y").count() == 0


def test_whole_refresh_stops_at_the_gate(spark, tmp_path):
    from datetime import date

    from rosterlake.plans import jobs
    from rosterlake.plans.rules import Rule, RuleFailure
    from rosterlake.sources.lake import FileSource

    spark.range(3).write.parquet(f"{tmp_path}/in/a.parquet")
    tables = {"a": spark.range(3)}
    rule = lambda bad: Rule("X", "few rows", lambda t: t["a"].where(f"id < {bad}"), ("a",))
    raw = {"source": FileSource(spark, f"{tmp_path}/in"), "root": f"{tmp_path}/raw", "lake": f"{tmp_path}/lake", "tables": ["a"], "system": "x", "schema": "y"}
    with pytest.raises(RuleFailure):
        jobs.full_refresh(spark, tables, date(2024, 1, 1), f"{tmp_path}/r1", [rule(2)], **raw)
    assert not (tmp_path / "raw").exists() and (tmp_path / "r1").exists()
    done = jobs.full_refresh(spark, tables, date(2024, 1, 1), f"{tmp_path}/r2", [rule(0)], **raw)
    assert done["uploaded_files"] and spark.read.parquet(f"{tmp_path}/lake/raw/a").count() == 3
