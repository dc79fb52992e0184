"""Bucketed merges and rules with state: any order of arrival, replays, untouched files."""

import os
import random
from collections import Counter

from pyspark.sql import functions as F

from rosterlake import streaming
from rosterlake.bindings import stream_bindings
from rosterlake.operators import BucketedTable

ROW = "k long, at long, v string, op string"


def files(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-") and "/_bucket=" in d}


def frame(spark, rows):
    return spark.createDataFrame(rows, ROW)


def held(rows):
    """The last change of each key, without deleted ones."""
    out = {}
    for k, at, v, op in rows:
        if k not in out or at > out[k][0]:
            out[k] = (at, v, op)
    return Counter((k, at, v) for k, (at, v, op) in out.items() if op != "D")


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = BucketedTable(spark, f"{tmp_path}/t", ["k"], ["at"], 8)
    rows = [(k, 1, f"v{k}", "U") for k in range(200)] + [(None, 1, "null", "U")]
    assert Counter(r.action for r in table.merge(frame(spark, rows), 1, "op").collect()) == {"created": 201}
    before = files(tmp_path)
    some = [(7, 2, "new", "U"), (7, 0, "old", "U"), (500, 1, "x", "U")]
    buckets = {r[0] for r in frame(spark, some).select(table.bucket()).collect()}
    log = {r.k: r.action for r in table.merge(frame(spark, some), 2, "op").collect()}
    assert log == {7: "updated", 500: "created"} and len(buckets) < 8
    after = files(tmp_path)
    untouched = {f: t for f, t in before.items() if int(f.split("/_bucket=")[1].split("/")[0]) not in buckets}
    assert untouched and all(after.get(f) == t for f, t in untouched.items())
    assert not any(f in after for f in before if f not in untouched)
    assert table.merge(frame(spark, [(1, 9, "never", "U")]), 2, "op") is None and files(tmp_path) == after  # a batch that was done
    assert Counter(map(tuple, table.read().collect())) == held(rows + some)
    assert not os.path.exists(f"{tmp_path}/t/_aside/2")


def test_actions(spark, tmp_path):
    table = BucketedTable(spark, f"{tmp_path}/t", ["k"], ["at"], 2)
    table.merge(frame(spark, [(k, 5, "a", "U") for k in range(5)]), op="op")
    log = table.merge(frame(spark, [(0, 6, "b", "U"), (1, 6, "a", "U"), (2, 6, None, "D"), (3, 4, "late", "U"), (4, 5, "a", "U"), (9, 1, None, "D")]), op="op")
    assert {r.k: r.action for r in log.collect()} == {0: "updated", 1: "unchanged", 2: "deleted", 3: "stale", 4: "unchanged", 9: "unchanged"}
    log = table.merge(frame(spark, [(2, 5, "before it was deleted", "U"), (9, 2, "back", "U")]), op="op")
    assert {r.k: r.action for r in log.collect()} == {2: "stale", 9: "created"}
    assert sorted(r.k for r in table.read().collect()) == [0, 1, 3, 4, 9]
    assert table.merge(frame(spark, []), op="op") is None


def test_any_order_and_replays(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.choice([None, *range(15)]), at, r.choice(["x", "y", None]), r.choice("UUD")) for at in range(80)]
    r.shuffle(rows)
    table = BucketedTable(spark, f"{tmp_path}/t", ["k"], ["at"], 4)
    for i, (a, b) in enumerate(((0, 30), (20, 50), (50, 80), (0, 10))):
        table.merge(frame(spark, rows[a:b]), i, "op")
    assert Counter(map(tuple, table.read().collect())) == held(rows)


def test_feed_of_a_stream(spark, tmp_path):
    rows = [(i % 11, i, f"v{i}", "D" if i % 7 == 0 else "U") for i in range(100)]
    frame(spark, rows).repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    table = BucketedTable(spark, f"{tmp_path}/t", ["k"], ["at"], 4)
    for _ in range(2):  # the second run finds nothing new
        streaming.merge_stream(stream, table, f"{tmp_path}/check", "op")
        assert Counter(map(tuple, table.read().collect())) == held(rows)


def test_rules_across_batches(spark, tmp_path):
    """Children before parents, duplicates and unlike pairs in different batches: after each run the batch rules' counts."""
    r = random.Random(1)
    children = [(i, r.choice([None, *range(12)])) for i in range(80)]
    parents = [(p,) for p in range(0, 12, 2)] + [(0,)]
    left = [(r.choice([None, *range(6)]), r.choice(["a", "b", None])) for _ in range(30)]
    right = [(r.choice([None, *range(6)]), r.choice(["a", "b", None])) for _ in range(20)]

    def expected(c, p, x, y):
        there = {k for (k,) in p}
        return {
            "orphans": sum(k is None or k not in there for _, k in c),
            "salted": sum(k is None or k not in there for _, k in c),
            "duplicates": sum(n > 1 for n in Counter(k for _, k in c).values()),
            "pairs": sum(a == b and a is not None and u != v for a, u in x for b, v in y),
        }

    for part in range(3):
        cut = lambda rows: rows[part::3]
        # Parents come last, so their children are orphans at first.
        spark.createDataFrame(cut(children), "id int, parent int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/children")
        spark.createDataFrame(cut(parents[::-1]) if part else [], "p int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/parents")
        spark.createDataFrame(cut(left), "k int, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/left")
        spark.createDataFrame(cut(right), "k2 int, w string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/right")
        read = lambda name, kind: spark.readStream.schema(kind).parquet(f"{tmp_path}/{name}")
        c, p = read("children", "id int, parent int"), read("parents", "p int")
        whole = streaming.orphan_statements("orphans", c, p, "parent", "p").unionByName(streaming.orphan_statements("salted", c, p, "parent", "p", salts=3))
        whole = whole.unionByName(streaming.duplicate_statements("duplicates", c, ["parent"]))
        whole = whole.unionByName(streaming.mismatch_statements("pairs", read("left", "k int, v string"), read("right", "k2 int, w string"), "k", "k2", [("v", "w")]))
        streaming.run_stateful_rules(whole, f"{tmp_path}/out", f"{tmp_path}/check")
        got = {x.rule: x.n for x in streaming.open_violations(spark.read.schema(streaming.CHANGE).parquet(f"{tmp_path}/out")).groupBy("rule").agg(F.sum("violations").alias("n")).collect()}
        seen = lambda rows: [x for i in range(part + 1) for x in rows[i::3]]
        there = [x for i in range(1, part + 1) for x in parents[::-1][i::3]]
        assert got == {k: n for k, n in expected(seen(children), there, seen(left), seen(right)).items() if n}


def test_changes_by_batch_and_no_call_for_each_key(spark, tmp_path):
    """+1 and -1 by batch add up to what is open; statements are summed before the state, without Python."""
    r = random.Random(5)
    children, parents = [(r.choice([None, *range(9)]),) for _ in range(45)], [(p,) for p in (8, 6, 4, 2, 0, 0)]
    left, right = ([(r.randrange(4), r.choice(["a", "b", None])) for _ in range(n)] for n in (18, 12))
    want, before = Counter(), Counter()
    for part in range(3):
        read = {}
        for name, rows, kind in (("children", children, "c int"), ("parents", parents, "p int"), ("left", left, "k int, v string"), ("right", right, "k2 int, w string")):
            spark.createDataFrame(rows[part::3], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
            read[name] = spark.readStream.schema(kind).parquet(f"{tmp_path}/{name}")
        whole = streaming.orphan_statements("orphans", read["children"], read["parents"], "c", "p", salts=2).unionByName(streaming.duplicate_statements("duplicates", read["children"], ["c"]))
        whole = whole.unionByName(streaming.mismatch_statements("pairs", read["left"], read["right"], "k", "k2", [("v", "w")]))
        streaming.run_stateful_rules(whole, f"{tmp_path}/out", f"{tmp_path}/check")
        seen = lambda rows: [x for i in range(part + 1) for x in rows[i::3]]
        there = {p for (p,) in seen(parents)}
        now = Counter({("orphans", c): n for c, n in Counter(c for (c,) in seen(children)).items() if c not in there})
        now.update({("duplicates", c): 1 for c, n in Counter(c for (c,) in seen(children)).items() if n > 1})
        now.update(("pairs", a) for a, u in seen(left) for b, v in seen(right) if a == b and u != v)
        want.update({(*k, part): now[k] - before[k] for k in now.keys() | before.keys() if now[k] != before[k]})
        before = now
    changes = spark.read.schema(streaming.CHANGE).parquet(f"{tmp_path}/out")
    key = F.get_json_object("key", "$.k0").cast("int")
    assert {(x.rule, x.k, x.batch): x.delta for x in streaming.violation_changes(changes).withColumn("k", key).collect()} == dict(want) and min(want.values()) < 0
    assert {(x.rule, x.k): x.violations for x in streaming.open_violations(changes).withColumn("k", key).collect()} == dict(before)
    plan = streaming.counts_of(streaming.duplicate_statements("d", spark.range(9), ["id"]))._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "Pandas" not in plan and "Python" not in plan


def test_arriving_in_as_many_files_as_rows_have_tasks(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 8)
    stream = stream_bindings.arriving(rows, f"{tmp_path}/in")
    assert len([f for f in os.listdir(f"{tmp_path}/in") if f.startswith("part-")]) == 9
    sizes = []
    stream.writeStream.foreachBatch(lambda batch, number: sizes.append(batch.count())).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert len(sizes) == 3 and sum(sizes) == 4000
