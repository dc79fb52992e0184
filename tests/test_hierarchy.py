"""Reporting lines by brute force: chains, trees, cycles, missing managers."""

import random

from pyspark.sql.readwriter import DataFrameWriter

from rosterlake.plans.hierarchy import reporting_lines


def walk(manager, e):
    """(steps, top, kind, first repeated id) by walking up."""
    seen, at = [], e
    while True:
        seen.append(at)
        m = manager[at]
        if m is None or m not in manager:
            return len(seen) - 1, at, "root" if m is None else "missing", None
        if m in seen:
            return None, None, None, seen[seen.index(m) :]
        at = m


def brute(manager):
    out, below = set(), dict.fromkeys(manager, 0)
    walks = {e: walk(manager, e) for e in manager}
    for e in manager:
        at, seen = manager[e], {e}
        while at in manager and at not in seen:
            below[at] += 1
            seen.add(at)
            at = manager[at]
    for e, (steps, top, kind, cycle) in walks.items():
        direct = sum(m == e for m in manager.values())
        if cycle:
            on = e in cycle
            out.add((e, None, None, "cycle" if on else "below cycle", min(cycle), direct, None if on else below[e]))
        else:
            out.add((e, steps, top, kind if not steps else "reports" if kind == "root" else "below missing", None, direct, below[e]))
    return out


def check(spark, manager, folder):
    rows = [tuple(r) for r in reporting_lines(spark.createDataFrame(list(manager.items()), "employee_id int, manager_id int"), str(folder)).collect()]
    assert len(rows) == len(manager) and set(rows) == brute(manager)


def test_random_managers(spark, tmp_path):
    r = random.Random(2)
    check(spark, {e: r.choice([None, e, 999, *range(60)]) if r.random() < 0.15 else r.randrange(60) for e in range(60)}, tmp_path / "a")
    check(spark, {e: (None if e == 0 else r.randrange(e)) for e in range(80)}, tmp_path / "b")


def test_deep_chain_and_cycles(spark, tmp_path):
    manager = {e: e - 1 if e else None for e in range(400)}
    manager |= {1000 + e: 1000 + (e + 1) % 96 for e in range(96)} | {2000 + e: 1999 + e for e in range(1, 70)} | {2000: 1050, 5000: 5000, 5001: 5000, 6000: -1, 6001: 6000}
    check(spark, manager, tmp_path)


def test_nobody(spark, tmp_path):
    assert reporting_lines(spark.createDataFrame([], "employee_id int, manager_id int"), str(tmp_path)).count() == 0


def test_no_join_passes_through_the_driver(spark, tmp_path, monkeypatch):
    plans, parquet = [], DataFrameWriter.parquet

    def kept(self, path, *args, **kwargs):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        parquet(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", kept)
    manager = {e: e - 1 if e else None for e in range(12)} | {20: 21, 21: 20, 22: 20, 30: 99}
    check(spark, manager, tmp_path / "a")
    rows = reporting_lines(spark.createDataFrame(list(manager.items()), "employee_id int, manager_id int"), str(tmp_path / "b"))
    plans.append(rows._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 6 and not any("Broadcast" in p for p in plans) and all("SortMergeJoin" in p for p in plans)
