"""Histories in any order of arrival, the joint timeline, and facts with what held at their time, against brute force."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from rosterlake.plans import history

DAY = date(2020, 1, 1)
CHANGE = "k int, at date, a string, b int"


def day(n):
    return DAY + timedelta(days=n)


def statements(seed, keys=6, n=150):
    r = random.Random(seed)
    rows = [(r.choice([None, *range(keys)]), day(r.randrange(40)), r.choice(["x", "y", None]), r.choice([1, 2, None])) for _ in range(n)]
    return rows + [(1, None, "x", 1), rows[0], rows[0]]


def low(v):
    """Order of a tuple with nulls first."""
    return tuple((x is not None, x) if x is not None else (False, 0) for x in v)


def brute_versions(rows):
    by = {}
    for k, at, *s in rows:
        if at is not None:
            by.setdefault(k, {})[at] = max(by.get(k, {}).get(at, s), s, key=low)
    out = set()
    for k, said in by.items():
        kept = []
        for at in sorted(said):
            if not kept or kept[-1][1] != said[at]:
                kept.append((at, said[at]))
        for i, (at, s) in enumerate(kept):
            to = kept[i + 1][0] if i + 1 < len(kept) else None
            out.add((k, *s, at, to, to is None, i + 1))
    return out


def shown(versions):
    rows = [tuple(r) for r in versions.drop("restated").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_changes_in_any_order(spark, tmp_path):
    for seed in range(2):
        rows = statements(seed)
        frame = lambda x: spark.createDataFrame(x, CHANGE)
        whole = shown(history.versions_of(frame(rows), "k", "at", ("a", "b")))
        assert whole == brute_versions(rows)
        random.Random(seed).shuffle(rows)
        parts = [rows[:60], rows[60:61], rows[61:120], rows[50:70], [], rows[120:]]
        versions, done = history.versions_of(frame([]), "k", "at", ("a", "b")), []
        for i, p in enumerate(parts):
            versions = history.merge_changes(versions, frame(p), "k", "at", ("a", "b"))
            versions.write.parquet(f"{tmp_path}/{seed}-{i}")
            versions = spark.read.parquet(f"{tmp_path}/{seed}-{i}")
            done += p
            assert shown(versions) == brute_versions(done)
        assert shown(versions) == whole


def test_a_late_change_splits_a_version(spark):
    frame = lambda *x: spark.createDataFrame([(1, day(n), s, 0) for n, s in x], CHANGE)
    base = history.versions_of(frame((1, "x"), (5, "x"), (9, "x")), "k", "at", ("a", "b"))
    assert [(r.a, r.effective_from, r.restated) for r in base.collect()] == [("x", day(1), [day(5), day(9)])]
    split = history.merge_changes(base, frame((7, "y")), "k", "at", ("a", "b"))
    assert [(r.a, r.effective_from, r.effective_to) for r in split.orderBy("version").collect()] == [("x", day(1), day(7)), ("y", day(7), day(9)), ("x", day(9), None)]
    filled = history.merge_changes(split, frame((8, "x"), (0, "x")), "k", "at", ("a", "b"))
    assert [(r.a, r.effective_from) for r in filled.orderBy("version").collect()] == [("x", day(0)), ("y", day(7)), ("x", day(8))]


def test_timeline_and_facts(spark):
    r = random.Random(7)
    base = [(k, k * 10, "home", f"role{k}") for k in range(5)] + [(None, -1, None, "nobody")]
    moves = [(r.choice([None, *range(6)]), r.choice([None, day(r.randrange(20))]), r.choice([1, 2, None]), r.choice(["here", None])) for _ in range(40)]
    raises = [(r.choice([None, *range(6)]), day(r.randrange(20)), r.choice(["p", "q", None])) for _ in range(30)]
    facts = [(i, r.choice([None, 0, 0, 0, 1, 2, 3, 4, 5, 9]), r.choice([None, day(r.randrange(-3, 25))])) for i in range(300)]

    t = history.timeline(
        spark.createDataFrame(base, "k int, place int, site string, role string"), "k",
        {"m": (spark.createDataFrame(moves, "k int, d date, p int, s string"), "d", {"place": "p", "site": "s"}), "r": (spark.createDataFrame(raises, "k int, d date, x string"), "d", {"role": "x"})},
    )

    def last(events, k, at):
        found = [e for e in events if e[0] == k and e[1] is not None and at is not None and e[1] <= at]
        return max(found, key=lambda e: (e[1], low(e[2:])))[2:] if found else None

    def held(k, at):
        start = next((b for b in base if b[0] == k), None)
        if at is None:
            return None, None, None
        m, x = last(moves, k, at), last(raises, k, at)
        return (*(m or (start[1:3] if start else (None, None))), x[0] if x else start[3] if start else None)

    f = spark.createDataFrame(facts, "id int, k int, at date").withColumns({"_salt": F.lit("clash"), "place": F.lit("clash")})
    for limit in (1_000_000, 7):  # the second deals frequent keys over several windows
        got = history.as_of(f, t, "k", "at", ("place", "site", "role"), ("id",), limit)
        assert sorted((tuple(x) for x in got.select("id", "place", "site", "role").collect()), key=str) == sorted(((i, *held(k, at)) for i, k, at in facts), key=str)
    rows = t.collect()
    for k in {x.k for x in rows}:
        mine = sorted((x for x in rows if x.k == k), key=lambda x: x.version)
        assert [x.version for x in mine] == list(range(1, len(mine) + 1)) and all(a.effective_to == b.effective_from for a, b in zip(mine, mine[1:])) and mine[-1].is_current
        assert all((a.place, a.site, a.role) != (b.place, b.site, b.role) for a, b in zip(mine, mine[1:]))
