"""HR calculations on small rows."""

import random

import pytest

from rosterlake.operators import ranked
from rosterlake.plans import derive


def test_hierarchy_has_every_level(spark, tmp_path):
    rows = [(1, None), (50, None), (51, 50), (60, 99), (None, 1)] + [(i, i - 1) for i in range(2, 12)]
    people = spark.createDataFrame(rows, "employee_id long, manager_id long")
    want = {(50, 0), (51, 1), (None, 1)} | {(i, i - 1) for i in range(1, 12)}  # 99 is nobody
    assert {tuple(r) for r in derive.hierarchy_levels(people, f"{tmp_path}/all").collect()} == want
    assert {tuple(r) for r in derive.hierarchy_levels(people, f"{tmp_path}/some", depth=3).collect()} == {r for r in want if r[1] < 3}
    assert derive.hierarchy_levels(people.limit(0), f"{tmp_path}/none").count() == 0


def test_emails_are_unique(spark, tmp_path):
    people = spark.createDataFrame([(1, "A B"), (2, "A B"), (3, "A B2"), (4, "A B"), (5, "A B2"), (6, "A B02"), (7, "C D")], "employee_id long, name string")
    got = {r.employee_id: r.email.split("@")[0] for r in derive.unique_emails(people, str(tmp_path)).collect()}
    assert len(set(got.values())) == 7 and (got[1], got[3], got[6], got[7]) == ("a.b", "a.b2", "a.b02", "c.d")
    assert got[2] == "a.b3" and derive.unique_emails(people.limit(0), str(tmp_path)).count() == 0


@pytest.fixture
def many_ranges(spark):
    """Small ranges are not put together, so that a key lies over several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_emails_by_brute_force(spark, tmp_path, many_ranges):
    """Names of few stems, many of them without Latin letters, and numbers that others' names end in."""
    rng = random.Random(3)
    names = [rng.choice(["Łż ńś", "Ж Д", None, "", "A B", f"A B{rng.randrange(9)}", f"C D{rng.randrange(400)}", f"Ж {rng.randrange(40)}"]) for _ in range(3000)]
    people = spark.createDataFrame(list(enumerate(names)), "employee_id long, name string").withColumnRenamed("name", "full name")
    alnum = lambda s: "".join(c for c in s.lower() if c in "0123456789abcdefghijklmnopqrstuvwxyz")
    base = lambda s: "" if s is None else ".".join(alnum(w) for w in ((s.split() or [""])[0], (s.split() or [""])[-1]))
    stem = lambda b: b.rstrip("0123456789")
    bases = [base(n) for n in names]
    own = {(stem(b), int(b[len(stem(b)) :])) for b in bases if b[len(stem(b)) :] and b[len(stem(b))] != "0"}
    want, seen, last = {}, set(), {}
    for b, k in sorted((b, k) for k, b in enumerate(bases)):
        if b not in seen:
            seen.add(b)
            want[k] = b
            continue
        n = last.get(stem(b), 1) + 1
        while (stem(b), n) in own:
            n += 1
        last[stem(b)] = n
        want[k] = f"{stem(b)}{n}"
    got = {r.employee_id: r.email for r in derive.unique_emails(people, str(tmp_path), "full name").collect()}
    assert got == {k: f"{v}@example.com" for k, v in want.items()}


def test_ranks_of_a_frequent_key(spark, tmp_path, many_ranges):
    rows = [(None if k % 5 else k % 3, k, k % 7) for k in range(4000)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "a long, b long, c long").repartition(6)
    want, seen = set(), {}
    for a, b, _ in sorted(rows, key=lambda r: r[1]):
        seen[a] = seen.get(a, 0) + 1
        want.add((a, b, seen[a]))
    assert {(r.a, r.b, r.n) for r in ranked(df, ["a"], ["b"], str(tmp_path), "n").collect()} == want
    spread = [spark.read.parquet(str(p)).where("a IS NULL").select("_range").distinct().count() for p in tmp_path.iterdir()]
    assert spread[0] > 1  # one key, several ranges
