"""Survival, forecasts, phrases, spellings, lineage and safe views against brute force."""

import hashlib
import hmac
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rosterlake.plans import conform, forecast, lineage, phrases, sharing, survival

# Survival


def durations(seed, n=300):
    r = random.Random(seed)
    return [(r.choice(["a", "b", None]), r.randrange(30), r.random() < 0.6) for _ in range(n)] + [("one", 5, True), ("seen", 4, False), ("zero", 0, True), ("zero", 0, False)]


def test_curves_and_comparison(spark):
    rows = durations(1)
    frame = spark.createDataFrame(rows, "g string, time int, event boolean")
    got = {(r.g, r.time): r for r in survival.kaplan_meier(frame, "g").collect()}
    by = defaultdict(list)
    for g, t, e in rows:
        by[g].append((t, e))
    seen = 0
    for g, xs in by.items():
        s, spread = 1.0, 0.0
        for t in sorted({t for t, _ in xs}):
            n, d = sum(u >= t for u, _ in xs), sum(u == t and e for u, e in xs)
            s *= 1 - d / n
            spread += d / (n * (n - d)) if d < n else 0
            x = got[g, t]
            assert (x.at_risk, x.events, x.censored) == (n, d, sum(u == t for u, _ in xs) - d)
            assert math.isclose(x.survival, s, abs_tol=1e-12) and math.isclose(x.error, s * math.sqrt(spread), abs_tol=1e-12)
            seen += 1
    assert seen == len(got)
    medians = {r.g: r["median"] for r in survival.median_time(survival.kaplan_meier(frame, "g"), "g").collect()}
    assert medians["one"] == 5 and medians["seen"] is None and medians["zero"] == 0
    found = {r.g: (r.observed, r.expected) for r in survival.compared(frame, "g").collect()}
    for g, xs in by.items():
        expected = sum(sum(e for _, u, e in rows if u == t) * sum(u >= t for u, _ in xs) / sum(u >= t for _, u, _ in rows) for t in {t for _, t, e in rows if e})
        assert found[g][0] == sum(e for _, e in xs) and math.isclose(found[g][1], expected, abs_tol=1e-9)
    assert math.isclose(sum(o for o, _ in found.values()), sum(x for _, x in found.values()))
    assert survival.kaplan_meier(frame.where("g = 'none'"), "g").count() == 0


def test_concordance(spark):
    r = random.Random(3)
    rows = [(r.randrange(20), r.random() < 0.7, float(r.randrange(6))) for _ in range(150)] + [(3, True, None)]
    pairs = right = 0
    for t, e, p in rows:
        for u, _, q in rows:
            if e and t < u and p is not None and q is not None:
                pairs += 1
                right += 1 if p < q else 0.5 if p == q else 0
    got = survival.concordance(spark.createDataFrame(rows, "time int, event boolean, p double"), "p").first()
    assert got.pairs == pairs and math.isclose(got.concordance, right / pairs)


def test_hazard_on_held_out_rows(spark):
    r = random.Random(5)
    rows = []
    for k in range(1500):
        x, y = r.random(), r.random()
        time = int(200 * math.exp(2 * x - y) * (-math.log(r.random())) ** 0.5)
        end = r.randrange(50, 900)
        rows.append((k, x, y, min(time, end), time <= end))
    frame = spark.createDataFrame(rows, "k int, x double, y double, time int, event boolean")
    model = survival.hazard_model(frame.where("k % 2 = 0"), ("x", "y"))
    held = survival.expected_time(frame.where("k % 2 = 1"), model, ("x", "y"))
    assert survival.concordance(held, "expected_days").first().concordance > 0.72
    assert abs(model.coefficients[0] - 2) < 0.4 and abs(model.coefficients[1] + 1) < 0.4
    assert survival.concordance(held.withColumn("expected_days", -F.col("expected_days")), "expected_days").first().concordance < 0.28


# Forecasts


def holt_winters(x, m, a=forecast.LEVEL, b=forecast.TREND, g=forecast.SEASONAL):
    if len(x) >= 2 * m:
        level = sum(x[:m]) / m
        trend, season, t = (sum(x[m : 2 * m]) / m - level) / m, [v - level for v in x[:m]], m
    else:
        level, trend, season, t, b, g = x[0], 0.0, [0.0] * m, 1, 0.0, 0.0
    errors = []
    for t in range(t, len(x)):
        old = season[t % m]
        errors.append(x[t] - level - trend - old)
        high = a * (x[t] - old) + (1 - a) * (level + trend)
        trend, level, season[t % m] = b * (high - level) + (1 - b) * trend, high, g * (x[t] - high) + (1 - g) * old
    return [level + h * trend + season[(len(x) + h - 1) % m] for h in (1, 2, 3)], errors


def test_seasonal_forecasts(spark):
    r = random.Random(2)
    series = {"long": [10 + t * 0.5 + 5 * math.sin(t * math.pi / 2) + r.random() for t in range(30)], "short": [3.0, 4.0, 6.0], "one": [7.0], "gap": [1.0, 0.0, 0.0, 5.0] * 4}
    rows = [(k, 100 + i, v) for k, x in series.items() for i, v in enumerate(x) if not (k == "gap" and v == 0)]
    rows += [("null", 5, None), ("null", 6, 2.0), ("one", 100, 1.5)]
    series |= {"null": [0.0, 2.0], "one": [8.5]}
    series["gap"] = series["gap"][:16]
    frame = spark.createDataFrame(rows, "k string, month int, value double")
    got = defaultdict(dict)
    for x in forecast.seasonal_forecast(frame, "k", 3, season=4).collect():
        got[x.k][x.month] = x.forecast
    errors = {x.k: x for x in forecast.rolling_errors(frame, "k", season=4).collect()}
    for k, x in series.items():
        want, off = holt_winters(x, 4)
        first = (5 if k == "null" else 100) + len(x)
        assert list(got[k]) == [first, first + 1, first + 2] and all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(got[k].values(), want))
        assert errors[k].forecasts == len(off) and (not off or math.isclose(errors[k].mean_error, sum(map(abs, off)) / len(off), abs_tol=1e-9) and math.isclose(errors[k].root_mean_square, math.sqrt(sum(e * e for e in off) / len(off)), abs_tol=1e-9))
    assert errors["one"].mean_error is None
    flat = spark.createDataFrame([("s", t, [1.0, 5.0, 2.0][t % 3]) for t in range(12)], "k string, month int, value double")
    assert [round(x.forecast, 6) for x in forecast.seasonal_forecast(flat, "k", 4, season=3).orderBy("month").collect()] == [1.0, 5.0, 2.0, 1.0]


# Phrases


def test_collocations_and_keyphrases(spark):
    texts = [(1, "New York is big. New York, new york!"), (2, "big new car; big new plan"), (3, None), (4, ""), (5, "york"), (6, "Ünder über Ünder über"), (7, "new york is old")]
    frame = spark.createDataFrame(texts, "id int, t string")
    pairs = Counter()
    own = {}
    for i, t in texts:
        w = [x for x in "".join(ch if ch.isalnum() else " " for ch in (t or "").lower()).split()]
        own[i] = Counter(zip(w, w[1:]))
        pairs += own[i]
    total = sum(pairs.values())
    got = {(r.a, r.b): r for r in phrases.collocations(frame, "id", "t", 1).collect()}
    assert {k: r.n for k, r in got.items()} == dict(pairs)
    for (a, b), n in pairs.items():
        na, nb = sum(v for (x, _), v in pairs.items() if x == a), sum(v for (_, y), v in pairs.items() if y == b)
        want = 2 * sum(k * math.log(k * total / (r * c)) for k, r, c in ((n, na, nb), (na - n, na, total - nb), (nb - n, total - na, nb), (total - na - nb + n, total - na, total - nb)) if k > 0)
        assert math.isclose(got[a, b].likelihood_ratio, want, abs_tol=1e-9)
    found = defaultdict(list)
    for r in phrases.keyphrases(frame, "id", "t", 3, 0.5).orderBy("id", "rank").collect():
        found[r.id].append(r.phrase)
    df = Counter(p for c in own.values() for p in c)
    for i, c in own.items():
        chosen = []
        for p in sorted((p for p in c if df[p] <= len(texts) * 0.5), key=lambda p: (-round(c[p] * math.log(len(texts) / df[p]), 6), p)):
            if len(chosen) < 3 and not any(set(p) & set(q) for q in chosen):
                chosen.append(p)
        assert found[i] == [" ".join(p) for p in chosen]


# Spellings


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_spellings_against_all_pairs(spark):
    r = random.Random(8)
    names = [("Full Time", 3), ("full-time", 2), ("Part Time", 4), ("aaaaaaaa", 5), ("aaaabaaa", 6), ("Trainee", 7), ("Intern", 8), (None, 9), ("x", 1), *(("".join(r.choices("abc", k=r.randrange(3, 12))), 20 + k) for k in range(60))]
    values = [n for n, _ in names] + [None, "", " FULL  _time ", "ful tme", "aaaaaaa", "aaaabaab", "trainnee", "y", "completely different"]
    for n, _ in names[9:]:
        x = list(n)
        for _ in range(r.randrange(4)):
            at = r.randrange(len(x) + 1)
            x[at : at + r.randrange(2)] = r.choices("abcd", k=r.randrange(2))
        values.append("".join(x))
    rows = spark.createDataFrame([(v,) for v in values * 2], "v string").withColumns({"distance_": F.lit(1), "text": F.lit("clash"), "n": F.lit("clash")})
    lookup = spark.createDataFrame(names, "name string, id int")
    got = {(x.v, x.code, x.distance) for x in conform.conformed(rows, "v", lookup, "name", "id").collect()}
    plain = lambda s: " ".join(s.lower().replace("-", " ").replace("_", " ").split())
    want = set()
    for v in values:
        near = [] if v is None else [(distance(plain(v), plain(n)), i) for n, i in names if n is not None]
        best = min([(d, i) for d, i in near if d <= (len(plain(v)) + 1) // 4], default=(None, None))
        want.add((v, best[1], best[0]))
    assert got == want and conform.conformed(rows, "v", lookup, "name", "id").count() == len(values) * 2


# Lineage


def test_lineage_of_plans(spark, tmp_path):
    spark.range(5).selectExpr("id", "id AS k", "id * 2 AS v", "array(id) AS xs").write.parquet(f"{tmp_path}/left.parquet")
    spark.range(5).selectExpr("id", "id AS k", "'t' AS name").write.parquet(f"{tmp_path}/right.parquet")
    a, b = spark.read.parquet(f"{tmp_path}/left.parquet"), spark.read.parquet(f"{tmp_path}/right.parquet")
    made = lambda df: {n: {f"{s}.{c}" for s, c in x} for n, x in lineage.Lineage(df).columns}
    decided = lambda df: {f"{s}.{c}" for s, c in lineage.Lineage(df).decided}

    joined = a.alias("a").join(b.alias("b"), F.col("a.k") == F.col("b.k")).where("v > 1").select(F.col("a.id").alias("id"), (F.col("v") + F.col("b.id")).alias("s"), F.lit(1).alias("one"), "name")
    assert made(joined) == {"id": {"left.id"}, "s": {"left.v", "right.id"}, "one": set(), "name": {"right.name"}}
    assert decided(joined) == {"left.k", "right.k", "left.v"}
    grouped = joined.groupBy("name").agg(F.sum("s").alias("total"), F.count(F.lit(1)).alias("n"))
    assert made(grouped) == {"name": {"right.name"}, "total": {"left.v", "right.id"}, "n": set()} and "right.name" in decided(grouped)
    both = a.select("id", "v").union(b.select("k", F.length("name")))
    assert made(both) == {"id": {"left.id", "right.k"}, "v": {"left.v", "right.name"}}
    assert made(a.union(a).select("k")) == {"k": {"left.k"}}
    windowed = a.withColumn("before", F.lag("v").over(Window.partitionBy("k").orderBy("id")))
    assert made(windowed)["before"] == {"left.v", "left.k", "left.id"} and made(windowed)["v"] == {"left.v"}
    assert made(a.select("id", F.explode("xs").alias("x"))) == {"id": {"left.id"}, "x": {"left.xs"}}
    assert made(a.rollup("k").agg(F.sum("v").alias("t"))) == {"k": {"left.k"}, "t": {"left.v"}}
    a.createOrReplaceTempView("lineage_a")
    cte = spark.sql("WITH c AS (SELECT k, v + 1 AS w FROM lineage_a) SELECT x.k AS kk, y.w FROM c AS x JOIN c AS y ON x.k = y.k")
    assert made(cte) == {"kk": {"left.k"}, "w": {"left.v"}}
    self_join = a.select("k", F.col("v").alias("p")).join(a.select("k", F.col("id").alias("q")), "k")
    assert made(self_join) == {"k": {"left.k"}, "p": {"left.v"}, "q": {"left.id"}}
    assert made(a.mapInPandas(lambda parts: parts, a.schema))["v"] == {"left.id", "left.k", "left.v", "left.xs"}
    rows = {(r.output, r.source_column): (r.rows, r.filled) for r in lineage.checked_lineage(grouped, {"left": a, "right": b}).where("role = 'value'").collect()}
    assert rows == {("name", "name"): (5, 5), ("total", "v"): (5, 5), ("total", "id"): (5, 5)}


# Sharing


def test_tokens(spark):
    names = ["Ann", "", "Été", None, "x" * 500]
    for key in (b"0123456789abcdef", b"k" * 64):
        got = [r.t for r in spark.createDataFrame([(n,) for n in names], "n string").select(sharing.token("n", key).alias("t")).collect()]
        assert got == [None if n is None else hmac.new(key, n.encode(), hashlib.sha256).hexdigest() for n in names]
    for key in (b"short", b"k" * 65):
        with pytest.raises(ValueError):
            sharing.token("n", key)


def solved(published):
    """Cells that can be worked out by taking known numbers from totals, again and again."""
    known = {k: n for k, n in published.items() if n is not None}
    found = True
    while found:
        found = False
        for axis in (0, 1):
            lines = defaultdict(list)
            for k in published:
                lines[k[axis]].append(k)
            for line in lines.values():
                open_ = [k for k in line if k not in known]
                total = next(k for k in line if k[1 - axis] == "T")
                if len(open_) == 1:
                    x = open_[0]
                    known[x] = sum(known[k] for k in line if k not in (x, total)) if x == total else known[total] - sum(known[k] for k in line if k not in (x, total))
                    found = True
    return {k: n for k, n in known.items() if published[k] is None}


def test_no_small_group_can_be_worked_out(spark, tmp_path):
    r = random.Random(6)
    for case, (height, width, n) in enumerate(((6, 5, 160), (3, 3, 12), (1, 4, 30), (1, 1, 2), (4, 6, 60))):
        rows = [(r.choice([None, *range(height - 1)]), f"c{int(width * r.random() ** 2)}") for _ in range(n)]
        true = Counter(rows)
        for k, m in list(true.items()):
            true["T", k[1]] += m
            true[k[0], "T"] += m
            true["T", "T"] += m
        frame = spark.createDataFrame(rows, "a int, b string").withColumn("n", F.lit("clash"))
        published = {}
        for x in sharing.safe_counts(frame, "a", "b", 5, f"{tmp_path}/{case}").collect():
            published["T" if x.total_of in ("column", "all") else x.a, "T" if x.total_of in ("row", "all") else x.b] = x.n
        assert set(published) == set(true)
        assert all(n is None or n == true[k] and n >= 5 for k, n in published.items())
        assert not solved(published)
        for axis in (0, 1):
            for line in {k[axis] for k in published}:
                gone = [true[k] for k in published if k[axis] == line and published[k] is None]
                assert not gone or len(gone) > 1 and sum(gone) >= 5 or len(gone) == sum(k[axis] == line for k in published)
    assert sharing.safe_counts(spark.createDataFrame([], "a int, b string"), "a", "b", 5, f"{tmp_path}/none").count() == 0
