"""Operators 11 to 13 against brute force on small rows, with nulls, empties, repeats, ties and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlake.llm import centroids, line_dedup, resample

CLASH = ("hi", "row", "places", "score", "cluster", "rank")
BLANK = " \t\n\x0b\x0c\r"


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).selectExpr("*", *[f"'clash' AS {c}" for c in CLASH])


# 11


def test_cuckoo_filter_forgets():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(-(2**63), 2**63 - 1, (60_000, 2)), axis=0)
    hi, lo = rng.permutation(keys).T.copy()
    f = line_dedup.CuckooFilter()
    for a, b in ((0, 3), (3, 20_000), (20_000, 20_001), (20_001, 50_000)):
        f.add(hi[a:b], lo[a:b])
        f = line_dedup.CuckooFilter(f.packed())
    assert f.has(hi[:50_000], lo[:50_000]).all() and len(f.tables) > 1
    assert f.has(hi[50_000:], lo[50_000:]).mean() < 0.01
    f.forget(hi[:49_000:2], lo[:49_000:2])
    assert f.has(hi[1:50_000:2], lo[1:50_000:2]).all() and f.has(hi[49_000:50_000], lo[49_000:50_000]).all()
    assert f.has(hi[:49_000:2], lo[:49_000:2]).mean() < 0.01
    f.forget(hi[1:49_000:2], lo[1:49_000:2])
    f.forget(hi[49_000:50_000], lo[49_000:50_000])
    assert not any(t.any() for t in f.tables)
    f.add(hi[:0], lo[:0])
    assert not line_dedup.CuckooFilter(b"").has(hi[:5], lo[:5]).any()


def test_cuckoo_filter_keeps_shared_fingerprints():
    """Keys with one fingerprint and one place: forgetting one leaves the others."""
    hi, lo = np.full(6, 65535 * 7, np.int64), np.arange(6, dtype=np.int64) << 40
    f = line_dedup.CuckooFilter()
    f.add(hi, lo)
    for n in range(6):
        assert f.has(hi[n:], lo[n:]).all()
        f.forget(hi[n : n + 1], lo[n : n + 1])
    assert not f.has(hi, lo).any()
    many = np.arange(40, dtype=np.int64) << 40  # more than two buckets hold: a larger table comes
    f.add(np.full(40, 3, np.int64), many)
    assert f.has(np.full(40, 3, np.int64), many).all()


def line_key(line):
    key = line.strip(BLANK)
    return key.encode().lower().decode() if len(key) >= 10 else None


def kept_lines(rows):
    """By brute force: (doc_id, text, n_lines, n_dropped) of each row."""
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[line_key(line)].add((i is None, i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = [line_key(x) is not None and len(holders[line_key(x)]) > 1 and min(holders[line_key(x)], key=lambda t: (t[0], t[1] or 0)) != (i is None, i) for x in lines]
        out.append((i, "\n".join(x for x, g in zip(lines, gone) if not g), len(lines), sum(gone)))
    return Counter(out)


def line_rows(seed):
    r = random.Random(seed)
    pool = ["The same boiler plate", "  the SAME boiler plate\t", "short", "", "Été à la plage", "été à la plage", "another shared line\r", "0123456789", "012345678", "\xa0no-break space\xa0", *(f"own line number {k}" for k in range(30))]
    rows = [(r.randrange(40), "\n".join(r.choices(pool, k=r.randrange(8)))) for _ in range(60)]
    return rows + [(None, "the same boiler plate\nonly with null here"), (None, "only with null here"), (3, None), (4, ""), rows[0], rows[0], (5, "\n".join(pool) * 50)]


def test_line_index_in_any_order(spark):
    rows = line_rows(1)
    whole = docs(spark, rows)
    index = line_dedup.empty(spark, 7)
    for k in range(3):
        index = line_dedup.insert(index, whole.where(F.coalesce(F.col("doc_id"), F.lit(1)) % 3 == k))
    cleaned = lambda d, x: Counter(tuple(r) for r in line_dedup.clean(d, x).collect())
    assert cleaned(whole, index) == kept_lines(rows)
    gone = [(i,) for i in (0, 1, 2, 5, 9, 30, 99)] + [(None,)]
    less = line_dedup.delete(index, spark.createDataFrame(gone, "doc_id long"))
    left = [r for r in rows if (r[0],) not in gone]
    assert cleaned(docs(spark, left), less) == kept_lines(left)
    # Counts and filters are those of an index of the documents that are left, and putting the others back restores all.
    fresh = line_dedup.insert(line_dedup.empty(spark, 7), docs(spark, left))
    state = lambda x: sorted(map(str, x.counts.select("shard", "hi", "lo", "refs", "first", "last", "nulls").collect()))
    assert state(less) == state(fresh)
    held = lambda x: sum(int(np.count_nonzero(t)) for r in x.filters.collect() for t in line_dedup.CuckooFilter(bytes(r.filter)).tables)
    assert held(less) == held(fresh) == less.counts.count()
    again = line_dedup.insert(less, docs(spark, [r for r in rows if (r[0],) in gone]))
    assert cleaned(whole, again) == kept_lines(rows) and state(again) == state(index) and held(again) == again.counts.count()


def test_lines_of_nothing(spark):
    index = line_dedup.insert(line_dedup.empty(spark), docs(spark, []))
    assert line_dedup.clean(docs(spark, []), index).count() == 0
    index = line_dedup.insert(index, docs(spark, [(None, None)]))
    assert [tuple(r) for r in line_dedup.clean(docs(spark, [(None, None)]), index).collect()] == [(None, "", 1, 0)]
    assert line_dedup.delete(index, spark.createDataFrame([(None,)], "doc_id long")).counts.count() == 0


def test_long_lines(spark):
    rows = [(k, f"{'x' * 3_000_000}\n{'shared line %d' % (k % 2)}\n{'y' * k}") for k in range(6)]
    got = Counter(tuple(r) for r in line_dedup.clean(docs(spark, rows), line_dedup.insert(line_dedup.empty(spark), docs(spark, rows))).collect())
    assert got == kept_lines(rows)


# 12


@pytest.mark.parametrize("longest", [5, 64, 65, 200, 5000, 3_000_000])
def test_crc_of_spans(longest):
    rng = np.random.default_rng(longest)
    data = rng.integers(0, 256, max(10_000, 2 * longest), np.uint8)
    n = 4 if longest > 10_000 else 300
    lengths = np.concatenate(([0, 1, longest], rng.integers(0, longest + 1, n)))
    starts = rng.integers(0, len(data) - lengths + 1)  # they overlap
    want = [zlib.crc32(data[a : a + k].tobytes()) for a, k in zip(starts, lengths)]
    assert resample.crc32_spans(data, starts, lengths).tolist() == want


def feature_list(text, order):
    low = (text or "").encode().lower().decode()
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [" ".join(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)]


def drawn(rows, target, buckets, order, least, percent, seed):
    """By brute force: (doc_id, n_words, n_features, weight, score, rank) of each row, equal ones in any order."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for counts, texts in ((s, [r[1] for r in rows]), (t, target)):
        for text in texts:
            counts.update(map(bucket, feature_list(text, order)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for i, text in rows:
        n, found = feature_list(text, order)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    ranks = defaultdict(list)
    for k, r in enumerate(able, 1):
        ranks[r].append(k if k <= percent * len(able) // 100 else None)
    return Counter(r + (ranks[r].pop(0) if ranks[r] else None,) for r in out)


@pytest.mark.parametrize("order", [1, 3])
def test_resampling(spark, order):
    r = random.Random(order)
    words = ["Alpha", "beta", "x1", "étude", "日本語", "a" * 70, "b" * 64, "-", "...", " ", "A_b"]
    text = lambda k: r.choice([" ", "\n", ", "]).join(r.choices(words, k=k))
    rows = [(k, text(r.randrange(12))) for k in range(80)] + [(None, None), (None, "beta alpha beta x1"), (7, text(9)), (7, ""), (2, "alphabeta"), (3, "c" * 100_000)]
    rows += [rows[5]] * 3
    target = [text(5) for _ in range(10)] + [None, ""]
    benchmark = spark.createDataFrame([(None, x) for x in target], "item_id long, text string").selectExpr("*", *[f"'clash' AS {c}" for c in CLASH])
    for percent, least in ((30, 3), (100, 0), (0, 1)):
        got = resample.resample(docs(spark, rows), benchmark, buckets=97, order=order, least=least, percent=percent, seed=9)
        assert Counter(tuple(x) for x in got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()) == drawn(rows, target, 97, order, least, percent, 9)


def test_resampling_of_nothing(spark):
    none = docs(spark, [])
    assert resample.resample(none, none).count() == 0
    assert resample.resample(docs(spark, [(1, None)]), none).first().asDict() | {"score": 0} == {"doc_id": 1, "n_words": 0, "n_features": 0, "weight": 0, "score": 0, "rank": None}


# 13


def test_pivot_bounds_hold_and_spare_comparisons():
    rng = np.random.default_rng(2)
    middles = rng.integers(-30_000, 30_000, (20, 16))
    x = middles[rng.integers(0, 20, 3000)] + rng.integers(-300, 300, (3000, 16))
    own = np.concatenate((x[:30], x[:1]))  # two equal centroids: the smaller number wins
    pivots, pairs = centroids.choose_pivots(own)
    nearest = centroids.Nearest(own, pivots, pairs)
    far = centroids.distances(x, pivots)
    exact = centroids.squared(x[:, None, :], own[None, :, :])
    assert (nearest.bounds(far) ** 2 <= exact).all()
    cluster, distance, looked = nearest.find(x, far)
    assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert looked < exact.size / 3
    same = np.ones((5, 16), np.int64)  # no two pivots differ: every centroid is compared
    alike = centroids.Nearest(same, *centroids.choose_pivots(same))
    assert alike.find(x, centroids.distances(x, same[:1]))[0].max() == 0


def lloyd(rows, k, rounds, seed):
    start = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    own = [list(r[1]) for r in start]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(own))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, x in rows:
            members[near(x)[1]].append(x)
        for j, xs in members.items():
            own[j] = [sum(v) // len(xs) for v in zip(*xs)]
    found = [(i, *near(x)[::-1]) for i, x in rows]
    inertia = Counter()
    for _, j, d in found:
        inertia[j] += d
    return Counter((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, own[j])).encode()).hexdigest()) for i, j, d in found)


def test_clusters(spark):
    r = random.Random(4)
    vector = lambda: [r.uniform(-2, 2) + r.choice([0, 5]) for _ in range(6)]
    rows = [(k, vector()) for k in range(120)]
    rows += [(None, rows[3][1]), (None, vector()), rows[8], rows[8], (8, vector())]
    odd = [(200, None), (201, [1.0] * 5), (202, [1.0] * 5 + [None]), (203, [1.0] * 5 + [float("nan")]), (204, [float("inf")] + [1.0] * 5), (205, [])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", *[f"'clash' AS {c}" for c in CLASH])
    whole = [(i, [math.floor(256 * v) for v in x]) for i, x in rows]
    for k, rounds in ((9, 3), (1, 1), (500, 2)):
        got = centroids.cluster(centroids.whole_vectors(frame, size=6), k, rounds, seed=2)
        assert Counter(tuple(x) for x in got.collect()) == lloyd(whole, k, rounds, 2)
    assert centroids.cluster(centroids.whole_vectors(frame, size=7)).count() == 0
    large = spark.createDataFrame([(1, [1e9])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(centroids.whole_vectors(large, size=1)).collect()


# Rows that earlier operators choose among


def test_chat_ties_by_the_texts_themselves(spark):
    from rosterlake.llm import chat

    rows = [(1, 0, "user", "A"), (1, 0, "user", "<turn x"), (1, 0, "user", "\\<turn y"), (1, 1, "assistant", "b"), (1, 1, "assistant", "</turn>")]
    got = chat.read_chats(chat.format_chats(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))).first()
    assert [t.text for t in got.turns] == ["<turn x", "A", "\\<turn y", "</turn>", "b"] and got.loss_texts == ["</turn>", "b"]


def test_defined_rows_for_any_order(spark):
    from rosterlake.llm import mixing, ngram_join

    text = " ".join(f"word{k}" for k in range(40))
    rows = [(1, text, s, {"k": s, "j": "x"}, [{"n": k}]) for k, s in enumerate("abcd")] * 2 + [(2, text, "z", None, None), (3, "other words than those of the first text", "q", {}, [])]
    kind = "doc_id long, text string, source string, tags map<string,string>, nested array<map<string,int>>"
    kept, mixes = set(), set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        frame = spark.createDataFrame(rows, kind).repartition(seed + 1)
        out = ngram_join.drop_near_duplicates(frame)
        assert out.columns == ["doc_id", "text", "source", "tags", "nested"]
        got = out.collect()
        assert sorted(r.doc_id for r in got) == [1, 3]
        kept.add(next(r.source for r in got if r.doc_id == 1))
        mixes.add(str(sorted((r.doc_id, r.source, str(sorted((r.tags or {}).items())), str(r.nested)) for r in mixing.mix(frame).collect())))
    assert len(kept) == 1 and len(mixes) == 1
    alike = [(1, "one two three", "s", {"k": str(k)}, None) for k in range(3)]  # they differ in a map alone
    taken = mixing.mix(spark.createDataFrame(alike, kind), most=1).collect()
    assert sorted(r.tags["k"] for r in taken) == ["0", "1", "2"]


def test_boilerplate_costs_no_pairs(spark, monkeypatch):
    """Texts that share 190 of 202 words, no two of them linked: they have one hub, and none meets another."""
    from rosterlake.llm import ngram_join

    shared = [f"common{k}" for k in range(190)]
    rows = []
    for i in range(1500):
        at = random.Random(i).randrange(len(shared))
        rows.append((i, " ".join([*shared[:at], *(f"own{i}x{k}" for k in range(12)), *shared[at:]])))
    sent, compared = [], ngram_join.compared

    def counting(pairs, *more):
        sent.append(pairs.count())
        return compared(pairs, *more)

    monkeypatch.setattr(ngram_join, "compared", counting)
    met, meeting = [], ngram_join.meeting

    def candidates(near, plan):
        sides = meeting(near, plan)
        met.append(near.count())
        met.extend(x.join(y, x["hub"] == y["h"]).count() for x, y in sides)
        return sides

    monkeypatch.setattr(ngram_join, "meeting", candidates)
    got = ngram_join.jaccard_classes(docs(spark, rows), 3, 90, 100).collect()
    assert len({r.component_id for r in got}) == 1500
    assert met[0] >= 1400 and sum(sent) <= 10 * 1500 and sum(met) <= 10 * 1500, (sent, met)
