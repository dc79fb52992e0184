"""N-gram Jaccard join: every pair of documents whose shingle sets are alike enough, and the classes they form.

Words are runs of characters other than ASCII white space, after A-Z became a-z; a document's set holds its distinct
shingles of `size` words as 64-bit hashes (a shorter text: its whole word sequence as one; no words: nothing, linked with
nothing). Documents with equal sets are one class from the start. Two classes link when
den * |A and B| >= num * |A or B|, exactly.

Token-combination prefixes. All shingles have one order: by zone (the low part of the hash space, then the rest), then
rare before frequent, then by hash. A set that may lack `tau` of its shingles in a partner is given a prefix; a rare
shingle in it is a signature of its own and counts 1. Frequent shingles fall into groups by hash, and all pairs of a
group's shingles in the prefix are signatures (2-token combinations); a group counts its shingles less one, so the prefix
is extended until the counts come to tau + l. By the pigeonhole principle two linked sets share l signatures or more. Orders and
groups depend on the shingle and on a level, the number of bits of the larger set's size; a set signs at its own level
and at that of its largest partner. A shingle is frequent when more documents hold it than max(16, documents / 20000):
those of the low zone are counted over all documents, packed, and there are at most 20000 times the mean set size of
them. How shingles are classed never changes the result, only the number of candidates.

The join runs twice. The first run looks at the low zone of all documents and only keeps the classes with l signatures or
more that another class has too. A task first looks for signatures that several of its own classes have, and sends two rows
for one of those, so a signature that a third of all documents hold costs two rows a chunk. The second run has the whole
sets of these classes, counts their shingles and orders them all rare before frequent. There, r of a set's shingles are
rare, and two sets differ by at least r + r' - 2 s shingles if they share s rare signatures and both prefixes hold all rare
ones; linked sets differ by at most (den - num) / (den + num) of their summed sizes.
- Pairs with a rare signature in common: their buckets (the classes of one signature) are small by definition.
- Pairs with only frequent signatures in common, groups of near copies: each bucket elects as its hub the class that has
  most company in all buckets. Each class is compared with its hubs, and what is linked so far makes parts. A hub whose
  members are all of one part is done, which is the rule for near copies. In another, the members outside its largest part
  meet those of other parts, never two that both have more rare shingles than half the limit, and are compared where r + r' and the difference of their distances to the hub in frequent
  shingles (the triangle inequality) come to no more than the limit. So a group of near copies costs a few comparisons for
  each member, not all pairs, and no connection between different texts is lost.
Sizes of buckets, hubs and ends of buckets come from aggregates with partial results, written and joined back, so Spark can
split whatever key is hot.

Nulls: a null text has no words; rows with a null id take part, but name no component. Rows of equal ids are documents of
their own. Other columns are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

LEAST_FREQUENT, SHARE_FREQUENT, MOST_FREQUENT = 16, 20_000, 1 << 22
SHORT_LEVEL = 6  # sets below 64 shingles sign with single ones only
BLOOM_BITS, BLOOM_SLICES = 1 << 25, 64
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(0, U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(size, len(h)), U)
    for k in range(min(size, len(h))):
        out = mixed(out + h[k : k + n] * U(2 * k + 0x9E3779B97F4A7C15))
    return np.unique(out)


def set_key(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


class Plan:
    """What follows from the threshold num / den."""

    def __init__(self, size: int, num: int, den: int, whole: bool = False):
        self.size, self.num, self.den = size, num, den
        lack = 1 - num / den
        share = 1.8 * lack + 0.02
        self.zone = U(2**64 - 1) if whole or share >= 1 else U(int(share * 2.0**64) - 1)
        self.groups = 0.35 * lack  # groups for each shingle of the smallest set of a level

    def tau(self, n: int) -> int:
        return n * (self.den - self.num) // self.den

    def least(self, n):
        """Signatures that linked sets share at least, of the smaller one's n shingles; n may be a column."""
        return F.floor(n * (2 * (self.den - self.num)) / (5 * self.den)) + 1 if isinstance(n, Column) else n * 2 * (self.den - self.num) // (5 * self.den) + 1

    def stored(self, s: np.ndarray) -> np.ndarray:
        """The start of a set's order that is enough for its prefix, whatever is frequent."""
        low = int(np.searchsorted(s, self.zone, "right"))
        n = len(s)
        return s[: max(low, min(n, self.tau(n) + self.least(n) + int(2 * self.groups * n) + 2))]

    def levels(self, n: int) -> list[int]:
        return sorted({n.bit_length(), (n * self.den // self.num).bit_length()})

    def signatures(self, tokens: np.ndarray, n: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, bool]:
        """Signatures, whether each is of frequent shingles, the number of rare shingles, and whether the prefix ends among them."""
        need = self.tau(n) + self.least(n)
        low = int(np.searchsorted(tokens, self.zone, "right"))
        zone, rest = tokens[:low], tokens[low:]
        often = isin(zone, frequent)
        rare, often = zone[~often], zone[often]
        out, kinds = [], []
        for level in self.levels(n):
            salt = U(level * 0x1234567)
            parts, count = [(rare[:need], None, False)], min(need, len(rare))
            if level <= SHORT_LEVEL:
                parts.append((often[: need - count], None, True))
                count += len(parts[-1][0])
            elif count < need and len(often):
                g = mixed(often ^ U(0x5851F42D4C957F2D)) % U(max(1, int(self.groups * (1 << (level - 1)))))
                first = np.zeros(len(often), bool)
                first[np.unique(g, return_index=True)[1]] = True
                reached = np.cumsum(~first)
                cut = int(np.searchsorted(reached, need - count)) + 1
                count += int(reached[min(cut, len(often)) - 1])
                parts += [(a, b, True) for a, b in grouped_pairs(often[:cut], g[:cut])]
            if count < need:
                parts.append((rest[: need - count], None, False))
            for x, y, kind in parts:
                out.append(mixed(x ^ salt) if y is None else mixed(mixed(x ^ salt) + y * U(3)))
                kinds.append(np.full(len(x), kind))
        return np.concatenate(out), np.concatenate(kinds), len(rare), len(rare) >= need


def grouped_pairs(tokens: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of tokens of one group, in the order of the tokens."""
    order = np.lexsort((tokens, group))
    t, g = tokens[order], group[order]
    for gap in range(1, len(t)):
        same = g[gap:] == g[:-gap]
        if not same.any():
            return
        yield t[:-gap][same], t[gap:][same]


def isin(x: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values) or not len(x):
        return np.zeros(len(x), bool)
    k = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[k] == x


def as_u64(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8")


def sketched(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, h (passed through), n (set size), cls (hash of the set; null if empty), tokens (the stored start of the set's order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, "text"):
            sets = [shingles(t, plan.size) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) if len(s) else None for s in sets], pa.int64()), pa.array([plan.stored(s).astype("<u8").tobytes() for s in sets], pa.binary())],
                ["doc_id", "h", "n", "cls", "tokens"],
            )

    return docs.mapInArrow(run, "doc_id long, h long, n long, cls long, tokens binary")


def frequent_tokens(sketches: DataFrame, plan: Plan) -> np.ndarray:
    """Shingles of the low zone that many documents hold, counted over all documents.

    Tasks send sorted runs with counts, cut by hash into buckets of about a million, so that a shingle that a third of
    all documents hold is one entry of each task.
    """
    stats = sketches.agg(F.count(F.lit(1)).alias("docs"), F.sum(F.octet_length("tokens") / 8).alias("tokens")).first()
    buckets = max(1, int((stats.tokens or 0) // 1_000_000))
    least = max(LEAST_FREQUENT, stats.docs // SHARE_FREQUENT)
    width = U(-(-(int(plan.zone) + 1) // buckets) if buckets > 1 else 2**64 - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(tokens // width, np.arange(buckets + 1).astype(U))
            cuts[-1] = len(tokens)
            parts = [(b, tokens[i:j].tobytes(), counts[i:j].astype("<u4").tobytes()) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if j > i]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts), (pa.int64(), pa.binary(), pa.binary()))], ["bucket", "tokens", "counts"])

        for batch in batches:
            for raw in batch.column("tokens").to_pylist():
                t = as_u64(raw)
                t = t[: int(np.searchsorted(t, plan.zone, "right"))]
                if len(t):
                    held.append(t)
                    n += len(t)
                if n > 2_000_000:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    def merge(table: pa.Table) -> pa.Table:
        tokens = np.concatenate([as_u64(x) for x in table.column("tokens").to_pylist()])
        counts = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("counts").to_pylist()])
        names, at = np.unique(tokens, return_inverse=True)
        total = np.bincount(at, counts).astype(np.int64)
        often = total > least
        return pa.table([pa.array(names[often].view(np.int64)), pa.array(total[often])], names=["token", "n"])

    runs = sketches.select("tokens").mapInArrow(count, "bucket long, tokens binary, counts binary")
    often = common.written(runs.groupBy("bucket").applyInArrow(merge, "token long, n long"), "frequent")
    # At most 20000 times the mean set size by the threshold above, and never more than MOST_FREQUENT.
    got = often.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).select("token").toArrow().column("token").to_numpy()
    return np.sort(got.astype(np.int64).view(U))


def signed(sets: DataFrame, plan: Plan, frequent: np.ndarray) -> DataFrame:
    """sig, cls, n, r, kind (0 rare, 1 frequent), closed of each class; sets has a row for each."""
    schema = "sig long, cls long, n long, r long, kind int, closed boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 500):
                out = []
                for cls, n, raw in zip(*(batch.slice(k, 500).column(c).to_pylist() for c in ("cls", "n", "tokens"))):
                    sigs, kinds, rare, closed = plan.signatures(as_u64(raw), n, frequent)
                    m = len(sigs)
                    out.append((sigs.view(np.int64), np.full(m, cls), np.full(m, n), np.full(m, rare), kinds.astype(np.int32), np.full(m, closed)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], [x.split(" ")[0] for x in schema.split(", ")])

    return sets.select("cls", "n", "tokens").mapInArrow(run, schema)


def shared_rows(signatures: DataFrame) -> DataFrame:
    """signatures that two classes or more have, with the number of them; a class has a signature once."""
    signatures = common.written(signatures, "signed")
    sizes = signatures.groupBy("sig").agg(F.count(F.lit(1)).alias("size")).where("size > 1").withColumnRenamed("sig", "s")
    return signatures.join(common.written(sizes, "bucket-sizes"), F.col("sig") == F.col("s")).drop("s")


def pooled(sketches: DataFrame, plan: Plan, frequent: np.ndarray) -> DataFrame:
    """The signatures of all classes, pooled in chunks: sig, cls, chunk, add, n.

    A class' row with `add` -1 counts if another class has its signature too; a class that shares it within the chunk has
    no such row, but is counted in the row with its n and the number of those signatures. Rows with `add` 0 and no n,
    two for each signature shared in the chunk, only tell other chunks of it. So for each class and chunk the rows count
    each signature once.
    """
    schema = "sig long, cls long, chunk long, add int, n long"
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.taskcontext import TaskContext

        classes: list[int] = []
        sizes: list[int] = []
        sigs: list[np.ndarray] = []
        seen: set[int] = set()
        held, chunk = 0, TaskContext.get().partitionId() << 32

        def flush() -> Iterator[pa.RecordBatch]:
            cls = np.array(classes, np.int64)
            who = np.repeat(np.arange(len(cls)), [len(x) for x in sigs])
            flat = np.concatenate(sigs).view(np.int64)
            order = np.argsort(flat, kind="stable")
            flat, who = flat[order], who[order]
            first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
            last = np.append(first[1:], len(flat)) - 1
            alone = who[first] == who[last]
            of_several = np.repeat(~alone, last - first + 1)
            both = np.stack([first[~alone], last[~alone]], axis=1).reshape(-1)
            number = np.bincount(who[of_several], minlength=len(cls))
            own = mixed(cls.view(U) ^ U(chunk * 0x9E3779B97F4A7C15 & 2**64 - 1)).view(np.int64)  # a place of its own in the shuffle
            parts = ((flat[first[alone]], cls[who[first[alone]]], -1), (flat[both], cls[who[both]], 0), (own, cls, number))
            for k, (sig, c, add) in enumerate(parts):
                n = pa.array(np.array(sizes, np.int64)) if k == 2 else pa.nulls(len(sig), pa.int64())
                out = pa.RecordBatch.from_arrays([pa.array(sig), pa.array(c), pa.array(np.full(len(sig), chunk)), pa.array(np.broadcast_to(add, len(sig)).astype(np.int32)), n], names)
                yield from (out.slice(i, 100_000) for i in range(0, len(out), 100_000))

        for batch in batches:
            for cls, n, raw in zip(*(batch.column(c).to_pylist() for c in ("cls", "n", "tokens"))):
                if cls in seen:
                    continue
                seen.add(cls)
                classes.append(cls)
                sizes.append(n)
                sigs.append(plan.signatures(as_u64(raw), n, frequent)[0])
                held += len(sigs[-1])
                if held > 1_000_000:
                    yield from flush()
                    held, chunk = 0, chunk + 1
                    for x in (classes, sizes, sigs, seen):
                        x.clear()
        if classes:
            yield from flush()

    return sketches.where("cls IS NOT NULL").select("cls", "n", "tokens").mapInArrow(run, schema)


def involved(sketches: DataFrame, plan: Plan) -> DataFrame:
    """cls: the classes with as many signatures in common with others as a link needs."""
    bucket = Window.partitionBy("sig")  # a row or two for each chunk
    rows = pooled(sketches, plan, frequent_tokens(sketches, plan))
    rows = rows.withColumn("more", F.min("cls").over(bucket) < F.max("cls").over(bucket))
    rows = rows.select("cls", "chunk", "n", F.when(F.col("add") < 0, F.col("more").cast("int")).otherwise(F.col("add")).alias("shared")).where("shared > 0 OR n IS NOT NULL")
    counts = rows.groupBy("cls", "chunk").agg(F.sum("shared").alias("shared"), F.max("n").alias("n"))
    # A partner may be smaller by the threshold, and then links need fewer.
    enough = F.col("shared") >= plan.least(F.floor(F.col("n") * plan.num / plan.den))
    return common.written(counts.where(enough).select("cls").distinct(), "involved")


def bloom_of(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size over a column of longs, put together slice by slice."""
    width = BLOOM_BITS // BLOOM_SLICES

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOOM_BITS, bool)
        for batch in batches:
            for at in bloom_places(batch.column(0).to_numpy(zero_copy_only=False)):
                bits[at] = True
        used = [k for k in range(BLOOM_SLICES) if bits[k * width : (k + 1) * width].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([np.packbits(bits[k * width : (k + 1) * width]).tobytes() for k in used], pa.binary())], ["k", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()]
        return pa.table([table.column("k")[:1], pa.array([np.bitwise_or.reduce(parts).tobytes()], pa.binary())], names=["k", "bits"])

    out = np.zeros(BLOOM_BITS, bool)
    for r in ids.mapInArrow(part, "k int, bits binary").groupBy("k").applyInArrow(merge, "k int, bits binary").collect():
        out[r.k * width : (r.k + 1) * width] = np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8)).astype(bool)
    return np.packbits(out)


def bloom_places(x: np.ndarray) -> list[np.ndarray]:
    h = mixed(x.astype(np.int64).view(U))
    return [((h >> U(s)) & U(BLOOM_BITS - 1)).astype(np.int64) for s in (0, 13, 26, 38)]


def in_bloom(bloom: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for at in bloom_places(x):
        out &= (bloom[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return out


def whole_sets(docs: DataFrame, sketches: DataFrame, classes: DataFrame, plan: Plan) -> DataFrame:
    """cls, n, tokens: the whole set of each of the classes, from one of its documents' texts.

    A Bloom filter spares other texts the work and the shuffle; what it lets through by mistake goes in the join.
    """
    one = sketches.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.max(F.col("doc_id").isNull()).alias("unnamed"))
    one = one.join(classes, "cls", "left_semi")
    bloom = bloom_of(one.where("doc_id IS NOT NULL").select("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, "text"):
            named = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            wanted = ~named | in_bloom(bloom, batch.column("doc_id").fill_null(0).to_numpy())
            sets = [s for t in batch.filter(pa.array(wanted)).column("text").to_pylist() if len(s := shingles(t, plan.size))]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["cls", "n", "tokens"])

    found = docs.mapInArrow(run, "cls long, n long, tokens binary")
    found = found.join(classes, "cls", "left_semi").dropDuplicates(["cls"])
    return common.written(found, "whole-sets", "none")


def compared(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """a, b, apart (shingles that only one of them has), linked of pairs (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [[as_u64(x) for x in batch.column(c).to_pylist()] for c in ("ta", "tb")]
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*tokens)], np.int64)
            total = np.array([len(x) + len(y) for x, y in zip(*tokens)], np.int64)
            out = [batch.column("a"), batch.column("b"), pa.array(total - 2 * both), pa.array(plan.den * both >= plan.num * (total - both))]
            yield pa.RecordBatch.from_arrays(out, ["a", "b", "apart", "linked"])

    left, right = (sets.select(F.col("cls").alias(c), F.col("tokens").alias(t)) for c, t in (("a", "ta"), ("b", "tb")))
    rows = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return common.written(rows.mapInArrow(run, "a long, b long, apart long, linked boolean"), "compared")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node, root for every node of links (a, b): the smallest node reachable.

    Each round a node takes the smallest root among its neighbours, and then that root's own root, so chains halve.
    """
    edges = common.written(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")).distinct(), f"{name}-edges")
    roots = common.written(edges.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("root")), name)
    while True:
        near = edges.join(roots, edges["y"] == roots["node"]).groupBy("x").agg(F.min("root").alias("m"))
        step = roots.join(near, roots["node"] == near["x"]).select("node", F.least("root", "m").alias("root"), F.col("root").alias("old"))
        # The root of the old root may have moved as well: hand its new root down.
        step = common.written(step, name)
        moved = step.where("root < old").groupBy(F.col("old").alias("o")).agg(F.min("root").alias("to"))
        moved = common.written(moved, f"{name}-moved")  # so that Spark can split a root of many nodes
        step = common.written(step.join(moved, F.col("old") == F.col("o"), "left").select("node", F.least("root", "to").alias("root"), "old"), name)
        ahead = step.select(F.col("node").alias("r"), F.col("root").alias("rr"))
        jumped = step.join(ahead, step["root"] == ahead["r"], "left").select("node", F.least("root", "rr").alias("root"), "old")
        jumped = common.written(jumped, name)
        roots = jumped.select("node", "root")
        if jumped.where("root <> old").isEmpty():
            return roots


def near_in_size(plan: Plan, m: Column, n: Column) -> Column:
    return plan.den * F.least(m, n) >= plan.num * F.greatest(m, n)


def limit(plan: Plan, m: Column, n: Column) -> Column:
    """The most shingles by which linked sets of m and n shingles differ."""
    return F.floor((m + n) * (plan.den - plan.num) / (plan.den + plan.num) + 1e-9)


def pairs_by_rare(rows: DataFrame, plan: Plan) -> DataFrame:
    """a, b with rare signatures in common, enough for a link."""
    rows = rows.where("kind = 0")
    a = rows.select("sig", F.col("cls").alias("a"), F.col("n").alias("m"), F.col("r").alias("q"), F.col("closed").alias("ended"))
    b = rows.select("sig", F.col("cls").alias("b"), "n", "r", "closed")
    met = a.join(b, "sig").where((F.col("a") < F.col("b")) & near_in_size(plan, F.col("m"), F.col("n")))
    met = met.groupBy("a", "b", "m", "n", "q", "r", "ended", "closed").agg(F.count(F.lit(1)).alias("shared"))
    enough = F.when(F.col("ended") | F.col("closed"), F.col("shared") >= plan.least(F.least("m", "n"))).otherwise(F.col("q") + F.col("r") - 2 * F.col("shared") <= limit(plan, F.col("m"), F.col("n")))
    return met.where(enough).select("a", "b")


def hub_members(rows: DataFrame) -> DataFrame:
    """hub, hub_r, cls, n, r: the hubs of each class with frequent signatures in common with others."""
    rows = rows.where("kind = 1").select("sig", "cls", "n", "r", "size")
    weight = rows.groupBy("cls").agg(F.sum("size").alias("weight")).withColumnRenamed("cls", "c")
    heavy = rows.join(weight, F.col("cls") == F.col("c")).groupBy("sig").agg(F.max(F.struct("weight", "cls", "r")).alias("hub"))
    heavy = common.written(heavy.select(F.col("sig").alias("s"), F.col("hub.cls").alias("hub"), F.col("hub.r").alias("hub_r")), "hubs")
    return rows.join(heavy, F.col("sig") == F.col("s")).groupBy("hub", "hub_r", "cls").agg(F.min("n").alias("n"), F.min("r").alias("r"))


def pairs_by_hub(members: DataFrame, stars: DataFrame, roots: DataFrame, plan: Plan) -> DataFrame:
    """a, b of one hub that are not connected yet and may be linked without a rare signature in common.

    A member's distance to the hub in frequent shingles is low + 2 s, where s, at most `some`, rare ones are common. Members
    of a hub's largest part are connected with each other, so one of each pair is outside it.
    """
    near = members.join(stars.select(F.col("a").alias("hub"), F.col("b").alias("cls"), "apart"), ["hub", "cls"])
    near = near.where(F.col("r") <= limit(plan, F.col("n"), F.col("n") * plan.den / plan.num))
    near = near.join(roots, near["cls"] == roots["node"], "left").select("hub", "cls", "n", "r", (F.col("apart") - F.col("r") - F.col("hub_r")).alias("low"), F.least("r", "hub_r").alias("some"), F.coalesce("root", "cls").alias("part"))
    near = common.written(near, "near-hubs")
    parts = near.groupBy("hub", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("hub").agg(F.max(F.struct("n", "part")).alias("main"), F.count(F.lit(1)).alias("parts"))
    parts = common.written(parts.where("parts > 1").select(F.col("hub").alias("h"), F.col("main.part").alias("main")), "hub-parts")
    near = common.written(near.join(parts, F.col("hub") == F.col("h")).drop("h"), "open-hubs")
    apart = F.greatest(F.lit(0), F.col("u") - F.col("v") - 2 * F.col("t"), F.col("v") - F.col("u") - 2 * F.col("s"))
    fits = (~F.col("again") | (F.col("a") < F.col("b"))) & (F.col("p") != F.col("o")) & (F.col("q") + F.col("r") + apart <= limit(plan, F.col("m"), F.col("n"))) & near_in_size(plan, F.col("m"), F.col("n"))
    (x, y), (v, w) = meeting(near, plan)
    same = F.col("hub") == F.col("h")
    return x.join(y, same & fits).unionByName(v.join(w, same & fits)).select("a", "b").distinct()


def meeting(near: DataFrame, plan: Plan) -> list[tuple[DataFrame, DataFrame]]:
    """The members of hubs that meet, as pairs of sides.

    Of two linked members one has rare shingles for half the limit at most, by the most generous partner's size. So members
    with more than that never meet each other, and those of the main part meet none of their own part.
    """
    near = near.withColumn("few", 2 * F.col("r") <= limit(plan, F.col("n"), F.col("n") * plan.den / plan.num))
    out, few = F.col("part") != F.col("main"), F.col("few")
    one = lambda rows: rows.select("hub", F.col("cls").alias("a"), F.col("n").alias("m"), F.col("r").alias("q"), F.col("low").alias("u"), F.col("some").alias("s"), F.col("part").alias("p"))
    other = lambda rows: rows.select(F.col("hub").alias("h"), F.col("cls").alias("b"), "n", "r", F.col("low").alias("v"), F.col("some").alias("t"), F.col("part").alias("o"), (few & out).alias("again"))
    return [(one(near.where(out & few)), other(near)), (one(near.where(~out & few)), other(near.where(out & ~few)))]


def classes_of(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """docs (doc_id, h, text) -> doc_id, h, n, cls (null if empty), and component, keeper_h of its class: the row that is first by id, then by h, of all reachable ones."""
    plan = Plan(size, num, den)
    sketches = common.written(sketched(docs, plan), "sketches", "none")
    sets = whole_sets(docs, sketches, involved(sketches, plan), plan)
    whole = Plan(size, num, den, whole=True)
    rows = common.written(shared_rows(signed(sets, whole, frequent_tokens(sets, whole))), "shared")
    members = common.written(hub_members(rows), "members")
    stars = members.where("hub <> cls").select(F.col("hub").alias("a"), F.col("cls").alias("b"))
    first = compared(stars.union(pairs_by_rare(rows, plan)).distinct(), sets, plan)
    links = first.where("linked").select("a", "b")
    more = common.written(pairs_by_hub(members, first, components(links), plan), "pairs")
    links = links.unionByName(compared(more, sets, plan).where("linked").select("a", "b"))
    roots = components(links)

    # Rows with ids come before those without, whose component has no name if it has no others.
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h")
    smallest = sketches.where("cls IS NOT NULL").groupBy("cls").agg(F.min(row).alias("m"))
    named = smallest.join(roots, smallest["cls"] == roots["node"], "left").select("cls", "m", F.coalesce("root", "cls").alias("root"))
    named = common.written(named, "class-roots")
    least = common.written(named.groupBy("root").agg(F.min("m").alias("first")), "components-first")
    named = common.written(named.join(least, "root").select(F.col("cls").alias("c"), F.col("first.doc_id").alias("component"), F.col("first.h").alias("keeper_h")), "named")
    light = sketches.select("doc_id", "h", "n", "cls")
    out = light.where("cls IS NOT NULL").join(named, F.col("cls") == F.col("c")).drop("c")
    return out.unionByName(light.where("cls IS NULL"), allowMissingColumns=True)


def jaccard_classes(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of every document."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("h"), F.col(text).cast("string").alias("text"))
    out = classes_of(rows, size, num, den)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class: that of the smallest id (nulls last), then of the smallest hash of id and text.

    Rows are told apart by id and text, so a row with a null or repeated id goes or stays for its own text; of equal ids and
    texts the row with the smallest hash of all its columns stays, whatever the order of the rows. Texts without words have no class: all of them stay.
    """
    key, h = F.coalesce(docs[doc_id].cast("long"), F.lit(0)), F.xxhash64(docs[doc_id].cast("long"), docs[text].cast("string"))
    found = classes_of(docs.select(docs[doc_id].cast("long").alias("doc_id"), h.alias("h"), docs[text].cast("string").alias("text")), size, num, den)
    keeps = F.col("doc_id").eqNullSafe(F.col("component")) & (F.col("h") == F.col("keeper_h"))
    rows = found.where("cls IS NOT NULL").groupBy(F.coalesce("doc_id", F.lit(0)).alias("_key"), F.col("h").alias("_h")).agg(F.max(keeps).alias("_keeps"), F.count(F.lit(1)).alias("_n"))
    marked = common.written(rows.where("NOT _keeps OR _n > 1"), "marked-rows")
    same = (key == F.col("_key")) & (h == F.col("_h"))
    once = docs.join(marked.where("_keeps"), same, "left_semi").groupBy(key.alias("_key"), h.alias("_h"))
    once = once.agg(F.min_by(F.struct(*[docs[f"`{c}`"] for c in docs.columns]), common.hash_of(docs)).alias("_row")).select("_row.*")
    return docs.join(marked, same, "left_anti").unionByName(once)
