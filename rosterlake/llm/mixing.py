"""Mixing sources to target weights by pivotal dependent rounding.

A document's size is its number of words. Sources share the sum of all sizes by weight; a target stops at `most` times
its source's size and the excess goes to the others by weight, until none is above. Each document of a source then has
the same expected number of copies, target / size of the source: a whole part, and a fraction in [0, 1).

Fractions are rounded in pairs. Of two units i and j with sizes a_i and a_j, mass moves at random from one to the other
until one is 0 or 1, so that a_i p_i + a_j p_j stays as it is, and so does each unit's expectation. Chunks of a bounded
number of units are rounded in one task each; the one unit that each leaves goes up a tree of chunks, until one is left
for a source: it becomes 1 with its own probability. A source's taken words so differ from its target by less than one
document's size. Random numbers come from hashes of the seed and the documents, so reruns and retries agree.

Null texts and texts without words have size 0 and take 0. A null source is a source, a null id an id. Repeated rows are
documents of their own: equal ones are counted, and their units numbered from the count, so a row repeated a million times
is one row for each task. Other columns pass through `mix`, whatever their names, and tell rows apart unless they are maps.
An empty table gives no rows. Sources of size 0 have target 0.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

CHUNK = 8192


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def numbered(sources: DataFrame) -> DataFrame:
    """Adds place, from 0, in the order of source (code points, null last). Sorted in ranges, so no task holds all."""
    order = F.col("source").asc_nulls_last()
    ranges = common.written(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "source-ranges")
    # One row for each range.
    counts = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n")).selectExpr("part AS p", "sum(n) OVER (ORDER BY part) - n AS before")
    rows = ranges.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(order)))
    return rows.join(F.broadcast(counts), F.col("part") == F.col("p")).withColumn("place", F.col("before") + F.col("at") - 1).drop("part", "p", "before", "at")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """sizes (source, source_size) -> source, source_size, target. One row for each source.

    A target is the smaller of most * size and weight * level. Starting from total / weights, the level rises to what the
    sources below their limits share of the rest, until no further source reaches its limit; each step is one aggregate.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = common.written(numbered(sizes).withColumn("weight", weight).drop("place"), "weights")
    level, limit = 0.0, F.col("source_size") * most
    while True:
        full = limit < F.col("weight") * level
        s = rows.agg(F.sum("source_size").alias("total"), F.sum(F.when(full, limit)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        after = (s.total - (s.full or 0)) / s.open if s.open else level
        if after <= level:
            break
        level = after
    return rows.select("source", "source_size", F.least(limit.cast("double"), F.col("weight") * level).alias("target"))


def draw(seed: int, *parts) -> float:
    """A number in [0, 1) from a hash."""
    return xxhash.xxh64_intdigest("|".join(map(str, parts)), seed) / 2.0**64


def pivotal(keys: list[int], sizes: np.ndarray, p: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Rounds p in place, one unit against the next; returns p and the place of the unit that is left, or -1."""
    eps = 1e-12
    i = -1
    for j in range(len(p)):
        if not eps < p[j] < 1 - eps:
            p[j] = round(p[j])
            continue
        if i < 0:
            i = j
            continue
        a, b = sizes[i], sizes[j]
        up = min(1 - p[i], b / a * p[j])  # i may gain so much before i is 1 or j is 0
        down = min(p[i], b / a * (1 - p[j]))
        if draw(seed, keys[i], keys[j]) < down / (up + down):
            p[i], p[j] = p[i] + up, p[j] - up * a / b
        else:
            p[i], p[j] = p[i] - down, p[j] + down * a / b
        for k in (i, j):
            if p[k] < eps or p[k] > 1 - eps:
                p[k] = round(p[k])
        i = next((k for k in (i, j) if 0 < p[k] < 1), -1)
    return p, i


def rounded(units: DataFrame, groups: list[str], seed: int) -> DataFrame:
    """units (source, chunk, row, size, p) -> the same with rounded p; `left` marks the unit that each chunk leaves."""

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column("size").to_pylist(), t.column("row").to_pylist(), range(len(t))), reverse=True)
        order = np.array([k for _, _, k in rows], np.int64)
        t = t.take(pa.array(order))
        sizes = np.array(t.column("size").to_pylist(), np.float64)
        p, left = pivotal(t.column("row").to_pylist(), sizes, np.array(t.column("p").to_pylist(), np.float64), seed)
        flags = np.arange(len(p)) == left
        return t.set_column(t.schema.get_field_index("p"), "p", pa.array(p)).append_column("left", pa.array(flags))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in units.schema.fields) + ", left boolean"
    return units.groupBy(*groups).applyInArrow(run, schema)


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 17, chunk: int = CHUNK) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every document."""
    return dealt(docs, weights, most, seed, chunk).drop("h")


def row_hash(docs: DataFrame) -> Column:
    """Of the columns that a mix looks at, then of all others."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"), docs["source"].cast("string"), common.hash_of(docs, "doc_id", "text", "source"))


def dealt(docs: DataFrame, weights: tuple[int, ...], most: int, seed: int, chunk: int) -> DataFrame:
    """mixed() with h, the hash of the row."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), word_count(docs["text"].cast("string")).alias("size"), row_hash(docs).alias("h"))
    # Repeated rows differ by their number among equals.
    rows = rows.groupBy("doc_id", "source", "size", "h").agg(F.count(F.lit(1)).alias("n"))
    rows = common.written(rows, "sizes")
    sums = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"), F.sum("n").alias("docs"))
    goals = common.written(targets(sums.select("source", "source_size"), weights, most).join(sums.select(F.col("source").alias("s"), "docs"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "targets").withColumnRenamed("source", "s")

    units = rows.join(goals, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    units = units.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n")
    units = units.withColumn("row", F.xxhash64("h", "doc_id", "again"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = units.withColumn("base", F.when(F.col("size") > 0, F.least(F.floor(rate + 1e-12), F.lit(most))).otherwise(0).cast("long"))
    units = units.withColumn("p", F.when(F.col("size") > 0, F.greatest(rate - F.col("base"), F.lit(0.0))).otherwise(0.0))
    # A source's documents are dealt into chunks of like sizes, by count.
    units = units.withColumn("chunk", F.pmod(F.xxhash64("row", F.lit(seed)), F.ceil(F.col("docs") / chunk)).cast("long"))
    light = units.select("source", "chunk", "row", "doc_id", "size", "p").where("p > 0")
    level = common.written(rounded(light, ["source", "chunk"], seed), "rounded-0")
    done = [level.where("NOT left")]
    # The reduction tree: each level has a unit for each chunk of the one below, dealt CHUNK to one.
    depth = 0
    while True:
        left = level.where("left").drop("left")
        most_left = left.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most_left <= 1:
            break
        depth += 1
        left = left.withColumn("chunk", F.floor(F.col("chunk") / chunk).cast("long"))
        level = common.written(rounded(left, ["source", "chunk"], seed + depth), f"rounded-{depth}")
        done.append(level.where("NOT left"))
    last = level.where("left").withColumn("p", F.when(F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(1 << 32)) / float(1 << 32) < F.col("p"), 1.0).otherwise(0.0))
    extra = last.select("row", "doc_id", "p")
    for d in done:
        extra = extra.unionByName(d.select("row", "doc_id", "p"))
    extra = extra.select(F.col("row").alias("r"), F.col("doc_id").alias("d"), F.col("p").cast("long").alias("more"))
    out = units.join(extra, (F.col("row") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")), "left").withColumn("copies", F.col("base") + F.coalesce("more", F.lit(0)))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "h")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 17, chunk: int = CHUNK) -> DataFrame:
    """docs with each document as often as the mix takes it. Equal rows share the copies of all of them."""
    got = dealt(docs, weights, most, seed, chunk).groupBy(F.coalesce("doc_id", F.lit(0)).alias("d"), "h").agg(F.sum("copies").cast("int").alias("copies"), F.count(F.lit(1)).alias("n")).where("copies > 0")
    key, h, copies = (f"_{x}_{uuid.uuid4().hex}" for x in ("key", "h", "copies"))  # no names of the table's own
    got = common.written(got.select(F.col("d").alias(key), F.col("h").alias(h), F.col("copies").alias(copies), "n"), "copies")
    same = (F.coalesce(docs["doc_id"].cast("long"), F.lit(0)) == F.col(key)) & (row_hash(docs) == F.col(h))
    columns = [docs[f"`{c}`"] for c in docs.columns]
    single, several = (docs.join(got.where(rows).drop("n"), same).select(*columns, key, h, copies) for rows in ("n = 1", "n > 1"))
    taken = single.unionByName(several.dropDuplicates([key, h]))
    return taken.withColumn(key, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(key, h, copies)
