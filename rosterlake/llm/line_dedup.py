r"""Reversible line deduplication: sharded cuckoo filters, backed by exact reference counts.

A line's key is the line without `[\x20\x09-\x0D]` at its ends, A-Z in lower case, as a 128-bit digest. Keys of LEAST code
points or more that two documents hold lose all their lines, save those in the document with the smallest id. The index has

* holders: doc_id, row (a hash of the text), hi, lo, places: the keys of each document and where its lines stand,
* counts: shard, hi, lo, refs, first, last, nulls: the exact reference count of each key and its holders' smallest and largest id,
* filters: shard, filter: a cuckoo filter of the shard's keys, which can forget keys again.

`insert` counts a batch's keys, a row for each key and task before any shuffle, so a line of a third of all documents is no hot
key. Keys that the filter of their shard does not know are new and need no look at the counts; the others meet the exact rows,
which also finds what the filter took for known by mistake. `delete` takes documents out: counts go down, keys without
holders leave counts and filter, and the others' smallest id is found anew among the holders that are left. So inserting and
deleting in any order gives the index of the documents that remain. A filter's memory is bounded by its shard's keys; shards
are hash ranges, and their number is to grow with the corpus. Filters grow by a chain of tables, none smaller than the one
before, as fingerprints alone cannot be dealt anew; deletion looks into the last first, which keeps shared fingerprints right.

Null and empty texts are one empty line. Rows of one id are one document: none loses lines to another of them, and deleting
the id deletes all. A null id is a document, too, after all others. Repeated lines of the document that keeps a key all stay.
Other columns are not read, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST = 10
BLANK = " \t\n\x0b\x0c\r"
KEY = ("hi", "lo")
#: Documents for each shard, about; and the least number of shards.
SHARD_DOCS, LEAST_SHARDS = 20_000, 64
#: Slots of a bucket, and the share of all slots that is filled before a filter counts as full.
SLOTS, FULL = 4, 0.8
KICKS = 500


class CuckooFilter:
    """A chain of tables of 16-bit fingerprints, none smaller than the one before; keys come as arrays (hi, lo) and are distinct."""

    def __init__(self, packed: bytes | None = None):
        self.tables: list[np.ndarray] = []
        at = 0
        while packed is not None and at < len(packed):
            n = int.from_bytes(packed[at : at + 8], "little")
            self.tables.append(np.frombuffer(packed, np.uint16, n * SLOTS, at + 8).reshape(n, SLOTS).copy())
            at += 8 + n * SLOTS * 2

    def packed(self) -> bytes:
        return b"".join(len(t).to_bytes(8, "little") + t.tobytes() for t in self.tables)

    @staticmethod
    def prints(hi: np.ndarray) -> np.ndarray:
        """1 to 65,535; 0 is an empty slot."""
        return (hi.view(np.uint64) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)

    @staticmethod
    def other(table: np.ndarray, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return bucket ^ ((print_.astype(np.int64) * 0x5BD1E995 >> 7) & (len(table) - 1))

    def has(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """False is certain, true is not."""
        found, p = np.zeros(len(hi), bool), self.prints(hi)
        for t in self.tables:
            b = lo & (len(t) - 1)
            found |= (t[b] == p[:, None]).any(axis=1) | (t[self.other(t, b, p)] == p[:, None]).any(axis=1)
        return found

    def add(self, hi: np.ndarray, lo: np.ndarray) -> None:
        p = self.prints(hi)
        if self.tables:
            last = self.tables[-1]
            room = max(0, int(FULL * last.size) - int(np.count_nonzero(last)))
            if placed := self.placed(last, p[:room], lo[:room]):
                self.tables[-1] = placed[0]
                p, lo = p[room:], lo[room:]
        waiting = [(p, lo)] if len(p) else []
        while waiting:
            p, lo = waiting.pop()
            last = len(self.tables[-1]) if self.tables else 16
            n = max(last, 1 << int(np.ceil(np.log2(max(16, len(p) / (FULL * SLOTS))))))
            if placed := self.placed(np.zeros((n, SLOTS), np.uint16), p, lo):
                self.tables.append(placed[0])
            else:  # too many equal fingerprints in one place
                half = len(p) // 2
                waiting += [(p[half:], lo[half:]), (p[:half], lo[:half])]

    def placed(self, table: np.ndarray, p: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray] | None:
        """The table with the fingerprints put in, or None if some find no room; the given table stays."""
        table, bucket = table.copy(), lo & (len(table) - 1)
        for turn in range(KICKS):
            order = np.argsort(bucket, kind="stable")
            p, bucket = p[order], bucket[order]
            rank = np.arange(len(p)) - np.searchsorted(bucket, bucket)
            free = table[bucket] == 0
            slot = free & (np.cumsum(free, axis=1) == rank[:, None] + 1)
            fits = slot.any(axis=1)
            table[bucket[fits], slot[fits].argmax(axis=1)] = p[fits]
            p, bucket, first = p[~fits], bucket[~fits], rank[~fits]
            if not len(p):
                return (table,)
            if turn:  # the first one that waits at a bucket takes a slot, whose fingerprint moves on
                lead = np.concatenate(([True], bucket[1:] != bucket[:-1]))
                slot = (p[lead].astype(np.int64) + turn) % SLOTS
                out = table[bucket[lead], slot]
                table[bucket[lead], slot] = p[lead]
                p[lead] = out
            bucket = self.other(table, bucket, p)
        return None

    def forget(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Keys must have been added."""
        p = self.prints(hi)
        for t in reversed(self.tables):
            left = np.ones(len(p), bool)
            waiting = np.arange(len(p))
            while len(waiting):
                b = lo[waiting] & (len(t) - 1)
                c = self.other(t, b, p[waiting])
                _, once = np.unique(np.minimum(b, c) << 16 | p[waiting], return_index=True)
                one, b, c = waiting[once], b[once], c[once]
                for bucket in (b, c):
                    hit = (t[bucket] == p[one, None]) & left[one, None]
                    some = hit.any(axis=1)
                    t[bucket[some], hit[some].argmax(axis=1)] = 0
                    left[one[some]] = False
                waiting = np.setdiff1d(waiting, one)
            p, lo = p[left], lo[left]


@dataclass(frozen=True)
class LineIndex:
    holders: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int


COUNTS = "shard int, hi long, lo long, refs long, first {0}, last {0}, nulls long"
FILTERS = "shard int, filter binary"


def shards_for(documents: int) -> int:
    return LEAST_SHARDS + documents // SHARD_DOCS


def empty(spark: SparkSession, shards: int = LEAST_SHARDS, id_type: str = "bigint") -> LineIndex:
    frame = lambda kind: spark.createDataFrame([], kind)
    return LineIndex(frame(f"doc_id {id_type}, row long, hi long, lo long, places array<int>"), frame(COUNTS.format(id_type)), frame(FILTERS), shards)


def rows_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("row", F.xxhash64("text"))


def line_keys(docs: DataFrame) -> DataFrame:
    """doc_id, row, hi, lo, places: the distinct keys of each row and the numbers of their lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, "text"):
            at, keys, places = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                found: dict[bytes, list[int]] = {}
                for k, line in enumerate((text or "").split("\n")):
                    line = line.strip(BLANK)
                    if len(line) >= LEAST:
                        found.setdefault(hashlib.md5(line.encode("utf-8", "replace").lower(), usedforsecurity=False).digest(), []).append(k)
                at += [i] * len(found)
                keys += found
                places += found.values()
            parts = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            own = batch.select(["doc_id", "row"]).take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(parts[:, 0]), pa.array(parts[:, 1]), pa.array(places, pa.list_(pa.int32()))], ["doc_id", "row", "hi", "lo", "places"])

    rows = rows_of(docs)
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, row long, hi long, lo long, places array<int>")


def counted(holders: DataFrame, shards: int) -> DataFrame:
    shard = F.pmod(F.shiftrightunsigned("lo", 32), F.lit(shards)).cast("int")
    ids = F.col("doc_id")
    return holders.groupBy(*KEY).agg(F.count(F.lit(1)).alias("refs"), F.min(ids).alias("first"), F.max(ids).alias("last"), F.count_if(ids.isNull()).alias("nulls")).withColumn("shard", shard)


def key_arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table.column("hi").to_numpy(), table.column("lo").to_numpy()


def filter_of(table: pa.Table) -> CuckooFilter:
    return CuckooFilter(table.column("filter")[0].as_py() if len(table) else None)


def by_shard(one: DataFrame, two: DataFrame):
    return one.groupBy("shard").cogroup(two.groupBy("shard"))


def changed_filters(filters: DataFrame, new: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """Filters that know new keys as well, or have forgotten those that are gone."""
    forget = gone is not None

    def run(key, old: pa.Table, keys: pa.Table) -> pa.Table:
        kept, (hi, lo) = filter_of(old), key_arrays(keys)
        (kept.forget if forget else kept.add)(hi, lo)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([kept.packed()], pa.binary())})

    return by_shard(filters, (gone if forget else new).select("shard", *KEY)).applyInArrow(run, FILTERS)


def insert(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with more documents."""
    holders = common.written(line_keys(docs), "holders")
    fresh = counted(holders, index.shards).select(*index.counts.columns)

    def probe(key, keys: pa.Table, old: pa.Table) -> pa.Table:
        return keys.append_column("known", pa.array(filter_of(old).has(*key_arrays(keys))))

    kinds = ", ".join(f"{n} {t}" for n, t in fresh.dtypes)
    probed = common.written(by_shard(fresh, index.filters).applyInArrow(probe, f"{kinds}, known boolean"), "probed")
    known, new = probed.where("known").drop("known"), probed.where("NOT known").drop("known")
    met = index.counts.join(known.select(*KEY), list(KEY), "left_semi").select(*known.columns)
    both = known.withColumn("old", F.lit(False)).unionByName(met.withColumn("old", F.lit(True)))
    total = [F.sum("refs").alias("refs"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("nulls").alias("nulls"), F.max("old").alias("old")]
    merged = common.written(both.groupBy("shard", *KEY).agg(*total), "merged")
    rest = index.counts.join(known.select(*KEY), list(KEY), "left_anti").select(*index.counts.columns)
    counts = common.written(rest.unionByName(new).unionByName(merged.drop("old")), "counts")
    filters = common.written(changed_filters(index.filters, new.unionByName(merged.where("NOT old").drop("old"))), "filters")
    return LineIndex(index.holders.unionByName(holders), counts, filters, index.shards)


def delete(index: LineIndex, ids: DataFrame) -> LineIndex:
    """The index without the documents of these ids (doc_id)."""
    own = ids.select(F.col("doc_id").alias("_id")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    less = counted(index.holders.join(own, same, "left_semi"), index.shards).select(*KEY, F.col("refs").alias("less"))
    hit = common.written(index.counts.join(less, list(KEY)).select("shard", *KEY, (F.col("refs") - F.col("less")).alias("refs")), "hit")
    holders = common.written(index.holders.join(own, same, "left_anti"), "holders")
    again = counted(holders.join(hit.where("refs > 0").select(*KEY), list(KEY), "left_semi"), index.shards).select(*index.counts.columns)
    rest = index.counts.join(hit.select(*KEY), list(KEY), "left_anti").select(*index.counts.columns)
    counts = common.written(rest.unionByName(again), "counts")
    filters = common.written(changed_filters(index.filters, None, hit.where("refs = 0")), "filters")
    return LineIndex(holders, counts, filters, index.shards)


def dropped_lines(index: LineIndex) -> DataFrame:
    """doc_id, row, places: the numbers of the lines that each row loses."""
    shared = index.counts.where("first <> last OR (first IS NOT NULL AND nulls > 0)").select(*KEY, "first")
    lost = index.holders.join(shared, list(KEY)).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    return lost.groupBy("doc_id", "row").agg(F.flatten(F.collect_list("places")).alias("places"))


def clean(docs: DataFrame, index: LineIndex) -> DataFrame:
    """doc_id, text without the lines that others keep, n_lines, n_dropped; docs are documents that the index has."""
    lost = dropped_lines(index).select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "places")
    rows = rows_of(docs).join(lost, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left").select("doc_id", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, "text"):
            kept, lines, dropped = [], [], []
            for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist()):
                text, gone = text or "", set(places or ())
                lines.append(text.count("\n") + 1)
                dropped.append(len(gone))
                kept.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone) if gone else text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string, n_lines long, n_dropped long")
