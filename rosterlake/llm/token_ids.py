"""Token ids in a binary file format.

Ids are replaced by their rank in the corpus' frequency order (0 is the most frequent), so most take one byte.
Ranks are written in byte-aligned variable length: a control byte holds the lengths (1 to 4 bytes, two bits each) of
four ranks, and stands apart from the data bytes. A decoder looks the control bytes up in a table and gathers the data
bytes with numpy, without a loop over ids.

A file set is a folder with `vocabulary` (rank, token_id, n) and `shards`, Parquet files whose rows are blocks of whole
documents: shard, block, start (ids before the block in its shard), doc_ids, lengths, control, data. Shards follow each
other in ascending doc_id order, and so do the documents in a block. Spark's commit protocol writes them, so a retried
task leaves no half file, on any file system that Spark writes to.

Texts are encoded whole, as the tokenizer does by itself: the content of an added token gives that token's id. Null texts count
as empty and hold the end id only. Repeated doc_ids are kept, next to each other in an order that depends on the ids; null
doc_ids come first. Other columns are not read, whatever their names. An empty table gives an empty file set.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from . import common

BLOCK_IDS = 1 << 18
#: Bytes of each of the four ranks of a control byte, by its value.
CONTROL_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks below 2**32."""
    ranks = np.asarray(ranks, "<u4")
    sizes = np.uint8(1) + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = sizes - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) < sizes[:, None]]
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    sizes = CONTROL_LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(sizes)
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    at = ends - sizes
    out = raw[at].astype(np.uint32)
    for k in range(1, 4):
        long = np.flatnonzero(sizes > k)
        if not len(long):
            break
        out[long] |= raw[at[long] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class MemoEncoder:
    """Encodes whole texts with a byte-level BPE tokenizer, each distinct word once, many texts at a time.

    The tokenizer's pattern never matches across the end of a run of non-space characters, so a text may be cut where a
    space or line feed follows such a run, and the ids of the pieces put together are the ids of the text. Texts with
    other white space, runs of it, some at an end, or the content of an added token are given to the tokenizer whole. The memo is emptied at `limit` pieces.
    """

    #: Marks that often end a word; the tokenizer always cuts between a letter and one of these.
    MARKS = ",.;:!?%&$#*()|\"-"
    #: White space beside single spaces and line feeds, and the mark of this class.
    ASCII_SPACES = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\0"
    WIDE_SPACES = "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))

    def __init__(self, path: str, end_id: int = 0, limit: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.limit, self.end_id = limit, end_id
        self.line_feed = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self._clear()

    def _clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = self.count = 0
        self.starts = np.zeros(1 << 16, np.int64)
        self.sizes = np.zeros(1 << 16, np.int64)
        self.end = self._put(np.array([self.end_id], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64))

    def _put(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> int:
        """Keeps pieces, given by where their ids lie in ids, and returns the number of the first."""
        first, upto = self.count, self.count + len(starts)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)])
        if upto > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros(max(len(x), len(starts)), np.int64)]) for x in (self.starts, self.sizes))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[first:upto], self.sizes[first:upto] = starts + self.used, sizes
        self.used, self.count = self.used + len(ids), upto
        return first

    def _learn(self, pieces: list[str]) -> None:
        """Puts new pieces in the memo; one that ends in marks after a letter is put together from its two parts."""
        memo, fresh, parts, halves = self.memo, {}, [], []
        for p, stem in zip(pieces, [p.rstrip(self.MARKS) for p in pieces]):
            if len(stem) < len(p) and stem[-1:].isalpha():
                tail = "\0" + p[len(stem) :]
                parts.append(p)
                halves += (stem, tail)
                if stem not in memo:
                    fresh[stem] = None
                if tail not in memo:
                    fresh[tail] = None
            else:
                fresh[p] = None
        self._encode_new(list(fresh))
        if parts:
            ids, sizes = self._gather(np.fromiter(map(memo.__getitem__, halves), np.int64, len(halves)))
            sizes = sizes.reshape(-1, 2).sum(axis=1)
            first = self._put(ids, np.cumsum(sizes) - sizes, sizes)
            memo.update(zip(parts, range(first, self.count)))

    def _encode_new(self, pieces: list[str]) -> None:
        """Encodes pieces in one text, with a line feed before each; its id marks where they start.

        A piece that starts with a line feed or the mark \\0 stands as it is, any other follows a space.
        """
        if not pieces:
            return
        text = ("\n " + "\n ".join(pieces)).replace("\n \0", "\n").replace("\n \n", "\n")
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        marks = np.flatnonzero(ids == self.line_feed)
        starts = marks + np.array([p[0] != "\n" for p in pieces])  # a piece's own line feed is the one before it
        first = self._put(ids, starts, np.append(marks[1:], len(ids)) - starts)
        self.memo.update(zip(pieces, range(first, self.count)))

    def _gather(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[k]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[k] - ends + sizes, sizes)
        at += np.arange(len(at))
        return self.ids[at], sizes

    def _cuttable(self, texts: list[str]) -> list[bool]:
        def spaced(t: str) -> bool:
            return any(c in t for c in self.ASCII_SPACES) or any(c in t for c in self.added) or not t.isascii() and any(c in t for c in self.WIDE_SPACES)

        def runs(t: str) -> bool:
            return "  " in t or "\n\n" in t or " \n" in t or "\n " in t

        all_texts = "|".join(texts)
        if spaced(all_texts) or runs(all_texts):
            return [bool(t) and t[0] not in " \n" and t[-1] not in " \n" and not runs(t) and not spaced(t) for t in texts]
        return [bool(t) and t[0] not in " \n" and t[-1] not in " \n" for t in texts]

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id after it, and how many ids each has."""
        if self.count > self.limit:
            self._clear()
        cut = self._cuttable(texts)
        plain = [t for t, c in zip(texts, cut) if c]
        pieces = " ".join(["\0" + t for t in plain]).replace("\n", " \n").split(" ") if plain else []
        numbers = np.fromiter(map(self.memo.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(numbers < 0).tolist()
        if new:
            unknown = [pieces[i] for i in new]
            self._learn(list(dict.fromkeys(unknown)))
            numbers[new] = np.fromiter(map(self.memo.__getitem__, unknown), np.int64, len(new))
        used, count = self.used, self.count
        whole = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast([t for t, c in zip(texts, cut) if not c], add_special_tokens=False)]
        sizes = np.array([len(x) for x in whole], np.int64)
        first = self._put(np.concatenate([np.zeros(0, np.uint32), *whole]), np.cumsum(sizes) - sizes, sizes)
        # The pieces of each text in turn (a whole text is one), then the end.
        n = np.array([t.count(" ") + t.count("\n") + 1 if c else 1 for t, c in zip(texts, cut)], np.int64)
        order, ends = np.full(int(n.sum()) + len(n), -1), np.cumsum(n + 1)
        order[ends - 1] = self.end
        body = np.flatnonzero(order < 0)
        from_pieces = np.repeat(np.array(cut, bool), n)
        order[body[from_pieces]] = numbers
        order[body[~from_pieces]] = np.arange(first, self.count)
        ids, lengths = self._gather(order)
        self.used, self.count = used, count  # whole texts are not kept
        return ids, np.add.reduceat(lengths, ends - n - 1) if len(n) else n

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0][:-1]


@lru_cache(maxsize=1)
def encoder_of(path: str, end_id: int, call: str) -> MemoEncoder:
    """The encoder of this Python worker: tasks of one call that follow each other in it share the memo, later calls start anew."""
    return MemoEncoder(path, end_id)


def encode_texts(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id, ids (little-endian unsigned integers of width_of the tokenizer, the end id last). One pass, no shuffle."""
    width, call = width_of(tokenizer_path), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path, end_id, call)
        for batch in common.small_batches(batches, "text", 2 << 20):
            ids, n = encoder.encode_many([t or "" for t in batch.column("text").to_pylist()])
            ids = ids.astype(width)
            offsets = np.append(0, np.cumsum(n)) * ids.itemsize
            out = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), out], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary")


def width_of(tokenizer_path: str) -> str:
    """The integer type that holds all ids of a tokenizer."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"


def frequency_order(encoded: DataFrame, width: str) -> DataFrame:
    """rank, token_id, n over all documents; ties go to the smaller id. Its rows are bounded by the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in common.small_batches(batches, "ids"):
            got = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), width))
            if len(got) > len(total):
                total, got = got.astype(np.int64), total
            total[: len(got)] += got
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["token_id", "n"])

    counts = encoded.select("ids").mapInArrow(run, "token_id long, n long").groupBy("token_id").agg(F.sum("n").alias("n"))
    return counts.selectExpr("CAST(row_number() OVER (ORDER BY n DESC, token_id) - 1 AS long) AS rank", "token_id", "n")


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, block_ids: int = BLOCK_IDS) -> None:
    """Writes docs (doc_id, text) as a file set at path. The tokenizer's file must be at tokenizer_path on every node."""
    encoded = common.written(encode_texts(docs, tokenizer_path, end_id), "token-ids")
    width, size = width_of(tokenizer_path), int(width_of(tokenizer_path)[-1])
    frequency_order(encoded, width).write.parquet(f"{path}/vocabulary")
    # At most one row for each entry of the tokenizer's vocabulary.
    order = np.array([r[0] for r in docs.sparkSession.read.parquet(f"{path}/vocabulary").orderBy("rank").select("token_id").collect()], np.int64)
    ranks = np.zeros(int(order.max(initial=0)) + 1, np.uint32)
    ranks[order] = np.arange(len(order), dtype=np.uint32)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        keys: list[int | None] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, start
            lengths = [len(x) // size for x in ids]
            control, data = encode_ranks(ranks[np.frombuffer(b"".join(ids), width)])
            row = [[shard], [block], [start], [list(keys)], [lengths], [control], [data]]
            block, start = block + 1, start + sum(lengths)
            ids.clear()
            keys.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds)], names)

        held = 0
        for batch in batches:
            for key, got in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                keys.append(key)
                ids.append(got.as_py())
                held += len(ids[-1]) // size
                if held >= block_ids:
                    yield flush()
                    held = 0
        if ids:
            yield flush()

    names = ["shard", "block", "start", "doc_ids", "lengths", "control", "data"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
    schema = "shard int, block int, start long, doc_ids array<long>, lengths array<long>, control binary, data binary"
    # Rows of one id, or of none, may be many: the hash of their ids cuts them into ranges too.
    keyed = encoded.withColumn("h", F.xxhash64("ids"))
    ordered = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "ids").drop("h")
    ordered.mapInArrow(blocks, schema).write.option("compression", "none").parquet(f"{path}/shards")


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard, block, and ids (array) if asked for, decoded from a file set."""
    order = np.array([r[0] for r in spark.read.parquet(f"{path}/vocabulary").orderBy("rank").select("token_id").collect()], "<u4")
    shards = spark.read.parquet(f"{path}/shards")
    schema = "doc_id long, at long, n_tokens long, ids_crc32 long, shard int, block int" + ", ids array<long>" * with_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {k: batch.column(k)[i].as_py() for k in batch.schema.names}
                sizes = np.array(row["lengths"], np.int64)
                ids = order[decode_ranks(row["control"], row["data"], int(sizes.sum()))]
                ends = np.cumsum(sizes)
                parts = [ids[e - n : e] for e, n in zip(ends, sizes)]
                out = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - sizes), pa.array(sizes), pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())]
                out += [pa.array([row[k]] * len(sizes), pa.int32()) for k in ("shard", "block")]
                if with_ids:
                    out.append(pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(out, [x.split(" ")[0] for x in schema.split(", ")])

    # One row for each shard: as many as write tasks.
    totals = shards.selectExpr("shard", "start + aggregate(lengths, 0L, (a, x) -> a + x) AS upto").groupBy("shard").agg(F.max("upto").alias("n"))
    before = totals.selectExpr("shard", "CAST(coalesce(sum(n) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS long) AS before")
    rows = shards.mapInArrow(decode, schema)
    return rows.join(before, "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard", "block", *(["ids"] if with_ids else []))
