r"""Target-distribution importance resampling over hashed word features.

A text's features are its runs of 1 to `order` consecutive words, joined by one space; words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`
after A-Z became a-z. A feature's bucket is the unsigned crc32 of its UTF-8 bytes modulo `buckets`. A bucket's gain is
floor(1000 ln of its smoothed share in the target over its smoothed share in the documents); a document's weight is the
floored mean of its features' gains; noise from its id's hash (Gumbel) is added, and the highest scores among documents of
`least` words or more are drawn.

The checksums come from a position table. crc32 is affine over bits: it is the XOR of one contribution for each byte, which
depends on the byte and its distance from the end alone, and of a constant for the length. So the contributions of all
features of a batch are looked up at once and folded by bitwise_xor.reduceat over the features' spans. Spans longer than the
table fold blockwise: blocks are looked up alike, and neighbours combine in pairs, the left one moved over the right one's
bytes by a table of that linear map.

Texts are read twice, whole: counts for the gains (a row a bucket and task), then weights. Ranks need no window over all rows:
the counts of each score, which has a bounded range, give the cut; only rows at or above it are sorted by range, and partition
sizes give the ranks.

Null and empty texts have no features and weight 0. A null id counts as empty text in the hash and stands last among ties;
repeated rows are documents of their own. Other columns are not read, whatever their names. Empty tables give no rows; an
empty target only evens out the gains.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 10_000
ORDER = 1
LEAST = 20
PERCENT = 10
SEED = 2024
#: Bytes of the position table, and blocks that a long span folds at a time.
WIDTH, BLOCKS = 64, 1 << 14
#: Bytes of features that are looked up at a time.
PIECE = 1 << 20


def word_bytes() -> np.ndarray:
    """A byte to itself in lower case, or 0 where it separates words."""
    table = np.zeros(256, np.uint8)
    for part in (range(0x30, 0x3A), range(0x61, 0x7B), range(0x80, 0x100)):
        table[list(part)] = part
    table[0x41:0x5B] = table[0x61:0x7B]
    return table


WORD = word_bytes()


@cache
def position_table() -> np.ndarray:
    """[distance from the end, byte] to the contribution."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1).astype(np.uint32)
    rows = [one]
    while len(rows) < WIDTH:
        rows.append(one[rows[-1] & 255] ^ (rows[-1] >> 8))
    return np.stack(rows)


def moved(by: np.ndarray, state: np.ndarray) -> np.ndarray:
    """States after some zero bytes more, by the table of that map: [byte of the state, its value]."""
    return by[0][state & 255] ^ by[1][state >> 8 & 255] ^ by[2][state >> 16 & 255] ^ by[3][state >> 24]


@cache
def move_tables(levels: int = 15) -> list[np.ndarray]:
    """Maps over WIDTH, 2 WIDTH, 4 WIDTH, ... zero bytes."""
    one, table = position_table()[0], np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for _ in range(WIDTH):
        table = one[table & 255] ^ (table >> 8)
    found = [table]
    while len(found) < levels:
        found.append(moved(found[-1], found[-1]))
    return found


@cache
def length_constants() -> np.ndarray:
    return np.array([zlib.crc32(bytes(n)) for n in range(WIDTH + 1)], np.uint32)


def length_constant(n: int) -> int:
    crc, zeros = 0, bytes(min(n, PIECE))
    for at in range(0, n, PIECE):
        crc = zlib.crc32(zeros[: min(PIECE, n - at)], crc)
    return crc


def folded(block: np.ndarray) -> np.ndarray:
    """Of rows of 2^k WIDTH bytes the XOR of contributions."""
    k = (block.shape[1] // WIDTH).bit_length() - 1
    far = np.arange(WIDTH - 1, -1, -1) * 256
    state = np.bitwise_xor.reduce(position_table().ravel()[block.reshape(len(block), -1, WIDTH) + far], axis=2)
    for by in move_tables()[:k]:
        state = moved(by, state[:, 0::2]) ^ state[:, 1::2]
    return state[:, 0]


def long_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of spans of more than WIDTH bytes."""
    out, most = np.zeros(len(starts), np.uint32), WIDTH * BLOCKS
    for i in np.flatnonzero(lengths > most):  # chunk after chunk
        state, a, n = np.zeros(1, np.uint32), int(starts[i]), int(lengths[i])
        for end in range(n % most or most, n + 1, most):
            chunk = np.zeros((1, most), np.uint8)
            part = data[a + max(0, end - most) : a + end]
            chunk[0, most - len(part) :] = part
            state = moved(move_tables()[BLOCKS.bit_length() - 1], state) ^ folded(chunk)
        out[i] = state[0] ^ np.uint32(length_constant(n))
    size = np.maximum(1, 2 ** np.ceil(np.log2(np.maximum(1, lengths) / WIDTH)).astype(np.int64)) * WIDTH
    for width in np.unique(size[lengths <= most]):
        rows = np.flatnonzero((size == width) & (lengths <= most))
        step = max(1, PIECE // int(width))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            place = np.arange(width)[None, :] + (lengths[some] - width)[:, None]
            block = np.where(place >= 0, data[np.maximum(starts[some][:, None] + place, 0)], 0).astype(np.uint8)
            out[some] = folded(block) ^ np.array([length_constant(int(n)) for n in lengths[some]], np.uint32)
    return out


def crc32_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The unsigned crc32 of data[start : start + length] for each span; spans may overlap, an empty one gives 0."""
    out = np.zeros(len(starts), np.uint32)
    rows = np.flatnonzero((lengths > 0) & (lengths <= WIDTH))
    table, ends = position_table().ravel(), np.cumsum(lengths[rows])
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
        some = rows[at:to]
        n = lengths[some]
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum()))
        byte = data[place + np.repeat(starts[some] - first, n)]
        far = np.repeat(first + n - 1, n) - place
        out[some] = np.bitwise_xor.reduceat(table[far * 256 + byte], first) ^ length_constants()[n]
        at = to
    more = np.flatnonzero(lengths > WIDTH)
    if len(more):
        out[more] = long_spans(data, starts[more], lengths[more])
    return out


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def features(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(words of each text, for each number of words in a run: (checksums of all such features in order, their number a text))."""
    low = WORD[data]
    word = low != 0
    before, after = np.concatenate(([False], word[:-1]))[: len(word)], np.concatenate((word[1:], [False]))[: len(word)]
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    bounds = np.searchsorted(starts, offsets)
    words = np.diff(bounds)
    if order > 1:  # one space between words
        length = ends - starts
        spaced = np.full(int(length.sum()) + len(length), 32, np.uint8)
        starts = np.cumsum(length) - length + np.arange(len(length))
        spaced[np.arange(int(length.sum())) + np.repeat(np.arange(len(length)), length)] = low[word]
        low, ends = spaced, starts + length
    last = np.repeat(bounds[1:], words)
    found = []
    for n in range(1, order + 1):
        run = np.flatnonzero(np.arange(len(starts)) + n <= last)
        found.append((crc32_spans(low, starts[run], ends[run + n - 1] - starts[run]), np.maximum(0, words - n + 1)))
    return words, found


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, order: int = ORDER) -> np.ndarray:
    """How many features of all texts each bucket has: a number for each bucket reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in common.small_batches([batch], "text"):
                for crc, _ in features(*texts_of(part.column("text")), order)[1]:
                    total += np.bincount(crc % buckets, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select(F.col("text").cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the source)) of each bucket, one added to every count."""
    k, all_s, all_t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_s + k) / ((s + 1) * (all_t + k)))) for s, t in zip(map(float, source), map(float, target))], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, n_features, weight of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, "text"):
            words, found = features(*texts_of(batch.column("text")), order)
            total, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            for crc, n in found:
                sums = np.concatenate(([0], np.cumsum(gain[crc % len(gain)])))
                end = np.cumsum(n)
                total += sums[end] - sums[end - n]
                count += n
            weight = np.where(count > 0, total // np.maximum(count, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(count), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select("doc_id", F.col("text").cast("string"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, n_features long, weight long")


def noise(doc_id, seed: int):
    """Gumbel noise in thousandths from the hash of the seed and the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, order: int = ORDER, least: int = LEAST, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of all documents; rank is null where a document is not drawn.

    Of the N documents with `least` words or more, floor(percent N / 100) with the highest scores are drawn, ties to the
    smaller id. Scores lie within some 200,000 values, so their counts fit the driver at any size.
    """
    gain = gains(bucket_counts(docs, buckets, order), bucket_counts(target, buckets, order))
    scored = common.written(weights(docs, gain, order).withColumn("score", F.col("weight") + noise("doc_id", seed)), "scores")
    counts = sorted(((r.score, r["count"]) for r in scored.where(F.col("n_words") >= least).groupBy("score").count().collect()), reverse=True)
    drawn = percent * sum(n for _, n in counts) // 100
    cut, above = None, 0
    for score, n in counts:
        if above >= drawn:
            break
        cut, above = score, above + n
    null = F.lit(None).cast("long")
    if cut is None:
        return scored.withColumn("rank", null)
    may = (F.col("n_words") >= least) & (F.col("score") >= cut)
    order_by = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    ranged = scored.where(may).repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    placed = common.written(ranged.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "drawn")
    before, starts = 0, []
    for r in sorted(placed.groupBy("part").count().collect()):
        starts.append((r.part, before))
        before += r["count"]
    ranks = placed.join(docs.sparkSession.createDataFrame(starts, "part int, before long"), "part")
    rank = F.col("at") + F.col("before") + 1
    return scored.where(~may).withColumn("rank", null).unionByName(ranks.withColumn("rank", F.when(rank <= drawn, rank)).drop("part", "at", "before"))
