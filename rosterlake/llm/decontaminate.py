"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, in lower case. A passage is aligned with a test item word by word (match 2, mismatch
and gap -1). `score` is the best local alignment divided by that of the item with itself; from `threshold` on the passage is
a leak. What is left on either side of a leak is aligned again, so each copy in a document gives a row.

Seeds are pairs of words that stand side by side or with one word between, in the item and in the document alike. They
lose no leak: of L words of an item a leak of score t has m matches and at most 2m - 2tL errors, so at most m - tL of its
m - 1 neighbouring matches are two or more errors apart, and at least tL - 1 of them are seeds, each with a first word of
its own in the item. So each item may leave out all but two of that many of its L - 1 first words, and two seeds with unlike
first words, no farther apart than an alignment is long, open a passage (one seed, where that number is one). Those left out
are the frequent ones: all documents are counted first, and each item keeps the first words whose pairs are rarest. A phrase
that stands in many documents opens a passage only where an item has nothing rarer.

Two upper bounds on the score, the item's words in any stretch as long as an alignment can be and the words that passage
and item share, spare most alignments and lose none.

The test set is taken in blocks of a bounded number of words (a longer item is a block of its own). A block is broadcast, as
the small side of the join by seeds, and takes two passes over the documents: counts, then passages. Documents are not
shuffled, and each row is judged by its own text.

Null or empty texts have no leaks; items that are null, have fewer than `least` words or a null id match nothing. Rows with
a null doc_id take part and are dropped like any other; repeated rows give repeated results, items of one id are items of
their own. Ties in frequency go to the earlier word. Other columns are not read, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEAST, THRESHOLD = 3, 0.5
BLOCK_WORDS = 1_000_000
MATCH, MISS, GAP = 2, -1, 1
WORDS = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


class Items:
    """A block of test items: word numbers, and the items of each pair, as sorted arrays."""

    def __init__(self, items: list[tuple[int, list[str]]], threshold: float):
        self.threshold, self.words = threshold, {}
        self.names = [i for i, _ in items]
        self.ids = [np.array([self.words.setdefault(w, len(self.words)) for w in ws], np.int64) for _, ws in items]
        self.counts = [Counter(ids.tolist()) for ids in self.ids]
        self.base = np.int64(len(self.words) + 1)
        sizes = np.array([len(ids) for ids in self.ids], np.int64)
        # m matches and x mismatches and gaps score 2m - x >= 2 * threshold * L and take m + x words of a passage at most.
        self.width = np.ceil((MATCH + 1) * sizes - threshold * MATCH * sizes).astype(np.int64)
        self.sure = np.maximum(1, np.ceil(threshold * sizes - 1 - 1e-9)).astype(np.int64)  # seeds that each leak has
        own = [self.pairs(ids) for ids in self.ids]
        self.index([(at, code, np.full(len(at), k)) for k, (at, code) in enumerate(own)])

    def index(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Keeps these pairs (places, codes and numbers of items), and no others, as seeds."""
        at, code, item = (np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(3))
        order = np.lexsort((at, item, code))
        self.at, self.item = at[order], item[order]
        self.codes, first = np.unique(code[order], return_index=True)
        self.first = np.append(first, len(order))

    def keep_rare(self, frequency: np.ndarray) -> None:
        """Leaves each item only as many first words as no leak can do without, those of the rarest pairs."""
        found = []
        for k, ids in enumerate(self.ids):
            at, code = self.pairs(ids)
            total = np.bincount(at, frequency[np.searchsorted(self.codes, code)], len(ids) - 1)
            kept = np.argsort(total, kind="stable")[: len(ids) - self.sure[k] + min(1, self.sure[k] - 1)]
            rare = np.isin(at, kept)
            found.append((at[rare], code[rare], np.full(rare.sum(), k)))
        self.index(found)

    def pairs(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of first words and the codes of pairs of the items' words, side by side or one apart."""
        places, codes = [], []
        for apart in (1, 2):
            a, b = ids[:-apart], ids[apart:]
            at = np.flatnonzero((a >= 0) & (b >= 0))
            places.append(at)
            codes.append(a[at] * self.base + b[at])
        return np.concatenate(places), np.concatenate(codes)

    def numbers(self, text: str | None) -> np.ndarray:
        """The words of a text as numbers, -1 for a word of no item."""
        get = self.words.get
        return np.array([get(w, -1) for w in words_of(text)], np.int64)

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a document and numbers of the seeds that stand there."""
        at, code = self.pairs(ids)
        if not len(at) or not len(self.codes):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        same = self.codes[k] == code
        return at[same], k[same]

    def opened(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and items of the seeds that open a passage."""
        at, k = self.hits(ids)
        many = self.first[k + 1] - self.first[k]
        place = np.repeat(self.first[k] - np.cumsum(many) + many, many) + np.arange(many.sum())
        at, item, word = np.repeat(at, many), self.item[place], self.at[place]
        order = np.lexsort((at, item))
        at, item, word = at[order], item[order], word[order]
        # Between two seeds of a leak with unlike first words some neighbours are unlike, and lie within the leak.
        near = (item[1:] == item[:-1]) & (word[1:] != word[:-1]) & (at[1:] - at[:-1] <= self.width[item[1:]])
        opens = self.sure[item] == 1
        opens[1:] |= near
        opens[:-1] |= near
        return at[opens], item[opens]

    def passages(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """The parts of a document around the seeds that open one."""
        at, item = self.opened(ids)
        return merged(zip(np.maximum(at - self.width[item], 0).tolist(), np.minimum(at + self.width[item], len(ids)).tolist()))

    def leaks(self, ids: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
        """Item, score, start and end of each leak in a passage."""
        spans = defaultdict(list)
        for p, k in zip(*(x.tolist() for x in self.opened(ids))):
            spans[k].append((max(0, p - int(self.width[k])), min(len(ids), p + int(self.width[k]))))
        for k, parts in spans.items():
            for a, b in merged(parts):
                for score, first, end in leaks_in(self.ids[k], self.counts[k], ids, a, b, self.threshold, int(self.width[k])):
                    yield self.names[k], score / (MATCH * len(self.ids[k])), first, end


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score, and the place in the passage where it ends. Rows are whole numpy operations."""
    j = np.arange(len(passage)) * GAP
    prev, best, end = np.zeros(len(passage), np.int64), 0, -1
    for w in item:
        diagonal = np.concatenate([[0], prev[:-1]]) + np.where(passage == w, MATCH, MISS)
        row = np.maximum(np.maximum(diagonal, prev - GAP), 0)
        row = np.maximum.accumulate(row + j) - j  # gaps along the row
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
        prev = row
    return best, end


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def passages(docs: DataFrame, shared, doc_id: str, text: str) -> DataFrame:
    """doc_id, start, words (numbers, -1 for a word of no item): the parts of documents around the seeds that open one."""
    schema = "doc_id long, start long, words binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in common.small_batches(batches, "text"):
            rows = []
            for key, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = items.numbers(t)
                rows += [(key, a, ids[a:b].astype("<i4").tobytes()) for a, b in items.passages(ids)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "start", "words"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def dense(passage: np.ndarray, words: np.ndarray, width: int, least: float) -> list[tuple[int, int]]:
    """The parts of a passage made of stretches of `width` words with at least `least` of the given ones."""
    total = np.concatenate([[0], np.cumsum(np.isin(passage, words))])
    if len(passage) <= width:
        return [(0, len(passage))] if total[-1] >= least else []
    starts = np.flatnonzero(total[width:] - total[:-width] >= least)
    if not len(starts):
        return []
    apart = np.flatnonzero(np.diff(starts) > width)
    return list(zip(starts[np.append(0, apart + 1)].tolist(), (starts[np.append(apart, len(starts) - 1)] + width).tolist()))


def leaks_in(item: np.ndarray, counts: Counter, ids: np.ndarray, a: int, b: int, threshold: float, width: int) -> Iterator[tuple[int, int, int]]:
    """Score, start and end of the leaks of an item in ids[a:b]; none overlaps another."""
    most = MATCH * len(item)
    left = [(a, b)]
    while left:
        a, b = left.pop()
        for c, d in dense(ids[a:b], item, width, threshold * len(item)):
            c, d = a + c, a + d
            here = Counter(ids[c:d].tolist())
            if MATCH * sum(min(n, here[w]) for w, n in counts.items()) < threshold * most:
                continue
            score, end = align(item, ids[c:d])
            if score >= threshold * most:
                _, back = align(item[::-1], ids[c : c + end + 1][::-1])
                start, end = c + end - back, c + end + 1
                yield score, start, end
                left += [(c, start), (end, d)]


def aligned(found: DataFrame, shared) -> DataFrame:
    schema = "doc_id long, item_id long, score double, start_word long, end_word long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            rows = []
            for key, start, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "words"))):
                rows += [(key, item, score, start + a, start + b) for item, score, a, b in items.leaks(np.frombuffer(raw, "<i4").astype(np.int64))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "score", "start_word", "end_word"])

    return found.mapInArrow(run, schema)


def seed_counts(docs: DataFrame, shared: Broadcast, text: str) -> np.ndarray:
    """How often each pair of the block stands in all documents: counted in tasks, summed by pair, two pairs a word at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        total = np.zeros(len(items.codes), np.int64)
        for batch in common.small_batches(batches, "text"):
            found = [items.hits(items.numbers(t))[1] for t in batch.column("text").to_pylist()]
            if found:
                total += np.bincount(np.concatenate(found), minlength=len(total))
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["seed", "n"])

    sums = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    frequency = np.zeros(len(shared.value.codes), np.int64)
    got = sums.toArrow()
    frequency[got.column("seed").to_numpy()] = got.column("n").to_numpy()
    return frequency


def item_blocks(docs: DataFrame, benchmark: DataFrame, least: int, threshold: float, block_words: int, text: str, item_id: str, item_text: str) -> Iterator[Broadcast]:
    """Reads the test set row by row and broadcasts it with its rare seeds, a block of at most block_words words or one item at a time."""
    send = benchmark.sparkSession.sparkContext.broadcast

    def block(held: list[tuple[int, list[str]]]) -> Broadcast:
        items = Items(held, threshold)
        shared = send(items)
        items.keep_rare(seed_counts(docs, shared, text))
        shared.unpersist()
        return send(items)

    held, words = [], 0
    for i, t in benchmark.select(F.col(item_id).cast("long"), F.col(item_text).cast("string")).where(F.col(item_id).isNotNull()).orderBy(item_id, item_text).toLocalIterator():
        ws = words_of(t)
        if len(ws) < least:
            continue
        if held and words + len(ws) > block_words:
            yield block(held)
            held, words = [], 0
        held.append((i, ws))
        words += len(ws)
    if held:
        yield block(held)


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, score, start_word, end_word: each passage of docs that aligns with a test item."""
    out = []
    for shared in item_blocks(docs, benchmark, least, threshold, block_words, text, item_id, item_text):
        found = common.written(passages(docs, shared, doc_id, text), "passages")
        out.append(aligned(found, shared))
    if not out:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, start_word long, end_word long")
    return reduce(DataFrame.unionByName, out)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows whose own text holds a leak, whatever their ids."""
    kept = docs
    for shared in item_blocks(docs, benchmark, least, threshold, block_words, text, item_id, item_text):
        kept = kept.where(~leaking(shared)(kept[text].cast("string")))
    return kept


def leaking(shared):
    """A function of a text column: whether the text holds a leak of the block's items."""

    @F.arrow_udf("boolean")
    def holds(texts: pa.Array) -> pa.Array:
        items, out = shared.value, []
        for t in texts:
            ids = items.numbers(t.as_py())
            out.append(any(True for a, b in items.passages(ids) for _ in items.leaks(ids[a:b])))
        return pa.array(out, pa.bool_())

    return holds
