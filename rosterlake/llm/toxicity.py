"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features of a document are its distinct words (letters, lower case) and their stems of four and five letters, as 64-bit
hashes. Those count that the sample has in at least LEAST documents, in one of its classes TIMES as often as in the
other, and APART standard errors or more apart. The model has one weight vector for all grades and an ascending threshold
for each: P(grade >= j) = sigmoid(w.x - theta_j); the expected severity is the sum of these over j. It rejects a document
when P(grade >= 1) reaches one half.

It is fitted on a bounded sample: at most SAMPLE labelled documents of each class, those with the smallest hash of their
id. Features are counted and chosen in Spark, and only the chosen ones of the sample reach the driver. Labels tell toxic
from not; the grades 1 to GRADES of toxic documents are equal parts of their order by a held-out score: the sample is dealt
into two halves, and each is scored by a model of toxic or not that was fitted on the other half. Where a half lacks one of
the classes all toxic documents are of grade 1. Whole texts are read. Scoring passes over all documents once, without a shuffle, and judges each row by its own text.

Nulls: null or empty texts have severity 0 and grade 0; null labels are no labels; null ids are scored. A document with
labels of both kinds counts as toxic. Repeated rows are scored alike, and rows of one id apart from each other. Without labels
of both classes, or features that tell them apart, nothing is rejected. Other columns are not read, whatever their names.
Empty tables give no rows and reject nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE, GRADES, LEAST, APART, TIMES = 4000, 3, 3, 6.0, 12
WORDS = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[int]:
    """Hashed features of a word: itself and its stems."""
    names = [word] + [f"{word[:k]}*" for k in (4, 5) if len(word) > k]
    return [xxhash.xxh3_64_intdigest(x) for x in names]


def words_of(text: str | None) -> set[str]:
    return set(WORDS.findall(text.lower())) if text else set()


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    weights: dict[int, float]
    thresholds: np.ndarray

    def grades(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j from 1, a column each."""
        return sigmoid(scores[:, None] - self.thresholds[None, :])


def sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """toxic, features (distinct, ascending) of the sample's documents; at most 2 * size labels, so they are broadcast."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    pick = lambda side: known.where(side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    picked = common.written(pick("toxic > 0").unionByName(pick("toxic <= 0")).select(F.col("doc_id").alias("_labelled"), F.col("toxic").alias("_toxic")), "labels")
    texts = docs.select(docs["doc_id"].cast("long").alias("_id"), docs["text"].cast("string").alias("text")).join(F.broadcast(picked), F.col("_id") == F.col("_labelled")).select((F.col("_toxic") > 0).alias("toxic"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, "text"):
            got = [sorted({k for w in words_of(t) for k in features(w)}) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([np.array(x, "<u8").tobytes() for x in got], pa.binary())], ["toxic", "features"])

    return common.written(texts.mapInArrow(run, "toxic boolean, features binary"), "sample")


def chosen(rows: DataFrame) -> DataFrame:
    """feature, odds: the features of the sample that tell the classes apart, with the logarithm of their odds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, "features"):
            flat = [np.frombuffer(x, "<u8") for x in batch.column("features").to_pylist()]
            toxic = np.repeat(batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool), [len(x) for x in flat])
            names, at = np.unique(np.concatenate(flat), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(np.bincount(at, toxic, len(names)).astype(np.int64)), pa.array(np.bincount(at, ~toxic, len(names)).astype(np.int64))], ["feature", "bad", "good"])

    totals = rows.agg(F.count_if("toxic").alias("b"), F.count_if(~F.col("toxic")).alias("g")).first()
    b, g = F.lit(float(totals.b)), F.lit(float(totals.g))
    counts = rows.mapInArrow(count, "feature long, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    both = (F.col("bad") + F.col("good") + 1) / (b + g + 2)
    apart = F.abs(F.col("bad") / b - F.col("good") / g) / F.sqrt(both * (1 - both) * (1 / b + 1 / g))
    odds = F.log((F.col("bad") + 0.5) / (b + 1)) - F.log((F.col("good") + 0.5) / (g + 1))
    return counts.where(F.col("bad") + F.col("good") >= LEAST).select("feature", odds.alias("odds"), apart.alias("apart")).where((F.abs("odds") >= float(np.log(TIMES))) & (F.col("apart") >= APART)).select("feature", "odds")


def held_out_grades(toxic: np.ndarray, rows: list[np.ndarray], size: int, grades: int = GRADES) -> np.ndarray:
    """0 for documents that are not toxic; for toxic ones 1 to grades, in the order of their scores by the other half's model."""
    half = np.zeros(len(rows), np.int64)
    for side in (toxic, ~toxic):
        half[side] = np.arange(side.sum()) % 2
    scores = np.zeros(len(rows))
    for h in (0, 1):
        known = np.flatnonzero(half != h)
        if len(set(toxic[known].tolist())) < 2:
            return toxic.astype(np.int64)
        w, theta = fit(toxic[known].astype(np.int64), [rows[i] for i in known], size)
        for i in np.flatnonzero(half == h):
            scores[i] = w[rows[i]].sum() - theta[0]
    grade = np.zeros(len(rows), np.int64)
    order = np.flatnonzero(toxic)[np.argsort(scores[toxic], kind="stable")]
    grade[order] = 1 + np.arange(len(order)) * grades // len(order)
    return np.searchsorted(np.unique(grade), grade)  # few documents may leave grades empty


def fit(grade: np.ndarray, rows: list[np.ndarray], size: int, rounds: int = 500, rate: float = 0.1, decay: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full-batch gradient steps (Adam) on the likelihood of the grades; both classes weigh alike.

    rows hold numbers of features below size; grades are 0 to their maximum, each with a document.
    """
    n, at = len(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat, each, toxic = np.concatenate(rows), np.arange(n), grade > 0
    grades = int(grade.max())
    weight = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())
    w, theta = np.zeros(size), np.arange(grades, dtype=float)
    m, v, mt, vt = np.zeros(size), np.zeros(size), np.zeros(grades), np.zeros(grades)
    for step in range(1, rounds + 1):
        p = sigmoid(np.bincount(at, w[flat], n)[:, None] - theta)
        full = np.hstack([np.ones((n, 1)), p, np.zeros((n, 1))])
        prob = np.maximum(full[each, grade] - full[each, grade + 1], 1e-9)
        slope = p * (1 - p)
        above, below = np.maximum(grade - 1, 0), np.minimum(grade, grades - 1)
        upper = np.where(grade > 0, slope[each, above], 0) * weight / prob
        lower = np.where(grade < grades, slope[each, below], 0) * weight / prob
        gw = np.bincount(flat, (lower - upper)[at], size) + decay * w
        gt = np.bincount(above, upper, grades) - np.bincount(below, lower, grades)
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mt, vt = 0.9 * mt + 0.1 * gt, 0.99 * vt + 0.01 * gt * gt
        a, b = 1 - 0.9**step, 1 - 0.99**step
        w -= rate * (m / a) / (np.sqrt(v / b) + 1e-8)
        theta -= rate * (mt / a) / (np.sqrt(vt / b) + 1e-8)
        theta = np.maximum.accumulate(np.maximum(theta, 1e-3))  # a text without features is of grade 0
    return w, theta


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model | None:
    rows = sample(docs, labels, size)
    classes = rows.agg(F.bool_or("toxic").alias("some"), F.bool_and("toxic").alias("all")).first()
    if not classes.some or classes.all:
        return None
    # Features with LEAST documents or more of the bounded sample, far fewer than its words.
    found = sorted(r.feature & (2**64 - 1) for r in chosen(rows).select("feature").collect())
    if not found:
        return None
    names = np.array(found, np.uint64)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, "features"):
            got = [np.flatnonzero(np.isin(names, np.frombuffer(x, "<u8"), assume_unique=True)).astype("<i4").tobytes() for x in batch.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(got, pa.binary())], ["toxic", "places"])

    # One row for each document of the bounded sample, chosen features only.
    got = sorted((r.toxic, bytes(r.places)) for r in rows.mapInArrow(places, "toxic boolean, places binary").collect())
    toxic, places_of = np.array([t for t, _ in got], bool), [np.frombuffer(x, "<i4").astype(np.int64) for _, x in got]
    w, theta = fit(held_out_grades(toxic, places_of, len(names)), places_of, len(names))
    strong = np.abs(w) > 1e-3
    return Model(dict(zip(names[strong].tolist(), w[strong].tolist())), theta)


class Scorer:
    """P(grade >= j) of texts, a column for each j from 1; 0 for a text without words."""

    def __init__(self, model: Model):
        self.model, self.memo = model, {}  # the features of a word that have a weight

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        memo, weights = self.memo, self.model.weights
        scores, some = np.zeros(len(texts)), np.zeros(len(texts), bool)
        for i, t in enumerate(texts):
            words = words_of(t)
            some[i] = bool(words)
            if len(memo) > 500_000:
                memo.clear()
            found: set[int] = set()
            for x in words:
                got = memo.get(x)
                if got is None:
                    got = memo[x] = [k for k in features(x) if k in weights]
                if got:
                    found.update(got)
            scores[i] = sum(weights[k] for k in sorted(found))
        p = self.model.grades(scores)
        p[~some] = 0
        return p


def score(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, expected_severity, grade, p_toxic of every document."""
    schema = "doc_id long, expected_severity double, grade int, p_toxic double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model is not None else lambda texts: np.zeros((len(texts), 1))
        for batch in common.small_batches(batches, "text"):
            p = scorer(batch.column("text").to_pylist())
            out = [batch.column("doc_id"), pa.array(p.sum(axis=1)), pa.array((p >= 0.5).sum(axis=1).astype(np.int32)), pa.array(p[:, 0])]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "expected_severity", "grade", "p_toxic"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def rejected(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """The documents that the model rejects, with their scores."""
    return score(docs, train(docs, labels, size)).where(F.col("grade") >= 1)


def drop_toxic(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """docs without the rows whose own text the model rejects, whatever their ids."""
    model = train(docs, labels, size)
    return docs if model is None else docs.where(~rejecting(model)(docs["text"].cast("string")))


def rejecting(model: Model):
    """A function of a text column: whether the model rejects the text."""
    scorer = Scorer(model)

    @F.arrow_udf("boolean")
    def rejects(texts: pa.Array) -> pa.Array:
        return pa.array(scorer(texts.to_pylist())[:, 0] >= 0.5)

    return rejects
