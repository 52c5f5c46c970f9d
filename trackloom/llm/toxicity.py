"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A bounded sample of labelled rows trains the model in one task; its L1 penalty leaves few
weights, which go to every task as one dense vector of fixed size (4 MB). Scoring is a
single map over whole texts without a shuffle.

Features are present or absent: words (runs without white space and ASCII punctuation,
A-Z lowered), beginnings of words, pairs of neighbours, and pairs with one or two words
between.

Defined results: null and empty texts score as the intercept alone; null labels teach
nothing; rows that repeat a label for one document teach it once, as toxic if any says so, and of
several documents with one id the one whose text has the least MD5 teaches it;
a null ``doc_id`` has no label and is not held out; without labelled rows all weights are
zero and every score is the intercept's 0.5; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm import hashing
from trackloom.llm.common import take
from trackloom.session import ship_package

BITS = 20
#: At most so many labelled documents train the model.
TRAIN_ROWS = 10_000
#: Toxic rows are rare; each counts as so many others.
POSITIVE_WEIGHT = 1.5
PLACES = ((0,), (0, 1), (0, 2), (0, 3))
#: Bytes of word beginnings, for forms of a word that are not seen in training.
STEMS = (4, 5, 6, 7, 8)


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(slot, text number) of each feature that a text has, once per text, by text."""
    words = hashing.Words(texts, hashing.BREAK)
    found = [hashing.ngrams(words.hash, words.at, p) for p in PLACES]
    found += [words.stems(n) for n in STEMS]
    slot = np.concatenate([f[0] for f in found]) >> np.uint64(64 - bits)
    doc = np.concatenate([f[1] for f in found])
    return slot.astype(np.int64), doc


@dataclass
class Ftrl:
    """FTRL-proximal with a learning rate of its own for each coordinate."""

    slots: int
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 0.1

    def __post_init__(self):
        self.z = np.zeros(self.slots + 1)  # the last one is the intercept, without penalty
        self.n = np.zeros(self.slots + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def intercept(self) -> float:
        return -self.z[-1] * self.alpha / (self.beta + np.sqrt(self.n[-1]))

    def learn(self, slots: np.ndarray, label: float, weight: float = 1.0) -> None:
        w = self.weights(slots)
        b = self.intercept()
        g = weight * (1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - label)
        for at, value in ((slots, w), (np.array([-1]), np.array([b]))):
            n = self.n[at]
            sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
            self.z[at] += g - sigma * value
            self.n[at] = n + g * g


def _fit(sample: DataFrame, bits: int, rounds: int) -> DataFrame:
    """(slot, weight) rows of a model fitted in one task to (``_text``, ``_y``, ``_key``)."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for a, b in hashing.slices(batch.column(0)):
                slot, doc = features(batch.column(0).slice(a, b - a), bits)
                order = np.argsort(doc, kind="stable")
                cuts = np.searchsorted(doc[order], np.arange(1, b - a))
                y, key = (batch.column(i).slice(a, b - a).to_pylist() for i in (1, 2))
                rows += [(k, t, np.unique(s).astype(np.int32)) for k, t, s in zip(key, y, np.split(slot[order], cuts))]
        rows.sort(key=lambda r: r[0])
        model = Ftrl(1 << bits)
        for _ in range(rounds):
            for _, label, slots in rows:
                model.learn(slots, label, POSITIVE_WEIGHT if label else 1.0)
        w = model.weights()[:-1]
        at = np.flatnonzero(w)
        slots = pa.array(np.append(at, -1), pa.int64())
        yield pa.RecordBatch.from_arrays([slots, pa.array(np.append(w[at], model.intercept()), pa.float64())], ["slot", "weight"])

    # an exchange, so that the scan and the join that make the sample keep their own tasks
    return sample.repartition(1).mapInArrow(train, "slot long, weight double")


def training_sample(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``rows`` labelled documents in a fixed shuffled order: ``_text, _y, _key``.

    ``learn`` is a condition on the labels' ``_id``; only the ids chosen meet the documents. Of
    several documents with one id the text of least MD5 is taken, so an id makes one row.
    """
    rated = take(labels, _id="doc_id", _y="toxic").filter(learn & F.col("_id").isNotNull() & F.col("_y").isNotNull())
    rated = rated.groupBy("_id").agg(F.max(F.col("_y").cast("double")).alias("_y"))
    rated = rated.withColumn("_key", F.md5(F.col("_id").cast("string"))).orderBy("_key", "_id").limit(rows)
    texts = take(docs, _id="doc_id", _text="text")
    text = F.coalesce(F.col("_text").cast("string"), F.lit(""))
    found = texts.join(F.broadcast(rated), "_id").select("_id", text.alias("_text"), "_y", "_key")
    return found.groupBy("_id").agg(F.min_by("_text", F.md5("_text")).alias("_text"), F.first("_y").alias("_y"), F.first("_key").alias("_key")).drop("_id")


def fit(docs: DataFrame, labels: DataFrame, learn: Column, bits: int = BITS, rounds: int = 4, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """(dense weights, intercept); what comes to the driver is at most one row per slot."""
    ship_package(docs.sparkSession)
    got = _fit(training_sample(docs, labels, learn, rows), bits, rounds).toPandas()
    weights = np.zeros(1 << bits, np.float32)
    inner = got[got["slot"] >= 0]
    weights[inner["slot"].to_numpy()] = inner["weight"].to_numpy()
    return weights, float(got.loc[got["slot"] < 0, "weight"].sum())


def scored(docs: DataFrame, weights: np.ndarray, intercept: float) -> DataFrame:
    """(``_id``, ``score``) of every row of ``docs``."""
    ship_package(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(weights)
    bits = int(weights.size).bit_length() - 1
    df = take(docs, _id="doc_id", _text="text").withColumn("_text", F.col("_text").cast("string"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for batch in batches:
            out = np.empty(batch.num_rows)
            for a, b in hashing.slices(batch.column(1)):
                slot, doc = features(batch.column(1).slice(a, b - a), bits)
                hit = np.flatnonzero(w[slot])
                pairs = np.unique((doc[hit] << bits) | slot[hit])
                total = np.bincount(pairs >> bits, w[pairs & ((1 << bits) - 1)], b - a)
                out[a:b] = 1 / (1 + np.exp(-np.clip(total + intercept, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["_id", "score"])

    return df.mapInArrow(score, f"_id {df.schema['_id'].dataType.simpleString()}, score double")


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns of query op9."""
    weights, intercept = fit(docs, labels, ~held_out("_id"))
    return scored(docs, weights, intercept).select(
        F.col("_id").alias("doc_id"),
        held_out("_id").alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
