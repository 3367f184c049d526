"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import Bounded, crc_of_id, raw_bytes, table, text_slices

BITS = 18
#: Labelled rows that a model is fitted on, at most; chosen by the hash of their id.
SAMPLE = 24_000
EDGES = b".,;:!?|()[]{}<>\"'`*_-#"
MIX = np.uint64(0x9E3779B97F4A7C15)


def _word(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word.strip(EDGES) or word)


_words = Bounded(_word, 500_000)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hashed feature) of all words, pairs of neighbours and pairs with one word between; repeats included."""
    lists = [t.lower().split() for t in texts]
    size = np.array([len(x) for x in lists], np.int64)
    h = np.fromiter(map(_words.__getitem__, (w for x in lists for w in x)), np.uint64, int(size.sum()))
    owner = np.repeat(np.arange(len(texts)), size)
    parts, owners = [h], [owner]
    for gap in (1, 2):
        inside = owner[:-gap] == owner[gap:]
        parts.append(((h[:-gap] * MIX + h[gap:] * np.uint64(2 * gap + 1)) * MIX)[inside])
        owners.append(owner[gap:][inside])
    code = np.concatenate(parts)
    return np.concatenate(owners), ((code * MIX) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """FTRL-proximal with per-coordinate rates; L1 keeps coordinates at zero until their gradients add up."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 1.0, size: int = (1 << BITS) + 1):
        self.alpha, self.beta, self.l2 = alpha, beta, l2
        self.l1 = np.full(size, l1)
        self.l1[-1] = 0.0  # the intercept is free
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = self.l1[at]
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def compact(self) -> tuple[np.ndarray, np.ndarray]:
        w = self.weights(slice(None))
        at = np.flatnonzero(w)
        return at, w[at]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, passes: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero coordinates of the model and their weights.

    Learns from at most ``sample`` labelled ids with crc32(id) mod 4 other than 2,
    chosen by the hash of the id. Only these are broadcast to find their texts.
    Features are made where the texts are; one task runs over them ``passes``
    times, row by row. Several labels of one id count as their largest, several
    texts of one id as the one whose features sort first. No labels: no weights.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(crc_of_id() % 4 != 2)
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").cast("long").alias("doc_id"), "label")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            raw = raw_bytes(part.column("text"))
            owner, code = features(raw)
            both = np.unique(owner << BITS | code)
            cut = np.searchsorted(both >> BITS, np.arange(len(raw) + 1))
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array((both & ((1 << BITS) - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), lists], names=["doc_id", "label", "at"])

    rows = texts.mapInArrow(make, "doc_id long, label int, at array<int>").groupBy("doc_id", "label").agg(F.min("at").alias("at"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ftrl()
        held = [(int(y > 0), at.values.to_numpy()) for b in batches for y, at in zip(b.column("label").to_pylist(), b.column("at"), strict=True)]
        for _ in range(passes):
            for y, at in held:
                model.learn(at.astype(np.int64), y)
        at, w = model.compact()
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w)], names=["at", "w"])

    # The only group that one task takes: at most ``sample`` rows, sent once.
    stream = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("label", "at")
    got = stream.mapInArrow(learn, "at long, w double").toArrow()
    return got.column("at").to_numpy(), got.column("w").to_numpy()


def scores(texts: list[bytes], dense: np.ndarray) -> np.ndarray:
    """Probability that each text is toxic; a feature counts once."""
    owner, code = features(texts)
    live = np.flatnonzero(dense[code])
    both = np.unique(owner[live] << BITS | code[live])
    sums = np.bincount(both >> BITS, weights=dense[both & ((1 << BITS) - 1)], minlength=len(texts))
    return 1.0 / (1.0 + np.exp(-np.clip(sums + dense[-1], -35, 35)))


def dense_weights(model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    dense = np.zeros((1 << BITS) + 1)
    dense[model[0]] = model[1]
    return dense


def score_texts(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], threshold: float = 0.3) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of each row.

    Whole texts are scored; nothing else of a row is looked at. Defined
    results: a null text is empty, and an empty text gets the score of the
    intercept alone; a null doc_id stays and isn't held out; repeated rows stay;
    an empty table gives no rows. The model is at most 2^18 + 1 numbers.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = dense_weights(sent.value)
        for part in text_slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores(raw_bytes(part.column("text")), dense))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(crc_of_id() % 4 == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below the threshold; other rows go.

    Defined results: a model that has learnt from no label rejects nothing; null
    and empty texts are judged by the intercept; null ids and repeated rows are
    judged like all others; an empty table gives no rows.
    """
    if not len(model[0]):
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = dense_weights(sent.value)
        for part in text_slices(batches):
            yield part.filter(pa.array(scores(raw_bytes(part.column("text")), dense) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, fit(docs, table(spark, sf_dir, "labels")))
