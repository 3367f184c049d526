"""Approximate nearest neighbours by additive quantisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import table

#: Vectors that the codebooks are fitted on, at most.
SAMPLE = 8192
#: Queries that are sent to the index at once.
BLOCK = 4096


class AdditiveQuantiser:
    """A vector is the sum of one full-dimensional word from each codebook; encoding keeps the best partial sums (beam search)."""

    def __init__(self, books: int = 8, words: int = 128, beam: int = 8, seed: int = 7):
        self.books, self.words, self.beam, self.seed = books, words, beam, seed
        self.code = np.zeros((books, words, 1), np.float32)

    def fit(self, x: np.ndarray, rounds: int = 6) -> AdditiveQuantiser:
        """Codebooks from residuals (k-means), then made better together: encode, solve least squares for all words."""
        random = np.random.default_rng(self.seed)
        x = x.astype(np.float32)
        self.code = np.zeros((self.books, self.words, x.shape[1]), np.float32)
        rest = x.copy()
        for m in range(self.books):
            centres = rest[random.choice(len(rest), self.words, replace=len(rest) < self.words)].copy()
            for _ in range(rounds):
                near = ((centres**2).sum(1)[None] - 2 * rest @ centres.T).argmin(1)
                n = np.bincount(near, minlength=self.words)
                for d in range(x.shape[1]):
                    centres[:, d] = np.where(n > 0, np.bincount(near, rest[:, d], self.words) / np.maximum(n, 1), centres[:, d])
            self.code[m] = centres
            rest -= centres[near]
        for _ in range(2):
            codes, _ = self.encode(x)
            at = codes.astype(np.int64) + np.arange(self.books) * self.words
            size = self.books * self.words
            gram = np.zeros((size, size))
            for a in range(self.books):
                for b in range(self.books):
                    np.add.at(gram, (at[:, a], at[:, b]), 1.0)
            target = np.zeros((size, x.shape[1]))
            for a in range(self.books):
                np.add.at(target, at[:, a], x)
            solved = np.linalg.solve(gram + np.eye(size) * 0.1, target + 0.1 * self.code.reshape(size, -1))
            self.code = solved.reshape(self.code.shape).astype(np.float32)
        return self

    def encode(self, x: np.ndarray, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers, and the squared norm of their sum."""
        words = self.code.reshape(self.books * self.words, -1)
        cross = words @ words.T
        norm = np.diag(cross)
        codes, norms = [], []
        for at in range(0, len(x), block):
            part = x[at : at + block].astype(np.float32)
            dot = (part @ words.T).reshape(len(part), self.books, self.words)
            kept = np.zeros((len(part), 1, 0), np.int64)
            size2 = np.zeros((len(part), 1), np.float32)  # squared norm of the partial sum
            inner = np.zeros((len(part), 1), np.float32)  # its product with the vector
            for m in range(self.books):
                own = slice(m * self.words, (m + 1) * self.words)
                grown = np.broadcast_to(size2[:, :, None] + norm[own], (*kept.shape[:2], self.words)).copy()
                for k in range(m):
                    grown += 2 * cross[own].T[kept[:, :, k]]
                cost = grown - 2 * (inner[:, :, None] + dot[:, None, m, :])
                flat = cost.reshape(len(part), -1)
                keep = min(self.beam, flat.shape[1])
                best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
                rows = np.arange(len(part))[:, None]
                from_, word = best // self.words, best % self.words
                size2 = grown.reshape(len(part), -1)[rows, best]
                inner = inner[rows, from_] + dot[:, m][rows, word]
                kept = np.concatenate([kept[rows, from_], (word + m * self.words)[:, :, None]], axis=2)
            first = (size2 - 2 * inner).argmin(1)
            rows = np.arange(len(part))
            codes.append((kept[rows, first] - np.arange(self.books) * self.words).astype(np.uint8))
            norms.append(size2[rows, first])
        return np.concatenate([np.empty((0, self.books), np.uint8), *codes]), np.concatenate([np.empty(0, np.float32), *norms])

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each word its product with each query: (book, word, query)."""
        return np.ascontiguousarray(np.einsum("mwd,qd->mwq", self.code, q.astype(np.float32)))


def usable(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector takes part, and the vectors."""
    values = column.cast(pa.list_(pa.float64()))
    size = np.array([len(x) if x.is_valid else -1 for x in values])
    rows = np.flatnonzero(size == dims)
    if not len(rows) or not dims:
        return np.empty(0, np.int64), np.empty((0, dims))
    flat = values.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
    x = flat.reshape(len(rows), dims)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return rows[good], x[good]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of extreme numbers overflow
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.clip(np.einsum("ij,ij->i", unit(a), unit(b)), -1.0, 1.0)


class Best:
    """The nearest of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score, self.id = np.full((queries, k), -np.inf), np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, query: np.ndarray, id_: np.ndarray, score: np.ndarray) -> None:
        n = self.score.shape[0]
        query = np.concatenate([np.repeat(np.arange(n), self.k), query])
        id_, score = np.concatenate([self.id.ravel(), id_]), np.concatenate([self.score.ravel(), score])
        order = np.lexsort((id_, -score, query))
        query, id_, score = query[order], id_[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = rank < self.k
        self.score, self.id = score[keep].reshape(n, self.k), id_[keep].reshape(n, self.k)


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, depth: int = 256, share: float = 0.04, sample: int = SAMPLE) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for each query (vec_id divisible by ``every``) the ``k`` nearest found by cosine.

    The codebooks are fitted on at most ``sample`` vectors, chosen by hash.
    Every vector is encoded and searched: each batch of rows is scored by table
    lookups and norms, its best ``depth`` distinct vectors of each query, or
    ``share`` of them if that is more (so recall doesn't sink with the batch's
    size), get the exact cosine of the originals, and the best of all batches are
    ranked. Queries are sent in blocks of 4,096. Copies of a vector within a
    batch are scored once, and stand for their ``k + 1`` smallest ids, more of
    which can't be among the nearest. Defined results: vectors that are null,
    zero, of another length than most, or hold null or non-finite components
    take no part; ties go to the smaller vec_id; a null vec_id takes no part;
    rows that repeat a vec_id count each on its own, and a query's id is never
    its own neighbour; an empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    schema = "query_id long, rank int, vec_id long, score double"
    lengths = rows.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if lengths is None or not lengths.dims:
        return spark.createDataFrame([], schema)
    dims = lengths.dims
    learn = rows.where(F.size("embedding") == dims).groupBy("embedding").agg(F.min("vec_id").alias("vec_id")).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    _, x = usable(learn.column("embedding").combine_chunks(), dims)
    if not len(x):
        return spark.createDataFrame([], schema)
    quantiser = spark.sparkContext.broadcast(AdditiveQuantiser().fit(unit(x)))
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    blocks = max(1, -(-queries.count() // BLOCK))
    found = None
    for b in range(blocks):
        got = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").toArrow()
        at, q = usable(got.column("embedding").combine_chunks(), dims)
        if not len(at):
            continue
        sent = spark.sparkContext.broadcast((got.column("vec_id").to_numpy()[at], q))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            (ids, q), aq = sent.value, quantiser.value
            tables, best = aq.tables(unit(q)), Best(len(ids), k)
            for batch in batches:
                rows, x = usable(batch.column("embedding"), dims)
                if not len(rows):
                    continue
                own = batch.column("vec_id").to_numpy()[rows]
                _, first, same = np.unique(x, axis=0, return_index=True, return_inverse=True)
                order = np.lexsort((own, same.ravel()))
                same_sorted = same.ravel()[order]
                place = np.arange(len(order)) - np.searchsorted(same_sorted, same_sorted)
                members, group = order[place <= k], same_sorted[place <= k]
                begin = np.searchsorted(group, np.arange(len(first) + 1))
                codes, norms = aq.encode(unit(x[first]))
                for a in range(0, len(ids), 128):
                    part = tables[:, :, a : a + 128]
                    approx = -norms[:, None] / 2
                    for m in range(aq.books):
                        approx = approx + part[m][codes[:, m]]
                    top = min(max(depth, int(share * len(first))), len(first))
                    near = np.argpartition(-approx, top - 1, axis=0)[:top]
                    query = np.repeat(np.arange(near.shape[1]) + a, top)
                    vector = near.T.ravel()
                    n = begin[vector + 1] - begin[vector]
                    member = members[np.repeat(begin[vector], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                    score, query = np.repeat(cosine(x[first[vector]], q[query]), n), np.repeat(query, n)
                    other = own[member] != ids[query]
                    best.add(query[other], own[member][other], score[other])
            good = np.isfinite(best.score)
            query = np.repeat(np.arange(len(ids)), k).reshape(best.score.shape)[good]
            yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(query), pa.array(best.id[good]), pa.array(best.score[good])], names=["query_id", "row", "vec_id", "score"])

        part = rows.mapInArrow(run, "query_id long, row long, vec_id long, score double").withColumn("row", F.col("row") + b * (1 << 32))
        found = part if found is None else found.unionAll(part)
    if found is None:
        return spark.createDataFrame([], schema)
    window = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
