"""LM scoring: a causal self-attention model over subword ids, trained in numpy, beside a unigram base."""

from __future__ import annotations

import base64
import copy
import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import crc_of_id, discard, materialise, table, text_slices

RANKS = "byte_bpe_50k.tiktoken"
#: Words whose counts are broadcast for the base, at most; all other words are joined.
FREQUENT = 100_000
#: Bytes of text whose words are counted and encoded together, and bytes of ids that are learnt from or scored together.
SLICE, IDS_SLICE = 8_000_000, 400_000
#: Classes that the model predicts (the last is the end of a text) in groups of MEMBERS, and how many classes are single ids.
CLASSES, SINGLE, MEMBERS = 512, 383, 32
GROUPS = CLASSES // MEMBERS
END_CLASS = CLASSES - 1
#: Vectors of input ids: the most frequent ids have their own, all others of a class share one.
VECTORS = 4096
#: Tokens in a window, and how many of them are only context.
WINDOW, CONTEXT = 64, 16
STRIDE = WINDOW - CONTEXT
#: Tokens in a block of attention; a window's first block is its context.
BLOCK = CONTEXT
WIDTH = 16


@lru_cache(maxsize=2)
def subwords(path: str):
    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def training(docs: DataFrame) -> DataFrame:
    """Rows whose crc32 of the id mod 7 isn't 2; a null id is learnt from."""
    return docs.where(F.coalesce(crc_of_id() % 7 != 2, F.lit(True)))


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of some texts (A-Z lower-cased, between ASCII white space), the number of each occurrence's word and of its text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    owner, coded = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy()), lists.flatten().dictionary_encode()
    words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    if "" in words:  # beside white space at the ends of a text
        none = words.index("")
        owner, at = owner[at != none], at[at != none]
        del words[none]
        at = at - (at > none)
    return words, at, owner


def word_counts(docs: DataFrame, most: int = 400_000) -> DataFrame:
    """``word`` and ``n`` over whole texts; the end of a text is the empty word. Counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for part in text_slices(batches, SLICE):
            words, at, _ = words_of(part.column("text"))
            for w, n in zip(words, np.bincount(at, minlength=len(words)).tolist(), strict=True):
                held[w] += n
            held[""] += part.num_rows
            if len(held) > most:
                yield out()
                held.clear()
        yield out()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encoded(path: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of all words, each as after a blank, and how many each word has.

    A match of the pattern goes beyond a blank only from other white space, so
    words without any are encoded together; a word begins where an id's bytes
    begin with the blank.
    """
    encoding, text = subwords(path)[0], " ".join(words)
    if text.split() != words:
        plain = [w.split() == [w] for w in words]
        words, other = [w if p else "x" for w, p in zip(words, plain, strict=True)], {i: encoding.encode_ordinary(" " + words[i]) for i, p in enumerate(plain) if not p}
        flat, sizes = encoded(path, words)
        parts = np.split(flat, np.cumsum(sizes)[:-1])
        parts = [other.get(i, x) for i, x in enumerate(parts)]
        return np.concatenate(parts).astype(np.int64), np.array([len(x) for x in parts])
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    flat = encoding.encode_to_numpy(" " + text).astype(np.int64)
    return flat, np.diff(np.append(np.flatnonzero(starting_words(path)[flat]), len(flat)))


class TextIds:
    """Packed 16-bit subword ids of texts: those of each word (A-Z lower-cased) as after a blank."""

    def __init__(self, path: str):
        self.path = path

    def packed(self, words: list[str], at: np.ndarray, owner: np.ndarray, texts: int) -> pa.Array:
        """The ids of each text, from the distinct words and the occurrences that ``words_of`` gives; each word is encoded once."""
        flat, sizes = encoded(self.path, words)
        n = sizes[at]
        last = np.cumsum(n)
        place = np.repeat((np.cumsum(sizes) - sizes)[at] - (last - n), n)
        place += np.arange(len(place))
        offsets = np.zeros(texts + 1, np.int64)
        np.cumsum(2 * np.bincount(owner, n, texts).astype(np.int64), out=offsets[1:])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), texts, [None, pa.py_buffer(offsets), pa.py_buffer(flat.astype(np.uint16)[place])])

    def streams(self, texts: list[bytes]) -> list[np.ndarray]:
        raw = self.packed(*words_of(pa.array([t.decode() for t in texts], pa.large_string())), len(texts))
        return [np.frombuffer(x, np.uint16) for x in raw.to_pylist()]


class WrittenIds:
    """Packed ids that stand for their texts."""

    def streams(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.frombuffer(x, np.uint16) for x in texts]


def token_ids(path: str) -> TextIds:
    return TextIds(path)


class Vocabulary:
    """How subword ids are grouped, from their counts ``n`` (all of them plus one for the end).

    Frequent ids are classes of their own; the others are binned by rank to
    equal weight, those that begin a word apart. ``share`` is the natural log of
    an id's part of its class: the counts plus one, so shares of a class add up
    to one. ``vector`` is the id's row of the input table.
    """

    def __init__(self, n: np.ndarray, begins: np.ndarray):
        self.size, bins = len(n), (CLASSES - 1 - SINGLE) // 2
        order = np.lexsort((np.arange(len(n)), -n))
        self.of = np.empty(len(n) + 1, np.int64)
        self.of[order[:SINGLE]] = np.arange(min(SINGLE, len(order)))
        for half, kind in enumerate((True, False)):
            rest = order[SINGLE:][begins[order[SINGLE:]] == kind]
            if len(rest):
                weight = np.cumsum(n[rest] + 1.0)
                self.of[rest] = SINGLE + bins * half + np.minimum(bins - 1, (weight * bins / weight[-1]).astype(np.int64))
        self.of[-1] = END_CLASS
        counted = np.append(n, 0) + 1.0
        self.share = np.log(counted / np.bincount(self.of, counted, CLASSES)[self.of])
        own = VECTORS - CLASSES
        self.vector = own + self.of
        self.vector[order[:own]] = np.arange(min(own, len(order)))

    @property
    def end(self) -> int:
        return self.size


def counted_ids(path: str, rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the words, how many each has, and the words' counts; the end, the empty word, has no ids."""
    rows = rows.filter(pc.not_equal(rows.column("word"), ""))
    return *encoded(path, rows.column("word").to_pylist()), rows.column("n").to_numpy()


def subword_counts(words: DataFrame, path: str) -> np.ndarray:
    """Occurrences of each subword id, from the words' counts; ids are bounded by the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(subwords(path)[1], np.int64)
        for b in batches:
            flat, sizes, n = counted_ids(path, b)
            np.add.at(total, flat, np.repeat(n, sizes))
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    got = words.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(subwords(path)[1], np.int64)
    out[got.column("id").to_numpy()] = got.column("n").to_numpy()
    return out


@lru_cache(maxsize=2)
def starting_words(path: str) -> np.ndarray:
    """Which subword ids begin a word: those whose bytes begin with a space."""
    encoding, size = subwords(path)
    return np.array([encoding.decode_single_token_bytes(i)[:1] == b" " for i in range(size)])


def class_pairs(words: DataFrame, path: str, vocabulary: Vocabulary, texts: int) -> np.ndarray:
    """Log share of each class after each other one, counted inside all training words; after a word comes any first class, by its share, or the end, once a text."""
    cells = CLASSES * CLASSES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells + 2 * CLASSES)
        for b in batches:
            flat, size, n = counted_ids(path, b)
            if not len(n):
                continue
            flat, last = vocabulary.of[flat], np.cumsum(size) - 1
            inner = np.delete(np.arange(len(flat)), last)
            total[:cells] += np.bincount(flat[inner] * CLASSES + flat[inner + 1], np.repeat(n, size)[inner], cells)
            total[cells : cells + CLASSES] += np.bincount(flat[last - size + 1], n, CLASSES)
            total[cells + CLASSES :] += np.bincount(flat[last], n, CLASSES)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], names=["id", "n"])

    got = words.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(cells + 2 * CLASSES)
    total[got.column("id").to_numpy()] = got.column("n").to_numpy()
    pairs, first, last = total[:cells].reshape(CLASSES, CLASSES), total[cells : cells + CLASSES], total[cells + CLASSES :]
    first[END_CLASS] = texts
    last[END_CLASS] = texts  # a text begins as if after an end
    first = first + 1e-3
    pairs = pairs + last[:, None] * (first / first.sum())
    any_ = pairs.sum(0) + 1e-3
    pairs = pairs + any_ / any_.sum()
    return np.log(pairs / pairs.sum(1, keepdims=True))


def both_blocks(e: np.ndarray) -> np.ndarray:
    """For each block after the first the vectors of the block before and its own, as a view."""
    b, n, d = e.shape
    x, y, z = e.strides
    return np.lib.stride_tricks.as_strided(e, (b, n // BLOCK - 1, 2 * BLOCK, d), (x, y * BLOCK, y, z), writeable=False)


def settle(logits: np.ndarray) -> None:
    """Take each row's largest logit from the row if any is too large or too small for ``exp`` in single precision."""
    if not (logits.size and logits.max() < 60 and logits.min() > -80):
        logits -= logits.max(-1, keepdims=True, initial=-np.inf)


def row_sums(rows: np.ndarray) -> np.ndarray:
    return rows @ np.ones(rows.shape[1], rows.dtype)


class Attention:
    """Causal self-attention and a feed-forward layer, both with residuals, over vectors of subword ids.

    A token sees its own block of BLOCK tokens up to itself and the whole block
    before; weights depend on what the tokens are and on their places in the two
    blocks. With one head as wide as the vectors, the projections of queries and
    keys are one matrix (``Q``), those of values and outputs another (``V``). It predicts the group of the next id's class, then the class in its
    group; the id follows from its class by its share. Logits begin with the
    counted pairs of classes (``pairs``: log share of each class after each
    other one), which stay as they are counted; all else is learnt.
    """

    def __init__(self, pairs: np.ndarray, seed: int = 3):
        random = np.random.default_rng(seed)
        d, draw = WIDTH, lambda *s: (random.standard_normal(s) / math.sqrt(d)).astype(np.float32)
        self.p = {
            "E": (random.standard_normal((VECTORS, d)) * 0.5).astype(np.float32), "P": np.zeros((BLOCK, 2 * BLOCK), np.float32),
            "Q": draw(d, d) / math.sqrt(d), "V": draw(d, d) * 0.5, "A": draw(d, 2 * d), "a": np.zeros(2 * d, np.float32), "B": draw(2 * d, d) * 0.5,
            "U": draw(d, GROUPS) * 0.1, "M": draw(GROUPS, d, MEMBERS) * 0.1,
        }
        each = pairs.reshape(CLASSES, GROUPS, MEMBERS)
        top = each.max(-1)
        self.group = (top + np.log(np.exp(each - top[:, :, None]).sum(-1))).astype(np.float32)
        self.member = (each - self.group[:, :, None]).astype(np.float32).reshape(CLASSES * GROUPS, MEMBERS)
        self.seen = np.where(np.arange(2 * BLOCK) <= BLOCK + np.arange(BLOCK)[:, None], 0, -1e9).astype(np.float32)

    def forward(self, x: np.ndarray) -> tuple:
        """Activations of the places after the context; the weights ``s`` of attention don't add up to one but to ``total``."""
        p, b = self.p, len(x)
        e = p["E"].take(x, 0)
        tail = np.ascontiguousarray(e[:, CONTEXT:]).reshape(-1, WIDTH)
        q = (tail @ p["Q"]).reshape(b, -1, BLOCK, WIDTH)
        k = both_blocks(e)
        s = np.matmul(q, k.swapaxes(2, 3))
        settle(s)
        s += p["P"] + self.seen
        np.exp(s, out=s)
        total = row_sums(s.reshape(-1, 2 * BLOCK))
        m = np.matmul(s, k).reshape(-1, WIDTH)
        m /= total[:, None]
        h = m @ p["V"]
        h += tail
        r = h @ p["A"]
        r += p["a"]
        np.maximum(r, 0, out=r)
        g = r @ p["B"]
        g += h
        return tail, q, k, s, total, m, h, r, g

    def heads(self, g: np.ndarray, c: np.ndarray, y: np.ndarray) -> tuple:
        """Logits of all groups and of the members of each target's group, and the target's places among both; all in order of the targets' groups."""
        of = y // MEMBERS
        order = np.argsort(of.astype(np.uint8), kind="stable")
        bounds = np.append(0, np.cumsum(np.bincount(of, minlength=GROUPS)))
        g, c, of, inner = (a.take(order, 0) for a in (g, c, of, y % MEMBERS))
        z, w = g @ self.p["U"], self.member.take(c * GROUPS + of, 0)
        z += self.group.take(c, 0)
        for k in range(GROUPS):
            a, b = bounds[k], bounds[k + 1]
            if b > a:
                w[a:b] += g[a:b] @ self.p["M"][k]
        settle(z)
        settle(w)
        n = np.arange(len(y))
        return g, z, w, n * GROUPS + of, n * MEMBERS + inner, order, bounds

    def log_probabilities(self, x: np.ndarray, c: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log of each target class's probability; ``x`` are input vectors, ``c`` the classes before the targets ``y`` (both flat)."""
        _, z, w, at, inner, order, _ = self.heads(self.forward(x)[-1], c, y)
        log = z.ravel().take(at).astype(np.float64)
        log += w.ravel().take(inner)
        np.exp(z, out=z)
        np.exp(w, out=w)
        log -= np.log(row_sums(z).astype(np.float64) * row_sums(w))
        out = np.empty(len(y))
        out[order] = log
        return out

    def gradients(self, x: np.ndarray, c: np.ndarray, y: np.ndarray, live: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean loss over the targets that are ``live``."""
        p, (tail, q, k, s, total, m, h, r, g) = self.p, self.forward(x)
        g, z, w, at, inner, order, bounds = self.heads(g, c, y)
        b, weight = len(x), live.take(order) / max(1.0, float(live.sum()))
        np.exp(z, out=z)
        z *= (weight / row_sums(z))[:, None]
        z.ravel()[at] -= weight
        np.exp(w, out=w)
        w *= (weight / row_sums(w))[:, None]
        w.ravel()[inner] -= weight
        d = {"U": g.T @ z, "M": np.zeros_like(p["M"])}
        back = z @ p["U"].T
        for i in range(GROUPS):
            a, t = bounds[i], bounds[i + 1]
            if t > a:
                d["M"][i] = g[a:t].T @ w[a:t]
                back[a:t] += w[a:t] @ p["M"][i].T
        dg = np.empty_like(back)
        dg[order] = back
        d["B"] = r.T @ dg
        dr = dg @ p["B"].T
        dr *= r > 0
        d["A"], d["a"] = h.T @ dr, np.ones(len(dr), dr.dtype) @ dr
        dh = dr @ p["A"].T
        dh += dg
        d["V"] = m.T @ dh
        dm = dh @ p["V"].T
        dm /= total[:, None]
        less = row_sums(dm * m)
        dm = dm.reshape(q.shape)
        ds = np.matmul(dm, k.swapaxes(2, 3))
        ds -= less.reshape(*q.shape[:3], 1)
        ds *= s
        d["P"] = (np.ones(len(y) // BLOCK, ds.dtype) @ ds.reshape(-1, 2 * BLOCK * BLOCK)).reshape(BLOCK, 2 * BLOCK)
        dq, dk = np.matmul(ds, k).reshape(-1, WIDTH), np.matmul(s.swapaxes(2, 3), dm)
        dk += np.matmul(ds.swapaxes(2, 3), q)
        d["Q"] = tail.T @ dq
        dh += dq @ p["Q"].T
        de = np.empty((b, WINDOW // BLOCK, BLOCK, WIDTH), dh.dtype)
        np.add(dk[:, :, BLOCK:], dh.reshape(q.shape), out=de[:, 1:])
        de[:, 0] = 0
        de[:, :-1] += dk[:, :, :BLOCK]
        d["E"] = summed(x.ravel(), de.reshape(-1, WIDTH), VECTORS)
        return d

    def pack(self) -> bytes:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)]).astype(np.float32).tobytes()

    def unpack(self, raw: bytes) -> Attention:
        flat, at, old = np.frombuffer(raw, np.float32), 0, self.p
        self.p = {}
        for k in sorted(old):
            self.p[k] = flat[at : at + old[k].size].reshape(old[k].shape).copy()
            at += old[k].size
        return self


def summed(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sum of the rows of each number."""
    width = rows.shape[1]
    return np.bincount((at[:, None] * width + np.arange(width)).ravel(), rows.ravel(), size * width).reshape(size, width).astype(rows.dtype)


class Adam:
    """Steps of bounded size along smoothed gradients, one for each parameter."""

    def __init__(self, model: Attention, rate: float):
        self.model, self.rate, self.t = model, rate, 0
        self.m, self.v, self.spare = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(3))

    def step(self, d: dict[str, np.ndarray]) -> None:
        self.t += 1
        rate = self.rate * math.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        for k, g in d.items():
            m, v, x = self.m[k], self.v[k], self.spare[k]
            np.subtract(g, m, out=x)
            x *= 0.1
            m += x
            np.multiply(g, g, out=x)
            x -= v
            x *= 0.01
            v += x
            np.sqrt(v, out=x)
            x += 1e-8
            np.divide(m, x, out=x)
            x *= rate
            self.model.p[k] -= x


class Windows:
    """The ids of some texts, in windows that overlap by the context: each id, and each text's end, is the target of one window.

    A text follows a context of ends. ``live`` marks the targets that are a
    text's; ``length`` has the number of ids of each text, with its end.
    """

    def __init__(self, texts: list[bytes], ids: TextIds | WrittenIds, end: int):
        streams = ids.streams(texts)
        self.length = np.array([len(s) + 1 for s in streams], np.int64)
        windows = -(-self.length // STRIDE)
        room = CONTEXT + 1 + windows * STRIDE
        begin = np.cumsum(room) - room
        self.flat = np.full(int(room.sum()), end, np.int64)
        place = np.repeat(begin + CONTEXT + 1 - (np.cumsum(self.length - 1) - (self.length - 1)), self.length - 1) + np.arange(int((self.length - 1).sum()))
        self.flat[place] = np.concatenate([np.empty(0, np.uint16), *streams])
        self.owner = np.repeat(np.arange(len(streams)), windows)
        self.number = np.arange(len(self.owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        self.start = begin[self.owner] + self.number * STRIDE

    def batch(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the windows with one more, and which targets are live."""
        ids = np.lib.stride_tricks.sliding_window_view(self.flat, WINDOW + 1)[self.start[some]]
        return ids, self.number[some][:, None] * STRIDE + np.arange(STRIDE) < self.length[self.owner[some]][:, None]


def train(ids: DataFrame, vocabulary: Vocabulary, model: Attention, rounds: int = 2, batch: int = 128, rate: float = 1.2e-2) -> Attention:
    """Local training on all partitions, then the weighted mean of their weights; ``rounds`` times, each on its part of the texts.

    All windows of all texts are learnt from, each once, where it is: a text
    belongs to one round by its hash. What goes to the driver is one set of
    weights a round.
    """
    spark = ids.sparkSession
    for r in range(rounds):
        sent = spark.sparkContext.broadcast((model, vocabulary))

        def learn(batches: Iterator[pa.RecordBatch], sent=sent, rate=rate / (1 + r)) -> Iterator[pa.RecordBatch]:
            model, voc = sent.value
            model, seen = copy.copy(model).unpack(model.pack()), 0
            adam, random = Adam(model, rate), np.random.default_rng(5)
            for part in text_slices(batches, IDS_SLICE, "ids"):
                w = Windows(part.column("ids").to_pylist(), WrittenIds(), voc.end)
                order = random.permutation(len(w.start))
                for a in range(0, len(order), batch):
                    i, live = w.batch(order[a : a + batch])
                    c = voc.of.take(i[:, CONTEXT:])
                    adam.step(model.gradients(voc.vector.take(i[:, :-1]), c[:, :-1].ravel(), c[:, 1:].ravel(), live.ravel().astype(np.float32)))
                    seen += int(live.sum())
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([model.pack()], pa.binary()), pa.array([seen], pa.int64())], names=["weights", "n"])

        def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = 0.0, 0
            for b in batches:
                for w, k in zip(b.column("weights").to_pylist(), b.column("n").to_pylist(), strict=True):
                    total, n = total + np.frombuffer(w, np.float32).astype(np.float64) * k, n + k
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([(total / n).astype(np.float32).tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["weights", "n"])

        kind = "weights binary, n long"
        own = ids.where(F.pmod("hash", F.lit(rounds)) == r).select("ids")
        got = own.mapInArrow(learn, kind).repartition(8).mapInArrow(mean, kind).repartition(1).mapInArrow(mean, kind).collect()
        if got:
            model.unpack(bytes(got[0].weights))
    return model


def text_scores(model: Attention, vocabulary: Vocabulary, texts: list[bytes], ids: TextIds | WrittenIds, batch: int = 64) -> np.ndarray:
    """log10 of the model's probability of each text's ids and its end."""
    w = Windows(texts, ids, vocabulary.end)
    out = np.zeros(len(texts))
    for a in range(0, len(w.start), batch):
        some = np.arange(a, min(a + batch, len(w.start)))
        i, live = w.batch(some)
        c = vocabulary.of.take(i[:, CONTEXT:])
        log = model.log_probabilities(vocabulary.vector.take(i[:, :-1]), c[:, :-1].ravel(), c[:, 1:].ravel()).reshape(live.shape) + vocabulary.share.take(i[:, CONTEXT + 1 :])
        log *= live
        out += np.bincount(w.owner[some], log.sum(1), len(texts))
    return out / math.log(10)


def fitted(ids: DataFrame, counts: DataFrame, path: str, texts: int) -> tuple[Vocabulary, Attention]:
    """The vocabulary and the model of training texts (``ids``, ``hash``), whose words are counted already."""
    vocabulary = Vocabulary(subword_counts(counts, path), starting_words(path))
    return vocabulary, train(ids, vocabulary, Attention(class_pairs(counts, path, vocabulary, texts)))


def encoded_texts(docs: DataFrame, path: str, base: dict[str, float], end: float) -> DataFrame:
    """Of each row ``doc_id``, ``held_out``, a ``hash`` of id and text, the packed ``ids`` and its number of words and the end, ``n_tokens``.

    ``known`` and ``base`` count the words that ``base`` has, and the end with
    ``end``; ``rare`` has all others and how often each occurs.
    """
    sent = docs.sparkSession.sparkContext.broadcast(base)
    docs = docs.select("doc_id", F.coalesce(crc_of_id() % 7 == 2, F.lit(False)).alias("held_out"), F.xxhash64("doc_id", "text").alias("hash"), "text")
    pair = pa.struct([("word", pa.string()), ("times", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, ids = sent.value, token_ids(path)
        for part in text_slices(batches, SLICE):
            n, (words, at, owner) = part.num_rows, words_of(part.column("text"))
            value = np.array([base.get(w, math.nan) for w in words], np.float64)[at]
            rare, size = np.isnan(value), np.bincount(owner, minlength=n) + 1
            key, times = np.unique(owner[rare] * max(1, len(words)) + at[rare], return_counts=True)
            of, word = np.divmod(key, max(1, len(words)))
            listed = pa.StructArray.from_arrays([pa.array(words, pa.string()).take(pa.array(word)), pa.array(times, pa.int64())], fields=list(pair))
            offsets = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
            known = size - np.bincount(owner[rare], minlength=n)
            bases = np.bincount(owner, np.where(rare, 0.0, value), n) + end
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("doc_id", "held_out", "hash")), ids.packed(words, at, owner, n).cast(pa.binary()), pa.array(size, pa.int64()), pa.array(known, pa.int64()), pa.array(bases), pa.ListArray.from_arrays(offsets, listed)],
                names=["doc_id", "held_out", "hash", "ids", "n_tokens", "known", "base", "rare"],
            )

    return docs.mapInArrow(run, "doc_id long, held_out boolean, hash long, ids binary, n_tokens long, known long, base double, rare array<struct<word:string,times:bigint>>")


def score_texts(docs: DataFrame, ranks: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of each row.

    Words are what ASCII white space separates, A-Z lower-cased, then one end.
    The base counts all training words; the counts of at most ``frequent`` words
    are broadcast, those of all others joined. The model reads and predicts
    subword ids: attention over the blocks of a window gives the class of the next id, the
    id's share of its class the id. ``score`` is the log10 of the probability of
    all ids of the text and its end; given what comes before, the probabilities
    of all ids and the end add up to one. Every training text is counted and
    learnt from, whole. Windows overlap by 16 tokens of context and score each
    token once; products are in single precision, so scores of equal texts may
    differ after seven digits. Defined results: a null text is empty and has one token, the
    end; a null doc_id is learnt from and isn't held out; repeated rows stay and
    count; an empty table gives no rows; other columns are not read.
    """
    spark, path = docs.sparkSession, ranks or public_tokenizers.path(RANKS)
    docs = texts_of(docs)
    counts, counts_path = materialise(word_counts(training(docs)), "word-counts")
    total, distinct, ends = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("word") == "", F.col("n"))), F.lit(0))).first()
    denominator = total + distinct + 1
    bins = counts.groupBy(F.floor(F.log2("n") * 8).alias("bin")).count().orderBy(F.desc("bin")).collect()  # at most 8 for each doubling
    least, many = math.inf, 0
    for b in bins:
        many += b["count"]
        if many > frequent:
            break
        least = b.bin
    base = {r.word: math.log10((r.n + 1) / denominator) for r in counts.where(F.floor(F.log2("n") * 8) >= least).toLocalIterator()} if least < math.inf else {}
    base.pop("", None)
    texts, texts_path = materialise(encoded_texts(docs, path, base, math.log10((ends + 1) / denominator)), "encoded")
    vocabulary, model = fitted(texts.where("not held_out"), counts, path, ends)
    sent = spark.sparkContext.broadcast((model, vocabulary))
    passed = ["doc_id", "held_out", "n_tokens", "known", "base", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, vocabulary = sent.value
        for part in text_slices(batches, IDS_SLICE, "ids"):
            score = text_scores(model, vocabulary, part.column("ids").to_pylist(), WrittenIds())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in passed), pa.array(score)], names=[*passed, "score"])

    schema = "doc_id long, held_out boolean, n_tokens long, known long, base double, rare array<struct<word:string,times:bigint>>, score double"
    scored, scored_path = materialise(texts.select(*passed, "ids").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.inline("rare").alias("word", "times"))
    c = F.coalesce("n", F.lit(0))
    rest = rare.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10((c + 1) / F.lit(float(denominator)))).alias("more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"))
    out = scored.join(rest, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("known") - (0 if ends else 1) + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")
    out, _ = materialise(out, "lm-scores")
    discard(spark, counts_path, texts_path, scored_path)
    return out


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
