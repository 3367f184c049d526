"""Token counts by finite-state transducers.

Two machines are stacked. The first splits text: a complete deterministic
transducer over character classes. Chunks of the text get state maps (from any
entry state to the exit state), a parallel prefix scan composes the maps, and
with each chunk's entry state known all chunks run side by side. The second
counts: a deterministic transducer over bytes, whose transitions say by how many
tokens the count of the piece so far changes. It is determinised as far as the
texts reach, kept as dense tables, and all pieces of a batch step through it
together.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.bpe_core import Vocabulary
from cairn.llm.common import raw_bytes, table, text_slices

FILE = "byte_bpe_50k.json"

# Character classes: space, other white space, letter, number, other, apostrophe,
# the letters that contractions use, and the end of a text.
SPACE, WHITE, LETTER, NUMBER, OTHER, APOSTROPHE = range(6)
SHORT = dict(zip("stmd", [6] * 4, strict=True)) | {"r": 7, "v": 8, "e": 9, "l": 10}
END = 11
# States: start of a piece; one space; one other white space; two or more, ending
# in a space or in another; letters; numbers; others; apostrophe; apostrophe and
# r, v, l; contraction complete.
START, ONE_S, ONE_W, RUN_S, RUN_W, LETTERS, NUMBERS, OTHERS, APOS, APOS_R, APOS_V, APOS_L, DONE = range(13)
HERE, BEFORE = 1, 2  # a piece begins at this character; at the one before


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output by (class, state), for: 's 't 're 've 'm 'll 'd, runs of letters, numbers or others after an optional space, white space."""

    def fresh(c: int) -> int:
        return {SPACE: ONE_S, WHITE: ONE_W, NUMBER: NUMBERS, OTHER: OTHERS, APOSTROPHE: APOS, END: START}.get(c, LETTERS)

    def step(c: int, s: int) -> tuple[int, int]:
        white, letter = c in (SPACE, WHITE), c == LETTER or 6 <= c <= 10
        if c == END:
            return START, HERE | (BEFORE if s in (APOS_R, APOS_V, APOS_L) else 0)
        if s in (ONE_S, ONE_W, RUN_S, RUN_W):
            if white:
                return (RUN_S if c == SPACE else RUN_W), 0
            out = BEFORE if s in (RUN_S, RUN_W) else 0  # the last white space leaves the run
            if s in (ONE_W, RUN_W):
                return fresh(c), out | HERE
            return (OTHERS if c == APOSTROPHE else fresh(c)), out
        if s == LETTERS and letter or s == NUMBERS and c == NUMBER or s == OTHERS and c in (OTHER, APOSTROPHE):
            return s, 0
        if s == APOS:
            if c == 6:
                return DONE, 0
            if c in (7, 8, 10):
                return {7: APOS_R, 8: APOS_V, 10: APOS_L}[c], 0
            if c in (OTHER, APOSTROPHE):
                return OTHERS, 0
            return fresh(c), HERE
        if s in (APOS_R, APOS_V, APOS_L):
            if c == (10 if s == APOS_L else 9):
                return DONE, 0
            if letter:
                return LETTERS, BEFORE
            return fresh(c), BEFORE | HERE
        return fresh(c), HERE

    table_ = [[step(c, s) for s in range(13)] for c in range(12)]
    return np.array([[x[0] for x in row] for row in table_], np.uint8), np.array([[x[1] for x in row] for row in table_], np.uint8)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point."""
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    of = np.full(0x110000, OTHER, np.uint8)
    for pattern, c in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE)):
        for m in regex.finditer(pattern, text):
            of[points[m.start() : m.end()]] = c
    of[ord(" ")], of[ord("'")] = SPACE, APOSTROPHE
    for x, c in SHORT.items():
        of[ord(x)] = c
    return of


def borders(kinds: np.ndarray, chunk: int = 128) -> np.ndarray:
    """Whether a piece begins at each character of a stream of classes."""
    step, emit = splitter()
    states = step.shape[1]
    n, k = len(kinds), max(1, -(-len(kinds) // chunk))
    padded = np.full(k * chunk, END, np.uint8)
    padded[:n] = kinds
    columns = np.ascontiguousarray(padded.reshape(k, chunk).T).astype(np.int64) * states
    flat, out = step.ravel(), emit.ravel()
    maps = np.tile(np.arange(states, dtype=np.uint8), (k, 1))
    for row in columns:
        maps = flat[row[:, None] + maps]
    reach = 1
    while reach < k:  # prefix scan: maps[i] becomes the map of chunks 0 to i
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.int64), axis=1)
        reach *= 2
    state = np.concatenate([[START], maps[:-1, START]]).astype(np.int64)
    marks = np.empty((chunk, k), np.uint8)
    for j, row in enumerate(columns):
        at = row + state
        marks[j] = out[at]
        state = flat[at].astype(np.int64)
    marks = marks.T.ravel()[:n]
    found = marks & HERE > 0
    found[:-1] |= marks[1:] & BEFORE > 0
    return found


class CountMachine:
    """Transducer from the bytes of a piece to its number of tokens, made state by state.

    After each byte, one token ends the merged prefix: the one that stays apart
    from the last token of the prefix before it. A state holds all that the rest
    of a piece can ask for: for each place where a token may have begun that is
    still growing, its node in the trie of tokens, the last token before that
    place, and the count there against the count now.
    """

    def __init__(self, vocabulary: Vocabulary, limit: int = 1 << 18):
        self.vocabulary, self.limit = vocabulary, limit
        self.child: dict[int, int] = {}
        self.token: list[bytes | None] = [None]
        self.grows: list[bool] = [False]
        for t in sorted(vocabulary.ids):
            node = 0
            for b in t:
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.grows[node] = True
                    self.token.append(None)
                    self.grows.append(False)
                node = self.child[key]
            self.token[node] = t
        self.column = np.full(256, -1, np.int64)
        self.clear()

    def clear(self) -> None:
        start = ((0, None, 0),)
        self.states, self.number = [start], {start: 0}
        self.same: dict[tuple, tuple] = {}  # equal entries of many states are one object
        self.next = np.full((1024, max(32, int(self.column.max()) + 1)), -1, np.int32)
        self.delta = np.zeros(self.next.shape, np.int8)

    def make(self, state: int, byte: int) -> None:
        entries, ended = [], None
        for node, last, behind in self.states[state]:
            to = self.child.get(node << 8 | byte)
            if to is None:
                continue
            t = self.token[to]
            if ended is None and t is not None and (last is None or self.vocabulary.apart(last, t)):
                ended = (t, behind + 1)
            if self.grows[to]:
                entries.append((to, last, behind))
        t, change = ended
        moved = [(node, last, behind - change) for node, last, behind in entries]
        key = tuple(self.same.setdefault(e, e) for e in [*moved, (0, t, 0)])
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            if to >= len(self.next):
                self.next = np.concatenate([self.next, np.full(self.next.shape, -1, np.int32)])
                self.delta = np.concatenate([self.delta, np.zeros(self.delta.shape, np.int8)])
        column = self.column[byte]
        self.next[state, column], self.delta[state, column] = to, change

    def counts(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of the pieces data[start : start + size], all at once."""
        if len(self.states) > self.limit:
            self.clear()
        fresh = [b for b in np.flatnonzero(np.bincount(data, minlength=256)).tolist() if self.column[b] < 0]
        for b in fresh:
            self.column[b] = self.column.max() + 1
        if self.column.max() >= self.next.shape[1]:
            wider = np.full((len(self.next), -(-(int(self.column.max()) + 1) // 16) * 16), -1, np.int32)
            wider[:, : self.next.shape[1]] = self.next
            more = np.zeros(wider.shape, np.int8)
            more[:, : self.next.shape[1]] = self.delta
            self.next, self.delta = wider, more
        order = np.argsort(-sizes, kind="stable")
        at, left = starts[order], sizes[order]
        alive = np.searchsorted(-left, -np.arange(int(left.max(initial=0))), side="left")
        total, state = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for j, n in enumerate(alive.tolist()):
            byte = data[at[:n] + j]
            column, s = self.column[byte], state[:n]
            to = self.next[s, column]
            if (to < 0).any():
                gaps = np.flatnonzero(to < 0)
                for key in np.unique(s[gaps] << 8 | byte[gaps]).tolist():
                    self.make(key >> 8, key & 255)
                to = self.next[s, column]
            total[:n] += self.delta[s, column]
            state[:n] = to
        result = np.empty(len(at), np.int64)
        result[order] = total
        return result


class Counter:
    def __init__(self, path: str):
        self.machine = CountMachine(Vocabulary.from_json(path))
        with open(path, encoding="utf-8") as f:
            self.specials = [x["content"] for x in json.load(f)["added_tokens"]]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None

    def count(self, texts: list[str]) -> np.ndarray:
        parts, owner = [], []
        special = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            cut = self.cut.split(text) if self.cut else [text]
            special[i] = len(cut) - 1
            parts += cut
            owner += [i] * len(cut)
        joined = "\n".join(parts) + "\n"  # the line feeds are ends, not text
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        ends = np.cumsum(np.array([len(p) + 1 for p in parts], np.int64)) - 1
        kinds = classes()[points]
        kinds[ends] = END
        begins = borders(kinds)
        begins[0] = True
        begins[ends] = True
        begins[ends[:-1] + 1] = True
        first = np.flatnonzero(begins)
        offset = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))])
        starts = offset[first]
        sizes = np.diff(np.concatenate([starts, offset[-1:]]))
        text = kinds[first] != END
        part = np.searchsorted(ends, first[text])
        n = self.machine.counts(np.frombuffer(joined.encode(), np.uint8), starts[text], sizes[text])
        return special + np.bincount(np.array(owner)[part], weights=n, minlength=len(texts)).astype(np.int64)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = 1024) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (n_tokens > limit) of each row.

    Whole texts, whatever their length. Defined results: a null text is empty
    and has no tokens; a null doc_id and repeated rows stay; an empty table
    gives no rows; other columns are not read. The machine's tables are bounded:
    they start anew when they hold too many states. ``tokenizer`` names a
    byte-level BPE file of the tokenizers library on every machine.
    """
    path = tokenizer or public_tokenizers.path(FILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for part in text_slices(batches):
            raw = raw_bytes(part.column("text"))
            n = count([x.decode() for x in raw])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
