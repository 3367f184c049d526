"""Byte-level BPE by monoid tree reduction: encoding joins halves, decoding concatenates up the tree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.bpe_core import Vocabulary
from cairn.llm.common import Bounded, raw_bytes, table, text_slices

RANKS = "byte_bpe_50k.tiktoken"


class TreeBpe:
    """Encoder whose partial results are joined pairwise.

    Two monoids are stacked. Texts are halved to leaves of ``leaf`` characters;
    a leaf's value is its list of pattern matches, and neighbours are joined by
    matching a window around the border again. Each match is a piece of bytes,
    halved down to ``short`` bytes, whose value is its tokens; neighbours are
    joined by merging a window of tokens around the border again. Both windows
    grow until what lies outside can't change any more.
    """

    def __init__(self, ranks_path: str, pattern: str = public_tokenizers.PATTERN, leaf: int = 2048, short: int = 16, memo: int = 200_000):
        self.vocabulary, self.leaf, self.short = Vocabulary.from_ranks(ranks_path), leaf, short
        self.find = regex.compile(pattern).findall
        self.pieces = Bounded(self._piece, memo)

    def _piece(self, piece: str) -> tuple[tuple[int, ...], str]:
        """Ids of one match, and the same as text."""
        ids = tuple(self.vocabulary.ids[t] for t in self.encode_piece(piece.encode()))
        return ids, " ".join(map(str, ids))

    def encode_piece(self, piece: bytes) -> list[bytes]:
        """Tokens of one match."""
        if piece in self.vocabulary.ids:
            return [piece]
        if len(piece) <= self.short:
            return self.vocabulary.merge(piece)
        half = len(piece) // 2
        return self.join_tokens(self.encode_piece(piece[:half]), self.encode_piece(piece[half:]))

    def join_tokens(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """Tokens outside the window stay if the window's outer tokens stay apart from them (``Vocabulary.apart``)."""
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.vocabulary.merge(b"".join(left[len(left) - i :] + right[:j]))
            calm_left = i == len(left) or self.vocabulary.apart(left[-i - 1], window[0])
            calm_right = j == len(right) or self.vocabulary.apart(window[-1], right[j])
            if calm_left and calm_right:
                return left[: len(left) - i] + window + right[j:]
            i, j = i * (1 if calm_left else 2), j * (1 if calm_right else 2)

    def matches(self, text: str) -> list[str]:
        """The pattern's matches over the whole text."""
        if len(text) <= self.leaf:
            return self.find(text)
        half = len(text) // 2
        return self.join_matches(self.matches(text[:half]), self.matches(text[half:]))

    def join_matches(self, left: list[str], right: list[str]) -> list[str]:
        """Join the matches of two neighbouring texts.

        A match depends on the text from its start to two characters beyond its
        end (the pattern looks one ahead, and three from an apostrophe). So
        matches that end two characters before the border stay; and from the
        first place where the window's matches and the right ones both begin,
        all further ones are the same.
        """
        if not left or not right:
            return left + right
        i = j = 4
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            head, tail = left[len(left) - i :], right[:j]
            here = sum(map(len, head))
            if i < len(left) and here < 2:
                i *= 2
                continue
            window = self.find("".join(head + tail))
            size = here + sum(map(len, tail))
            if j == len(right):
                return left[: len(left) - i] + window
            borders, at = {}, here
            for k, m in enumerate(tail):
                borders[at] = k
                at += len(m)
            at = 0
            for k, m in enumerate(window):
                if at in borders and at <= size - 2:
                    return left[: len(left) - i] + window[:k] + right[borders[at] :]
                at += len(m)
            j *= 2

    def encoded(self, text: str) -> tuple[list[int], str]:
        """Ids, and the same as text, joined by single spaces."""
        found = list(map(self.pieces.__getitem__, self.matches(text)))
        return list(chain.from_iterable([ids for ids, _ in found])), " ".join([shown for _, shown in found])

    def encode(self, text: str) -> list[int]:
        return self.encoded(text)[0]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.vocabulary.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=2)
def encoder(path: str) -> TreeBpe:
    """One for each worker; its vocabulary is loaded once."""
    return TreeBpe(path)


def encode_texts(docs: DataFrame, ranks: str | None = None, ids: bool = False) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` (and ``ids``, if asked for) of each row.

    Whole texts, whatever their length. Defined results: a null text is empty,
    an empty one has no tokens (both digests are those of no bytes); a null
    doc_id and repeated rows stay; an empty table gives no rows; other columns
    are not read. Partial results of a text live on one worker and are linear
    in it. ``ranks`` names a rank file at the same place on every machine.
    """
    path = ranks or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for part in text_slices(batches):
            n, digests, decoded, kept = [], [], [], []
            for raw in raw_bytes(part.column("text")):
                got, shown = bpe.encoded(raw.decode())
                n.append(len(got))
                digests.append(hashlib.sha256(shown.encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(got)).hexdigest())
                if ids:
                    kept.append(got)
            columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))
