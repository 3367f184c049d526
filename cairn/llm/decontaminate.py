"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import Bounded, materialise, raw_bytes, table, text_slices

EDGES = b".,;:!?|()[]{}<>\"'`*_-#"
#: For items of at least 13 tokens: five tokens next to each other, or five of six with one ignored inside. If at
#: most a fifth of an overlap's tokens are replaced, some six neighbours hold
#: one replaced token at most, so a mask hits. Shorter items have a run of their own
#: length, see ``short_run``.
MASKS = [(0, 1, 2, 3, 4), (0, 2, 3, 4, 5), (0, 1, 3, 4, 5), (0, 1, 2, 4, 5), (0, 1, 2, 3, 5)]
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
#: Text of the test items that one index holds; about 20 bytes of index for each.
BLOCK_BYTES = 2_000_000
#: Hits that are expanded at once.
HITS = 1_000_000

_tokens = Bounded(lambda w: xxhash.xxh64_intdigest(w.strip(EDGES)), 200_000)
_EMPTY = xxhash.xxh64_intdigest(b"")


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased words without punctuation at their edges (words of nothing else are left out), and each text's number of them."""
    lists = [t.lower().split() for t in texts]
    size = np.array([len(x) for x in lists], np.int64)
    h = np.fromiter(map(_tokens.__getitem__, (w for x in lists for w in x)), np.uint64, int(size.sum()))
    keep = h != np.uint64(_EMPTY)
    if not keep.all():
        owner = np.repeat(np.arange(len(texts)), size)
        size = np.bincount(owner[keep], minlength=len(texts))
    return h[keep], size


def masked(h: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """One hash for each place where the mask fits."""
    n = len(h) - mask[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, number, np.uint64)
    for k, o in enumerate(mask):
        total += h[o : o + n] * FACTORS[k]
    return total * FACTORS[0]


def short_run(tokens: int, similarity: float) -> int:
    """Tokens next to each other that stay equal somewhere in a short item, wherever the replaced ones are (pigeonhole); five at most."""
    replaced = int((1 - similarity) * tokens + 1e-9)
    return min(5, -(-(tokens - replaced) // (replaced + 1)))


class SeedIndex:
    """Masked hashes of one block of test items."""

    def __init__(self, ids: list[int | None], texts: list[bytes], overlap: int, similarity: float):
        self.ids, self.overlap, self.similarity, self.blocks = ids, overlap, similarity, 1
        h, size = token_hashes(texts)
        self.items = np.split(h, np.cumsum(size)[:-1]) if len(texts) else []
        code, item, place = [], [], []
        self.masks = set()
        for i, x in enumerate(self.items):
            short = min(overlap, len(x)) < 13
            run = short_run(min(overlap, len(x)), similarity)
            if run < 1:
                continue
            for number, mask in [(len(MASKS) + run, tuple(range(run)))] if short else enumerate(MASKS):
                self.masks.add((number, mask))
                c = masked(x, mask, number)
                code.append(c)
                item.append(np.full(len(c), i))
                place.append(np.arange(len(c)))
        code = np.concatenate([np.empty(0, np.uint64), *code])
        order = np.argsort(code, kind="stable")
        self.code = code[order]
        self.item = np.concatenate([np.empty(0, np.int64), *item]).astype(np.int64)[order]
        self.place = np.concatenate([np.empty(0, np.int64), *place]).astype(np.int64)[order]
        self.seen = np.zeros(1 << 20, bool)  # by the top bits: most hashes need no search
        self.seen[(self.code >> np.uint64(44)).astype(np.int64)] = True

    def search(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text number, item number, first and last+1 token in the text, equal tokens): the longest overlap of each pair."""
        h, size = token_hashes(texts)
        ends = np.cumsum(size)
        owner = np.repeat(np.arange(len(texts)), size)
        found = []
        for number, mask in sorted(self.masks):
            c = masked(h, mask, number)
            at = np.flatnonzero(self.seen[(c >> np.uint64(44)).astype(np.int64)])
            at = at[owner[at] == owner[at + mask[-1]]]
            lo, hi = np.searchsorted(self.code, c[at], "left"), np.searchsorted(self.code, c[at], "right")
            many = hi - lo
            # A repeated word in both texts hits everywhere; what counts are the distinct alignments, which are linear.
            for cut in np.split(np.arange(len(at)), np.searchsorted(np.cumsum(many), np.arange(HITS, int(many.sum()), HITS))):
                n = many[cut]
                which = np.repeat(lo[cut], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                place = np.repeat(at[cut], n)
                if len(which):
                    found.append(np.unique(np.stack([owner[place], self.item[which], place - self.place[which]], axis=1), axis=0))
        if not found:
            return []
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for text, item, shift in np.unique(np.concatenate(found), axis=0).tolist():
            tokens = self.items[item]
            first, last = int(ends[text] - size[text]), int(ends[text])
            a, z = max(shift, first), min(shift + len(tokens), last)
            equal = h[a:z] == tokens[a - shift : z - shift]
            s, e = best_run(equal, self.similarity)
            if e - s >= min(self.overlap, len(tokens)) and (e - s, -s) > (best.get((text, item), (0, 0, 0))[1] - best.get((text, item), (0, 0, 0))[0], 0):
                best[text, item] = (a + s - first, a + e - first, int(equal[s:e].sum()))
        return [(t, i, *x) for (t, i), x in best.items()]


def best_run(equal: np.ndarray, similarity: float) -> tuple[int, int]:
    """The longest stretch (first on ties) in which at least ``similarity`` of the tokens are equal."""
    score = np.concatenate([[0.0], np.cumsum(np.where(equal, 1 - similarity, -similarity))])
    low = np.minimum.accumulate(score)
    longest = (0, 0)
    j = len(score) - 1
    # For each end, the first start whose prefix sum isn't larger; ends are tried from the last.
    for e in range(j, 0, -1):
        if e <= longest[1] - longest[0]:
            break
        s = int(np.searchsorted(-low, -(score[e] + 1e-9), "left"))
        if e - s > longest[1] - longest[0] or e - s == longest[1] - longest[0] and s < longest[0]:
            longest = (s, e)
    return longest


def indexes(benchmark: DataFrame, overlap: int, similarity: float) -> Iterator[SeedIndex]:
    """The test items in blocks of about BLOCK_BYTES of text; the next is made when the one before has been used."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_BYTES))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toArrow()
        index = SeedIndex(rows.column("item_id").to_pylist(), raw_bytes(rows.column("text").combine_chunks()), overlap, similarity)
        index.blocks = blocks
        yield index


def overlaps(docs: DataFrame, benchmark: DataFrame, overlap: int = 13, similarity: float = 0.8) -> DataFrame:
    """``doc_id``, ``item_id``, ``first_token``, ``end_token``, ``equal_tokens``, ``item_tokens``: one row for each row of ``docs`` and test item that overlap.

    An overlap is a stretch of at least ``overlap`` tokens of the item (all of
    them, if it has fewer), aligned with the document's, of which at least
    ``similarity`` are equal. The longest of a pair is reported. All documents
    are run against all items, in blocks of items. Defined results: null and
    empty texts overlap with nothing; so do items without tokens; null ids stay, repeated rows too; an empty table on
    either side gives no rows; other columns are not read.
    """
    found = None
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for index in indexes(benchmark, overlap, similarity):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for part in text_slices(batches):
                hits = index.search(raw_bytes(part.column("text")))
                ids = part.column("doc_id").to_pylist()
                rows = [(ids[t], index.ids[i], a, z, n, len(index.items[i])) for t, i, a, z, n in hits]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(6)], names=["doc_id", "item_id", "first_token", "end_token", "equal_tokens", "item_tokens"])

        part = docs.mapInArrow(run, "doc_id long, item_id long, first_token long, end_token long, equal_tokens long, item_tokens long")
        if index.blocks > 1:  # done before the next block is sent
            part, _ = materialise(part, "overlaps")
            sent.destroy()
        found = part if found is None else found.unionAll(part)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, overlap: int = 13, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, whose text overlaps with no test item (see ``overlaps``).

    Defined results: rows with null or empty texts stay, repeated ones too; an
    empty benchmark keeps all rows, and an empty table gives none.
    """
    for index in indexes(benchmark, overlap, similarity):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for part in text_slices(batches):
                keep = np.ones(part.num_rows, bool)
                keep[[t for t, *_ in index.search(raw_bytes(part.column("text")))]] = False
                yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
        if index.blocks > 1:
            docs, _ = materialise(docs, "decontaminated")
            sent.destroy()
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
