"""SimHash near-duplicates by a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import materialise, raw_bytes, table, text_slices
from cairn.llm.components import connected_components
from cairn.llm.gray_index import hamming_links

LANES = np.uint64(0x0101010101010101)


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprint of each consecutive group of hashes: the bits set in over half of them; zero for an empty group.

    Eight counters of eight bits share a word, so groups are summed in pieces of
    at most 255 hashes.
    """
    sizes = np.asarray(sizes, np.int64)
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    begin = np.concatenate([[0], np.cumsum(sizes[full])])[:-1]
    pieces = -(-sizes[full] // 255)
    first = np.concatenate([[0], np.cumsum(pieces)])[:-1]
    owner = np.repeat(np.arange(len(full)), pieces)
    starts = begin[owner] + 255 * (np.arange(len(owner)) - first[owner])
    counts, bits = np.empty((len(owner), 8, 8), np.uint8), np.empty_like(hashes)
    for s in range(8):
        np.right_shift(hashes, np.uint64(s), out=bits)
        bits &= LANES
        counts[:, :, s] = np.add.reduceat(bits, starts).view(np.uint8).reshape(-1, 8)
    counts = np.add.reduceat(counts.reshape(-1, 64), first, axis=0, dtype=np.int64)
    out[full] = np.packbits(2 * counts > sizes[full][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def shingle_hashes(text: bytes, width: int, seed: int) -> list[int]:
    """XXH64 of the shingles of one text: A-Z lower-cased, words between ASCII white space."""
    words = text.lower().split()  # of bytes: ASCII only
    if not words:
        return []
    if len(words) < width:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    digest = xxhash.xxh64_intdigest
    return [digest(s, seed) for s in map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))]


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a signed long) of each row; other columns are not read."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            hashes = [np.array(shingle_hashes(t, width, seed), np.uint64) for t in raw_bytes(part.column("text"))]
            fp = majority_bits(np.concatenate(hashes), np.array([len(h) for h in hashes]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, "doc_id long, fp long")


def near_duplicate_groups(docs: DataFrame, distance: int = 3, width: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` (the smallest doc_id that links reach) of each row.

    Two rows link if their fingerprints differ in at most ``distance`` bits.
    Exact copies are joined by their fingerprint, so only distinct fingerprints
    enter the index (see ``hamming_links``), and the components are those of
    fingerprints. Defined results: null and blank texts have fingerprint zero and
    link like any other; a row with a null doc_id stays, and its id counts for
    nothing (a component of such rows only has a null id); repeated rows stay;
    an empty table gives no rows. The words of one text are held at once.
    """
    own, _ = materialise(fingerprints(docs, width, seed), "fingerprints")
    each = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(hamming_links(each, distance, size=own.count()), "near").withColumnsRenamed({"node": "fp"})
    rooted, _ = materialise(each.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.select("fp", "root").join(names, "root").select("fp", "component_id")
    return own.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one_of_each_group(docs: DataFrame, distance: int = 3) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the document with the smallest doc_id stays.

    All columns stay as they are. Rows with a null doc_id stay, for they can't
    be told apart; rows that repeat one doc_id count as one document; null and
    blank texts are one group; an empty table gives no rows.
    """
    gone = near_duplicate_groups(docs, distance).where("doc_id <> component_id").select("doc_id").distinct()
    gone, _ = materialise(gone, "near-duplicates")
    return docs.join(gone.withColumnRenamed("doc_id", "__gone"), F.col("doc_id") == F.col("__gone"), "left_anti")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
