"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import discard, materialise

#: A node with over one edge in so many (and this many at least) is a hub; there are at most twice as many hubs.
HUB_SHARE, HUB_LEAST = 500, 100
#: Edges that a task joins at once, and the most that are left to a single task; more go through the star steps.
TOGETHER = 1_000_000


def with_least(rows: DataFrame, key: str, value: str, size: int) -> DataFrame:
    """``rows`` with ``m``, the smallest ``value`` of the row's ``key``.

    Minima are aggregated before the shuffle. Those of hubs, at most 2 *
    HUB_SHARE, are sent to all tasks, so a hub's rows stay where they are; all
    other keys have few rows each and are joined.
    """
    least = rows.groupBy(key).agg(F.min(value).alias("m"), F.count(F.lit(1)).alias("n"))
    found = least.where(F.col("n") > max(HUB_LEAST, 2 * size // HUB_SHARE)).select(key, "m").toArrow()
    if not found.num_rows:
        return rows.join(least.drop("n"), key)
    hubs = F.broadcast(rows.sparkSession.createDataFrame(found))
    apart = rows.join(F.broadcast(hubs.select(key)), key, "left_anti")
    return rows.join(hubs, key).unionByName(apart.join(least.drop("n"), key))


def stars(lo: pa.Array, hi: pa.Array) -> pa.RecordBatch:
    """``lo`` and ``hi`` of as few edges that connect the same nodes: the smallest node of each group, and each other one."""
    nodes = pa.concat_arrays([lo, hi]).dictionary_encode()
    order = pc.sort_indices(nodes.dictionary)
    number = np.empty(len(order), np.int64)
    number[order.to_numpy()] = np.arange(len(order))
    at = number[nodes.indices.to_numpy()]
    label = merge_labels(np.arange(len(order)), at[: len(lo)], at[len(lo) :])
    own, names = np.flatnonzero(label != np.arange(len(label))), nodes.dictionary.take(order)
    return pa.RecordBatch.from_arrays([names.take(pa.array(label[own])), names.take(pa.array(own))], names=["lo", "hi"])


def joined(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars; when over ``most`` are held, they are passed on."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n > most:
            t = pa.Table.from_batches(held).combine_chunks()
            yield stars(t["lo"].chunk(0), t["hi"].chunk(0))
            held, n = [], 0
    if n:
        t = pa.Table.from_batches(held).combine_chunks()
        yield stars(t["lo"].chunk(0), t["hi"].chunk(0))


def connected_components(edges: DataFrame, label: str = "components", together: int = TOGETHER) -> DataFrame:
    """``edges(a, b)`` -> ``(node, root)``: each node that has an edge to another, with the smallest node it reaches.

    Each task first joins its own edges to stars. Up to ``together`` edges that
    are left then meet in one task. More of them alternate large-star and
    small-star steps (each node's neighbours are hooked to the smallest of them)
    until the edges are stars; there no neighbourhood is ever gathered in one
    place (``with_least``). Edges with a null end and loops are dropped; no
    edges give no rows.
    """
    spark = edges.sparkSession
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    own = edges.where("a is not null and b is not null and a <> b").select(lo.alias("lo"), hi.alias("hi"))
    now, path = materialise(own.mapInArrow(lambda batches: joined(batches, together), own.schema), label)
    size, seen = now.count(), None
    if 0 < size <= together:
        one, one_path = materialise(now.coalesce(1).mapInArrow(lambda batches: joined(batches, together), own.schema), label)
        discard(spark, path)
        now, path, size = one, one_path, 0
    while size:
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionAll(now.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        hooked = with_least(both, "u", "v", size).select("v", F.least("u", "m").alias("lo"), "u")
        large, large_path = materialise(hooked.where("v > u and lo < v").select("lo", F.col("v").alias("hi")).distinct(), label)
        small = with_least(large, "hi", "lo", size).select(F.explode(F.array(F.struct("m", F.col("lo").alias("v")), F.struct("m", F.col("hi").alias("v")))).alias("e"))
        after, new_path = materialise(small.where("e.m < e.v").select(F.col("e.m").alias("lo"), F.col("e.v").alias("hi")).distinct(), label)
        # A round changed nothing if the edge set is the same: compared by size and two sums of hashes.
        h = F.xxhash64("lo", "hi")
        mark = after.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
        discard(spark, path, large_path)
        now, path, size = after, new_path, mark[0]
        if mark == seen:
            break
        seen = mark
    roots = now.select("lo").distinct().select(F.col("lo").alias("node"), F.col("lo").alias("root"))
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(roots)


def merge_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union the pairs (i, j) into ``labels``, where a label is the smallest index of its set."""
    while len(i):
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels[:] = jumped
    return labels
