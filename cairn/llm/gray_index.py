"""Gray-order hierarchical index over 64-bit fingerprints, and the distributed join that uses it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import materialise, spread
from cairn.llm.components import merge_labels

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Children of a node. A tree over so few values is its leaves only, which are compared one by one.
FANOUT = 16
#: Values that share a slot, about, and values that a task holds before it passes crowded blocks on.
SLOT, HELD = 400_000, 3_000_000


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code word in the reflected Gray sequence: neighbours there differ in one bit."""
    x = x.copy()
    for s in (32, 16, 8, 4, 2, 1):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """A tree over fingerprints sorted by Gray rank.

    A node stores the bits on which all of its leaves agree, without those that
    its ancestors already store. A search adds up differences on the way down
    and leaves a whole group as soon as the sum exceeds the distance.
    """

    def __init__(self, values: np.ndarray, fanout: int = FANOUT):
        self.order = np.argsort(gray_rank(values), kind="stable")
        self.leaves, self.fanout = values[self.order], fanout
        mask, pattern = np.full(len(values), ONES), self.leaves
        self.levels = [[mask, pattern, np.arange(1, len(values) + 1)]]  # mask, pattern, end of the node's leaves
        while len(mask) > fanout:
            starts = np.arange(0, len(mask), fanout)
            group = np.arange(len(mask)) // fanout
            common = np.bitwise_and.reduceat(mask, starts) & ~np.bitwise_or.reduceat(pattern ^ pattern[starts][group], starts)
            end = self.levels[-1][2][np.minimum(starts + fanout, len(mask)) - 1]
            self.levels[-1][0] = mask & ~common[group]
            mask, pattern = common, pattern[starts] & common
            self.levels.append([mask, pattern, end])

    def pairs(self, distance: int, queries: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Leaf positions i < j within the distance, in blocks of bounded size; or each i of ``queries`` with all such j."""
        n, own = len(self.leaves), queries is None
        queries = np.arange(n) if own else queries
        step = max(1, min(n, 2_000_000 // max(n, 1)))
        for at in range(0, len(queries), step):
            some = queries[at : at + step]
            q = np.repeat(some, len(self.levels[-1][0]))
            node = np.tile(np.arange(len(self.levels[-1][0])), len(some))
            sum_ = np.zeros(len(q), np.uint8)
            for depth in range(len(self.levels) - 1, -1, -1):
                mask, pattern, end = self.levels[depth]
                if own:
                    later = end[node] > q + 1  # else all its leaves come before q
                    q, node, sum_ = q[later], node[later], sum_[later]
                sum_ = sum_ + np.bitwise_count((self.leaves[q] ^ pattern[node]) & mask[node])
                near = sum_ <= distance
                q, node, sum_ = q[near], node[near], sum_[near]
                if depth:
                    below = len(self.levels[depth - 1][0])
                    node = (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                    inside = node < below
                    q, sum_ = np.repeat(q, self.fanout)[inside], np.repeat(sum_, self.fanout)[inside]
                    node = node[inside]
            if len(q):
                yield q, node


def linked(values: np.ndarray, distance: int) -> np.ndarray:
    """Label (smallest index) of each value's connected group."""
    labels = np.arange(len(values))
    if len(values) < 2:
        return labels
    index = GrayIndex(values)
    for i, j in index.pairs(distance):
        merge_labels(labels, index.order[i], index.order[j])
    return labels


def first_masks(distance: int) -> list[int]:
    """Blocks of the 64 bits; values within the distance agree on one of them (pigeonhole)."""
    return split_bits(list(range(64)), distance + 1)


def split_bits(bits: list[int], parts: int) -> list[int]:
    cuts = [len(bits) * i // parts for i in range(parts + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]


def finer_masks(mask: int, distance: int) -> list[int]:
    """For a block that too many values share: the same block and one of the parts of the rest."""
    return [mask | m for m in split_bits([b for b in range(64) if not mask >> b & 1], distance + 1)]


def slots_of(fp: np.ndarray, mask: int, number: int, slots: int) -> np.ndarray:
    """Slot of each value: the same for values that agree on the mask."""
    h = (fp & np.uint64(mask)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(number + 1)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return number * slots + ((h >> np.uint64(33)) % np.uint64(slots)).astype(np.int64)


def packed_by_slot(slot: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """Each slot that occurs, with its values of each column as bytes."""
    order = np.argsort(slot, kind="stable")
    slot, columns = slot[order], [c[order] for c in columns]
    bounds = np.concatenate([np.flatnonzero(np.diff(slot, prepend=-1)), [len(slot)]])
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield int(slot[a]), [c[a:z].tobytes() for c in columns]


def by_slots(rows: DataFrame, masks: list[int], slots: int, own_mask: bool, held: int = 1 << 19) -> DataFrame:
    """``slot`` and packed ``fps``: rows for the shuffle that hold many fingerprints each, dealt and sorted by slot.

    Without ``own_mask`` each value goes to one slot for every mask, else to that of its column ``mask``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0

        def out() -> pa.RecordBatch:
            slot = np.concatenate([s for s, _ in kept])
            got = list(packed_by_slot(slot, np.concatenate([f for _, f in kept])))
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in got], pa.int64()), pa.array([c[0] for _, c in got], pa.binary())], names=["slot", "fps"])

        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            own = b.column("mask").to_numpy(zero_copy_only=False) if own_mask else None
            for k, m in enumerate(masks):
                some = fp[own == k] if own_mask else fp
                if len(some):
                    kept.append((slots_of(some, m, k, slots), some))
                    n += len(some)
            if n >= held:
                yield out()
                kept, n = [], 0
        if n:
            yield out()

    parts = spread(rows)
    return rows.mapInArrow(run, "slot long, fps binary").repartition(parts, "slot").sortWithinPartitions("slot")


def search_slots(batches: Iterator[pa.RecordBatch], masks: list[int], slots: int, distance: int, most: int) -> Iterator[pa.RecordBatch]:
    """Edges of all runs of values that share a block; the values of runs longer than ``most`` are passed on with their mask's number.

    A task holds one slot at a time. If crowded blocks make it too much, their
    values are passed on before the slot's end, and later ones as they come.
    """

    def rows(a: np.ndarray, b: np.ndarray, over: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), over))], names=["a", "b", "over"])

    def runs(fp: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fp = np.unique(fp)
        block = fp & np.uint64(mask)
        order = np.argsort(block, kind="stable")
        fp, block = fp[order], block[order]
        return fp, block, np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(fp)]]) if len(fp) else np.zeros(1, np.int64)

    def finished(fp: np.ndarray, bounds: np.ndarray, number: int) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(bounds)
        run = np.repeat(np.arange(len(sizes)), sizes)
        long = sizes > most
        if long.any():
            gone = fp[long[run]]
            yield rows(gone, np.full(len(gone), number, np.int64), True)
        short = (sizes > 1) & (sizes <= FANOUT)
        for shift in range(1, int(sizes[short].max(initial=1))):  # the leaves of all small trees at once
            i = np.flatnonzero((run[:-shift] == run[shift:]) & short[run[shift:]])
            i = i[np.bitwise_count(fp[i] ^ fp[i + shift]) <= distance]
            if len(i):
                yield rows(fp[i + shift], fp[i], False)
        for k in np.flatnonzero((sizes > FANOUT) & ~long).tolist():
            part = fp[bounds[k] : bounds[k + 1]]
            root = linked(part, distance)
            own = root != np.arange(len(part))
            if own.any():
                yield rows(part[own], part[root[own]], False)

    held, n, last, crowded = [], 0, None, np.empty(0, np.uint64)

    def whole() -> Iterator[pa.RecordBatch]:
        fp, _, bounds = runs(np.concatenate(held), masks[last // slots])
        if len(fp):
            yield from finished(fp, bounds, last // slots)

    for b in batches:
        for slot, raw in zip(b.column("slot").to_pylist(), b.column("fps").to_pylist(), strict=True):
            if slot != last:
                if held:
                    yield from whole()
                held, n, last, crowded = [], 0, slot, np.empty(0, np.uint64)
            fp, number = np.frombuffer(raw, np.uint64), slot // slots
            if len(crowded):
                gone = np.isin(fp & np.uint64(masks[number]), crowded)
                if gone.any():
                    yield rows(fp[gone], np.full(int(gone.sum()), number, np.int64), True)
                    fp = fp[~gone]
            held.append(fp)
            n += len(fp)
            if n > HELD:
                fp, block, bounds = runs(np.concatenate(held), masks[number])
                long = np.repeat(np.diff(bounds) > most, np.diff(bounds))
                crowded = np.union1d(crowded, block[long])
                if long.any():
                    yield rows(fp[long], np.full(int(long.sum()), number, np.int64), True)
                held = [fp[~long]]
                n = len(held[0]) - HELD  # what is left are small blocks
    if held:
        yield from whole()


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Join small batches into larger ones."""
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def hamming_links(fingerprints: DataFrame, distance: int = 3, most: int = 4096, label: str = "links", size: int | None = None) -> DataFrame:
    """Edges (a, b) between the distinct ``fp`` of a table, that connect exactly what pairs within the distance connect.

    Values within the distance share one of ``distance + 1`` blocks. Those that
    share a block meet in one task, which searches them with a ``GrayIndex`` and
    returns one edge for each value to the first of its local group: rows stay
    linear however dense a group is. More than ``most`` values in a block are
    not searched but dealt again by that block plus a part of the other bits,
    until they are few or the bits that are left bound their number. ``size``,
    the number of values or more, saves counting them; slots are cut by it.
    """
    masks = first_masks(distance)
    rows, own, found = fingerprints.select("fp").distinct(), False, []
    size = (fingerprints.count() if size is None else size) * len(masks)
    while True:
        limit = most if 64 - min(m.bit_count() for m in masks) > 12 else 1 << 20
        slots = max(1, -(-size // (SLOT * len(masks))), -(-4 * spread(fingerprints) // len(masks)))
        at = list(masks)

        def search(batches, at=at, limit=limit, slots=slots):
            return gathered(search_slots(batches, at, slots, distance, limit))

        out, _ = materialise(by_slots(rows, masks, slots, own).mapInArrow(search, "a long, b long, over boolean"), label)
        found.append(out.where("not over").select("a", "b"))
        rest = out.where("over").select(F.col("a").alias("fp"), F.col("b").cast("int").alias("parent")).distinct()
        size = rest.count() * (distance + 1)
        if limit > most or not size:
            break
        finer = [finer_masks(m, distance) for m in masks]
        numbered = [list(range(i * (distance + 1), (i + 1) * (distance + 1))) for i in range(len(masks))]
        children = F.element_at(F.array(*[F.array(*[F.lit(n) for n in x]) for x in numbered]), F.col("parent") + 1)
        rows, own = rest.select("fp", F.explode(children).alias("mask")), True
        masks = [m for x in finer for m in x]
    edges = found[0]
    for f in found[1:]:
        edges = edges.unionAll(f)
    return edges
