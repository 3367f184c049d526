"""Duplicate groups of manifest rows: links by content hash, source group and near hashes, then connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.curate import banded_pairs
from cairn.sources.shared import discard, stored, written

#: Ordinals in a bucket when groups are numbered; buckets are numbered by one small window.
BUCKET = 1 << 16


#: A key with over one row in so many (and this many at least) is a hub; there are at most so many hubs.
HUB_SHARE, HUB_LEAST = 250, 100


def attach(rows: DataFrame, values: DataFrame, key: str, size: int) -> DataFrame:
    """Inner join of ``rows`` (``size`` of them) with ``values``, which has one row for each key.

    The values of hubs, at most HUB_SHARE rows, are sent to all tasks, so a
    hub's rows stay where they are; only the other keys are shuffled.
    """
    hubs = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(HUB_LEAST, size // HUB_SHARE)).select(key).toArrow()
    if not hubs.num_rows:
        return rows.join(values, key)
    few = F.broadcast(rows.sparkSession.createDataFrame(hubs))
    apart = rows.join(few, key, "left_anti").join(values.join(few, key, "left_anti"), key)
    return rows.join(F.broadcast(values.join(few, key, "left_semi")), key).unionByName(apart)


def components(edges: DataFrame) -> DataFrame:
    """G1. ``edges(a, b)`` of numbers -> ``(node, root)``: each linked node with the largest node that it reaches.

    Rounds of min-label hooking with pointer jumping: a node takes the best
    label around it, then the label of that label, so paths shorten by powers
    of two. Labels are aggregated before the shuffle, and hubs aren't shuffled
    (``attach``); each round is written to the shared folder, and the one
    before deleted.
    """
    spark = edges.sparkSession
    links, links_path = written(edges.where("a <> b").select("a", "b").unionAll(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "group-links")
    labels, path = written(links.groupBy("a").agg(F.max("b").alias("m")).select(F.col("a").alias("node"), F.greatest("a", "m").alias("root")), "group-labels")
    many, nodes = links.count(), labels.count()
    while True:
        seen = labels.withColumnsRenamed({"node": "b", "root": "around"})
        best = attach(links, seen, "b", many).groupBy("a").agg(F.max("around").alias("around")).withColumnRenamed("a", "node")
        met, met_path = written(labels.join(best, "node"), "group-met")
        # What a node's root has learnt from any of its members counts for all of them.
        taught = met.groupBy("root").agg(F.max("around").alias("up"))
        hooked, hooked_path = written(attach(met, taught, "root", nodes).select("node", F.col("root").alias("old"), F.greatest("root", "around", "up").alias("root")), "group-hooked")
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        after, after_path = written(attach(hooked, jump, "root", nodes).select("node", "old", F.greatest("root", "far").alias("root")), "group-labels")
        discard(spark, path, met_path, hooked_path)
        changed = not after.where("old <> root").isEmpty()
        labels, path = after.select("node", "root"), after_path
        if not changed:
            discard(spark, links_path)
            return labels


def duplicate_groups(rows: DataFrame, ordinal: str, sha: str, phash: str, source: str, distance: int = 4, bits: int = 64, skip_zero: bool = True) -> DataFrame:
    """``ordinal`` and ``duplicate_group`` of each row.

    Rows link if they have the same content hash, the same source group that
    isn't blank, or perceptual hashes that differ in at most ``distance`` bits.
    A group is named ``duplicate_%08d`` by the rank of its largest ordinal.
    Nulls link nothing; ordinals must be distinct whole numbers.
    """
    n = rows.select(F.col(ordinal).cast("long").alias("a"), F.col(sha).alias("sha"), F.col(phash).alias("h"), F.col(source).alias("src"))
    n = stored(n.withColumn("h", F.col("h").cast("long")), "group-rows")

    def star(key: str, kept) -> DataFrame:
        some = n.where(kept).select("a", key)
        return some.join(some.groupBy(key).agg(F.max("a").alias("b")).where(F.col("b").isNotNull()), key).select("a", "b")

    edges = star("sha", F.col("sha").isNotNull()).unionAll(star("src", F.coalesce(F.trim("src") != "", F.lit(False))))
    hashes = n.where("h is not null" + (" and h <> 0" if skip_zero else ""))
    edges = edges.unionAll(star("h", F.col("h").isNotNull() & ((F.col("h") != 0) | F.lit(not skip_zero))))
    # One row for each distinct hash takes part in the band join, whatever the number of its copies.
    heads = hashes.groupBy("h").agg(F.max("a").alias("id"))
    near = banded_pairs(heads, "id", "h", distance, bits).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    roots = components(edges.unionAll(near)).withColumnRenamed("node", "a")
    rooted = stored(n.select("a").join(roots, "a", "left").select("a", F.coalesce("root", "a").alias("root")), "group-roots")
    return rooted.join(numbered(rooted.select("root").distinct()), "root").select(F.col("a").alias(ordinal), F.format_string("duplicate_%08d", F.col("number")).alias("duplicate_group"))


def numbered(roots: DataFrame) -> DataFrame:
    """G2. ``root`` and its rank from 0; ranks are counted within buckets, and only bucket sizes are summed up in order."""
    at = roots.withColumn("bucket", F.floor(F.col("root") / BUCKET))
    sizes = at.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy("root")) - 1
    return at.withColumn("inside", inside).join(before, "bucket").select("root", (F.col("before") + F.col("inside")).alias("number"))
