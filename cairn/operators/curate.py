"""Splits, quarantine, duplicates and selection over manifest rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How much a split is held out, least first.
PRIORITY = {"train": 0, "calibration": 1, "validation": 2, "test": 3, "test_unseen": 4}


def _priority(split: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[split]


def unify_splits(rows: DataFrame, group: str, most_held_out: bool = True) -> DataFrame:
    """W5 (the most held-out split of a group wins) and W6 (train wins): a two-step join, so a hot group needs no window.

    A row without a group keeps its own split.
    """
    pick = F.max_by if most_held_out else F.min_by
    chosen = rows.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("__group")).agg(pick("split", _priority(F.col("split"))).alias("__split"))
    joined = rows.join(chosen, F.col(group) == F.col("__group"), "left")
    return joined.withColumn("split", F.coalesce("__split", "split")).drop("__split", "__group")


def relabel_unseen(rows: DataFrame, group: str, family: str, synthetic: Column) -> DataFrame:
    """Groups in test_unseen whose synthetic families are in train become test_seen; those without any become test. A row without a group is a group of its own."""
    trained = rows.where((F.col("split") == "train") & synthetic).select(F.col(family).alias("__family")).distinct().withColumn("__seen", F.lit(True))
    marked = rows.withColumn("__syn", F.coalesce(synthetic, F.lit(False))).join(trained, F.col(family) == F.col("__family"), "left")
    unseen, known = F.col("split") == "test_unseen", F.col("__syn") & F.col("__seen").isNotNull()
    per = marked.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("__group")).agg(F.max(unseen).alias("__u"), F.max(known).alias("__k"), F.max("__syn").alias("__a"))
    joined = marked.join(per, F.col(group) == F.col("__group"), "left")
    u, k, a = F.coalesce("__u", unseen), F.coalesce("__k", known), F.coalesce("__a", "__syn")
    return joined.withColumn("split", F.when(u & k, "test_seen").when(u & ~a, "test").otherwise(F.col("split"))).select(rows.columns)


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The first rule that fits names the reason; null keeps the row."""
    out = None
    for name, rule in rules:
        out = F.when(rule, name) if out is None else out.when(rule, name)
    return out


def conflicting_groups(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Groups with more than one distinct value."""
    return rows.groupBy(group).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def first_flags(rows: DataFrame, key: str, order: str, name: str = "is_first") -> DataFrame:
    """Whether a row is the first of its key. The minimum is aggregated before the shuffle and joined, so a key that many rows share needs no window; a null key is never shared."""
    least = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.min(order).alias("__least"))
    return rows.join(least, F.col(key) == F.col("__key"), "left").withColumn(name, F.coalesce(F.col(order) == F.col("__least"), F.lit(True))).drop("__key", "__least")


def first_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rank of each row in its key; 1 stays."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(order)))


def capped(rows: DataFrame, key: str, order: str, cap: int) -> DataFrame:
    """W10."""
    return first_rows(rows, key, order).where(F.col("rank") <= cap)


def banded_pairs(rows: DataFrame, id_: str, hash_: str, distance: int, bits: int = 64) -> DataFrame:
    """Pairs of ids whose hashes differ in at most ``distance`` bits; they share one of ``distance + 1`` bands.

    Distinct hashes are paired; zero hashes are left out.
    """
    cuts = [bits * i // (distance + 1) for i in range(distance + 2)]
    distinct = rows.where(F.col(hash_) != 0).select(F.col(hash_).alias("h")).distinct()
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("h", a).bitwiseAND((1 << (z - a)) - 1).alias("value")) for i, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))])
    banded = distinct.select("h", F.inline(bands))
    other = banded.withColumnRenamed("h", "g")
    near = banded.join(other, ["band", "value"]).where(F.col("h") < F.col("g")).where(F.bit_count(F.col("h").bitwiseXOR(F.col("g"))) <= distance).select("h", "g").distinct()
    left, right = rows.select(F.col(id_).alias("id_a"), F.col(hash_).alias("h")), rows.select(F.col(id_).alias("id_b"), F.col(hash_).alias("g"))
    return near.join(left, "h").join(right, "g").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), F.bit_count(F.col("h").bitwiseXOR(F.col("g"))).alias("distance"))


def two_hash_pairs(rows: DataFrame, id_: str, first: str, second: str, distances: tuple[int, int] = (4, 6), bits: int = 64) -> DataFrame:
    """J3 with both hashes: pairs near by the first (five bands) or by the second (eight bands of eight bits)."""
    a = banded_pairs(rows, id_, first, distances[0], bits).select("id_a", "id_b")
    wide = banded_pairs(rows, id_, second, distances[1], bits).select("id_a", "id_b")
    return a.unionAll(wide).distinct()


def manifest_digest(rows: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Digest that the order of rows doesn't change, over row hashes by group.

    Row hashes are first digested in 4,096 buckets, so no task holds all of them.
    """
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    hashed = rows.select(*keys, h.alias("h")).withColumn("bucket", F.substring("h", 1, 3))
    part = hashed.groupBy(*keys, "bucket").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("d"), F.count(F.lit(1)).alias("n"))
    return part.groupBy(*keys).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "d"))), lambda x: x["d"]), ""), 256).alias("digest"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """U1."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
