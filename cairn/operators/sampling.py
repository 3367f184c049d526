"""Sampling and augmentation plans that are pure functions of a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 4096

# Severities of the training candidates by transformation.
SEVERITIES = {
    "jpeg": [90.0, 70.0, 50.0, 30.0], "blur": [0.5, 1.0, 2.0], "resize": [0.5, 0.25], "noise": [0.02, 0.05, 0.10], "color": [0.10, 0.20, 0.30], "crop": [0.70, 0.80, 0.90],
}


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the digest of the joined parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def weighted_draws(rows: DataFrame, ordinal: str, weight: str, samples: int, seed: int, epoch: int = 0, world: int = 1) -> DataFrame:
    """R1, W15. ``draw``, ``rank`` (draw mod ``world``) and the drawn ``ordinal``: with replacement, in proportion to ``weight``.

    The number of draws is rounded up so that ranks get equally many. Weights
    are summed within buckets of ordinals and the bucket sums in order; draws
    meet the rows in cells of the summed weight, by an equi-join. Null and
    non-positive weights are never drawn; if none is positive, nothing is.
    """
    spark, total_draws = rows.sparkSession, -(-samples // world) * world
    w = rows.where(F.col(weight) > 0).select(F.col(ordinal).alias("o"), F.col(weight).alias("w")).withColumn("bucket", F.floor(F.col("o") / BUCKET))
    total, count = w.agg(F.sum("w"), F.count(F.lit(1))).first()
    cells = max(1, max(count, total_draws) // 16)
    sums = w.groupBy("bucket").agg(F.sum("w").alias("all"))
    before = sums.select("bucket", (F.sum("all").over(Window.orderBy("bucket")) - F.col("all")).alias("before"))
    upto = F.sum("w").over(Window.partitionBy("bucket").orderBy("o"))
    spans = w.withColumn("hi", upto).join(before, "bucket").select("o", (F.col("before") + F.col("hi") - F.col("w")).alias("lo"), (F.col("before") + F.col("hi")).alias("hi"))
    cell = lambda c: F.least(F.floor(c * F.lit(float(cells)) / F.lit(float(total or 1))), F.lit(cells - 1)).cast("long")
    spans = spans.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
    draws = spark.range(total_draws).select(F.col("id").alias("draw"), (uniform(F.lit(seed), F.lit(epoch), F.col("id")) * F.lit(float(total or 0))).alias("at")).withColumn("cell", cell(F.col("at")))
    met = draws.join(spans, "cell").where((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
    return met.select("draw", F.pmod("draw", F.lit(world)).alias("rank"), F.col("o").alias(ordinal))


def transform_candidates(rows: DataFrame, row: str, count: int, seed: int, epoch: int = 0) -> DataFrame:
    """R4, R5. ``count`` candidates a row: transformations in an order drawn from the seed, all before any comes again, each with a drawn severity."""
    names = F.array(*[F.lit(n) for n in sorted(SEVERITIES)])
    turn = F.sequence(F.lit(0), F.lit(count - 1))
    key = lambda name, lap: F.sha2(F.concat_ws(":", F.lit(seed), F.lit(epoch), F.col(row), lap, name), 256)
    lap = F.floor(F.col("candidate") / len(SEVERITIES)).cast("int")
    order = F.transform(F.array_sort(F.transform(names, lambda n: F.struct(key(n, lap).alias("k"), n.alias("n")))), lambda x: x["n"])
    severities = F.create_map(*[x for n, s in SEVERITIES.items() for x in (F.lit(n), F.array(*[F.lit(v) for v in s]))])
    out = rows.select(row, F.explode(turn).alias("candidate")).withColumn("family", F.element_at(order, F.pmod("candidate", F.lit(len(SEVERITIES))) + 1)).withColumn("choices", severities[F.col("family")])
    at = F.floor(uniform(F.lit(seed), F.lit(epoch), F.col(row), F.col("candidate")) * F.size("choices")).cast("int") + 1
    return out.select(row, "candidate", "family", F.element_at("choices", at).alias("severity"))
