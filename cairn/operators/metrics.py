"""Ranking and threshold metrics as aggregations.

Ties are collapsed by (group, score) before any window, so what a window sees
is the number of distinct scores of a group. Undefined values are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by_score(rows: DataFrame, keys: list[str], target: str, score: str, weight: Column) -> DataFrame:
    known = rows.where(F.col(target).isNotNull() & F.col(score).isNotNull())
    return known.groupBy(*keys, F.col(score).alias("s")).agg(F.sum(F.when(F.col(target) == 1, weight).otherwise(0)).alias("p"), F.sum(F.when(F.col(target) == 0, weight).otherwise(0)).alias("n"))


def running(tied: DataFrame, keys: list[str], columns: list[str], at: str = "s") -> DataFrame:
    """``tied`` with ``<column>_below``, the sum over all smaller ``at`` of the key, and ``<column>_all``.

    Values are cut into 4,096 ranges by a rising function that is even on [0, 1]
    and bounded elsewhere. Sums of whole ranges are accumulated in one small
    window for each key, those inside a range in the range's own task: no task
    sees all values of a key.
    """
    part = F.floor(F.col(at) / (1 + F.abs(at)) * 2048)
    cut = tied.withColumn("__part", F.coalesce(part, F.lit(-4096)))
    sums = cut.groupBy(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__part").alias("__range")).agg(*[F.sum(c).alias(f"__{c}") for c in columns])
    key = [f"__{k}" for k in keys]
    before, every = Window.partitionBy(*key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*key)
    whole = sums.select(*key, "__range", *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}_before") for c in columns], *[F.sum(f"__{c}").over(every).alias(f"{c}_all") for c in columns])
    same = F.col("__part") == F.col("__range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    inside = Window.partitionBy(*keys, "__part").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    run = cut.join(whole, same).withColumns({f"{c}_below": F.col(f"__{c}_before") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns})
    return run.drop(*key, "__range", "__part", *[f"__{c}_before" for c in columns])


def auroc(rows: DataFrame, keys: list[str], target: str = "y", score: str = "score", weight: Column | None = None) -> DataFrame:
    """A7 (A19 with a weight): chance that a positive outranks a negative, ties half."""
    ranked = running(_by_score(rows, keys, target, score, F.lit(1) if weight is None else weight), keys, ["n"])
    sums = ranked.groupBy(*keys).agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), F.sum(F.col("p") * (F.col("n_below") + F.col("n") / 2)).alias("won"))
    return sums.select(*keys, "n_pos", "n_neg", F.try_divide("won", (F.col("n_pos") * F.col("n_neg")).cast("double")).alias("auroc"))


def auprc(rows: DataFrame, keys: list[str], target: str = "y", score: str = "score") -> DataFrame:
    """Precision at each distinct threshold, weighted by the step in recall."""
    run = running(_by_score(rows, keys, target, score, F.lit(1)), keys, ["p", "n"])
    tp, fp = F.col("p_all") - F.col("p_below"), F.col("n_all") - F.col("n_below")
    return run.groupBy(*keys).agg(F.try_divide(F.sum(F.col("p") * F.try_divide(tp, tp + fp)), F.sum("p")).alias("auprc"))


def confusion(rows: DataFrame, keys: list[str], target: str, predicted: str) -> DataFrame:
    """A5."""
    return rows.where(F.col(target).isNotNull()).groupBy(*keys, F.col(target).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def binary_summary(rows: DataFrame, keys: list[str], target: str = "y", score: str = "score", threshold: float = 0.5, undefined: float | None = None) -> DataFrame:
    """A10 (undefined is null) and A11 (undefined is 0.0)."""
    hit, pos = F.col(score) >= threshold, F.col(target) == 1
    count = lambda c: F.count_if(c)
    c = rows.where(F.col(target).isNotNull()).groupBy(*keys).agg(count(pos & hit).alias("tp"), count(pos & ~hit).alias("fn"), count(~pos & hit).alias("fp"), count(~pos & ~hit).alias("tn"))
    tp, fn, fp, tn = (F.col(x).cast("double") for x in ("tp", "fn", "fp", "tn"))
    ratio = lambda a, b: F.try_divide(a, b) if undefined is None else F.coalesce(F.try_divide(a, b), F.lit(undefined))
    recall, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    return c.select(
        *keys, "tp", "fn", "fp", "tn", ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), recall.alias("recall"), specificity.alias("specificity"),
        ((recall + specificity) / 2).alias("balanced_accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def macro_f1(matrix: DataFrame, classes: int) -> DataFrame:
    """A6 from a confusion table without keys; an absent class counts as 0."""
    per = matrix.select(F.explode(F.array(F.struct(F.col("actual").alias("c"), F.lit(1).alias("act"), F.lit(0).alias("prd")), F.struct(F.col("predicted").alias("c"), F.lit(0).alias("act"), F.lit(1).alias("prd")))).alias("x"), "n", (F.col("actual") == F.col("predicted")).alias("ok"))
    sums = per.groupBy("x.c").agg(F.sum(F.col("x.act") * F.col("n")).alias("actual"), F.sum(F.col("x.prd") * F.col("n")).alias("predicted"), F.sum(F.when(F.col("ok"), F.col("x.act") * F.col("n")).otherwise(0)).alias("tp"))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("actual") + F.col("predicted")), F.lit(0.0))
    rec = F.coalesce(F.try_divide("tp", "actual"), F.lit(0.0))
    return sums.agg((F.sum(f1) / classes).alias("macro_f1"), (F.sum(rec) / classes).alias("balanced_accuracy"))


def at_thresholds(rows: DataFrame, grid: DataFrame, target: str = "y", score: str = "score") -> DataFrame:
    """True-positive and true-negative rates for each threshold of a one-column table.

    Scores are collapsed, then joined with the thresholds as one sorted stream
    of running sums: no rows are multiplied by the number of thresholds.
    """
    tied = _by_score(rows, [], target, score, F.lit(1)).select("s", "p", "n", F.lit(False).alias("asked"))
    asked = grid.select(F.col("threshold").alias("s"), F.lit(0).alias("p"), F.lit(0).alias("n"), F.lit(True).alias("asked"))
    both = tied.unionByName(asked).groupBy("s").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.max("asked").alias("asked"))
    run = running(both, [], ["p", "n"]).where("asked")
    return run.select(F.col("s").alias("threshold"), (1 - F.try_divide("p_below", "p_all")).alias("tpr"), F.try_divide("n_below", "n_all").alias("tnr"))


def calibrate(rates: DataFrame, least_recall: float) -> DataFrame:
    """The best threshold of a rates table, feasible ones first; one row."""
    ok = (F.col("tpr") >= least_recall) & (F.col("tnr") >= least_recall)
    bal, gap = (F.col("tpr") + F.col("tnr")) / 2, F.round(F.abs(F.col("tpr") - F.col("tnr")), 12)
    ranked = rates.withColumns({"ok": ok, "bal": F.round(bal, 12), "low": F.when(ok, 0.0).otherwise(F.round(F.least("tpr", "tnr"), 12)), "gap": gap, "off": F.round(F.abs(F.col("threshold") - 0.5), 12)})
    best = ranked.orderBy(F.desc("ok"), F.desc("bal"), F.desc("low"), "gap", "off", "threshold").limit(1)
    return best.select(F.round("threshold", 6).alias("threshold"), F.round("tpr", 9).alias("tpr"), F.round("tnr", 9).alias("tnr"), F.col("ok").alias("feasible"))


def balanced_weights(rows: DataFrame, target: str, group: str, max_ratio: float = 5.0, masses: dict[int, float] | None = None) -> DataFrame:
    """Equal mass for each group of a class, capped against natural sampling, then scaled to the class's mass."""
    mass = F.lit(0.5) if masses is None else F.create_map(*[F.lit(x) for kv in masses.items() for x in kv])[F.col(target)]
    sizes = rows.where(F.col(target).isNotNull()).groupBy(target, group).agg(F.count(F.lit(1)).alias("size"))
    per = sizes.groupBy(target).agg(F.count(F.lit(1)).alias("groups"), F.sum("size").alias("rows"))
    capped = sizes.join(per, target).withColumn("raw", F.least(mass / (F.col("groups") * F.col("size")), max_ratio * mass / F.col("rows")))
    total = capped.groupBy(target).agg(F.sum(F.col("raw") * F.col("size")).alias("total"))
    weights = capped.join(total, target).select(target, group, (F.col("raw") * mass / F.col("total")).alias("weight"))
    return rows.join(weights, [target, group])
