"""Evaluation over a long table of scores: one row for each row and condition (``condition``, ``family``, ``y``, ``score``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators import metrics as M

# The conditions of the robustness evaluation (name, transformation, severity).
CONDITIONS = [
    ("clean", "clean", 0.0), ("jpeg90", "jpeg", 90.0), ("jpeg70", "jpeg", 70.0), ("jpeg50", "jpeg", 50.0), ("jpeg30", "jpeg", 30.0), ("blur0.5", "blur", 0.5), ("blur1", "blur", 1.0), ("blur2", "blur", 2.0),
    ("resize_half", "resize", 0.5), ("resize_quarter", "resize", 0.25), ("noise0.02", "noise", 0.02), ("noise0.05", "noise", 0.05), ("noise0.10", "noise", 0.10), ("color20", "color", 0.2), ("crop80", "crop", 0.8),
]


def condition_table(spark) -> DataFrame:
    """The conditions, numbered; rows meet them in a cross join with these 15 rows only."""
    return spark.createDataFrame([(a, b, s, i) for i, (a, b, s) in enumerate(CONDITIONS)], "condition string, family string, severity double, k int")


def ovr_macro_auroc(rows: DataFrame, target: str, scores: str, classes: int) -> DataFrame:
    """Mean over the classes of the area of one against the rest, undefined ones left out; ``scores`` is an array."""
    each = rows.select(F.col(target).alias("t"), F.posexplode(F.slice(F.col(scores), 1, classes)).alias("class", "score")).withColumn("y", (F.col("t") == F.col("class")).cast("int"))
    return M.auroc(each, ["class"]).agg(F.avg("auroc").alias("macro_auroc"), F.count("auroc").alias("classes"))


def poisson(text: Column) -> Column:
    """A draw from the Poisson distribution of mean 1 by the digest of a text; 7 at most (one in 98,000 is more)."""
    u = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))
    out, term, total = F.lit(0), 1.0, 0.0
    for k in range(1, 8):
        term = 0.36787944117144233 if k == 1 else term / (k - 1)
        total += term
        out = out + F.when(u >= total, 1).otherwise(0)
    return out


def bootstrap_auroc(rows: DataFrame, group: str, draws: int = 200, seed: int = 42, score: str = "score", minus: str | None = None) -> DataFrame:
    """95 % interval of the area, groups being drawn whole; D8 with ``minus``: of the difference of two scores on the same draws.

    Each draw gives each group a Poisson count, the form of drawing with
    replacement that needs no number of groups and no order of them. Null in
    both ends if fewer than half of the draws are defined. Rows are summed by
    group and score first, draws by score before the shuffle.
    """
    def areas(column: str) -> DataFrame:
        tied = rows.where(F.col("y").isNotNull() & F.col(column).isNotNull()).groupBy(F.col(group).cast("string").alias("g"), F.col(column).alias("s")).agg(F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b"))
        drawn = tied.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("w", poisson(F.concat_ws(":", F.lit(seed), "i", F.coalesce("g", F.lit(""))))).where("w > 0")
        run = M.running(drawn.groupBy("i", "s").agg(F.sum(F.col("a") * F.col("w")).alias("p"), F.sum(F.col("b") * F.col("w")).alias("n")), ["i"], ["n"])
        sums = run.groupBy("i").agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"), F.sum(F.col("p") * (F.col("n_below") + F.col("n") / 2)).alias("won"))
        return sums.select("i", F.try_divide("won", (F.col("pos") * F.col("neg")).cast("double")).alias("v"))

    value = areas(score)
    if minus is not None:
        value = value.join(areas(minus).withColumnRenamed("v", "other"), "i").select("i", (F.col("v") - F.col("other")).alias("v"))
    v = value.agg(F.count("v").alias("finite"), F.sort_array(F.collect_list(F.round("v", 12))).alias("v"))
    at = lambda q: F.when(F.col("finite") >= draws // 2, F.element_at("v", (1 + F.bround(F.lit(q) * (F.col("finite") - 1))).cast("int")))
    return v.select("finite", at(0.025).alias("low"), at(0.975).alias("high"))


def condition_metrics(long: DataFrame, threshold: float) -> DataFrame:
    """A18 by condition: area, its drop from clean, and recalls and balanced accuracy at 0.5 and at the calibrated threshold."""
    area = M.auroc(long, ["condition", "family"]).select("condition", "family", "auroc")
    at = lambda t, tag: M.binary_summary(long, ["condition", "family"], threshold=t, undefined=0.0).select("condition", F.col("recall").alias(f"recall{tag}"), F.col("specificity").alias(f"specificity{tag}"), F.col("balanced_accuracy").alias(f"balanced{tag}"))
    both = area.join(at(0.5, ""), "condition").join(at(threshold, "_calibrated"), "condition")
    clean = area.where("condition = 'clean'").select(F.col("auroc").alias("clean"))
    return both.join(F.broadcast(clean), how="left").withColumn("auroc_drop", F.col("clean") - F.col("auroc")).drop("clean")


def robustness(per_condition: DataFrame) -> DataFrame:
    """Mean and worst over the transformed conditions, of each family and (family null) of all, with the worst condition's name."""
    t = per_condition.where("condition <> 'clean' and auroc is not null")
    worst = F.min(F.struct("auroc", "condition"))["condition"]
    values = [F.avg("auroc").alias("mean_auroc"), F.min("auroc").alias("worst_auroc"), worst.alias("worst_condition"), F.max("auroc_drop").alias("worst_drop"), F.min("balanced_calibrated").alias("worst_balanced")]
    return t.groupBy("family").agg(*values).unionAll(t.agg(*values).select(F.lit(None).cast("string"), "*"))


def generator_areas(clean: DataFrame, generator: str, least: int = 2) -> DataFrame:
    """Each generator's positives against all authentic rows, on clean scores, rounded to 4 digits; null with fewer than ``least`` of either.

    Each generator's rows meet the authentic sums of the ranges of scores, not
    the authentic rows: negatives are collapsed by score once.
    """
    known = clean.where(F.col("y").isNotNull() & F.col("score").isNotNull())
    negative = known.where("y = 0").groupBy(F.col("score").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("p"))
    positive = known.where("y = 1").groupBy(F.col("score").alias("s"), F.coalesce(F.col(generator), F.lit("unknown")).alias("g")).agg(F.count(F.lit(1)).alias("p"))
    scores = negative.select("s", "n").unionByName(positive.select("s", F.lit(0).alias("n"))).groupBy("s").agg(F.sum("n").alias("n"))
    below = M.running(scores, [], ["n"]).select("s", "n", "n_below", "n_all")
    sums = positive.join(below, "s").groupBy("g").agg(F.sum("p").alias("n_positives"), F.max("n_all").alias("negatives"), F.sum(F.col("p") * (F.col("n_below") + F.col("n") / 2)).alias("won"))
    enough = (F.col("n_positives") >= least) & (F.col("negatives") >= least)
    return sums.select(F.col("g").alias(generator), "n_positives", "negatives", F.when(enough, F.round(F.col("won") / (F.col("n_positives") * F.col("negatives")), 4)).alias("auroc"))


def domain_metrics(clean: DataFrame, domain: str, threshold: float) -> DataFrame:
    """Each data set's area (null with fewer than two rows of either class) and recalls at the calibrated threshold."""
    area = M.auroc(clean, [domain]).select(domain, "n_pos", "n_neg", "auroc")
    s = M.binary_summary(clean, [domain], threshold=threshold, undefined=0.0).select(domain, "accuracy", "recall", "specificity", "balanced_accuracy")
    enough = (F.col("n_pos") >= 2) & (F.col("n_neg") >= 2)
    return area.join(s, domain).select(domain, (F.col("n_pos") + F.col("n_neg")).alias("n"), F.when(enough, F.round("auroc", 4)).alias("auroc"), "accuracy", *[F.when(enough, F.col(c)).alias(c) for c in ("recall", "specificity", "balanced_accuracy")])


def worst_of(table: DataFrame, name: str, value: str = "auroc") -> DataFrame:
    """The row with the smallest value, the first by name on ties."""
    return table.where(F.col(value).isNotNull()).orderBy(value, name).limit(1)


def probe(long: DataFrame, order: str, n: int, conditions: tuple[str, ...] = ("clean", "jpeg50", "blur2")) -> DataFrame:
    """Accuracy, balanced accuracy, recalls at 0.5 and area of the first ``n`` rows by ``order`` in a few conditions, and the mean area."""
    first = long.select(order).distinct().orderBy(order).limit(n)
    rows = long.where(F.col("condition").isin(*conditions)).join(first, order, "left_semi")
    s = M.binary_summary(rows, ["condition"], undefined=0.0).select("condition", "accuracy", "balanced_accuracy", "recall", "specificity", "f1")
    out = s.join(M.auroc(rows, ["condition"]).select("condition", "auroc"), "condition")
    return out.join(out.agg(F.avg("auroc").alias("mean_auroc")))


def student_gate(per_condition: DataFrame, teacher_clean: float, teacher_worst: float, least: float = 0.82) -> DataFrame:
    """Clean, worst and mean area, gaps to the teacher and the reasons that fail (recalls on clean, 2 points clean, 3 points worst)."""
    t = F.col("condition") != "clean"
    one = lambda c: F.max(F.when(~t, F.col(c)))
    s = per_condition.agg(one("auroc").alias("clean"), one("recall_calibrated").alias("recall"), one("specificity_calibrated").alias("specificity"), F.min(F.when(t, F.col("auroc"))).alias("worst"), F.avg(F.when(t, F.col("auroc"))).alias("mean"))
    gaps = s.withColumns({"clean_gap": teacher_clean - F.col("clean"), "worst_gap": teacher_worst - F.col("worst")})
    rules = [("ai_positive_recall", F.col("recall") < least), ("authentic_recall", F.col("specificity") < least), ("clean_gap", F.col("clean_gap") > 0.02), ("worst_gap", F.col("worst_gap") > 0.03)]
    return gaps.withColumn("failed", failed(rules)).withColumn("passed", F.size("failed") == 0)


def failed(rules: list[tuple[str, Column]]) -> Column:
    """Names of the rules that hold, in order; an undefined rule counts as failed."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), name) for name, c in rules]))


def all_passed(gates: DataFrame, keys: list[str], passed: str = "passed") -> DataFrame:
    """Whether all gates of a report passed; null counts as failed."""
    return gates.groupBy(*keys).agg(F.bool_and(F.coalesce(F.col(passed), F.lit(False))).alias("passed"), F.count(F.lit(1)).alias("gates"))


def rank_checkpoints(reports: DataFrame) -> DataFrame:
    """Passed first, then clean, worst and mean area and balanced accuracy (missing is 0), then the path."""
    order = [F.coalesce("passed", F.lit(False)).desc(), *[F.coalesce(c, F.lit(0.0)).desc() for c in ("clean", "worst", "mean", "balanced")], F.coalesce("path", F.lit("")).asc()]
    return reports.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def rank_students(reports: DataFrame) -> DataFrame:
    """Passed, clean, worst, mean; the name breaks ties here, so that the order is always the same."""
    return reports.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("passed"), F.desc("clean"), F.desc("worst"), F.coalesce("mean", F.lit(0.0)).desc(), "name")))


def guarded_best(candidates: DataFrame, keys: list[str], name: str, score: str, recalls: tuple[str, str], least: float = 0.60) -> DataFrame:
    """Each key's candidate with the best score among those whose recalls both reach ``least``; if none does, the first by name."""
    ok = (F.col(recalls[0]) >= least) & (F.col(recalls[1]) >= least)
    best = F.min_by(name, F.struct(F.when(ok, -F.col(score)).otherwise(F.lit(float("inf"))), F.col(name)))
    return candidates.groupBy(*keys).agg(best.alias(name), F.bool_or(ok).alias("guarded"))


def family_histogram(rows: DataFrame, family: str, families: DataFrame) -> DataFrame:
    """How often each family is the hardest; those that never are count 0."""
    return families.join(rows.groupBy(family).agg(F.count(F.lit(1)).alias("n")), family, "left").select(family, F.coalesce("n", F.lit(0)).alias("n"))


def acquisition_counts(tasks: DataFrame, source: str, registry: DataFrame | None = None) -> DataFrame:
    """Saved, skipped and failed tasks of each source and (source null) of all.

    ``status`` is saved, skipped or error; with a registry, tasks of a source
    that it doesn't list are errors whatever they say.
    """
    status = F.col("status")
    if registry is not None:
        tasks = tasks.join(registry.select(F.col(source).alias("__known")).distinct(), F.col(source) == F.col("__known"), "left")
        status = F.when(F.col("__known").isNull(), "error").otherwise(status)
    t = tasks.withColumn("__status", status)
    counts = [F.count_if(F.col("__status") == s).alias(s) for s in ("saved", "skipped", "error")]
    return t.groupBy(source).agg(*counts).unionAll(t.agg(*counts).select(F.lit(None).cast(dict(t.dtypes)[source]), "*"))


# Which operators of a graph quantisation changes, and which hold the weights.
OPERATIONS = {"MatMul": "linear", "Gemm": "linear", "Conv": "convolution", "Softmax": "keep_float", "LayerNormalization": "keep_float", "Sigmoid": "keep_float"}


def operation_histogram(nodes: DataFrame, kind: str = "op_type") -> DataFrame:
    """How often each type of operation occurs, and its class for quantisation."""
    named = F.create_map(*[F.lit(x) for kv in OPERATIONS.items() for x in kv])
    return nodes.groupBy(kind).agg(F.count(F.lit(1)).alias("n")).withColumn("class", F.coalesce(F.try_element_at(named, F.col(kind)), F.lit("other")))


def latency_summary(runs: DataFrame, keys: list[str], seconds: str, items: str) -> DataFrame:
    """Items, seconds, items a second and milliseconds an item."""
    s = runs.groupBy(*keys).agg(F.sum(items).alias("items"), F.sum(seconds).alias("seconds"))
    return s.withColumns({"per_second": F.try_divide("items", "seconds"), "milliseconds": F.try_divide(F.col("seconds") * 1000, F.col("items"))})


def compare_outputs(rows: DataFrame, one: str, other: str, threshold: float, tolerance: float = 0.005) -> DataFrame:
    """Two scores of the same rows: areas, drop, recalls, largest and mean difference, and the gate on the drop.

    Recalls of an absent class are 1, and an undefined drop is 0.
    """
    area = lambda c, name: M.auroc(rows, [], score=c).select(F.col("auroc").alias(name))
    y, recall = F.col("y"), lambda c, pos: F.coalesce(F.avg(F.when(y == pos, ((F.col(c) >= threshold) == (pos == 1)).cast("double"))), F.lit(1.0))
    gap = F.abs(F.col(one) - F.col(other))
    s = rows.where(y.isNotNull()).agg(
        F.count(F.lit(1)).alias("samples"), recall(one, 1).alias("recall_one"), recall(one, 0).alias("authentic_one"), recall(other, 1).alias("recall_other"), recall(other, 0).alias("authentic_other"),
        F.coalesce(F.max(gap), F.lit(0.0)).alias("largest_gap"), F.coalesce(F.avg(gap), F.lit(0.0)).alias("mean_gap"),
    )
    out = s.join(area(one, "auroc_one")).join(area(other, "auroc_other"))
    return out.withColumn("drop", F.coalesce(F.col("auroc_one") - F.col("auroc_other"), F.lit(0.0))).withColumn("passed", F.col("drop") <= tolerance)


def compare_tracks(baseline: DataFrame, candidate: DataFrame, track: str, values: list[str]) -> DataFrame:
    """Candidate less baseline of each value, for tracks that both have."""
    b = baseline.select(track, *[F.col(v).alias(f"base_{v}") for v in values])
    return candidate.select(track, *values).join(b, track).select(track, *values, *[(F.col(v) - F.col(f"base_{v}")).alias(f"{v}_gain") for v in values])
