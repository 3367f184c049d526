"""Queries of evaluation, guards and selections, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import exprs as X
from cairn.operators import curate as C
from cairn.operators import evaluate as E
from cairn.operators import guards as G
from cairn.operators import metrics as M
from cairn.operators import select as S
from cairn.plans.manifest_queries import AUROC, BASE, SCORED, assigned, read, scored
from cairn.plans.registry import query

GRID = "cond AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {i})" for i, (a, b, _) in enumerate(E.CONDITIONS)) + ") c(condition, family, k)), grid AS (SELECT doc_id, dataset, generator, condition, family, y, greatest(0, score - k * 0.01::DOUBLE * (doc_id % 3)) AS score FROM scored, cond)"
RATES = """rates AS (SELECT {k}, count(*) FILTER (y = 1 AND score >= {t}) / nullif(count(*) FILTER (y = 1), 0)::DOUBLE AS rec, count(*) FILTER (y = 0 AND score < {t}) / nullif(count(*) FILTER (y = 0), 0)::DOUBLE AS spec,
 count(*) FILTER ((y = 1) = (score >= {t})) / count(*)::DOUBLE AS acc FROM {s} WHERE y IS NOT NULL GROUP BY {k})"""


def grid(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all documents in the 15 conditions."""
    c = F.broadcast(E.condition_table(spark).select("condition", "family", "k"))
    return scored(spark, d).join(c).withColumn("score", F.greatest(F.lit(0.0), F.col("score") - F.col("k") * F.lit(0.01) * F.pmod("doc_id", F.lit(3))))


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


CONDITION_SQL = f"""WITH {SCORED}, {GRID}, a AS ({AUROC.format(k="condition, family,", w="PARTITION BY condition, family", weight="1", t="grid", g="GROUP BY condition, family")}),
 {RATES.format(k="condition", t="0.5", s="grid")}, {RATES.format(k="condition", t="0.3", s="grid").replace("rates AS", "low AS")},
 m AS (SELECT a.condition, a.family, a.auroc, r.rec AS recall, r.spec AS specificity, (r.rec + r.spec) / 2 AS balanced, l.rec AS recall_calibrated, l.spec AS specificity_calibrated, (l.rec + l.spec) / 2 AS balanced_calibrated,
 (SELECT auroc FROM a WHERE condition = 'clean') - a.auroc AS auroc_drop FROM a JOIN rates r USING (condition) JOIN low l USING (condition))"""


@query("q61_condition_metrics", CONDITION_SQL + " SELECT condition, family, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("auroc", "recall", "specificity", "balanced", "recall_calibrated", "specificity_calibrated", "balanced_calibrated", "auroc_drop")) + " FROM m")
def q61(spark, d):
    """A18, J10."""
    m = E.condition_metrics(grid(spark, d), 0.3)
    return rounded(m.withColumns({c: F.round(c, 9) for c in ("auroc", "auroc_drop")}), 6)


@query("q62_robustness", CONDITION_SQL + """, v AS (SELECT * FROM m WHERE condition <> 'clean'), f AS (SELECT family, avg(auroc) AS mean_auroc, min(auroc) AS worst_auroc, min_by(condition, (round(auroc, 9), condition)) AS worst_condition, max(auroc_drop) AS worst_drop, min(balanced_calibrated) AS worst_balanced FROM v GROUP BY GROUPING SETS ((family), ()))
 SELECT family, round(mean_auroc, 8) AS mean_auroc, round(worst_auroc, 8) AS worst_auroc, worst_condition, round(worst_drop, 8) AS worst_drop, round(worst_balanced, 8) AS worst_balanced FROM f""")  # fmt: skip
def q62(spark, d):
    """A17, A18."""
    m = E.condition_metrics(grid(spark, d), 0.3)
    return rounded(E.robustness(m.withColumn("auroc", F.round("auroc", 9))), 8)


@query("q63_generator_areas", f"""WITH {SCORED}, g AS (SELECT generator, count(*) AS n_positives FROM scored WHERE y = 1 GROUP BY 1), o AS (SELECT g.generator, s.score, s.y FROM scored s JOIN g ON s.y = 0 OR s.y = 1 AND s.generator = g.generator),
 a AS ({AUROC.format(k="generator,", w="PARTITION BY generator", weight="1", t="o", g="GROUP BY generator")}) SELECT generator, n_positives, CASE WHEN n_positives >= 2 AND n_neg >= 2 THEN round(auroc, 4) END AS auroc FROM a JOIN g USING (generator)""")  # fmt: skip
def q63(spark, d):
    """A16, A18."""
    return E.generator_areas(scored(spark, d), "generator").drop("negatives")


DOMAIN_SQL = f"""WITH {SCORED}, a AS ({AUROC.format(k="dataset,", w="PARTITION BY dataset", weight="1", t="scored", g="GROUP BY dataset")}), {RATES.format(k="dataset", t="0.3", s="scored")},
 m AS (SELECT dataset, n_pos + n_neg AS n, n_pos >= 2 AND n_neg >= 2 AS ok, round(auroc, 4) AS area, acc, coalesce(rec, 0) AS rec, coalesce(spec, 0) AS spec FROM a JOIN rates USING (dataset)),
 t AS (SELECT dataset, n, CASE WHEN ok THEN area END AS auroc, round(acc, 9) AS accuracy, CASE WHEN ok THEN round(rec, 9) END AS recall, CASE WHEN ok THEN round(spec, 9) END AS specificity, CASE WHEN ok THEN round((rec + spec) / 2, 9) END AS balanced_accuracy FROM m)"""


@query("q64_domain_metrics", DOMAIN_SQL + " SELECT * FROM t")
def q64(spark, d):
    """A15, A18."""
    return rounded(E.domain_metrics(scored(spark, d), "dataset", 0.3))


@query("q65_worst_domain_of_two", DOMAIN_SQL + " SELECT dataset, n, auroc FROM t WHERE auroc IS NOT NULL ORDER BY auroc, dataset LIMIT 1")
def q65(spark, d):
    """A17."""
    return E.worst_of(E.domain_metrics(scored(spark, d), "dataset", 0.3), "dataset").select("dataset", "n", "auroc")


CLASSES = "(1 + y + q) % 3"


@query("q66_ovr_macro_auroc", f"""WITH {SCORED}, r AS (SELECT {CLASSES} AS t, [score, 1 - score, abs(score - 0.5::DOUBLE)] AS p FROM scored WHERE y IS NOT NULL), e AS (SELECT u.k AS class, (r.t = u.k)::INT AS y, p[u.k + 1] AS score FROM r, (VALUES (0), (1), (2)) u(k)),
 a AS ({AUROC.format(k="class,", w="PARTITION BY class", weight="1", t="e", g="GROUP BY class")}) SELECT round(avg(auroc), 8) AS macro_auroc, count(auroc) AS classes FROM a""")  # fmt: skip
def q66(spark, d):
    """A9."""
    rows = scored(spark, d).where("y is not null").select(((1 + F.col("y") + F.col("q")) % 3).alias("t"), F.array(F.col("score"), 1 - F.col("score"), F.abs(F.col("score") - 0.5)).alias("p"))
    return rounded(E.ovr_macro_auroc(rows, "t", "p", 3), 8)


def _poisson_sql(text: str) -> str:
    total, term, out = 0.0, 1.0, []
    for k in range(1, 8):
        term = 0.36787944117144233 if k == 1 else term / (k - 1)
        total += term
        out.append(f"(u >= {total!r}::DOUBLE)::INT")
    return f"(SELECT {' + '.join(out)} FROM (SELECT ('0x' || substr(sha256({text}), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u))"


def _draws_sql(score: str, name: str) -> str:
    return f"""{name}0 AS (SELECT duplicate_group AS g, {score} AS score, i, y, w FROM b JOIN weights USING (duplicate_group)), {name}1 AS (SELECT i, score, sum((y = 1)::INT * w) AS p, sum((y = 0)::INT * w) AS n FROM {name}0 WHERE w > 0 GROUP BY ALL),
 {name} AS (SELECT i, sum(p * (below + n / 2.0::DOUBLE)) / nullif(sum(p) * sum(n), 0) AS v FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY i ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {name}1) GROUP BY i)"""


BOOT = f"""WITH {SCORED}, b AS (SELECT substr(sha256(d.text), 1, 16) AS duplicate_group, s.score, s.y, 1 - abs(s.score - 0.4::DOUBLE) AS other FROM scored s JOIN documents d USING (doc_id) WHERE s.y IS NOT NULL),
 weights AS (SELECT duplicate_group, i, {_poisson_sql("'42:' || i || ':' || duplicate_group")} AS w FROM (SELECT DISTINCT duplicate_group FROM b), range(200) r(i)), {_draws_sql("score", "one")}"""
ENDS = """ SELECT finite, CASE WHEN finite >= 100 THEN round(v[1 + round_even(0.025 * (finite - 1), 0)::INT], 8) END AS low, CASE WHEN finite >= 100 THEN round(v[1 + round_even(0.975 * (finite - 1), 0)::INT], 8) END AS high FROM (SELECT count(v) AS finite, list(v ORDER BY v) FILTER (v IS NOT NULL) AS v FROM {0})"""


def grouped(spark: SparkSession, d: str) -> DataFrame:
    groups = read(spark, d, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("duplicate_group"))
    return scored(spark, d).join(groups, "doc_id").withColumn("other", 1 - F.abs(F.col("score") - 0.4))


@query("q10_bootstrap_ci", BOOT + ENDS.format("one"))
def q10(spark, d):
    """200 draws of duplicate groups, undefined if fewer than half have both classes."""
    return rounded(E.bootstrap_auroc(grouped(spark, d), "duplicate_group"), 8)


@query("q67_paired_bootstrap", BOOT + ", " + _draws_sql("other", "two") + ", diff AS (SELECT one.v - two.v AS v FROM one JOIN two USING (i))" + ENDS.format("diff"))
def q67(spark, d):
    """D8."""
    return rounded(E.bootstrap_auroc(grouped(spark, d), "duplicate_group", minus="other"), 8)


REPORTS = f"""WITH {SCORED}, a AS ({AUROC.format(k="dataset,", w="PARTITION BY dataset", weight="1", t="scored", g="GROUP BY dataset")}), {RATES.format(k="dataset", t="0.5", s="scored")},
 reports AS (SELECT 'runs/' || dataset AS path, n_pos >= 5 AS passed, round(auroc, 1) AS clean, round(auroc, 2) AS worst, auroc AS mean, (rec + spec) / 2 AS balanced FROM a JOIN rates USING (dataset))"""


def reports(spark: SparkSession, d: str) -> DataFrame:
    a = M.auroc(scored(spark, d), ["dataset"]).join(M.binary_summary(scored(spark, d), ["dataset"]).select("dataset", "balanced_accuracy"), "dataset")
    area = F.round("auroc", 9)
    return a.select(F.concat(F.lit("runs/"), "dataset").alias("path"), (F.col("n_pos") >= 5).alias("passed"), F.round(area, 1).alias("clean"), F.round(area, 2).alias("worst"), area.alias("mean"), F.col("balanced_accuracy").alias("balanced"))


@query("q68_rank_by_six_keys", REPORTS + " SELECT path, row_number() OVER (ORDER BY passed DESC, coalesce(clean, 0) DESC, coalesce(worst, 0) DESC, coalesce(mean, 0) DESC, coalesce(balanced, 0) DESC, path)::INT AS rank FROM reports")
def q68(spark, d):
    """W8."""
    return E.rank_checkpoints(reports(spark, d)).select("path", "rank")


@query("q69_rank_students", REPORTS + " SELECT path AS name, row_number() OVER (ORDER BY passed DESC, clean DESC NULLS LAST, worst DESC NULLS LAST, coalesce(mean, 0) DESC, path)::INT AS rank FROM reports")
def q69(spark, d):
    """W9."""
    return E.rank_students(reports(spark, d).withColumnRenamed("path", "name")).select("name", "rank")


@query("q70_guarded_best", f"""WITH {SCORED}, {GRID}, a AS ({AUROC.format(k="condition, family,", w="PARTITION BY condition, family", weight="1", t="grid", g="GROUP BY condition, family")}), {RATES.format(k="condition", t="0.35", s="grid")}
 SELECT family, min_by(condition, (CASE WHEN rec >= 0.6 AND spec >= 0.3 THEN -round(auroc, 9) ELSE 'inf'::DOUBLE END, condition)) AS condition, bool_or(rec >= 0.6 AND spec >= 0.3) AS guarded FROM a JOIN rates USING (condition) GROUP BY 1""")  # fmt: skip
def q70(spark, d):
    """W18; one recall is doubled, so that some pass."""
    g = grid(spark, d)
    m = M.auroc(g, ["condition", "family"]).join(M.binary_summary(g, ["condition", "family"], threshold=0.35).select("condition", "recall", (F.col("specificity") * 2).alias("double")), "condition").withColumn("auroc", F.round("auroc", 9))
    return E.guarded_best(m, ["family"], "condition", "auroc", ("recall", "double"))


@query("q71_probe", f"""WITH {SCORED}, {GRID}, few AS (SELECT * FROM grid WHERE condition IN ('clean', 'jpeg50', 'blur2') AND doc_id IN (SELECT doc_id FROM scored ORDER BY doc_id LIMIT 300)), a AS ({AUROC.format(k="condition,", w="PARTITION BY condition", weight="1", t="few", g="GROUP BY condition")}), {RATES.format(k="condition", t="0.5", s="few")}
 SELECT condition, round(acc, 8) AS accuracy, round((coalesce(rec, 0) + coalesce(spec, 0)) / 2, 8) AS balanced_accuracy, round(coalesce(rec, 0), 8) AS recall, round(coalesce(spec, 0), 8) AS specificity, round(auroc, 8) AS auroc, round((SELECT avg(auroc) FROM a), 8) AS mean_auroc FROM a JOIN rates USING (condition)""")  # fmt: skip
def q71(spark, d):
    """The first 300 rows are the probe."""
    return rounded(E.probe(grid(spark, d), "doc_id", 300).drop("f1"), 8)


@query("q72_student_gate", CONDITION_SQL + """, s AS (SELECT max(auroc) FILTER (condition = 'clean') AS clean, max(recall_calibrated) FILTER (condition = 'clean') AS recall, max(specificity_calibrated) FILTER (condition = 'clean') AS specificity, min(auroc) FILTER (condition <> 'clean') AS worst, avg(auroc) FILTER (condition <> 'clean') AS mean FROM m)
 SELECT round(clean, 8) AS clean, round(worst, 8) AS worst, round(mean, 8) AS mean, array_to_string(list_filter([CASE WHEN recall < 0.82 THEN 'ai_positive_recall' END, CASE WHEN specificity < 0.82 THEN 'authentic_recall' END, CASE WHEN 0.6 - clean > 0.02 THEN 'clean_gap' END, CASE WHEN 0.5 - worst > 0.03 THEN 'worst_gap' END], lambda x: x IS NOT NULL), ',') AS failed FROM s""")  # fmt: skip
def q72(spark, d):
    """A29, A32."""
    out = E.student_gate(E.condition_metrics(grid(spark, d), 0.3), 0.6, 0.5)
    return rounded(out.select("clean", "worst", "mean", F.array_join("failed", ",").alias("failed")), 8)


@query("q73_gates_all_passed", f"WITH {SCORED} SELECT dataset, bool_and(coalesce(score >= 0.05, false)) AS passed, count(*) AS gates FROM scored GROUP BY 1")
def q73(spark, d):
    """A30."""
    return E.all_passed(scored(spark, d).withColumn("ok", F.col("score") >= 0.05), ["dataset"], "ok")


@query("q74_hardest_histogram", "WITH h AS (SELECT list_element(['jpeg', 'blur', 'noise'], (o_orderkey % 3)::INT + 1) AS family FROM orders) SELECT f.family, count(h.family) AS n FROM (VALUES ('jpeg'), ('blur'), ('noise'), ('crop'), ('color')) f(family) LEFT JOIN h ON f.family = h.family GROUP BY 1")
def q74(spark, d):
    """A22."""
    h = read(spark, d, "orders").select(F.element_at(F.array(*[F.lit(x) for x in ("jpeg", "blur", "noise")]), (F.col("o_orderkey") % 3).cast("int") + 1).alias("family"))
    return E.family_histogram(h, "family", spark.createDataFrame([(x,) for x in ("jpeg", "blur", "noise", "crop", "color")], "family string"))


TASKS = "t AS (SELECT event_type AS source, list_element(['saved', 'saved', 'skipped', 'error'], (event_id % 4)::INT + 1) AS status FROM events)"


def tasks(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.col("event_type").alias("source"), F.element_at(F.array(*[F.lit(x) for x in ("saved", "saved", "skipped", "error")]), (F.col("event_id") % 4).cast("int") + 1).alias("status"))


@query("q75_acquisition_counts", f"""WITH {TASKS}, r AS (SELECT DISTINCT source FROM t WHERE source <= 'm'), c AS (SELECT source, CASE WHEN source IN (SELECT source FROM r) THEN status ELSE 'error' END AS status FROM t)
 SELECT source, count(*) FILTER (status = 'saved') AS saved, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'error') AS error FROM c GROUP BY GROUPING SETS ((source), ())""")  # fmt: skip
def q75(spark, d):
    """Sources after m aren't in the registry."""
    t = tasks(spark, d)
    return E.acquisition_counts(t, "source", t.select("source").where("source <= 'm'").distinct())


@query("q76_compare_outputs", f"""WITH {SCORED}, r AS (SELECT y, score, round(score * 16, 0) / 16 AS other FROM scored WHERE y IS NOT NULL), a AS ({AUROC.format(k="", w="", weight="1", t="r", g="")}), o AS (SELECT y, other AS score FROM r), b AS ({AUROC.format(k="", w="", weight="1", t="o", g="")}),
 s AS (SELECT count(*) AS samples, count(*) FILTER (y = 1 AND score >= 0.4) / count(*) FILTER (y = 1)::DOUBLE AS recall_one, count(*) FILTER (y = 0 AND score < 0.4) / count(*) FILTER (y = 0)::DOUBLE AS authentic_one, count(*) FILTER (y = 1 AND other >= 0.4) / count(*) FILTER (y = 1)::DOUBLE AS recall_other, count(*) FILTER (y = 0 AND other < 0.4) / count(*) FILTER (y = 0)::DOUBLE AS authentic_other, max(abs(score - other)) AS largest_gap, avg(abs(score - other)) AS mean_gap FROM r)
 SELECT samples, round(recall_one, 8) AS recall_one, round(authentic_one, 8) AS authentic_one, round(recall_other, 8) AS recall_other, round(authentic_other, 8) AS authentic_other, round(largest_gap, 8) AS largest_gap, round(mean_gap, 8) AS mean_gap, round(a.auroc, 8) AS auroc_one, round(b.auroc, 8) AS auroc_other, a.auroc - b.auroc <= 0.005 AS passed FROM s, a, b""")  # fmt: skip
def q76(spark, d):
    """A21, A33, J13."""
    rows = scored(spark, d).withColumn("other", F.round(F.col("score") * 16, 0) / 16)
    return rounded(E.compare_outputs(rows, "score", "other", 0.4).drop("drop"), 8)


@query("q77_latency", "SELECT event_type, count(*) AS items, round(sum(value), 6) AS seconds, round(count(*) / nullif(sum(value), 0), 6) AS per_second, round(sum(value) * 1000 / count(*), 4) AS milliseconds FROM events GROUP BY 1")
def q77(spark, d):
    """A27."""
    out = E.latency_summary(read(spark, d, "events").withColumn("one", F.lit(1)), ["event_type"], "value", "one")
    return out.select("event_type", "items", F.round("seconds", 6).alias("seconds"), F.round("per_second", 6).alias("per_second"), F.round("milliseconds", 4).alias("milliseconds"))


NODES = ["MatMul", "Gemm", "Conv", "Softmax", "Add", "Sigmoid", "Reshape"]


@query("q78_operation_histogram", f"WITH n AS (SELECT list_element({NODES!r}, (p_partkey % 7)::INT + 1) AS op_type FROM part) SELECT op_type, count(*) AS n, CASE WHEN op_type IN ('MatMul', 'Gemm') THEN 'linear' WHEN op_type = 'Conv' THEN 'convolution' WHEN op_type IN ('Softmax', 'Sigmoid') THEN 'keep_float' ELSE 'other' END AS class FROM n GROUP BY 1")
def q78(spark, d):
    """A26, on part numbers as nodes: graphs aren't among the tables."""
    return E.operation_histogram(read(spark, d, "part").select(F.element_at(F.array(*[F.lit(x) for x in NODES]), (F.col("p_partkey") % 7).cast("int") + 1).alias("op_type")))


@query("q33_coverage_shards", """WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('42:0:' || doc_id), doc_id) - 1 AS position FROM documents), n AS (SELECT count(*) AS total, ceil(count(*) / 7.0)::BIGINT * 7 AS length FROM documents),
 l AS (SELECT doc_id, position, false AS padding FROM p UNION ALL SELECT doc_id, position + total, true FROM p, n WHERE position + total < length) SELECT doc_id, position, (position % 7)::INT AS rank, position // 7 AS step, padding FROM l WHERE position // 7 >= 3""")  # fmt: skip
def q33(spark, d):
    """Seven ranks that resume after three steps."""
    return S.coverage_shards(read(spark, d, "documents"), "doc_id", 7, offset=3)


@query("q79_coverage_report", "WITH n AS (SELECT count(*) AS total, ceil(count(*) / 7.0)::BIGINT AS step FROM documents) SELECT step * 7 AS draws, total AS unique_rows, step * 7 - total AS padded, step AS shortest, step AS longest FROM n")
def q79(spark, d):
    """R2."""
    return S.coverage_report(S.coverage_shards(read(spark, d, "documents"), "doc_id", 7), "doc_id")


ELIGIBLE = BASE.replace("duplicate_group, 'img_'", "duplicate_group, CASE WHEN doc_id % 9 = 0 THEN 'src' || doc_id // 18 ELSE '' END AS source_image_group, 'img_'") + """, e AS (SELECT *, CASE WHEN label = 'Tampered' THEN 'tampered' WHEN label IN ('ai', 'fully_aigc') THEN 'fully_aigc' ELSE 'authentic' END AS provenance, (label NOT IN ('real', 'authentic'))::INT AS ai_positive FROM assigned)"""


def eligible(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("label") == "Tampered", "tampered").when(F.col("label").isin("ai", "fully_aigc"), "fully_aigc").otherwise("authentic")
    group = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("src"), F.floor(F.col("doc_id") / 18))).otherwise("")
    return assigned(spark, d).withColumns({"provenance": kind, "ai_positive": (~F.col("label").isin("real", "authentic")).cast("int"), "source_image_group": group})


@query("q31_calibration_selection", ELIGIBLE + """, s AS (SELECT *, count(*) OVER (PARTITION BY duplicate_group) AS nd, count(*) OVER (PARTITION BY sha256) AS ns, count(*) OVER (PARTITION BY source_image_group) AS ng FROM e),
 k AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN ai_positive = 0 THEN 'n' ELSE provenance END ORDER BY sha256('42:' || doc_id), doc_id) AS k FROM s WHERE nd = 1 AND ns = 1 AND (source_image_group = '' OR ng = 1)),
 o AS (SELECT * FROM k WHERE k <= CASE WHEN ai_positive = 0 THEN 20 ELSE 10 END), t AS (SELECT *, row_number() OVER (ORDER BY sha256('42:' || doc_id), doc_id) - 1 AS p FROM o)
 SELECT doc_id, provenance, 'calibration' AS split, list_element(['jpeg', 'blur', 'resize', 'noise', 'color', 'crop'], (p % 6)::INT + 1) AS calib_transformation, list_element([70.0, 1.0, 0.5, 0.05, 0.4, 0.75], (p % 6)::INT + 1)::DOUBLE AS calib_severity FROM t""")  # fmt: skip
def q31(spark, d):
    """40 rows, disjoint from the others; enough candidates of each kind are there, so the SQL needs no filling."""
    rows = eligible(spark, d)
    return S.calibration(rows, 40, id_="doc_id").select("doc_id", "provenance", "split", "calib_transformation", "calib_severity")


@query("q80_stratified_sample", "SELECT doc_id, source, row_number() OVER (ORDER BY h, doc_id) - 1 AS position FROM (SELECT doc_id, source, sha256('42:' || doc_id) AS h, row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || doc_id), doc_id) AS k FROM documents) WHERE k <= 5")
def q80(spark, d):
    """W12."""
    return S.stratified(read(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 5)


@query("q81_balanced_cohort", """SELECT doc_id, lang, y, CASE WHEN k / 10.0::DOUBLE < 0.7 THEN 'train' WHEN k / 10.0::DOUBLE < 0.8 THEN 'validation' WHEN k / 10.0::DOUBLE < 0.9 THEN 'test' ELSE 'test_unseen' END AS split FROM
 (SELECT d.doc_id, d.lang, l.toxic AS y, row_number() OVER (PARTITION BY d.lang, l.toxic ORDER BY sha256('42:' || d.doc_id), d.doc_id) - 1 AS k FROM documents d JOIN labels l USING (doc_id)) WHERE k < 10""")  # fmt: skip
def q81(spark, d):
    """Four languages as strata and two classes."""
    rows = read(spark, d, "documents").select("doc_id", "lang").join(read(spark, d, "labels").select("doc_id", F.col("toxic").alias("y")), "doc_id")
    return S.balanced_cohort(rows, "lang", "y", "doc_id", 10)


DECLARED = """declared AS (SELECT doc_id, CASE WHEN doc_id % 31 = 5 THEN '../' ELSE '' END || source || '/' || lang || '_' || n_chars || '.png' AS path, CASE WHEN doc_id % 29 = 4 THEN 'DALL-E Advanced' ELSE source END AS tag, sha256(text) AS own, CASE WHEN doc_id % 23 = 3 THEN 0 ELSE strlen(text) END AS n_bytes,
 (n_chars % 700)::INT AS width, ((n_chars // 7) % 400)::INT AS height, (doc_id % 19 <> 2) AS readable, CASE WHEN doc_id % 17 = 1 THEN 'sha:' || doc_id ELSE sha256(text) END AS sha, CASE WHEN doc_id % 3 = 0 THEN 'masks/' || doc_id ELSE '' END AS mask, CASE WHEN doc_id % 12 = 0 THEN 0 ELSE 9 END AS mask_bytes, (doc_id % 15 <> 0) AS mask_readable, (n_chars % 700)::INT + (doc_id % 21 = 0)::INT AS mask_width FROM documents),
 tagged AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY doc_id) > 1 AS again FROM declared)"""


def declared(spark: SparkSession, d: str) -> DataFrame:
    id_, n, sha = F.col("doc_id"), F.col("n_chars"), F.sha2("text", 256)
    rows = read(spark, d, "documents").select(
        "doc_id", F.concat(F.when(id_ % 31 == 5, "../").otherwise(""), "source", F.lit("/"), "lang", F.lit("_"), "n_chars", F.lit(".png")).alias("path"), F.when(id_ % 29 == 4, "DALL-E Advanced").otherwise(F.col("source")).alias("tag"),
        sha.alias("own"), F.when(id_ % 23 == 3, 0).otherwise(F.octet_length("text")).alias("n_bytes"), (n % 700).cast("int").alias("width"), (F.floor(n / 7) % 400).cast("int").alias("height"), (id_ % 19 != 2).alias("readable"),
        F.when(id_ % 17 == 1, F.concat(F.lit("sha:"), id_)).otherwise(sha).alias("sha"), F.when(id_ % 3 == 0, F.concat(F.lit("masks/"), id_)).otherwise("").alias("mask"), F.when(id_ % 12 == 0, 0).otherwise(9).alias("mask_bytes"),
        (id_ % 15 != 0).alias("mask_readable"), ((n % 700) + (id_ % 21 == 0).cast("int")).cast("int").alias("mask_width"),
    )
    again = ~F.col("is_first")
    c = F.col
    return C.first_flags(rows, "own", "doc_id").withColumn("reason", S.exclusion_reason(c("path"), X.forbidden_reason(c("tag")), again, c("n_bytes"), c("width"), c("height"), F.lit(0.5), c("readable"), c("sha"), c("mask"), c("mask_bytes"), c("mask_readable"), c("mask_width"), c("height")))


TEN = f"""WITH {DECLARED} SELECT doc_id, CASE WHEN starts_with(path, '../') THEN 'unsafe_relative_path' WHEN tag = 'DALL-E Advanced' THEN 'forbidden_organizer_dalle_advanced_demo' WHEN again THEN 'exact_duplicate_row' WHEN n_bytes = 0 THEN 'missing_file_on_disk' WHEN NOT readable THEN 'corrupted_image_bytes'
 WHEN width < 16 OR height < 16 THEN 'image_too_small_or_flat' WHEN starts_with(sha, 'sha:') THEN 'placeholder_sha_on_disk' WHEN mask <> '' AND mask_bytes = 0 THEN 'missing_tamper_mask' WHEN mask <> '' AND NOT mask_readable THEN 'corrupted_tamper_mask' WHEN mask <> '' AND mask_width <> width THEN 'tamper_mask_dimension_mismatch' END AS reason FROM tagged"""


@query("q82_ten_checks", TEN)
def q82(spark, d):
    """The ten checks in order, W4 for repeated content."""
    return declared(spark, d).select("doc_id", "reason")


@query("q83_declared_is_eligible_plus_excluded", f"SELECT count(*) AS declared, count(*) FILTER (reason IS NULL) AS eligible, count(reason) AS excluded, count(DISTINCT reason) AS reasons FROM ({TEN})")
def q83(spark, d):
    """The guards pass, and the counts."""
    rows = declared(spark, d)
    keep, gone = rows.where("reason is null"), rows.where("reason is not null")
    G.partitioned(rows, G.not_empty(keep), gone, "doc_id")
    return rows.agg(F.count(F.lit(1)).alias("declared"), F.count_if(F.col("reason").isNull()).alias("eligible"), F.count("reason").alias("excluded"), F.count_distinct("reason").alias("reasons"))


@query("q84_shared_report", f"""{BASE}, a AS (SELECT * FROM assigned WHERE split = 'train'), b AS (SELECT * FROM assigned WHERE split = 'test'), k AS (SELECT 'sha256' AS key, v FROM (SELECT sha256 AS v FROM a INTERSECT SELECT sha256 FROM b) UNION ALL SELECT 'image_path', v FROM (SELECT image_path AS v FROM a INTERSECT SELECT image_path FROM b) UNION ALL SELECT 'doc_id', v FROM (SELECT doc_id::VARCHAR AS v FROM a INTERSECT SELECT doc_id::VARCHAR FROM b)),
 s AS (SELECT key, count(*) AS shared, array_to_string(list_slice(list(v ORDER BY v), 1, 5), ',') AS sample FROM k GROUP BY 1) SELECT n.key, coalesce(shared, 0) AS shared, coalesce(sample, '') AS sample FROM (VALUES ('sha256'), ('image_path'), ('doc_id')) n(key) LEFT JOIN s USING (key)""")  # fmt: skip
def q84(spark, d):
    """J9, U4."""
    rows = assigned(spark, d)
    out = G.shared_report(rows.where("split = 'train'"), rows.where("split = 'test'"), ["sha256", "image_path", "doc_id"])
    return out.withColumn("sample", F.array_join("sample", ","))


@query("q85_records", f"""{BASE} SELECT doc_id::VARCHAR AS row_id, split, 'data/' || image_path AS image_path, CASE WHEN label IN ('real', 'authentic') THEN 0 WHEN label = 'Tampered' THEN 1 ELSE 2 END AS label, (label NOT IN ('real', 'authentic'))::INT AS ai_positive, dataset, trim(generator) AS generator, generator_family, duplicate_group, doc_id::VARCHAR AS source_image_group FROM assigned""")
def q85(spark, d):
    """P4."""
    return S.records(assigned(spark, d).withColumn("row_id", F.col("doc_id").cast("string")), ["doc_id"], root="data")


@query("q86_anti_and_fan_out", "WITH w AS (SELECT p_partkey AS destination, p_size * 100 AS l_orderkey FROM part), n AS (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1) SELECT destination, l_orderkey, lines FROM w LEFT JOIN n USING (l_orderkey) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def q86(spark, d):
    """J7, J8."""
    wanted = read(spark, d, "part").select(F.col("p_partkey").alias("destination"), (F.col("p_size") * 100).cast("long").alias("l_orderkey"))
    lines = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    gone = read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return S.without(S.fan_out(lines, wanted, ["l_orderkey"]), gone, "l_orderkey").select("destination", "l_orderkey", "lines")


@query("q87_needed", "WITH f AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1) SELECT q.lang, need, coalesce(n, 0) AS found, greatest(0, need - coalesce(n, 0)) AS missing FROM (VALUES ('en', 10::BIGINT), ('de', 100000::BIGINT), ('xx', 5::BIGINT)) q(lang, need) LEFT JOIN f USING (lang)")
def q87(spark, d):
    """D7."""
    return S.needed(read(spark, d, "documents"), spark.createDataFrame([("en", 10), ("de", 100_000), ("xx", 5)], "lang string, need long"), ["lang"])


@query("q88_scalar_rules", """SELECT doc_id, CASE WHEN n_chars % 100 / 100.0::DOUBLE >= 0.5 THEN 'AIGC' ELSE 'AUTHENTIC' END AS verdict, greatest(n_chars % 100 / 100.0::DOUBLE, 1 - n_chars % 100 / 100.0::DOUBLE) >= 0.9 AS confident,
 round(CASE WHEN doc_id < 100 THEN (doc_id + 1) / 100.0::DOUBLE ELSE 0.5 * (1 + cos(pi() * least(1.0, (doc_id - 100) / 900.0::DOUBLE))) END, 9) AS rate, (n_chars % 1500 >= 512 AND greatest(n_chars % 1500, 600) / least(n_chars % 1500, 600)::DOUBLE <= 3 AND strlen(text) >= 400) AS quality,
 round(0.5::DOUBLE * (n_chars % 7) + 0.25 * (n_chars % 5) + 0.2 * (n_chars % 3) + 0.05 * (n_chars % 2), 9) AS selection, regexp_full_match(sha256(text), '[0-9a-f]{64}') AS digest, coalesce(json_extract_string(j, '$.b.c'), json_extract_string(j, '$.a')) AS first_path
 FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN '{"b": {"c": "x"}, "a": "y"}' ELSE '{"a": "z"}' END AS j FROM documents)""")  # fmt: skip
def q88(spark, d):
    """P17, P19, P23, P24, P25, D1, D5."""
    n, id_ = F.col("n_chars"), F.col("doc_id")
    p = (n % 100) / F.lit(100.0)
    w = (n % 1500).cast("int")
    j = F.when(id_ % 2 == 0, '{"b": {"c": "x"}, "a": "y"}').otherwise('{"a": "z"}')
    return read(spark, d, "documents").select(
        "doc_id", X.verdict(p, 0.5).alias("verdict"), X.is_confident(p, 0.9).alias("confident"), F.round(X.learning_rate(id_, 100, 1000), 9).alias("rate"), (X.passes_quality(w, F.lit(600), F.octet_length("text"), least_bytes=400) & (w >= 512)).alias("quality"),
        F.round(X.selection_score("poc", n % 7, n % 5, n % 3, n % 2), 9).alias("selection"), X.is_sha256(F.sha2("text", 256)).alias("digest"), X.first_json(j, "$.b.c", "$.a").alias("first_path"),
    )


@query("q89_cohort", "SELECT page_id FROM pages WHERE ' ' || replace(replace(url, '/', ' '), '.', ' ') || ' ' LIKE '% com %' AND page_id BETWEEN 10 AND 2000 AND page_id % 10 >= 3 AND page_id % 2 = 0")
def q89(spark, d):
    """D4."""
    p = read(spark, d, "pages").withColumns({"tags": F.replace(F.replace("url", F.lit("/"), F.lit(" ")), F.lit("."), F.lit(" ")), "score": F.col("page_id") % 10, "rating": F.lit("g"), "created": F.lit("2024-01-01")})
    keep = X.cohort(F.col("page_id"), F.col("tags"), F.col("score"), F.col("rating"), F.col("created"), tag="com", low=10, high=2000, floor=3, ratings=["g", "s"], before="2025-01-01", modulo=2, rest=0)
    return p.where(keep).select("page_id")


@query("q90_unseen_with_lost_groups", """SELECT doc_id, CASE WHEN g IS NULL THEN split ELSE min(split) OVER (PARTITION BY g) END AS split FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id // 5 END AS g, CASE WHEN doc_id % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM documents) WHERE true""")
def q90(spark, d):
    """W5 on rows some of which have no group: test is held out more than train, and first by name."""
    rows = read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, None).otherwise(F.floor(F.col("doc_id") / 5)).alias("g"), F.when(F.col("doc_id") % 3 == 0, "test").otherwise("train").alias("split"))
    return C.unify_splits(rows, "g").select("doc_id", "split")
