"""Queries: the manifest operators on tables shaped like manifests, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import exprs as X
from cairn.operators import curate as C
from cairn.operators import evaluate as E
from cairn.operators import metrics as M
from cairn.plans.registry import query


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as scored rows; ``y`` is null where no label covers the row."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("dataset"), F.col("lang").alias("generator"), "n_chars")
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y"), F.col("quality").alias("q"))
    score = F.pmod(F.col("n_chars") * 37 + F.col("doc_id") * 11, F.lit(1000)) / F.lit(1000.0)
    return d.join(labels, "doc_id", "left").withColumn("score", score)


SCORED = "scored AS (SELECT d.doc_id, d.source AS dataset, d.lang AS generator, d.n_chars, l.toxic AS y, l.quality AS q, ((d.n_chars*37 + d.doc_id*11) % 1000) / 1000.0::DOUBLE AS score FROM documents d LEFT JOIN labels l USING (doc_id))"

NAMES = ["sd-1", "Midjourney", " Stable Diffusion v2 ", "", "DALL-E 2", "flux.1 dev", "GPT 4o image"]
SPLITS = ["train", "Validation", "testing", "dev", "train", "test_unseen", "train", "val"]
KINDS = ["real", "fully_aigc", "Tampered", "ai", "authentic"]


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as manifest rows; the text's digest is the content hash and names the duplicate group."""
    d = read(spark, sf_dir, "documents")
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(by, F.lit(len(values))).cast("int") + 1)
    sha = F.sha2("text", 256)
    return d.select(
        "doc_id", F.col("source").alias("dataset"), pick(NAMES, F.col("doc_id")).alias("generator"), pick(SPLITS, F.col("doc_id") + F.floor(F.col("doc_id") / 8)).alias("official_split"),
        pick(KINDS, F.col("doc_id") + F.col("n_chars")).alias("label"), sha.alias("sha256"), F.substring(sha, 1, 16).alias("duplicate_group"),
        F.concat(F.lit("img_"), F.col("doc_id")).alias("external_id"), F.concat("source", F.lit("/"), "lang", F.lit("_"), F.col("n_chars"), F.lit(".png")).alias("image_path"), "n_chars", "lang",
    )


def _pick(values: list[str], by: str) -> str:
    return f"list_element([{', '.join(repr(v) for v in values)}], (({by}) % {len(values)})::INT + 1)"


MANIFEST = f"""manifest AS (SELECT doc_id, source AS dataset, {_pick(NAMES, "doc_id")} AS generator, {_pick(SPLITS, "doc_id + doc_id // 8")} AS official_split,
 {_pick(KINDS, "doc_id + n_chars")} AS label, sha256(text) AS sha256, substr(sha256(text), 1, 16) AS duplicate_group, 'img_' || doc_id AS external_id,
 source || '/' || lang || '_' || n_chars || '.png' AS image_path, n_chars, lang FROM documents)"""
ALIAS_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in X.ALIASES.items()) + "}"
HELD = "(" + ", ".join(f"'{x}'" for x in X.HELD_OUT) + ")"
SLUG = "trim(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '_', 'g'), '_')"
FAMILY = f"""family AS (SELECT *, CASE WHEN slug = '' THEN coalesce(nullif({SLUG.format("dataset")}, ''), 'unknown') || '_unknown' ELSE coalesce(({ALIAS_MAP})[slug], slug) END AS generator_family
 FROM (SELECT *, {SLUG.format("generator")} AS slug FROM manifest))"""
ASSIGNED = f"""assigned AS (SELECT *, CASE WHEN lower(official_split) = 'test_unseen' THEN 'test_unseen' WHEN lower(label) IN ('fully_aigc','aigc','ai') AND generator_family IN {HELD} THEN 'test_unseen'
 WHEN lower(official_split) IN ('test','testing') THEN 'test' WHEN lower(official_split) IN ('validation','val','dev') THEN 'validation' ELSE 'train' END AS split FROM family)"""
PRIO = "CASE split WHEN 'train' THEN 0 WHEN 'calibration' THEN 1 WHEN 'validation' THEN 2 WHEN 'test' THEN 3 ELSE 4 END"
BASE = f"WITH {MANIFEST}, {FAMILY}, {ASSIGNED}"


def with_family(m: DataFrame) -> DataFrame:
    return m.withColumn("generator_family", X.generator_family(F.col("generator"), F.col("dataset")))


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = with_family(manifest(spark, sf_dir))
    return m.withColumn("split", X.first_split(F.col("official_split"), F.col("label"), F.col("generator_family")))


AUROC = """SELECT {k} sum(p)::BIGINT AS n_pos, sum(n)::BIGINT AS n_neg, round(sum(p * (below + n / 2.0::DOUBLE)) / nullif(sum(p) * sum(n), 0), 9) AS auroc FROM
 (SELECT *, coalesce(sum(n) OVER ({w} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM
 (SELECT {k} score, sum((y = 1)::INT * {weight}) AS p, sum((y = 0)::INT * {weight}) AS n FROM {t} WHERE y IS NOT NULL GROUP BY {k} score)) {g}"""


@query("q01_auroc_by_source", f"WITH {SCORED} " + AUROC.format(k="dataset,", w="PARTITION BY dataset", weight="1", t="scored", g="GROUP BY dataset"))
def q01(spark, d):
    return M.auroc(scored(spark, d), ["dataset"]).withColumn("auroc", F.round("auroc", 9))


@query("q02_auprc", f"""WITH {SCORED} SELECT dataset, round(sum(p * (tp / (tp + fp))) / nullif(sum(p), 0), 9) AS auprc FROM (SELECT dataset, p, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM
 (SELECT dataset, score, sum((y = 1)::INT)::DOUBLE AS p, sum((y = 0)::INT)::DOUBLE AS n FROM scored WHERE y IS NOT NULL GROUP BY 1, 2) WINDOW w AS (PARTITION BY dataset ORDER BY score DESC)) GROUP BY 1""")
def q02(spark, d):
    return M.auprc(scored(spark, d), ["dataset"]).withColumn("auprc", F.round("auprc", 9))


@query("q03_confusion", f"WITH {SCORED} SELECT y AS actual, (score >= 0.5)::INT AS predicted, count(*) AS n FROM scored WHERE y IS NOT NULL GROUP BY 1, 2")
def q03(spark, d):
    return M.confusion(scored(spark, d).withColumn("hit", (F.col("score") >= 0.5).cast("int")), [], "y", "hit")


@query("q04_macro_f1_balanced_acc", f"""WITH {SCORED}, c AS (SELECT y AS a, (score >= 0.5)::INT AS p FROM scored WHERE y IS NOT NULL),
 k AS (SELECT c, (SELECT count(*) FROM c WHERE a = k.c AND p = k.c) AS tp, (SELECT count(*) FROM c WHERE a = k.c) AS na, (SELECT count(*) FROM c WHERE p = k.c) AS np FROM (VALUES (0), (1)) k(c))
 SELECT round(sum(coalesce(2.0::DOUBLE * tp / nullif(na + np, 0), 0)) / 2, 9) AS macro_f1, round(sum(coalesce(tp::DOUBLE / nullif(na, 0), 0)) / 2, 9) AS balanced_accuracy FROM k""")
def q04(spark, d):
    m = M.macro_f1(q03(spark, d), 2)
    return m.select(F.round("macro_f1", 9).alias("macro_f1"), F.round("balanced_accuracy", 9).alias("balanced_accuracy"))


def _summary(other: str) -> str:
    r = lambda a, b: f"round(coalesce(({a})::DOUBLE / nullif({b}, 0), {other}), 9)"
    x = lambda a, b: f"coalesce(({a})::DOUBLE / nullif({b}, 0), {other})"
    return f"""WITH {SCORED}, c AS (SELECT dataset, count(*) FILTER (y = 1 AND score >= 0.5) AS tp, count(*) FILTER (y = 1 AND score < 0.5) AS fn, count(*) FILTER (y = 0 AND score >= 0.5) AS fp,
 count(*) FILTER (y = 0 AND score < 0.5) AS tn FROM scored WHERE y IS NOT NULL GROUP BY 1) SELECT dataset, tp, fn, fp, tn, {r("tp + tn", "tp + tn + fp + fn")} AS accuracy, {r("tp", "tp + fn")} AS recall,
 {r("tn", "tn + fp")} AS specificity, round(({x("tp", "tp + fn")} + {x("tn", "tn + fp")}) / 2, 9) AS balanced_accuracy, {r("tp", "tp + fp")} AS precision, {r("2 * tp", "2 * tp + fp + fn")} AS f1 FROM c"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("q05_binary_summary_nulls", _summary("NULL"))
def q05(spark, d):
    return _rounded(M.binary_summary(scored(spark, d), ["dataset"]))


@query("q06_binary_summary_zeros", _summary("0"))
def q06(spark, d):
    return _rounded(M.binary_summary(scored(spark, d), ["dataset"], undefined=0.0))


RATES = """r AS (SELECT threshold, (SELECT count(*) FROM scored WHERE y = 1 AND score >= threshold)::DOUBLE / (SELECT count(*) FROM scored WHERE y = 1) AS tpr,
 (SELECT count(*) FROM scored WHERE y = 0 AND score < threshold)::DOUBLE / (SELECT count(*) FROM scored WHERE y = 0) AS tnr FROM grid)"""


@query("q07_calibrate_linspace", f"""WITH {SCORED}, b AS (SELECT min(score) + 0.0001 AS lo, max(score) - 0.0001 AS hi FROM scored WHERE y IS NOT NULL), grid AS (SELECT lo + (hi - lo) * i / 199.0::DOUBLE AS threshold, i FROM b, range(200) t(i)), {RATES}
 SELECT round(threshold, 6) AS threshold, round(tpr, 9) AS tpr, round(tnr, 9) AS tnr FROM r ORDER BY round((CASE WHEN tpr >= 0.9 AND tnr >= 0.9 THEN 0 ELSE greatest(0.9 - tpr, 0) + greatest(0.9 - tnr, 0) END), 9), round((tpr + tnr) / 2, 9) DESC, r.threshold LIMIT 1""")
def q07(spark, d):
    """200 thresholds; feasible ones by balanced accuracy, else the smallest deficit in recall."""
    rows = scored(spark, d)
    b = rows.where("y is not null").agg((F.min("score") + 0.0001).alias("lo"), (F.max("score") - 0.0001).alias("hi"))
    grid = b.select(F.explode(F.sequence(F.lit(0), F.lit(199))).alias("i"), "lo", "hi").select((F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / F.lit(199.0)).alias("threshold"))
    r = M.at_thresholds(rows, grid)
    short = lambda c: F.greatest(0.9 - F.col(c), F.lit(0.0))
    miss = F.when((F.col("tpr") >= 0.9) & (F.col("tnr") >= 0.9), 0.0).otherwise(short("tpr") + short("tnr"))
    best = r.orderBy(F.round(miss, 9), F.desc(F.round((F.col("tpr") + F.col("tnr")) / 2, 9)), "threshold").limit(1)
    return best.select(F.round("threshold", 6).alias("threshold"), F.round("tpr", 9).alias("tpr"), F.round("tnr", 9).alias("tnr"))


@query("q08_calibrate_grid", f"""WITH {SCORED}, grid AS (SELECT DISTINCT threshold FROM (SELECT 0.01 + i / 1000.0::DOUBLE AS threshold FROM range(981) t(i) UNION SELECT score FROM scored WHERE y IS NOT NULL)), {RATES}
 SELECT round(threshold, 6) AS threshold, round(tpr, 9) AS tpr, round(tnr, 9) AS tnr, tpr >= 0.9 AND tnr >= 0.9 AS feasible FROM r ORDER BY (tpr >= 0.9 AND tnr >= 0.9) DESC, round((tpr + tnr) / 2, 12) DESC,
 CASE WHEN tpr >= 0.9 AND tnr >= 0.9 THEN 0 ELSE round(least(tpr, tnr), 12) END DESC, round(abs(tpr - tnr), 12), round(abs(threshold - 0.5), 12), r.threshold LIMIT 1""")
def q08(spark, d):
    rows = scored(spark, d)
    grid = spark.range(981).select((F.lit(0.01) + F.col("id") / F.lit(1000.0)).alias("threshold")).unionByName(rows.where("y is not null").select(F.col("score").alias("threshold"))).distinct()
    return M.calibrate(M.at_thresholds(rows, grid), 0.9)


@query("q09_weighted_metrics", f"WITH {SCORED}, w AS (SELECT dataset, score, y, 1 + n_chars % 3 AS wt FROM scored) " + AUROC.format(k="dataset,", w="PARTITION BY dataset", weight="wt", t="w", g="GROUP BY dataset"))
def q09(spark, d):
    """A row counts as often as its weight says, without being repeated."""
    rows = scored(spark, d).withColumn("wt", 1 + F.pmod("n_chars", F.lit(3)))
    return M.auroc(rows, ["dataset"], weight=F.col("wt")).withColumn("auroc", F.round("auroc", 9))


@query("q11_normalize_generator", f"WITH {MANIFEST}, {FAMILY} SELECT doc_id, generator_family, generator_family IN {HELD} AS held_out FROM family")
def q11(spark, d):
    m = with_family(manifest(spark, d))
    return m.select("doc_id", "generator_family", X.is_held_out(F.col("generator_family")).alias("held_out"))


@query("q12_row_id", f"WITH {MANIFEST} SELECT doc_id, substr(sha256(official_split || ':' || dataset || ':' || doc_id || ':' || image_path || ':' || sha256 || ':' || external_id || ':'), 1, 32) AS row_id FROM manifest")
def q12(spark, d):
    c = F.col
    return manifest(spark, d).select("doc_id", X.row_id(c("official_split"), c("dataset"), c("doc_id"), c("image_path"), c("sha256"), c("external_id"), F.lit("")).alias("row_id"))


@query("q13_source_index_both", r"""WITH u AS (SELECT page_id, coalesce(url, '') AS url, 'x_' || page_id AS ext FROM pages) SELECT page_id, coalesce(nullif(regexp_extract(ext, '_(\d{1,9})\b', 1), ''), nullif(regexp_extract(url, '_(\d{1,9})\.', 1), ''), '')::BIGINT::VARCHAR AS loose,
 coalesce(nullif(regexp_extract(ext, '_(\d{5,8})\b', 1), ''), nullif(regexp_extract(url, '_(\d{5,8})\.', 1), ''), regexp_extract(ext, '(\d+)', 1))::BIGINT AS strict FROM u""")
def q13(spark, d):
    p = read(spark, d, "pages").select("page_id", "url", F.concat(F.lit("x_"), "page_id").alias("ext"))
    return p.select("page_id", X.source_index(F.col("ext"), F.col("url")).alias("loose"), X.source_index_strict(F.col("ext"), F.col("url")).alias("strict"))


@query("q14_safe_path", """WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_extract(url, '://[^/]*/(.*)$', 1) WHEN 1 THEN regexp_extract(url, '://[^/]*(/.*)$', 1) WHEN 2 THEN 'C:/' || page_id ELSE 'a/../' || page_id END AS p FROM pages)
 SELECT page_id, trim(p) <> '' AND NOT starts_with(trim(p), '/') AND NOT regexp_matches(trim(p), '^[a-zA-Z]:') AND NOT list_contains(string_split(trim(p), '/'), '..') AS safe FROM u""")
def q14(spark, d):
    part = lambda p: F.regexp_extract("url", p, 1)
    k = F.pmod("page_id", F.lit(4))
    p = F.when(k == 0, part("://[^/]*/(.*)$")).when(k == 1, part("://[^/]*(/.*)$")).when(k == 2, F.concat(F.lit("C:/"), "page_id")).otherwise(F.concat(F.lit("a/../"), "page_id"))
    return read(spark, d, "pages").select("page_id", X.is_safe_relative_path(p).alias("safe"))


TAGS = ["clean", "COCO_val-2017", "DALL-E 3 Advanced", "organizer_demo", "Newer Image Model Data(x)", "dalle3"]


@query("q15_forbidden_reason", f"""WITH u AS (SELECT page_id, lower({_pick(TAGS, "page_id")} || ' ' || url) AS t, regexp_replace(lower({_pick(TAGS, "page_id")} || ' ' || url), '[^a-z0-9]+', '', 'g') AS c FROM pages)
 SELECT page_id, CASE WHEN contains(t, 'newer image model data') THEN 'forbidden_newer_image_model_data_folder' WHEN contains(c, 'coco') AND contains(c, 'val2017') THEN 'forbidden_organizer_coco_val2017'
 WHEN contains(c, 'dalle') AND (contains(c, 'advanced') OR contains(c, 'dalle3')) THEN 'forbidden_organizer_dalle_advanced_demo' WHEN contains(c, 'organizerdemo') OR contains(t, 'organizer_demo') THEN 'forbidden_organizer_demo' ELSE '' END AS reason FROM u""")
def q15(spark, d):
    tag = F.element_at(F.array(*[F.lit(t) for t in TAGS]), F.pmod("page_id", F.lit(len(TAGS))).cast("int") + 1)
    return read(spark, d, "pages").select("page_id", X.forbidden_reason(tag, F.col("url")).alias("reason"))


@query("q16_placeholder_sha", f"WITH {MANIFEST} SELECT doc_id, doc_id % 5 = 0 OR doc_id % 7 = 0 AS placeholder FROM manifest")
def q16(spark, d):
    s = F.when(F.col("doc_id") % 5 == 0, " SHA:x").when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("sha256"))
    return manifest(spark, d).select("doc_id", X.is_placeholder_sha(s).alias("placeholder"))


@query("q17_aspect_bucket", """SELECT doc_id, CASE WHEN n_chars % 640 = 0 OR length(source) = 0 THEN 'square' WHEN r BETWEEN 0.95 AND 1.05 THEN 'square' WHEN r >= 1.8 THEN 'wide' WHEN r > 1.05 THEN 'landscape' ELSE 'portrait' END AS bucket
 FROM (SELECT *, (n_chars % 640)::DOUBLE / 320 AS r FROM documents)""")
def q17(spark, d):
    return read(spark, d, "documents").select("doc_id", X.aspect_bucket(F.col("n_chars") % 640, F.lit(320)).alias("bucket"))


@query("q18_round_robin", "SELECT doc_id, list_element(['jpeg','blur','resize','noise','color','crop'], (doc_id % 6)::INT + 1) AS transform, list_element([70.0, 1.0, 0.5, 0.05, 0.4, 0.75]::DOUBLE[], (doc_id % 6)::INT + 1) AS severity FROM documents")
def q18(spark, d):
    t, s = X.in_turn(F.col("doc_id"))
    return read(spark, d, "documents").select("doc_id", t.alias("transform"), s.alias("severity"))


CHAIN = f"""{BASE}, ranked AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY doc_id) AS k FROM assigned), tagged AS (SELECT doc_id, dataset, CASE WHEN doc_id % 97 = 3 THEN 'unsafe_path' WHEN generator = 'DALL-E 2' AND n_chars % 11 = 0 THEN 'forbidden'
 WHEN k > 1 THEN 'exact_duplicate' WHEN n_chars < 100 THEN 'tiny' WHEN lang = 'fr' AND n_chars % 13 = 0 THEN 'missing' END AS reason FROM ranked)"""


def chain(spark, d) -> DataFrame:
    ranked = C.first_flags(assigned(spark, d), "sha256", "doc_id")
    c = F.col
    reason = C.first_reason([("unsafe_path", c("doc_id") % 97 == 3), ("forbidden", (c("generator") == "DALL-E 2") & (c("n_chars") % 11 == 0)), ("exact_duplicate", ~c("is_first")), ("tiny", c("n_chars") < 100), ("missing", (c("lang") == "fr") & (c("n_chars") % 13 == 0))])
    return ranked.withColumn("reason", reason).select("doc_id", "dataset", "reason")


@query("q19_exclusion_chain", CHAIN + " SELECT * FROM tagged")
def q19(spark, d):
    return chain(spark, d)


@query("q20_exclusion_summary", CHAIN + " SELECT dataset, reason, count(*) AS n, grouping(dataset)::BIGINT AS all_datasets, grouping(reason)::BIGINT AS all_reasons FROM tagged GROUP BY GROUPING SETS ((dataset, reason), (dataset), (reason), ())")
def q20(spark, d):
    sets = chain(spark, d).groupingSets([["dataset", "reason"], ["dataset"], ["reason"], []], "dataset", "reason")
    return sets.agg(F.count(F.lit(1)).alias("n"), F.grouping("dataset").cast("long").alias("all_datasets"), F.grouping("reason").cast("long").alias("all_reasons"))


@query("q21_cross_label_quarantine", f"{BASE} SELECT doc_id, duplicate_group FROM assigned WHERE duplicate_group IN (SELECT duplicate_group FROM assigned GROUP BY 1 HAVING count(DISTINCT label) > 1)")
def q21(spark, d):
    rows = assigned(spark, d)
    return rows.join(C.conflicting_groups(rows, "duplicate_group", "label"), "duplicate_group", "left_semi").select("doc_id", "duplicate_group")


@query("q22_exact_duplicates", f"WITH {MANIFEST} SELECT sha256, min(doc_id) AS first_id, count(*) AS copies FROM manifest GROUP BY 1 HAVING count(*) > 1")
def q22(spark, d):
    return manifest(spark, d).groupBy("sha256").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


def hashed_vectors(spark, d) -> DataFrame:
    """Signs of the first 20 components: a short hash, so that near pairs exist."""
    bit = lambda i: F.when(F.col("embedding")[i] > 0, F.lit(1 << i)).otherwise(F.lit(0))
    h = bit(0)
    for i in range(1, 20):
        h = h + bit(i)
    return read(spark, d, "embeddings").select("vec_id", "label", h.cast("long").alias("h"))


HASHED = "hashed AS (SELECT vec_id, label, (" + " + ".join(f"CASE WHEN embedding[{i + 1}] > 0 THEN {1 << i} ELSE 0 END" for i in range(20)) + ")::BIGINT AS h FROM embeddings)"
PAIRS = "pairs AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, bit_count(xor(a.h, b.h))::INT AS distance FROM hashed a JOIN hashed b ON a.vec_id < b.vec_id WHERE a.h <> b.h AND a.h <> 0 AND b.h <> 0 AND bit_count(xor(a.h, b.h)) <= 2)"


@query("q23_banded_hamming_pairs", f"WITH {HASHED}, {PAIRS} SELECT * FROM pairs")
def q23(spark, d):
    return C.banded_pairs(hashed_vectors(spark, d), "vec_id", "h", 2, 20)


@query("q25_split_max_priority", f"{BASE} SELECT doc_id, (SELECT max_by(split, {PRIO}) FROM assigned b WHERE b.duplicate_group = a.duplicate_group) AS split FROM assigned a")
def q25(spark, d):
    return C.unify_splits(assigned(spark, d), "duplicate_group").select("doc_id", "split")


@query("q26_split_min_priority", f"{BASE} SELECT doc_id, (SELECT min_by(split, {PRIO}) FROM assigned b WHERE b.duplicate_group = a.duplicate_group) AS split FROM assigned a")
def q26(spark, d):
    return C.unify_splits(assigned(spark, d), "duplicate_group", False).select("doc_id", "split")


@query("q27_assign_splits", f"""{BASE}, u AS (SELECT * EXCLUDE (split), max_by(split, {PRIO}) OVER (PARTITION BY duplicate_group) AS split, lower(label) IN ('fully_aigc','aigc','ai') AS syn FROM assigned),
 t AS (SELECT DISTINCT generator_family AS f FROM u WHERE split = 'train' AND syn), g AS (SELECT duplicate_group, bool_or(split = 'test_unseen') AS unseen, bool_or(syn AND generator_family IN (SELECT f FROM t)) AS known, bool_or(syn) AS anysyn FROM u GROUP BY 1)
 SELECT doc_id, CASE WHEN unseen AND known THEN 'test_seen' WHEN unseen AND NOT anysyn THEN 'test' ELSE split END AS split FROM u JOIN g USING (duplicate_group)""")
def q27(spark, d):
    rows = C.unify_splits(assigned(spark, d), "duplicate_group")
    return C.relabel_unseen(rows, "duplicate_group", "generator_family", F.lower("label").isin("fully_aigc", "aigc", "ai")).select("doc_id", "split")


@query("q28_group_leakage", f"{BASE} SELECT duplicate_group, count(DISTINCT split) AS n_values FROM assigned GROUP BY 1 HAVING count(DISTINCT split) > 1")
def q28(spark, d):
    return C.conflicting_groups(assigned(spark, d), "duplicate_group", "split")


@query("q29_family_leakage", f"{BASE} SELECT generator_family FROM assigned WHERE split = 'train' AND label <> 'real' INTERSECT SELECT generator_family FROM assigned WHERE split = 'test_unseen' AND label <> 'real'")
def q29(spark, d):
    rows = assigned(spark, d).where("label <> 'real'")
    return rows.where("split = 'train'").select("generator_family").intersect(rows.where("split = 'test_unseen'").select("generator_family"))


@query("q30_disjointness_audit", f"""{BASE} SELECT 'sha256' AS key, count(*) AS shared FROM (SELECT sha256 FROM assigned WHERE split = 'train' INTERSECT SELECT sha256 FROM assigned WHERE split <> 'train')
 UNION ALL SELECT 'duplicate_group', count(*) FROM (SELECT duplicate_group FROM assigned WHERE split = 'train' INTERSECT SELECT duplicate_group FROM assigned WHERE split <> 'train')
 UNION ALL SELECT 'image_path', count(*) FROM (SELECT image_path FROM assigned WHERE split = 'train' INTERSECT SELECT image_path FROM assigned WHERE split <> 'train')""")
def q30(spark, d):
    rows = assigned(spark, d)
    parts = [rows.where("split = 'train'").select(k).intersect(rows.where("split <> 'train'").select(k)).agg(F.lit(k).alias("key"), F.count(F.lit(1)).alias("shared")) for k in ("sha256", "duplicate_group", "image_path")]
    return C.union_all(parts)


@query("q32_sampling_weights", f"""WITH {SCORED}, s AS (SELECT y, dataset, count(*) AS size FROM scored WHERE y IS NOT NULL GROUP BY 1, 2), c AS (SELECT *, least(0.5::DOUBLE / (count(*) OVER (PARTITION BY y) * size), 5.0::DOUBLE * 0.5 / sum(size) OVER (PARTITION BY y)) AS raw FROM s),
 w AS (SELECT *, raw * 0.5 / sum(raw * size) OVER (PARTITION BY y) AS weight FROM c) SELECT doc_id, round(weight, 12) AS weight FROM scored JOIN w USING (y, dataset)""")
def q32(spark, d):
    return M.balanced_weights(scored(spark, d), "y", "dataset").select("doc_id", F.round("weight", 12).alias("weight"))


@query("q34_caps", f"WITH {MANIFEST} SELECT doc_id, dataset FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY doc_id) AS k FROM manifest) WHERE k <= 7")
def q34(spark, d):
    return C.capped(manifest(spark, d), "dataset", "doc_id", 7).select("doc_id", "dataset")


# Evaluation conditions with family and severity.
CONDITIONS = E.CONDITIONS
COND_SQL = "cond AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {i})" for i, (a, b, _) in enumerate(CONDITIONS)) + ") c(condition, family, k)), grid AS (SELECT condition, family, y, greatest(0, score - k * 0.01::DOUBLE * (doc_id % 3)) AS score FROM scored, cond)"


def grid(spark, d) -> DataFrame:
    """Rows by conditions; the condition table is a constant of eleven rows."""
    c = spark.createDataFrame([(a, b, i) for i, (a, b, _) in enumerate(CONDITIONS)], "condition string, family string, k int")
    return scored(spark, d).crossJoin(F.broadcast(c)).withColumn("score", F.greatest(F.lit(0.0), F.col("score") - F.col("k") * F.lit(0.01) * F.pmod("doc_id", F.lit(3))))


@query("q35_condition_grid", f"WITH {SCORED}, {COND_SQL}, a AS ({AUROC.format(k='condition, family,', w='PARTITION BY condition, family', weight='1', t='grid', g='GROUP BY condition, family')}) SELECT condition, family, auroc FROM a")
def q35(spark, d):
    return M.auroc(grid(spark, d), ["condition", "family"]).select("condition", "family", F.round("auroc", 9).alias("auroc"))


@query("q36_per_generator_ovr", f"WITH {SCORED}, o AS (SELECT g.generator, s.score, s.y FROM (SELECT DISTINCT generator FROM scored WHERE y = 1) g JOIN scored s ON s.y = 0 OR (s.y = 1 AND s.generator = g.generator)), a AS ({AUROC.format(k='generator,', w='PARTITION BY generator', weight='1', t='o', g='GROUP BY generator')}) SELECT generator, n_pos, n_neg, round(auroc, 4) AS auroc FROM a")
def q36(spark, d):
    """A generator's positives meet the sums of the negatives below each score."""
    return E.generator_areas(scored(spark, d), "generator", least=1).withColumnsRenamed({"n_positives": "n_pos", "negatives": "n_neg"})


@query("q37_family_rollup", f"WITH {SCORED}, {COND_SQL}, a AS ({AUROC.format(k='condition, family,', w='PARTITION BY condition, family', weight='1', t='grid', g='GROUP BY condition, family')}) SELECT family, condition, round(avg(auroc), 9) AS mean_auroc, round(min(auroc), 9) AS worst_auroc FROM a GROUP BY ROLLUP (family, condition)")
def q37(spark, d):
    return q35(spark, d).rollup("family", "condition").agg(F.round(F.avg("auroc"), 9).alias("mean_auroc"), F.round(F.min("auroc"), 9).alias("worst_auroc"))


@query("q38_worst_domain", f"WITH {SCORED}, a AS ({AUROC.format(k='dataset,', w='PARTITION BY dataset', weight='1', t='scored', g='GROUP BY dataset')}) SELECT min_by(dataset, (round(auroc, 9), dataset)) AS worst_dataset, round(min(auroc), 9) AS worst_auroc, round(avg(auroc), 9) AS mean_auroc FROM a WHERE auroc IS NOT NULL")
def q38(spark, d):
    a = q01(spark, d).where("auroc is not null")
    return a.agg(F.min_by("dataset", F.struct("auroc", "dataset")).alias("worst_dataset"), F.min("auroc").alias("worst_auroc"), F.round(F.avg("auroc"), 9).alias("mean_auroc"))


@query("q39_gate_reasons", _summary("NULL").replace("SELECT dataset, tp, fn", ", s AS (SELECT dataset, tp, fn") + """) SELECT dataset, array_to_string(list_filter([CASE WHEN recall IS NULL THEN 'recall_missing' WHEN recall < 0.5 THEN 'recall_low' END, CASE WHEN specificity < 0.5 THEN 'specificity_low' END], lambda x: x IS NOT NULL), ',') AS reasons,
 coalesce(recall >= 0.5, false) AND coalesce(specificity >= 0.5, true) AS passed FROM s""")
def q39(spark, d):
    """Reasons that fail; pass is none."""
    r = F.when(F.col("recall").isNull(), "recall_missing").when(F.col("recall") < 0.5, "recall_low")
    why = F.array_compact(F.array(r, F.when(F.col("specificity") < 0.5, "specificity_low")))
    return q05(spark, d).select("dataset", F.array_join(why, ",").alias("reasons"), (F.size(why) == 0).alias("passed"))


@query("q40_rank_checkpoints", f"WITH {SCORED}, a AS ({AUROC.format(k='dataset,', w='PARTITION BY dataset', weight='1', t='scored', g='GROUP BY dataset')}) SELECT dataset, row_number() OVER (ORDER BY coalesce(auroc >= 0.5, false) DESC, coalesce(auroc, 0) DESC, n_pos DESC, dataset) AS rank FROM a")
def q40(spark, d):
    w = Window.orderBy(F.desc(F.coalesce(F.col("auroc") >= 0.5, F.lit(False))), F.desc(F.coalesce("auroc", F.lit(0.0))), F.desc("n_pos"), "dataset")
    return q01(spark, d).select("dataset", F.row_number().over(w).cast("long").alias("rank"))


@query("q41_track_compare", f"WITH {SCORED} SELECT a.dataset, a.n AS base_n, b.n AS cand_n, round(b.m - a.m, 9) AS gain FROM (SELECT dataset, count(*) AS n, avg(score) AS m FROM scored WHERE (doc_id // 20) % 2 = 0 GROUP BY 1) a JOIN (SELECT dataset, count(*) AS n, avg(score) AS m FROM scored WHERE (doc_id // 20) % 2 = 1 GROUP BY 1) b USING (dataset)")
def q41(spark, d):
    """Both tracks in one pass."""
    s, even = scored(spark, d), F.floor(F.col("doc_id") / 20) % 2 == 0
    a = s.groupBy("dataset").agg(F.count_if(even).alias("base_n"), F.count_if(~even).alias("cand_n"), F.round(F.avg(F.when(~even, F.col("score"))) - F.avg(F.when(even, F.col("score"))), 9).alias("gain"))
    return a.where("base_n > 0 and cand_n > 0")


@query("q42_hardest_candidate", "SELECT o_custkey, max_by(o_orderkey, (o_totalprice, -o_orderkey)) AS hardest, max(o_totalprice) AS loss FROM orders GROUP BY 1")
def q42(spark, d):
    """The largest of each group, first on ties."""
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("hardest"), F.max("o_totalprice").alias("loss"))


@query("q43_topk_token_mean", "SELECT vec_id, round(list_avg(list_transform(list_slice(list_reverse_sort(embedding), 1, greatest(ceil(len(embedding) * 0.05), 1)::INT), lambda x: x::DOUBLE)), 9) AS top_mean FROM embeddings")
def q43(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.round(X.top_share_mean(F.col("embedding").cast("array<double>")), 9).alias("top_mean"))


@query("q44_cosine_consistency", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def q44(spark, d):
    e = read(spark, d, "embeddings")
    o = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(o, "vec_id").select("vec_id", F.round(X.cosine_similarity(F.col("embedding"), F.col("other")), 9).alias("cosine"))


@query("q45_token_grid", """SELECT p_partkey, h * w AS tokens, least(h, w) AS short_side FROM (SELECT p_partkey, min_by(h, (cost, h)) AS h, min_by(w, (cost, h)) AS w FROM (SELECT p_partkey, h, p_size // h AS w, round(abs(ln((p_size // h)::DOUBLE / h)), 9) AS cost FROM part, range(1, 51) t(h) WHERE p_size % h = 0) GROUP BY 1)""")
def q45(spark, d):
    g = X.token_grid(F.col("p_size"), F.lit(1.0))
    return read(spark, d, "part").select("p_partkey", g.alias("g")).select("p_partkey", (F.col("g.h") * F.col("g.w")).cast("long").alias("tokens"), F.least("g.h", "g.w").cast("long").alias("short_side"))


@query("q46_source_counts_grouping_sets", "SELECT source, lang, count(*) AS n, grouping_id(source, lang)::BIGINT AS level FROM documents GROUP BY GROUPING SETS ((source, lang), (source), (lang), ())")
def q46(spark, d):
    return read(spark, d, "documents").groupingSets([["source", "lang"], ["source"], ["lang"], []], "source", "lang").agg(F.count(F.lit(1)).alias("n"), F.grouping_id("source", "lang").alias("level"))


@query("q47_manifest_digest", f"""WITH {MANIFEST}, h AS (SELECT dataset, sha256(concat_ws(chr(31), doc_id::VARCHAR, sha256)) AS h FROM manifest), b AS (SELECT dataset, substr(h, 1, 3) AS bucket, sha256(string_agg(h, '' ORDER BY h)) AS d, count(*) AS n FROM h GROUP BY 1, 2)
 SELECT dataset, sum(n)::BIGINT AS n, sha256(string_agg(d, '' ORDER BY bucket)) AS digest FROM b GROUP BY 1""")
def q47(spark, d):
    return C.manifest_digest(manifest(spark, d), ["doc_id", "sha256"], ["dataset"])


@query("q48_float_vs_rounded_parity", f"WITH {SCORED} SELECT count(*) AS n, round(max(abs(score - round(score, 1))), 9) AS max_diff, round(avg(abs(score - round(score, 1))), 9) AS mean_diff FROM scored")
def q48(spark, d):
    """Two outputs row by row."""
    x = F.abs(F.col("score") - F.round("score", 1))
    return scored(spark, d).agg(F.count(F.lit(1)).alias("n"), F.round(F.max(x), 9).alias("max_diff"), F.round(F.avg(x), 9).alias("mean_diff"))


@query("q51_source_registry_counts", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (value IS NULL) AS errors FROM events GROUP BY 1")
def q51(spark, d):
    """Counters of each source."""
    return read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("value").isNull()).alias("errors"))


@query("q52_row_seed", "SELECT doc_id, ('0x' || substr(sha256('42_0_' || doc_id || '_1'), 1, 8))::BIGINT AS seed FROM documents")
def q52(spark, d):
    return read(spark, d, "documents").select("doc_id", X.row_seed(F.lit("42"), F.lit("0"), F.col("doc_id").cast("string"), F.lit("1")).alias("seed"))


@query("q53_parse_provenance", f"WITH {MANIFEST} SELECT doc_id, CASE lower(label) WHEN 'real' THEN 0 WHEN 'authentic' THEN 0 WHEN 'tampered' THEN 1 ELSE 2 END AS provenance FROM manifest")
def q53(spark, d):
    return manifest(spark, d).select("doc_id", X.provenance_code(F.col("label"), F.col("dataset")).alias("provenance"))
