"""Queries: duplicate groups, sampling, losses, pooling, images and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import exprs as X
from cairn.functions import losses as L
from cairn.operators import duplicates as D
from cairn.operators import sampling as S
from cairn.plans.manifest_queries import HASHED, SCORED, hashed_vectors, read, scored
from cairn.plans.registry import query


@query("q24_duplicate_components", f"""WITH RECURSIVE {HASHED}, n AS (SELECT vec_id AS id, h, vec_id // 3 AS sha, CASE WHEN vec_id % 10 = 0 THEN vec_id // 40 END AS src FROM hashed),
 e AS (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.id <> b.id AND (a.sha = b.sha OR a.src = b.src OR (a.h <> 0 AND b.h <> 0 AND bit_count(xor(a.h, b.h)) <= 1))),
 reach(id, r) AS (SELECT id, id FROM n UNION SELECT e.a, reach.r FROM reach JOIN e ON e.b = reach.id), top AS (SELECT id, max(r) AS r FROM reach GROUP BY 1)
 SELECT id AS vec_id, printf('duplicate_%08d', dense_rank() OVER (ORDER BY r) - 1) AS duplicate_group FROM top""")
def q24(spark, d):
    rows = hashed_vectors(spark, d).select("vec_id", "h", F.floor(F.col("vec_id") / 3).alias("sha"), F.when(F.col("vec_id") % 10 == 0, F.floor(F.col("vec_id") / 40).cast("string")).alias("src"))
    return D.duplicate_groups(rows, "vec_id", "sha", "h", "src", distance=1, bits=20)


UNIFORM = "(('0x' || substr(sha256({0}), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"


@query("q54_weighted_draws", f"""WITH w AS (SELECT doc_id, sum(1 + n_chars % 7) OVER (ORDER BY doc_id) AS hi, 1 + n_chars % 7 AS weight FROM documents), s AS (SELECT sum(weight) AS total FROM w),
 u AS (SELECT range AS draw, {UNIFORM.format("'42:0:' || range")} * (SELECT total FROM s)::DOUBLE AS pos FROM range(0, 1000))
 SELECT draw, draw % 4 AS rank, doc_id FROM u JOIN w ON pos >= hi - weight AND pos < hi""")
def q54(spark, d):
    rows = read(spark, d, "documents").select("doc_id", (1 + F.col("n_chars") % 7).alias("weight"))
    return S.weighted_draws(rows, "doc_id", "weight", 998, 42, 0, 4)


_CHOICES = "MAP {" + ", ".join(f"'{n}': {[float(x) for x in s]}::DOUBLE[]" for n, s in S.SEVERITIES.items()) + "}"


@query("q55_transform_candidates", f"""WITH f AS (SELECT unnest({sorted(S.SEVERITIES)}) AS family), l AS (SELECT unnest([0, 1]) AS lap),
 o AS (SELECT doc_id, lap, family, lap * 6 + row_number() OVER (PARTITION BY doc_id, lap ORDER BY sha256('7:0:' || doc_id || ':' || lap || ':' || family), family) - 1 AS candidate FROM documents, f, l)
 SELECT doc_id, candidate, family, list_element(({_CHOICES})[family], (floor({UNIFORM.format("'7:0:' || doc_id || ':' || candidate")} * len(({_CHOICES})[family])))::INT + 1) AS severity FROM o WHERE candidate < 8""")
def q55(spark, d):
    return S.transform_candidates(read(spark, d, "documents"), "doc_id", 8, 7)


_LOGIT = "((score - 0.5) * 8)"


@query("q56_losses", f"""WITH {SCORED}, z AS (SELECT dataset, {_LOGIT} AS x, y::DOUBLE AS y, ((n_chars % 100) / 100.0::DOUBLE) AS t FROM scored WHERE y IS NOT NULL),
 p AS (SELECT *, 1 / (1 + exp(-x)) AS p, greatest(x, 0) - x * y + ln(1 + exp(-abs(x))) AS bce FROM z)
 SELECT dataset, round(avg(bce), 8) AS bce, round(avg(pow(1 - CASE WHEN y >= 0.5 THEN p ELSE 1 - p END, 2) * bce), 8) AS focal, round(1 - (2 * sum(p * y) + 1e-6) / (sum(p) + sum(y) + 1e-6), 8) AS dice,
 round(coalesce(avg(CASE WHEN greatest(t, 1 - t) >= 0.8 THEN CASE WHEN t > 0 THEN t * (ln(t) + ln(1 + exp(-x))) ELSE 0 END + (1 - t) * (ln(1 - t) + ln(1 + exp(x))) END), 0), 8) AS gated_kl FROM p GROUP BY 1""")
def q56(spark, d):
    x, y = (F.col("score") - 0.5) * 8, F.col("y").cast("double")
    rows = scored(spark, d).where("y is not null").withColumn("t", (F.col("n_chars") % 100) / F.lit(100.0))
    return rows.groupBy("dataset").agg(*[F.round(c, 8).alias(n) for n, c in [("bce", F.avg(L.bce(x, y))), ("focal", F.avg(L.focal_bce(x, y))), ("dice", L.soft_dice(x, y)), ("gated_kl", L.gated_kl(x, F.col("t")))]])


@query("q57_pooled_scores", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), w AS (SELECT *, list_avg(e) AS m, list_max(e) AS top FROM v)
 SELECT vec_id, round(m, 8) AS mean, round(sqrt(list_avg(list_transform(e, lambda x: (x - m) * (x - m)))), 8) AS deviation,
 round(list_sum(list_transform(e, lambda x: x * exp(x - top))) / list_sum(list_transform(e, lambda x: exp(x - top))), 8) AS softmax_mean FROM w""")
def q57(spark, d):
    return read(spark, d, "embeddings").select("vec_id", *[F.round(c, 8).alias(n) for n, c in L.pooled(F.col("embedding")).items()])


@query("q58_quality_score", """WITH q AS (SELECT page_id, length(url) AS w, length(html) % 97 + 1 AS h, (length(html) % 5000)::DOUBLE AS var FROM pages)
 SELECT page_id, CASE WHEN least(w, h) < 16 OR var < 1 THEN 0.0::DOUBLE ELSE round(least(1.0::DOUBLE, greatest(0.1::DOUBLE, least(1.0::DOUBLE, ln(1 + var) / 7.5::DOUBLE) * (1 - greatest(0::DOUBLE, least(0.35::DOUBLE, (greatest(w, h)::DOUBLE / least(w, h) - 2.5::DOUBLE) * 0.15::DOUBLE))))), 4) END AS quality FROM q""")
def q58(spark, d):
    n = F.length("html")
    return read(spark, d, "pages").select("page_id", X.quality_score(F.length("url"), n % 97 + 1, (n % 5000).cast("double")).alias("quality"))


@query("q59_provenance_probabilities", f"""WITH {SCORED}, p AS (SELECT doc_id, 1 / (1 + exp(-{_LOGIT})) AS a, 1 / (1 + exp(-(n_chars % 9 - 4)::DOUBLE)) AS t FROM scored)
 SELECT doc_id, round(a, 9) AS generated, round((1 - a) * t, 9) AS tampered, round((1 - a) * (1 - t), 9) AS authentic FROM p""")
def q59(spark, d):
    p = L.provenance_probabilities((F.col("score") - 0.5) * 8, (F.col("n_chars") % 9 - 4).cast("double"))
    return scored(spark, d).select("doc_id", *[F.round(c, 9).alias(n) for c, n in zip(p, ["generated", "tampered", "authentic"], strict=True)])


@query("q60_streamed_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM (SELECT DISTINCT ON (event_id) * FROM events) GROUP BY 1, 2")
def q60(spark, d):
    from cairn.streaming import events as E

    return E.run_available(E.windowed_counts(E.event_stream(spark, d), late="3650 days"), "windows", ["start", "event_type"])


def drawn_images(spark, d):
    """Each vector as the decoded rows of an 8 x 8 grey image, in the form of the ``image`` source."""
    top = F.array_max(F.transform("embedding", lambda x: F.abs(x)))
    level = lambda x: F.lpad(F.hex(F.floor((x / F.greatest(top, F.lit(1e-9)) + 1) * 127.5).cast("long")), 2, "0")
    data = F.unhex(F.array_join(F.transform("embedding", level), ""))
    side = F.floor(F.sqrt(F.size("embedding"))).cast("int")
    data = F.substring(data, F.lit(1), side * side)
    return read(spark, d, "embeddings").select(F.struct(F.col("vec_id").cast("string").alias("origin"), side.alias("height"), side.alias("width"), F.lit(1).alias("nChannels"), data.alias("data")).alias("image"))


@query("q49_dhash")
def q49(spark, d):
    from cairn.functions import pixels

    return pixels.difference_hashes(drawn_images(spark, d))


@query("q50_radial_fft")
def q50(spark, d):
    from cairn.functions import pixels

    return pixels.radial_energies(drawn_images(spark, d)).select("path", F.transform("energy", lambda x: F.round(x, 9)).alias("energy"))
