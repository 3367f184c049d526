"""Column builders of the manifest rules; all run inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of image generators that mean the same family.
ALIASES = {
    "stable_diffusion": "stable_diffusion_1", "stable_diffusion_v1": "stable_diffusion_1", "stable_diffusion_1_4": "stable_diffusion_1",
    "stable_diffusion_1_5": "stable_diffusion_1", "sd": "stable_diffusion_1", "sd_1": "stable_diffusion_1", "sd_v1": "stable_diffusion_1",
    "sd14": "stable_diffusion_1", "sd15": "stable_diffusion_1", "stable_diffusion_v2": "stable_diffusion_2", "sd_2": "stable_diffusion_2",
    "sd_v2": "stable_diffusion_2", "dall_e_2": "dalle_2", "dall_e_3": "dalle_3", "midjourney_v6": "midjourney_6", "midjourney_v5": "midjourney_5",
    "sd3": "sd_3_medium", "sd_3": "sd_3_medium", "stable_diffusion_3": "sd_3_medium", "stable_diffusion_3_5": "sd_3_5", "sd35": "sd_3_5",
    "gpt_4o_image": "gpt_image",
}
# Families kept for the unseen test split.
HELD_OUT = ["flux_1_dev", "nano_banana_pro", "novelai_anime_v3", "midjourney", "sdxl_1_0", "dalle2", "dalle_2"]
# Spellings of the data set, and its family, that is always trained on.
FORCED_TRAINING = (["diffusionforensics", "dire"], "adm")
# Fixed value: digest of a known placeholder image.
PLACEHOLDERS = ["9b5936f4006146e4e1e9025b474c02863c0b5614132ad40db4b925a10e8bfbb9"]
# Label names; 0 authentic, 1 tampered, 2 fully generated.
LABELS = {"real": 0, "authentic": 0, "tampered": 1, "full_synthetic": 2, "fully_synthetic": 2, "fully_aigc": 2, "aigc": 2, "ai": 2}
# Transformations of the calibration rows, in turn.
TRANSFORMS = [("jpeg", 70.0), ("blur", 1.0), ("resize", 0.5), ("noise", 0.05), ("color", 0.4), ("crop", 0.75)]


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def _lookup(key: Column, values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def generator_family(generator: Column, dataset: Column) -> Column:
    """P1. Null counts as blank."""
    name, own = slug(F.coalesce(generator, F.lit(""))), slug(F.coalesce(dataset, F.lit("")))
    blank = F.concat(F.when(own == "", "unknown").otherwise(own), F.lit("_unknown"))
    return F.when(name == "", blank).otherwise(F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv]), name), name))


def is_held_out(family: Column) -> Column:
    """P2."""
    return family.isin(HELD_OUT)


def provenance_code(label: Column, dataset: Column, strict: bool = False) -> Column:
    """P3. Null for what has no meaning, numbers of any length included; ``strict`` fails the query there."""
    name = F.regexp_replace(F.lower(F.trim(label)), "[- ]", "_")
    number = F.when(name.rlike("^[0-9]+$"), name.try_cast("int"))
    sid = F.regexp_replace(F.lower(dataset), "-", "_").isin("sid", "sid_set")
    coded = F.when(sid, F.when(number == 0, 0).when(number == 1, 2).when(number == 2, 1)).when(number.between(0, 2), number)
    named = F.try_element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), name)
    code = F.coalesce(named, coded)
    return F.coalesce(code, F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null")))).cast("int")) if strict else code


def is_safe_relative_path(path: Column) -> Column:
    """P5."""
    p = F.trim(F.replace(path, F.lit("\\"), F.lit("/")))
    return F.coalesce((p != "") & ~p.startswith("/") & ~p.rlike("^[a-zA-Z]:") & ~F.array_contains(F.split(p, "/"), ".."), F.lit(False))


def forbidden_reason(*columns: Column) -> Column:
    """P6. The first rule that fits; empty if none does."""
    text = F.lower(F.replace(F.concat_ws(" ", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), F.lit("\\"), F.lit("/")))
    compact = F.regexp_replace(text, "[^a-z0-9]+", "")
    return (
        F.when(text.contains("newer image model data"), "forbidden_newer_image_model_data_folder")
        .when(compact.contains("coco") & compact.contains("val2017"), "forbidden_organizer_coco_val2017")
        .when(compact.contains("dalle") & (compact.contains("advanced") | compact.contains("dalle3")), "forbidden_organizer_dalle_advanced_demo")
        .when(compact.contains("organizerdemo") | text.contains("organizer_demo"), "forbidden_organizer_demo")
        .otherwise("")
    )


def is_placeholder_sha(sha: Column) -> Column:
    """P8."""
    v = F.lower(F.trim(F.coalesce(sha, F.lit(""))))
    return (v == "") | v.startswith("sha:") | v.isin(PLACEHOLDERS)


def row_id(split: Column, dataset: Column, index: Column, path: Column, sha: Column, external: Column, member: Column) -> Column:
    """P9."""
    clean = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit("")))
    slash = lambda c: F.replace(clean(c), F.lit("\\"), F.lit("/"))
    return F.substring(F.sha2(F.concat_ws(":", clean(split), clean(dataset), clean(index), slash(path), clean(sha), clean(external), slash(member)), 256), 1, 32)


def source_index(external: Column, path: Column) -> Column:
    """P10: as text, from up to nine digits."""
    found = lambda c, p: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), p, 1), F.lit("")).cast("long").cast("string")
    return F.coalesce(found(external, r"_(\d{1,9})\b"), found(path, r"_(\d{1,9})\."), found(external, r"\b(\d{1,9})\b"), F.lit(""))


def source_index_strict(external: Column, path: Column) -> Column:
    """As number, from five to eight digits first; null for more digits than a long has."""
    found = lambda c, p: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), p, 1), F.lit("")).try_cast("long")
    return F.coalesce(found(external, r"_(\d{5,8})\b"), found(path, r"_(\d{5,8})\."), found(external, r"(\d+)"))


def quality_score(width: Column, height: Column, variance: Column) -> Column:
    """P12 over measured pixels."""
    ratio = F.greatest(width, height) / F.greatest(F.least(width, height), F.lit(1))
    penalty = F.greatest(F.lit(0.0), F.least(F.lit(0.35), (ratio - 2.5) * 0.15))
    score = F.least(F.lit(1.0), F.log1p(variance) / 7.5) * (1 - penalty)
    return F.when((F.least(width, height) < 16) | (variance < 1), 0.0).otherwise(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.1), score)), 4))


def aspect_bucket(width: Column, height: Column) -> Column:
    """P13."""
    r = F.try_divide(width.cast("double"), height)
    bad = (F.coalesce(width, F.lit(0)) <= 0) | (F.coalesce(height, F.lit(0)) <= 0)
    return F.when(bad, "square").when(r.between(0.95, 1.05), "square").when(r >= 1.8, "wide").when(r > 1.05, "landscape").otherwise("portrait")


def in_turn(position: Column) -> tuple[Column, Column]:
    """Transformation and severity for positions from 0."""
    at = F.pmod(position, F.lit(len(TRANSFORMS))).cast("int") + 1
    return F.element_at(F.array(*[F.lit(n) for n, _ in TRANSFORMS]), at), F.element_at(F.array(*[F.lit(s) for _, s in TRANSFORMS]), at)


def row_seed(seed: Column, epoch: Column, row: Column, candidate: Column) -> Column:
    """P20."""
    return F.conv(F.substring(F.sha2(F.concat_ws("_", seed, epoch, row, candidate), 256), 1, 8), 16, 10).cast("long")


def first_split(official: Column, label: Column, family: Column, dataset: Column | None = None) -> Column:
    """P27 before groups are looked at; one family of one data set (FORCED_TRAINING) never counts as held out."""
    o = F.lower(F.trim(F.coalesce(official, F.lit("train"))))
    synthetic = F.lower(F.trim(label)).isin("fully_aigc", "aigc", "ai")
    plain = F.regexp_replace(F.lower(F.coalesce(dataset if dataset is not None else F.lit(None).cast("string"), F.lit(""))), "[^a-z0-9]+", "")
    forced = plain.isin(FORCED_TRAINING[0]) & (family == FORCED_TRAINING[1])
    return (
        F.when(o == "test_unseen", "test_unseen").when(F.coalesce(synthetic & is_held_out(family) & ~forced, F.lit(False)), "test_unseen")
        .when(o.isin("test", "testing"), "test").when(o.isin("validation", "val", "dev"), "validation").otherwise("train")
    )


def token_grid(count: Column, aspect: Column) -> Column:
    """factor pair closest to the aspect ratio in logarithm, first by height order on ties."""
    heights = F.filter(F.sequence(F.lit(1), F.floor(F.sqrt(count)).cast("int")), lambda h: count % h == 0)
    pairs = F.flatten(F.transform(heights, lambda h: F.array(F.struct(h.alias("h"), (count / h).cast("int").alias("w")), F.struct((count / h).cast("int").alias("h"), h.alias("w")))))
    costed = F.transform(pairs, lambda p, i: F.struct(F.abs(F.log(p["w"] / p["h"] / aspect)).alias("cost"), i.alias("i"), p["h"].alias("h"), p["w"].alias("w")))
    return F.array_min(costed)


def cosine_similarity(a: Column, b: Column) -> Column:
    """F13; null if a norm is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_share_mean(values: Column, share: float = 0.05) -> Column:
    """Mean of the largest ``share`` of an array, one value at least."""
    n = F.greatest(F.ceil(F.size(values) * share), F.lit(1)).cast("int")
    top = F.slice(F.sort_array(values, asc=False), F.lit(1), n)
    return F.aggregate(top, F.lit(0.0), lambda s, v: s + v) / n


def positive_probability(probabilities: Column, classes: int = 2) -> Column:
    """The positive class of an array; another number of classes fails the query."""
    wrong = F.raise_error(F.concat(F.lit("classes expected: "), F.lit(classes), F.lit(", found: "), F.size(probabilities).cast("string"))).cast("double")
    return F.when(F.size(probabilities) == classes, F.element_at(probabilities, 2).cast("double")).otherwise(wrong)


def verdict(score: Column, threshold: float, positive: str = "AIGC", negative: str = "AUTHENTIC") -> Column:
    """P17; null for a null score."""
    return F.when(score >= threshold, positive).when(score.isNotNull(), negative)


def is_confident(p: Column, least: float) -> Column:
    """The more probable of two classes has at least ``least``."""
    return F.greatest(p, 1 - p) >= least


def normal_path(path: Column, root: str | None = None) -> Column:
    """Forward slashes, joined to ``root`` unless absolute."""
    p = F.trim(F.replace(path, F.lit("\\"), F.lit("/")))
    return p if root is None else F.when(p.startswith("/") | p.rlike("^[a-zA-Z]:"), p).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), p))


def first_json(document: Column, *paths: str) -> Column:
    """The first of the JSON paths that is there, as text."""
    return F.coalesce(*[F.get_json_object(document, p) for p in paths])


def learning_rate(step: Column, warmup: int, total: int, floor: float = 0.0) -> Column:
    """P25: factor of the rate, a linear rise and then half a cosine down to ``floor``."""
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - warmup) / F.lit(float(max(1, total - warmup)))))
    return F.when(step < warmup, (step + 1) / F.lit(float(max(1, warmup)))).otherwise(floor + (1 - floor) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * part)))


def milestones(stop: int, shares: list[float]) -> list[int]:
    """Steps at shares of a run, from the first on."""
    return [max(1, -int(-(stop * s) // 1)) for s in shares]


def is_sha256(text: Column) -> Column:
    """P23."""
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))


def held_out_by_hash(family: Column, seed: int = 42, parts: int = 5) -> Column:
    """D3: a family is held out if the digest of seed and name is 0 modulo ``parts``; by the digest's last 15 hex digits weighed with the rest."""
    h = F.sha2(F.concat(F.lit(f"seed{seed}:"), family), 256)
    digits = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.conv(F.substring(h, i, F.lit(1)), 16, 10).cast("int"))
    return F.aggregate(digits, F.lit(0), lambda m, x: (m * 16 + x) % parts) == 0


def passes_quality(width: Column, height: Column, n_bytes: Column, short: int = 512, aspect: float = 3.0, least_bytes: int = 10_240) -> Column:
    """D5; null counts as failed."""
    edge = F.least(width, height)
    return F.coalesce((edge >= short) & (F.greatest(width, height) / F.greatest(edge, F.lit(1)) <= aspect) & (n_bytes >= least_bytes), F.lit(False))


def cohort(id_: Column, tags: Column, score: Column, rating: Column, created: Column, *, tag: str, low: int, high: int, floor: float, ratings: list[str], before: str, modulo: int, rest: int) -> Column:
    """One tag among many, an id range, a score floor, ratings, a cutoff date and every ``modulo``-th id."""
    tagged = F.concat(F.lit(" "), F.coalesce(tags, F.lit("")), F.lit(" ")).like(f"% {tag} %")
    return tagged & id_.between(low, high) & (score >= floor) & rating.isin(ratings) & (created < before) & (F.pmod(id_, F.lit(modulo)) == rest)


# Weights of the selection scores, best evidence first.
SELECTION = {"poc": [0.50, 0.25, 0.20, 0.05], "bakeoff": [0.45, 0.30, 0.15, 0.10], "final": [0.40, 0.25, 0.20, 0.10, 0.05]}


def selection_score(kind: str, *parts: Column) -> Column:
    """Weighted sum of a candidate's parts; null if one is missing."""
    weights = SELECTION[kind]
    if len(parts) != len(weights):
        raise ValueError(f"{kind} takes {len(weights)} parts")
    out = F.lit(0.0)
    for w, c in zip(weights, parts, strict=True):
        out = out + w * c
    return out
