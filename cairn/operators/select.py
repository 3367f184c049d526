"""Selections with quotas and records with defaults; draws are hash orders of a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import exprs as X
from cairn.operators.guards import Refused


def in_order(rows: DataFrame, keys: list[str], order: list[str], name: str = "position") -> DataFrame:
    """Position (from 0) of each row in its key by ``order``, whose first column is a hexadecimal digest.

    Rows are numbered inside ranges of the digest; the sizes of the ranges, 4,096
    for each key, are summed apart. No task sees all rows of a key.
    """
    part = F.substring(order[0], 1, 3)
    cut = rows.withColumn("__part", part)
    own = [F.col(k).alias(f"__{k}") for k in keys]
    sizes = cut.groupBy(*own, F.col("__part").alias("__range")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*[f"__{k}" for k in keys]).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    same = F.col("__part") == F.col("__range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    inside = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order)) - 1
    out = cut.withColumn("__k", inside).join(starts, same).withColumn(name, (F.col("__start") + F.col("__k")).cast("long"))
    return out.select(*rows.columns, name)


def digest(seed: int, *columns: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), *columns), 256)


def stratified(rows: DataFrame, stratum: str, id_: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows of each stratum in hash order, and ``position`` for a shuffled order of all of them."""
    drawn = in_order(rows.withColumn("__d", digest(seed, id_)), [stratum], ["__d", id_], "__k").where(F.col("__k") < n)
    return in_order(drawn, [], ["__d", id_], "position").drop("__d", "__k")


def head(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows; each task keeps ``n`` at most."""
    return rows.orderBy(*order).limit(n)


def coverage_shards(rows: DataFrame, id_: str, world: int, seed: int = 42, epoch: int = 0, offset: int = 0) -> DataFrame:
    """A permutation without replacement, dealt to ranks of equal length.

    Position p goes to rank p mod ``world``. The first positions are repeated to
    fill the last round, at most ``world - 1`` (again and again if there are
    fewer rows). ``offset`` steps of each rank are skipped on resume.
    """
    total = rows.count()
    length = -(-total // world) * world
    placed = in_order(rows.select(id_).withColumn("__d", F.sha2(F.concat_ws(":", F.lit(seed), F.lit(epoch), id_), 256)), [], ["__d", id_]).drop("__d")
    laps = F.sequence(F.lit(0), F.floor((F.lit(length) - 1 - F.col("position")) / F.lit(max(total, 1))).cast("int"))
    dealt = placed.withColumn("lap", F.explode(laps)).withColumn("position", F.col("position") + F.col("lap") * total)
    return dealt.select(id_, "position", F.pmod("position", F.lit(world)).cast("int").alias("rank"), F.floor(F.col("position") / world).alias("step"), (F.col("lap") > 0).alias("padding")).where(F.col("step") >= offset)


def coverage_report(shards: DataFrame, id_: str) -> DataFrame:
    """R2: rows, distinct rows, padding and the shortest and longest rank."""
    ranks = shards.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    whole = shards.agg(F.count(F.lit(1)).alias("draws"), F.count_distinct(id_).alias("unique_rows"), F.count_if("padding").alias("padded"))
    return whole.join(ranks.agg(F.min("n").alias("shortest"), F.max("n").alias("longest")))


def calibration(rows: DataFrame, size: int, seed: int = 42, id_: str = "row_id") -> DataFrame:
    """``size`` rows whose duplicate group, content hash and source group (if any) are theirs alone.

    Half are positive (``ai_positive`` 1), of these at most half tampered, then
    fully generated ones; what is still missing comes from the other positives,
    and what is missing in all from the other candidates. Draws are hash orders
    of the seed. Too few candidates raise. Adds ``calib_transformation`` and
    ``calib_severity`` in turn and sets ``split``.
    """
    own = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    found = rows
    for c, blank_ok in (("duplicate_group", False), ("sha256", False), ("source_image_group", True)):
        value = rows.select(own(c).alias("__v")).where("__v <> ''") if blank_ok else rows.select(own(c).alias("__v"))
        single = value.groupBy("__v").agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").select("__v")
        alone = found.join(single, own(c) == F.col("__v"), "left_semi")
        found = alone.unionByName(found.where(own(c) == "")) if blank_ok else alone
    n, positives, tampered, generated = found.agg(F.count(F.lit(1)), *[F.count_if(F.expr(x)) for x in ("ai_positive = 1", "ai_positive = 1 and provenance = 'tampered'", "ai_positive = 1 and provenance = 'fully_aigc'")]).first()
    if n < size:
        raise Refused(f"{size} calibration rows asked for, {n} candidates")
    want = size // 2
    quota = {"negative": min(n - positives, size - want)}
    if positives <= want:
        quota |= {"tampered": tampered, "generated": generated, "other": positives - tampered - generated}
    else:
        quota["tampered"] = min(tampered, want // 2)
        quota["generated"] = min(generated, want - quota["tampered"])
        quota["other"] = 0
    stratum = F.when(F.col("ai_positive") == 0, "negative").when(F.col("provenance") == "tampered", "tampered").when(F.col("provenance") == "fully_aigc", "generated").otherwise("other")
    ranked = in_order(found.withColumn("__d", digest(seed, id_)).withColumn("__s", stratum), ["__s"], ["__d", id_], "__k")
    first = F.lit(False)
    for name, q in quota.items():
        first = first | ((F.col("__s") == name) & (F.col("__k") < q))
    # What the quotas leave open: other positives first up to their half, then any candidate.
    missing = max(0, min(want, positives) - sum(quota[k] for k in ("tampered", "generated", "other")))
    more = in_order(ranked.where(~first & (F.col("__s") != "negative")).drop("__k"), [], ["__d", id_], "__k").where(F.col("__k") < missing)
    chosen = ranked.where(first).drop("__k").unionByName(more.drop("__k"))
    short = size - sum(quota.values()) - missing
    rest = ranked.drop("__k").join(chosen.select(F.col(id_).alias("__id")), F.col(id_) == F.col("__id"), "left_anti")
    fill = in_order(rest, [], ["__d", id_], "__k").where(F.col("__k") < short)
    placed = in_order(chosen.unionByName(fill.drop("__k")), [], ["__d", id_], "__k")
    name, severity = X.in_turn(F.col("__k"))
    return placed.withColumns({"split": F.lit("calibration"), "calib_transformation": name, "calib_severity": severity}).drop("__d", "__s", "__k")


def balanced_cohort(rows: DataFrame, stratum: str, label: str, id_: str, each: int, seed: int = 42) -> DataFrame:
    """``each`` rows of every stratum and class, dealt 70/10/10/10 to train, validation, test and test_unseen in hash order."""
    drawn = in_order(rows.withColumn("__d", digest(seed, id_)), [stratum, label], ["__d", id_], "__k").where(F.col("__k") < each)
    part = F.col("__k") / F.lit(float(each))
    split = F.when(part < 0.7, "train").when(part < 0.8, "validation").when(part < 0.9, "test").otherwise("test_unseen")
    return drawn.withColumn("split", split).drop("__d", "__k")


def fan_out(source: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each wanted destination; sources nobody wants are left out, and destinations without a source stay with nulls."""
    return wanted.join(source, keys, "left")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in ``gone``; a null key stays."""
    return rows.join(gone.select(F.col(key).alias("__gone")).distinct(), F.col(key) == F.col("__gone"), "left_anti")


def records(rows: DataFrame, order: list[str], expected_split: str | None = None, root: str | None = None) -> DataFrame:
    """Manifest rows as records for a loader.

    Missing columns count as blank. Labels are parsed (an unknown one fails the
    query), ``ai_positive`` falls back to label > 0, the family to the
    generator's, both groups to the row's id, and a blank row id to the row's
    position by ``order`` in a digest's order. With ``expected_split`` another
    split fails the query.
    """
    have = set(rows.columns)
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in have else F.lit("")
    filled = lambda c, other: F.when(text(c) == "", other).otherwise(text(c))
    own = F.sha2(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order]), 256)
    out = rows.withColumn("__row", filled("row_id", F.substring(own, 1, 32)))
    split = text("split")
    if expected_split is not None:
        split = F.when(split == expected_split, split).otherwise(F.raise_error(F.concat(F.lit(f"expected split {expected_split}, found "), split)).cast("string"))
    label = X.provenance_code(F.col("label").cast("string"), text("dataset"), strict=True)
    positive = F.coalesce(F.col("ai_positive").cast("int"), (label > 0).cast("int")) if "ai_positive" in have else (label > 0).cast("int")
    family = filled("generator_family", X.generator_family(text("generator"), text("dataset")))
    return out.select(
        F.col("__row").alias("row_id"), split.alias("split"), X.normal_path(text("image_path"), root).alias("image_path"), label.alias("label"), positive.alias("ai_positive"), text("dataset").alias("dataset"),
        text("generator").alias("generator"), family.alias("generator_family"), filled("duplicate_group", F.col("__row")).alias("duplicate_group"), filled("source_image_group", F.col("__row")).alias("source_image_group"),
    )


def needed(rows: DataFrame, quotas: DataFrame, keys: list[str]) -> DataFrame:
    """Found against needed for each quota (``need``), with what is missing."""
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("found"))
    n = F.coalesce("found", F.lit(0))
    return quotas.join(found, keys, "left").select(*keys, "need", n.alias("found"), F.greatest(F.lit(0), F.col("need") - n).alias("missing"))


def exclusion_reason(path: Column, forbidden: Column, repeated: Column, n_bytes: Column, width: Column, height: Column, quality: Column, readable: Column, sha: Column, mask_path: Column, mask_bytes: Column, mask_readable: Column, mask_width: Column, mask_height: Column) -> Column:
    """Why a declared row is left out, the first of ten checks that fails; null keeps it.

    ``readable`` says whether the bytes decode; sizes and digests are those of
    the stored bytes, null where there is no file.
    """
    has_mask = F.trim(F.coalesce(mask_path, F.lit(""))) != ""
    empty = lambda n: F.coalesce(n, F.lit(0)) == 0
    broken = lambda ok: ~F.coalesce(ok, F.lit(False))
    return (
        F.when(~X.is_safe_relative_path(F.coalesce(path, F.lit(""))), "unsafe_relative_path").when(forbidden != "", forbidden).when(repeated, "exact_duplicate_row").when(empty(n_bytes), "missing_file_on_disk")
        .when(broken(readable), "corrupted_image_bytes").when((F.least(width, height) < 16) | (quality == 0), "image_too_small_or_flat").when(X.is_placeholder_sha(sha), "placeholder_sha_on_disk")
        .when(has_mask & empty(mask_bytes), "missing_tamper_mask").when(has_mask & broken(mask_readable), "corrupted_tamper_mask")
        .when(has_mask & ((mask_width != width) | (mask_height != height)), "tamper_mask_dimension_mismatch")
    )
