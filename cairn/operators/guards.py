"""Integrity guards: each passes its rows on or raises ``Refused`` with a count and a few offenders."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import exprs as X

SPLITS = ["train", "validation", "test", "test_seen", "test_unseen", "calibration"]


class Refused(ValueError):
    """A guard found rows that must not be there."""


def refuse(bad: DataFrame, what: str, show: int = 5) -> None:
    """Raise if ``bad`` has rows; at most ``show`` of them and their number go to the driver."""
    some = bad.limit(show).collect()
    if some:
        raise Refused(f"{what}: {bad.count()} rows, for instance {[tuple(r) for r in some]}")


def no_group_leakage(rows: DataFrame, group: str = "duplicate_group", split: str = "split") -> DataFrame:
    """I1. Rows without a group can't leak."""
    refuse(rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count_distinct(split).alias("splits")).where("splits > 1").orderBy(group), "groups cross splits")
    return rows


def shared_values(rows: DataFrame, column: str, one: Column, other: Column) -> DataFrame:
    """The values that rows of both kinds have; aggregated before the shuffle."""
    flags = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.max(one).alias("one"), F.max(other).alias("other"))
    return flags.where("one and other").select(column)


def unseen_families_absent(rows: DataFrame, synthetic: Column, family: str = "generator_family", split: str = "split") -> DataFrame:
    """Synthetic families of test_unseen aren't trained on."""
    refuse(shared_values(rows.where(synthetic), family, F.col(split) == "train", F.col(split) == "test_unseen").orderBy(family), "families of train and test_unseen")
    return rows


def disjoint(rows: DataFrame, keys: list[str], one: Column, other: Column) -> DataFrame:
    """U3, R3's last check: rows of the two kinds share no value of any key."""
    for k in keys:
        refuse(shared_values(rows, k, one, other).orderBy(k), f"{k} is shared")
    return rows


def shared_report(a: DataFrame, b: DataFrame, keys: list[str], show: int = 5) -> DataFrame:
    """For each key the number of values in both tables and the first ``show`` in order."""
    out = None
    for k in keys:
        both = a.select(F.col(k).cast("string").alias("v")).intersect(b.select(F.col(k).cast("string").alias("v"))).where("v is not null")
        first = both.orderBy("v").limit(show).agg(F.sort_array(F.collect_list("v")).alias("sample"))
        one = both.agg(F.count(F.lit(1)).alias("shared")).join(first).select(F.lit(k).alias("key"), "shared", "sample")
        out = one if out is None else out.unionAll(one)
    return out


def splits_within(rows: DataFrame, allowed: list[str], split: str = "split") -> DataFrame:
    """No row's split is outside ``allowed``; a null one is."""
    refuse(rows.where(~F.coalesce(F.col(split).isin(allowed), F.lit(False))).groupBy(split).count().orderBy(split), f"splits other than {allowed}")
    return rows


def validation_rows(rows: DataFrame, split: str = "split") -> DataFrame:
    """All splits are known and validation is there; its rows."""
    splits_within(rows, SPLITS, split)
    found = rows.where(F.col(split) == "validation")
    not_empty(found, "validation rows")
    return found


def forbidden_absent(rows: DataFrame, columns: list[str], split: str = "split", advanced: str | None = None) -> DataFrame:
    """No training row names a demonstration set in any column, nor has the flag."""
    bad = X.forbidden_reason(*[F.col(c) for c in columns]) != ""
    if advanced is not None:
        bad = bad | F.coalesce(F.col(advanced).cast("boolean"), F.lit(False))
    refuse(rows.where((F.col(split) == "train") & bad), "forbidden demonstration rows in train")
    return rows


def exact_size(rows: DataFrame, size: int, what: str = "rows") -> DataFrame:
    """I3."""
    n = rows.count()
    if n != size:
        raise Refused(f"{what}: {n}, expected exactly {size}")
    return rows


def not_empty(rows: DataFrame, what: str = "eligible rows") -> DataFrame:
    """I4."""
    if rows.isEmpty():
        raise Refused(f"no {what}")
    return rows


def partitioned(declared: DataFrame, eligible: DataFrame, excluded: DataFrame, key: str) -> None:
    """Each declared row is either eligible or excluded, once."""
    tag = lambda d, name: d.select(F.col(key), *[F.lit(int(n == name)).alias(n) for n in ("declared", "eligible", "excluded")])
    all_ = tag(declared, "declared").unionAll(tag(eligible, "eligible")).unionAll(tag(excluded, "excluded"))
    sums = all_.groupBy(key).agg(*[F.sum(n).alias(n) for n in ("declared", "eligible", "excluded")])
    refuse(sums.where("declared <> eligible + excluded").orderBy(key), "declared rows aren't eligible plus excluded")


def one_destination(tasks: DataFrame, destination: str, sources: list[str], workers: int = 1) -> DataFrame:
    """1 to 32 workers, and no destination is asked for by different sources; equal tasks are one."""
    if not 1 <= workers <= 32:
        raise Refused(f"workers: {workers}, expected 1 to 32")
    unique = tasks.dropDuplicates([destination, *sources])
    refuse(unique.groupBy(destination).count().where("count > 1").orderBy(destination), "conflicting destinations")
    return unique


def same_identity(saved: dict, now: dict, fields: tuple[str, ...] = ("manifest_sha256", "batch_size", "world_size", "accumulation")) -> None:
    """A run resumes only with the manifest and the batch geometry it began with."""
    wrong = [f for f in fields if saved.get(f) != now.get(f)]
    if wrong:
        raise Refused("resumed with another " + ", ".join(f"{f} ({saved.get(f)!r}, now {now.get(f)!r})" for f in wrong))


def evaluation_contract(contract: dict) -> dict:
    """Digests are 64 hex digits and thresholds lie in [0, 1]."""
    for name, value in contract.items():
        if name.endswith(("sha256", "digest")) and not (isinstance(value, str) and len(value) == 64 and set(value) <= set("0123456789abcdef")):
            raise Refused(f"{name} isn't a digest")
        if name.endswith("threshold") and not (isinstance(value, int | float) and not isinstance(value, bool) and math.isfinite(value) and 0 <= value <= 1):
            raise Refused(f"{name} isn't in [0, 1]")
    return contract


def teacher_report(report: dict, checkpoint_sha: str, manifest_digest: str, required: tuple[str, ...] = ("clean", "mean", "worst", "calibrated")) -> list[str]:
    """I8: why a report doesn't hold for this checkpoint and manifest; empty if it does."""
    reasons = [] if report.get("passed") is True else ["not_passed"]
    reasons += [] if report.get("checkpoint_sha256") == checkpoint_sha else ["checkpoint_sha_mismatch"]
    reasons += [] if report.get("manifest_digest") == manifest_digest else ["manifest_digest_mismatch"]
    return reasons + [f"missing_{m}" for m in required if not report.get("metrics", {}).get(m)]


def promotion_claim(claim: dict) -> dict:
    """What claims to be promoted has a passed report, its digest and a calibrated threshold."""
    if claim.get("promoted"):
        missing = [k for k in ("report_sha256", "calibrated_threshold", "manifest_digest") if claim.get(k) is None]
        if missing or claim.get("passed") is not True:
            raise Refused("promoted without evidence: " + ", ".join(missing or ["passed"]))
    return claim


def artifact_variant(dimensions: tuple[int, ...], known: dict[tuple[int, ...], str], declared: str | None) -> str:
    """The variant that the stored dimensions mean; another declared one is refused, unknown dimensions too."""
    found = known.get(tuple(dimensions))
    if found is None:
        raise Refused(f"unknown dimensions {dimensions}; known are {sorted(known)}")
    if declared is not None and declared != found:
        raise Refused(f"declared {declared}, stored {found}")
    return found


def checkpoint_eligible(path: str, banned: tuple[str, ...] = ("bakeoff", "proxy", "smoke", "dryrun")) -> str:
    """P22."""
    for word in banned:
        if word in path.lower().replace("\\", "/"):
            raise Refused(f"{path}: {word} checkpoints aren't eligible")
    return path


def looked_up(rows: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """Each row with its catalogue entry; a key that isn't there fails with the first hundred that are."""
    missing = rows.select(key).distinct().join(catalogue.select(key), key, "left_anti")
    lost = missing.limit(5).collect()
    if lost:
        known = [r[0] for r in catalogue.select(key).distinct().orderBy(key).limit(100).collect()]
        raise Refused(f"unknown {key}: {[r[0] for r in lost]}; known are {known}")
    return rows.join(catalogue, key)
