"""Sinks: packages of splits, reports, predictions, receipts and catalogues."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.guards import Refused, evaluation_contract


def write_package(rows: DataFrame, exclusions: DataFrame, path: str, declared: DataFrame | None = None, calibration: DataFrame | None = None) -> None:
    """K1: rows by split, and the exclusions, declared rows and calibration rows beside them; no split's rows pass through one task."""
    rows.write.mode("overwrite").partitionBy("split").parquet(f"{path}/splits")
    for name, part in (("exclusions", exclusions), ("declared", declared), ("calibration", calibration)):
        if part is not None:
            part.write.mode("overwrite").parquet(f"{path}/{name}")


def source_revisions(rows: DataFrame, repositories: DataFrame, revisions: DataFrame) -> DataFrame:
    """Repository and revision of each data set, by data set and then repository; ``local`` where neither is known."""
    named = rows.select("dataset").distinct().join(repositories.select("dataset", "repository"), "dataset", "left")
    out = named.join(revisions.select("repository", "revision"), "repository", "left")
    return out.select("dataset", F.coalesce("repository", F.lit("local")).alias("repository"), F.coalesce("revision", F.lit("local_or_non_hf")).alias("revision"))


def audit(rows: DataFrame, exclusions: DataFrame, by: tuple[str, ...] = ("dataset", "label", "split")) -> dict:
    """K2: counts of rows for each value of ``by`` (columns of few values), and of exclusions for each reason."""
    have = [c for c in by if c in rows.columns]
    out = {"rows": 0, "excluded": 0, **{c: {} for c in have}, "reasons": {}}
    if have:
        for r in rows.groupingSets([[F.col(c)] for c in have] + [[]], *have).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n")).collect():
            at = [i for i in range(len(have)) if not r.g >> (len(have) - 1 - i) & 1]
            if at:
                out[have[at[0]]][str(r[have[at[0]]])] = r.n
            else:
                out["rows"] = r.n
    else:
        out["rows"] = rows.count()
    for r in exclusions.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect():
        out["reasons"][str(r.reason)] = r.n
    out["excluded"] = sum(out["reasons"].values())
    return out


def write_atomic(path: str, content: bytes) -> None:
    """K3: a small driver-side file, whole or not at all."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    finally:
        if os.path.exists(temporary):
            os.unlink(temporary)


def write_report(path: str, report: dict) -> None:
    """K2, K5, K6: JSON with sorted keys."""
    write_atomic(path, (json.dumps(report, indent=2, sort_keys=True) + "\n").encode())


def write_predictions(scored: DataFrame, path: str, probability: str = "score") -> None:
    """K4: JSON lines, probabilities rounded to six places."""
    scored.withColumn(probability, F.round(probability, 6)).write.mode("overwrite").json(path)


def receipts(files: DataFrame) -> DataFrame:
    """K9: path, size and digest of the files that a scan found."""
    return files.select("path", F.col("length").alias("size"), "sha256")


def upsert_catalogue(catalogue: DataFrame, new: DataFrame, family: str, base_url: str, expected: int | None = None) -> DataFrame:
    """float32 entries outside ``family`` (an id prefix) with their paths moved to ``base_url``, and the new ones in order of id.

    With ``expected``, any other number of entries fails the query itself.
    """
    kept = catalogue.where((F.col("quantization") == "float32") & ~F.col("id").startswith(family))
    moved = kept.withColumn("path", F.concat(F.lit(base_url.rstrip("/") + "/"), F.element_at(F.split("path", "/"), -1)))
    out = moved.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    if expected is not None:
        n = out.agg(F.count(F.lit(1)).alias("__n"))
        checked = n.select(F.when(F.col("__n") == expected, True).otherwise(F.raise_error(F.concat(F.lit(f"expected {expected} entries, found "), F.col("__n")))).cast("boolean").alias("__ok"))
        out = out.join(F.broadcast(checked), F.col("__ok"))
        out = out.drop("__ok")
    return out.orderBy("__new", "id").drop("__new")


def resume_state(path: str, identity: dict) -> list[dict]:
    """K5: the rows that an earlier run with the same identity has written, from JSON lines; none if the file isn't there or belongs to another run."""
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as f:
        lines = [json.loads(x) for x in f if x.endswith("\n") and x.strip()]  # a line cut off by a crash has no end
    return lines[1:] if lines and lines[0] == {"identity": identity} else []


def append_state(path: str, identity: dict, rows: list[dict]) -> None:
    """K5: add finished rows, flushed to the disk; a file of another run is begun anew."""
    kept = resume_state(path, identity)
    lines = [{"identity": identity}, *kept, *rows]
    write_atomic(path, "".join(json.dumps(x, sort_keys=True) + "\n" for x in lines).encode())


#: Fields that each report must have, with the types that they may be.
CONTRACTS = {
    "promotion": {"passed": bool, "checkpoint_path": str, "checkpoint_sha256": str, "manifest_digest": str, "metrics": dict, "failed_reasons": list},
    "sidecar": {"model_id": str, "checkpoint_sha256": str, "calibrated_threshold": float, "manifest_digest": str, "promoted": bool},
    "artifact": {"model_id": str, "sha256": str, "size_bytes": int, "quantization": str, "input_size": int, "calibrated_threshold": float, "evaluation_status": str},
}


def contract(kind: str, report: dict) -> dict:
    """K6, K7: a report with exactly its contract's fields, of the right types, sound digests and thresholds, and sizes above zero."""
    fields = CONTRACTS[kind]
    wrong = [f"missing {k}" for k in fields if k not in report] + [f"unknown {k}" for k in report if k not in fields]
    wrong += [f"{k} isn't {t.__name__}" for k, t in fields.items() if k in report and (not isinstance(report[k], t) or t is int and isinstance(report[k], bool))]
    wrong += [f"{k} isn't positive" for k in ("size_bytes", "input_size") if isinstance(report.get(k), int) and report[k] <= 0]
    if wrong:
        raise Refused(f"{kind}: " + ", ".join(wrong))
    return evaluation_contract(report)


def in_shards(items: DataFrame, id_: str, size: str, most: int) -> DataFrame:
    """K8: ``shard`` of each item, filled in order of id to ``most`` bytes by where the item begins, so a shard may end ``most`` bytes late at worst.

    Bytes before an item come from sums over 1,024 ranges of ids and inside them.
    """
    low, high = items.agg(F.min(id_), F.max(id_)).first()
    width = 1 if low is None else max(1, -(-(high - low + 1) // 1024))
    cut = items.withColumn("__range", F.floor((F.col(id_) - F.lit(low or 0)) / width))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("__range").agg(F.sum(size).alias("__all")).select("__range", F.coalesce(F.sum("__all").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__range").orderBy(id_).rowsBetween(Window.unboundedPreceding, -1)
    run = cut.join(starts, "__range").withColumn("__at", F.col("__before") + F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return run.withColumn("shard", F.floor(F.col("__at") / most)).drop("__range", "__before", "__at")
