"""Sources: manifests, split folders, images, archives, paged services and configuration."""

from __future__ import annotations

import io
import json
import os
import re
import time
import urllib.error
import urllib.request
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cairn.functions import exprs as X

SPLITS = ["train", "validation", "test", "test_unseen", "calibration"]
# Suffixes that a folder scan takes.
IMAGES = ["jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff"]
REQUIRED = ["image_path", "label", "dataset"]


def load_manifest(spark: SparkSession, path: str, schema: str | None = None, required: list[str] | None = None) -> DataFrame:
    """A manifest by the suffix of its path; a ``ValueError`` for other formats or missing columns."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if suffix == ".csv":
        out = reader.option("header", True).option("escape", '"').option("multiLine", True).option("inferSchema", schema is None).csv(path)
    elif suffix == ".parquet":
        out = reader.parquet(path)
    elif suffix in (".jsonl", ".ndjson"):
        out = reader.json(path)
    else:
        raise ValueError(f"unsupported manifest format {suffix!r}: CSV, Parquet or JSON lines")
    missing = [c for c in required or [] if c not in out.columns]
    if missing:
        raise ValueError(f"manifest without columns {missing}")
    return out


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_splits(spark: SparkSession, folder: str, splits: list[str] | None = None) -> tuple[DataFrame | None, list[str]]:
    """All splits of a folder (Parquet before JSON lines) and the names of missing ones; ``split`` is the file's name, whatever rows say."""
    found, missing = [], []
    for name in splits or SPLITS:
        path = next((p for s in (".parquet", ".jsonl") if exists(spark, p := f"{folder}/{name}{s}")), None)
        if path is None:
            missing.append(name)
        else:
            found.append(load_manifest(spark, path).withColumn("split", F.lit(name)))
    out = None
    for f in found:
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out, missing


def declared(rows: DataFrame, path: str = "image_path", *also: str) -> tuple[DataFrame, DataFrame]:
    """S3: rows that may be fetched, and the others with their ``reason`` (missing path, unsafe path, forbidden)."""
    text = F.trim(F.coalesce(F.col(path), F.lit("")))
    forbidden = X.forbidden_reason(*[F.col(c) for c in (path, *also)])
    reason = F.when(text == "", "missing_image_path").when(~X.is_safe_relative_path(F.col(path)), "unsafe_path").when(forbidden != "", forbidden)
    tagged = rows.withColumn("reason", reason)
    return tagged.where("reason is null").drop("reason"), tagged.where("reason is not null")


def files(spark: SparkSession, folder: str, suffixes: list[str] | None = None) -> DataFrame:
    """Files below a folder or glob, with size and digest of their content; suffixes in any case. Other files are listed, but not read."""
    either = lambda s: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s)
    names = "*.{" + ",".join(either(s) for s in suffixes or IMAGES) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(folder)
    return found.select("path", "length", F.sha2("content", 256).alias("sha256"))


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded images below a folder; what can't be decoded has negative sizes."""
    return spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", False).load(folder)


def missing_files(rows: DataFrame, listing: DataFrame, path: str = "image_path", mask: str = "tamper_mask_path", root: str = "") -> DataFrame:
    """One row with ``rows``, ``missing_images`` and ``missing_masks``; blank masks are not missed."""

    def full(c: str) -> Column:
        p = F.nullif(F.replace(F.trim(F.col(c)), F.lit("\\"), F.lit("/")), F.lit(""))
        return F.when(p.startswith("/") | (F.lit(root) == ""), p).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), p))

    have = listing.select(F.regexp_replace("path", "^file:/+", "/").alias("have")).distinct()
    at = rows.select(full(path).alias("p"), full(mask).alias("m") if mask in rows.columns else F.lit(None).cast("string").alias("m"))
    joined = at.join(have.withColumn("hit", F.lit(1)), F.col("p") == F.col("have"), "left").drop("have")
    joined = joined.join(have.withColumn("mask_hit", F.lit(1)), F.col("m") == F.col("have"), "left")
    return joined.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("hit").isNull()).alias("missing_images"), F.count_if(F.col("m").isNotNull() & F.col("mask_hit").isNull()).alias("missing_masks"))


def zip_members(spark: SparkSession, folder: str, names: list[str] | None = None, ordinals: list[int] | None = None) -> DataFrame:
    """Members of the zip archives below a folder, all or by name or by position among the sorted file names.

    An archive is opened by one task, one member in memory at a time; a broken
    archive gives one row with ``error``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["archive", "ordinal", "member", "content", "error"]
        for b in batches:
            for path, raw in zip(b["path"], b["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        for i, name in enumerate(sorted(n for n in z.namelist() if not n.endswith("/"))):
                            if (names is None or name in names) and (ordinals is None or i in ordinals):
                                yield pd.DataFrame([[path, i, name, z.read(name), None]], columns=columns)
                except zipfile.BadZipFile as e:
                    yield pd.DataFrame([[path, None, None, None, str(e)]], columns=columns)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(folder)
    return found.select("path", "content").mapInPandas(run, "archive string, ordinal int, member string, content binary, error string")


def first_field(rows: DataFrame, fields: list[str]) -> Column:
    """The first of the fields that the table has and that isn't null or blank."""
    have = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in fields if c in rows.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


class _Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class _PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.size = options["url"], int(options.get("pagesize", "100"))
        self.tries, self.wait = int(options.get("tries", "5")), float(options.get("wait", "1"))
        wanted = options.get("rows")
        last = int(options.get("last", "-1"))
        self.wanted = set(map(int, wanted.split(","))) if wanted else None
        self.pages = sorted({i // self.size for i in self.wanted}) if self.wanted is not None else range(last // self.size + 1)

    def partitions(self):
        return [_Page(n) for n in self.pages]

    def read(self, partition):
        start = partition.number * self.size
        url = self.url.replace("{offset}", str(start)).replace("{length}", str(self.size))
        for t in range(self.tries):
            try:
                with urllib.request.urlopen(url, timeout=60) as r:
                    page = json.load(r)
                break
            except urllib.error.HTTPError as e:
                if e.code != 429 and e.code < 500 or t + 1 == self.tries:
                    raise
                time.sleep(self.wait * 2**t)
        for i, row in enumerate(page["rows"]):
            at = int(row.get("row_idx", start + i))
            if self.wanted is None or at in self.wanted:
                yield at, json.dumps(row.get("row", row), sort_keys=True)


class PagedRows(DataSource):
    """Rows of a paged service as ``row_idx`` and ``row`` (JSON); a partition is a page.

    Options: ``url`` with ``{offset}`` and ``{length}``; ``rows`` (numbers that
    are wanted: only their pages are read) or ``last``; ``pagesize``; ``tries``
    and ``wait`` for answers 429 and 5xx.
    """

    @classmethod
    def name(cls):
        return "paged_rows"

    def schema(self):
        return "row_idx long, row string"

    def reader(self, schema):
        return _PageReader(self.options)


def expand_environment(value, environment=os.environ):
    """``${NAME}`` in all texts of a configuration; a ``KeyError`` for names that aren't set."""
    if isinstance(value, dict):
        return {k: expand_environment(v, environment) for k, v in value.items()}
    if isinstance(value, list):
        return [expand_environment(v, environment) for v in value]
    return re.sub(r"\$\{([A-Z0-9_]+)\}", lambda m: environment[m[1]], value) if isinstance(value, str) else value


def load_config(path: str) -> dict:
    """A JSON file, or YAML where that library is installed."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            config = json.load(f)
        else:
            import yaml

            config = yaml.safe_load(f)
    if not isinstance(config, dict):
        raise TypeError("the root of a configuration must be a mapping")
    return expand_environment(config)


def expand_globs(spark: SparkSession, patterns: list[str]) -> list[str]:
    """The files of each pattern in order, by the file system that the path names; a pattern without a match stays as it is."""
    out = []
    for p in patterns:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
        names = sorted(f.getPath().toUri().getPath() for f in found) if found else []
        out += names or [p]
    return out


def probed(rows: DataFrame, listings: list[DataFrame], key: str = "member", remote: str | None = None) -> DataFrame:
    """Each row with the ``path`` of the first listing (``key``, ``path``) that has its key, else the ``remote`` address with the key appended; ``probe`` is the listing's position, null for remote and missing ones.

    Several files of one key in a listing: the first path in order.
    """
    ranked = None
    for i, one in enumerate(listings):
        part = one.select(F.col(key).alias("__key"), F.struct(F.lit(i).alias("probe"), F.col("path").cast("string").alias("path")).alias("__hit"))
        ranked = part if ranked is None else ranked.unionByName(part)
    if ranked is None:
        joined = rows.withColumn("__hit", F.lit(None).cast("struct<probe:int,path:string>"))
    else:
        joined = rows.join(ranked.groupBy("__key").agg(F.min("__hit").alias("__hit")), F.col(key) == F.col("__key"), "left").drop("__key")
    away = F.lit(None).cast("string") if remote is None else F.concat(F.lit(remote.rstrip("/") + "/"), F.col(key))
    return joined.withColumns({"path": F.coalesce(F.col("__hit.path"), away), "probe": F.col("__hit.probe")}).drop("__hit")


#: Fields that may hold an image, in the order in which they are tried.
IMAGE_FIELDS = ["image", "img", "jpg", "png", "picture", "photo", "file", "image_bytes", "content", "data"]


def image_field(rows: DataFrame, path_field: str | None = None, url_field: str | None = None, pair: tuple[str, int] | None = None) -> DataFrame:
    """``image_path``, ``image_bytes`` and ``image_from`` of each row.

    Tried in order: the declared path field, the url field, one item of an array
    of images, then ``IMAGE_FIELDS``. A field may be text, bytes, or a struct of
    ``bytes`` and ``path`` (bytes win). Blank texts and empty bytes are skipped.
    """
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    tried: list[tuple[str, Column, object]] = [(n, F.col(n), kinds[n]) for n in (path_field, url_field) if n in kinds]
    if pair and pair[0] in kinds:
        tried.append((pair[0], F.get(F.col(pair[0]), F.lit(pair[1])), kinds[pair[0]].elementType))
    tried += [(n, F.col(n), kinds[n]) for n in IMAGE_FIELDS if n in kinds]
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    raw = lambda c: F.when(F.octet_length(c) > 0, c)
    path, content, origin = F.lit(None).cast("string"), F.lit(None).cast("binary"), F.lit(None).cast("string")
    for name, c, kind in reversed(tried):
        p, b = F.lit(None).cast("string"), F.lit(None).cast("binary")
        if kind.typeName() == "string":
            p = text(c)
        elif kind.typeName() == "binary":
            b = raw(c)
        elif kind.typeName() == "struct":
            b = raw(c["bytes"]) if "bytes" in kind.names else b
            p = F.when(b.isNull(), text(c["path"])) if "path" in kind.names else p
        hit = p.isNotNull() | b.isNotNull()
        path, content, origin = F.when(hit, p).otherwise(path), F.when(hit, b).otherwise(content), F.when(hit, F.lit(name)).otherwise(origin)
    return rows.withColumns({"image_path": path, "image_bytes": content, "image_from": origin})


def dispatched(tasks: DataFrame, registry: DataFrame, readers: dict, key: str = "dataset", kind: str = "source_type") -> DataFrame:
    """Each source's tasks go to the reader of its registered type.

    ``readers`` maps a type to a function from tasks to tasks with ``status``.
    Tasks of an unknown data set or type are errors. The registry must have one
    row for each key.
    """
    typed = tasks.join(registry.select(key, kind), key, "left")
    out = typed.where(~F.coalesce(F.col(kind).isin(list(readers)), F.lit(False))).withColumn("status", F.lit("error"))
    for name, read in readers.items():
        out = out.unionByName(read(typed.where(F.col(kind) == name)), allowMissingColumns=True)
    return out


def cached_features(rows: DataFrame, features: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows with their cached features, by id and not by position; a row without features fails the query, so does an id that the cache has twice."""
    unique = features.groupBy(key).agg(F.first("features").alias("features"), F.count(F.lit(1)).alias("__n"))
    joined = rows.join(unique, key, "left")
    wrong = F.raise_error(F.concat(F.lit(f"no single cached feature for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("int")
    return joined.where(F.when(F.col("__n") == 1, 1).otherwise(wrong) == 1).drop("__n")


def find_environment(start: str, name: str = ".env") -> dict[str, str]:
    """``NAME=value`` lines of the nearest environment file, from a folder upwards; quotes are taken off, and # lines left out."""
    folder = os.path.abspath(start)
    while True:
        path = os.path.join(folder, name)
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as f:
                lines = [x.strip().removeprefix("export ") for x in f]
            return {k.strip(): v.strip().strip("\"'") for k, _, v in (x.partition("=") for x in lines if "=" in x and not x.startswith("#"))}
        if os.path.dirname(folder) == folder:
            return {}
        folder = os.path.dirname(folder)
