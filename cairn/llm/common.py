"""Plumbing that the operators share: tables, the shared folder, batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Without it Spark keeps a query's shuffles on disk until the driver's JVM has collected its plan.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Only a local session may go
    without: it gets a temporary folder that ends with the process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = tempfile.mkdtemp(prefix="cairn-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def materialise(df: DataFrame, label: str, codec: str = "snappy") -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it again: the lineage ends here,
    and a lost executor costs no recomputation. The shuffles of the write are
    deleted when it ends."""
    path = f"{shared_dir(df.sparkSession)}/cairn/{label}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that ``materialise`` wrote and nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def crc_of_id(column: str = "doc_id"):
    """crc32 of the id as text; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def crc(value) -> int:
    return zlib.crc32(str(value).encode())


def text_slices(batches: Iterator[pa.RecordBatch], max_bytes: int = 2_000_000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice holds about ``max_bytes`` of text, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(sizes):
            total += int(n) + 16
            if total >= max_bytes:
                yield batch.slice(start, i + 1 - start)
                start, total = i + 1, 0
        if start < len(sizes):
            yield batch.slice(start)


def raw_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def spread(df: DataFrame) -> int:
    """Partitions for work keyed by hashes."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


class Bounded(dict):
    """A memo that forgets everything when it is full."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value
