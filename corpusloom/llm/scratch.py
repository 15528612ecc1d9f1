"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import ship

#: Bounds on one Arrow batch handed to a Python worker: rows (long texts make rows large) and bytes.
BATCH_ROWS = 256
BATCH_BYTES = 16 << 20
#: Bytes of a row group of a written table: what a writer gathers and a reader holds of a file at once.
GROUP_BYTES = 8 << 20
_VECTORED = "parquet.hadoop.vectored.io.enabled"
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"

_own: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def prepare(spark: SparkSession) -> None:
    """Make the package known to the Python workers and bound what one of them, and a reader of files, holds at once.

    Lazy results run under these session settings too, so they stay; smaller ones of the caller are kept.
    """
    ship(spark)
    if not 0 < int(spark.conf.get(_ROWS)) <= BATCH_ROWS:
        spark.conf.set(_ROWS, str(BATCH_ROWS))
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BYTES)) > BATCH_BYTES:
        spark.conf.set(_BYTES, str(BATCH_BYTES))
    # Vectored reads take whole column chunks into memory outside the heap, which each thread that reads then keeps.
    spark.conf.set(_VECTORED, "false")


@contextmanager
def short_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of many short rows, for what is written inside."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


def base_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, or the folder set on its context.

    Only a local session, whose one machine sees all files, falls back to a temporary folder.
    """
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if not set_by_cluster:
        folder = spark.sparkContext._jsc.sc().getCheckpointDir()
        set_by_cluster = folder.get() if folder.isDefined() else None
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{base_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a scan of it.

    This cuts the lineage at files that outlive any executor, and fixes values (row ids, sampled
    ranges) that a recomputation could change.  The files stay until :func:`release` is called or
    the cluster clears its checkpoint folder, because lazy results may still read them.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of keys, of at most some 100 bytes each, that are sent to every task.
FEW_ROWS = 500_000


def few_or_merged(keys: DataFrame, rows: int = FEW_ROWS) -> DataFrame:
    """A written table of keys, marked to be sent to every task if it has few rows, else to be merged with the other side."""
    return F.broadcast(keys) if keys.limit(rows + 1).count() <= rows else keys.hint("merge")


def made(spark: SparkSession) -> list[str]:
    """Paths of this session's tables, in the order in which they were made."""
    return list(_made.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, paths: Iterable[str] | None = None) -> None:
    """Delete tables, all of this session's if none are named; results that read them and are not yet written are lost."""
    jvm, known = spark.sparkContext._jvm, _made.get(spark.sparkContext.applicationId, [])
    for p in list(known if paths is None else paths):
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if p in known:
            known.remove(p)
