"""Files: existing inputs, CSV series, corpus text, token stores, manifests, previews."""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T


@dataclass(frozen=True)
class Source:
    """A weighted input of a mix; a weight of 0 or less switches it off."""

    name: str
    weight: float
    path: str


# Default shares of the inputs and targets in tokens.
PRETRAIN_WEIGHTS = (0.65, 0.35)
CHAT_WEIGHTS = (0.90, 0.0)
PRETRAIN_TOKENS, CHAT_TOKENS = 120_000_000, 8_000_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; only a local session may do without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        folder = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = folder.get() if folder.isDefined() else None
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    return f"{base.rstrip('/')}/corpusloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, so that what refers to it twice computes it once."""
    path = shared_path(df.sparkSession, "written")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def active(sources: Iterable[Source]) -> list[Source]:
    return [s for s in sources if s.weight > 0]


def read_source(spark: SparkSession, source: Source) -> DataFrame:
    """A Parquet input with its name as ``source``."""
    return spark.read.parquet(source.path).withColumn("source", F.lit(source.name))


def switched(first: Source, other: Source, direct: bool) -> Source:
    """Which of two inputs of the same form is read."""
    return other if direct else first


def arguments_json(**arguments: Column) -> Column:
    """Named arguments as one line of JSON, in their order: all values as text, as on a command line, missing ones as null."""
    texts = [value.cast("string").alias(name) for name, value in arguments.items()]
    return F.to_json(F.struct(*texts), {"ignoreNullFields": "false"})


def existing(spark: SparkSession, paths: Iterable[str]) -> tuple[list[str], list[str]]:
    """The paths that hold data, and the others; any file system that Spark reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found, missing = [], []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        there = fs.exists(path) and fs.getContentSummary(path).getLength() > 0
        (found if there else missing).append(p)
    return found, missing


def read_series(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header row, by a given schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_series(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def read_ndjson_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, or no rows where there is no file."""
    return spark.read.schema(schema).json(path) if existing(spark, [path])[0] else spark.createDataFrame([], schema)


def write_corpus(samples: DataFrame, path: str, text_col: str = "text", split_col: str = "split", escaped: bool = False) -> None:
    """Text files by split, samples stripped and each followed by a blank line.

    A blank line within a sample ends it for a reader.  With ``escaped`` it is written as a backslash, and a line of backslashes with one more.
    """
    text = T.strip(F.col(text_col))
    if escaped:
        text = F.regexp_replace(text, r"(?dm)^(\\*)$", r"$1\\")
    lines = samples.select(split_col, F.concat(text, F.lit("\n")).alias("value"))
    lines.write.partitionBy(split_col).text(path)


def read_corpus(spark: SparkSession, path: str, escaped: bool = False) -> DataFrame:
    """The samples of :func:`write_corpus` with their split."""
    text = T.strip(F.col("value"))
    if escaped:
        text = F.regexp_replace(text, r"(?dm)^(\\*)\\$", "$1")
    return spark.read.option("lineSep", "\n\n").text(path).where(T.strip(F.col("value")) != "").select(text.alias("text"), "split").where("text <> ''")


def write_tokens(ids: DataFrame, path: str, overwrite: bool = False) -> None:
    """A token store; refuses to replace one unless told to."""
    ids.write.mode("overwrite" if overwrite else "error").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def preview(samples: DataFrame, order: str, most: int = 24, chars: int = 1200) -> DataFrame:
    """The first samples, shortened."""
    return samples.orderBy(order).limit(most).withColumn("text", F.substring("text", 1, chars))


def stage_record(samples: DataFrame, stage: str, target_chars: int) -> dict:
    """Counts of one stage by split and source; one row a split and source reaches the driver."""
    chars = F.char_length(T.strip(F.col("text"))) + 1
    rows = samples.groupBy("source", "split").agg(F.count("*").alias("samples"), F.sum(chars).alias("chars")).collect()
    record: dict = {"stage": stage, "target_chars": target_chars, "actual_chars": sum(r.chars for r in rows), "sources": {}}
    for split in ("train", "val"):
        record[f"{split}_samples"] = sum(r.samples for r in rows if r.split == split)
        record[f"{split}_chars"] = sum(r.chars for r in rows if r.split == split)
    for r in rows:
        own = record["sources"].setdefault(r.source, {"samples": 0, "chars": 0})
        own["samples"] += r.samples
        own["chars"] += r.chars
    return record


def write_manifest(spark: SparkSession, records: list[dict], path: str) -> None:
    """One JSON document of all stages."""
    document = json.dumps({"created": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "stages": records}, sort_keys=True, default=str)
    spark.createDataFrame([(document,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def with_retries(action: Callable[[], object], most: int = 8, base_seconds: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """Run ``action`` again after a failure, waiting base, 2, 4 and at most 8 times base seconds; fails after ``most`` in a row."""
    failures = 0
    while True:
        try:
            return action()
        except Exception as error:
            failures += 1
            if failures > most:
                raise RuntimeError(f"failed after {most} retries") from error
            sleep(base_seconds * min(8, 2 ** (failures - 1)))


def reopened(open_source: Callable[[], Iterable], take: Callable[[object], None], most: int = 8, base_seconds: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> int:
    """Hand every item of a source to ``take``; after a failure the source is opened again and goes on behind what was taken.

    Waits like :func:`with_retries`.  An item that gets through sets the count of failures back, so only
    ``most`` failures in a row end it.  Returns the number of items.
    """
    taken, failures = 0, 0
    while True:
        try:
            items: Iterator = iter(open_source())
            for _ in range(taken):
                next(items)
            for item in items:
                take(item)
                taken, failures = taken + 1, 0
            return taken
        except Exception as error:
            failures += 1
            if failures > most:
                raise RuntimeError(f"failed after {most} retries") from error
            sleep(base_seconds * min(8, 2 ** (failures - 1)))
