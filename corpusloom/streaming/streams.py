"""Structured Streaming forms of cleaning, gating, reply pairing, sessions and the moving average, and what drives them to a table."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions import text as T
from corpusloom.operators import corpus
from corpusloom.sources import files


def read(spark: SparkSession, path: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    """New Parquet files below ``path`` as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def documents(stream: DataFrame) -> DataFrame:
    """Cleaned, gated and rendered documents; keeps no state."""
    return corpus.documents(stream)


def replies(messages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Answers joined to prompts that came before them by at most ``delay``; columns ``ts, message_id, parent_id, role, text``."""
    clean = messages.select("ts", "message_id", "parent_id", T.normalise_role(F.col("role")).alias("role"), T.clean_text(F.col("text"), T.CHAT_CHARS[1]).alias("text")).where("text <> ''").withWatermark("ts", delay)
    prompts = clean.where("role = 'user'").select(F.col("message_id").alias("prompt_id"), F.col("ts").alias("prompt_ts"), F.col("text").alias("prompt"))
    answers = clean.where("role = 'assistant'").select("ts", "message_id", "parent_id", "text")
    joined = answers.join(prompts, F.expr(f"parent_id = prompt_id AND prompt_ts < ts AND prompt_ts >= ts - INTERVAL {delay}"))
    return joined.select("ts", "message_id", T.render_pair(F.col("prompt"), F.col("text"), end=True).alias("rendered")).where("rendered <> ''")


def ema(stream: DataFrame, key: str, order: str, value: str, beta: float = 0.99) -> DataFrame:
    """``key, n, ema`` after each batch, from one number of state for each key."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, average = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(batches)).sort_values(order)
        for x in rows[value]:
            average = float(x) if n == 0 else beta * average + (1 - beta) * float(x)
            n += 1
        state.update((n, average))
        yield pd.DataFrame({key: [k[0]], "n": [n], "ema": [average]})

    kind = stream.schema[key].dataType.simpleString()
    grouped = stream.select(key, order, value).groupBy(key)
    return grouped.applyInPandasWithState(update, f"{key} {kind}, n long, ema double", "n long, ema double", "update", "NoTimeout")


def windowed_counts(stream: DataFrame, time_col: str = "ts", width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Rows and mean value by window and type; rows later than ``delay`` are left out."""
    stamped = stream.withColumn(time_col, F.col(time_col).cast("timestamp"))
    return stamped.withWatermark(time_col, delay).groupBy(F.window(time_col, width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def sessions(stream: DataFrame, key: str, time_col: str, value: str, gap: str, delay: str) -> DataFrame:
    """``key, start, end, n, total``: stretches of a key's rows with less than ``gap`` between neighbours, once they are closed.

    A session closes when the watermark, the latest time seen in earlier batches less ``delay``, has reached its end.  A row is left
    out if the session it would begin alone was closed in the batch before.  State is the open sessions.
    """
    open_rows = stream.select(key, time_col, value).withWatermark(time_col, delay)
    grouped = open_rows.groupBy(key, F.session_window(time_col, gap).alias("session"))
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(key, "session.start", "session.end", "n", "total")


def hourly(stream: DataFrame, time_col: str, group: str, value: str, width: str, delay: str) -> DataFrame:
    """``group, start, n, total`` by window, once it is closed; a row is left out if its window was closed in the batch before."""
    stamped = stream.select(group, time_col, value).withWatermark(time_col, delay)
    return stamped.groupBy(group, F.window(time_col, width).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(group, "w.start", "n", "total")


#: Rows of one file of a replayed batch, at least, where a batch is cut into several.
FILE_ROWS = 500_000


def replayed(spark: SparkSession, rows: DataFrame, batch: str, files_a_batch: int | None = None) -> DataFrame:
    """A stream of ``rows`` whose micro-batches are the values of ``batch`` (a small number of them), in their order.

    Each batch is as many files, by default one for each :data:`FILE_ROWS` rows of the smallest batch, so that tasks share it.  Rows are
    kept by batch, and each is read once.
    """
    path, kept = files.shared_path(spark, "replay"), files.shared_path(spark, "batches")
    rows.write.partitionBy(batch).parquet(kept)
    own = ST.StructType([*[f for f in rows.schema.fields if f.name != batch], rows.schema[batch]])
    parted = spark.read.schema(own).parquet(kept)
    counts = {r[0]: r[1] for r in parted.groupBy(batch).count().collect()}
    several = files_a_batch or max(1, min(counts.values(), default=0) // FILE_ROWS)
    for b in sorted(counts):
        # Rows are dealt in turn, so with this many in a batch no file stays empty.
        parted.where(F.col(batch) == b).drop(batch).repartition(several).write.mode("append").parquet(path)
    return read(spark, path, rows.drop(batch).schema, several)


class Table:
    """A table in the shared folder that a stream fills batch by batch.

    Each batch is a folder named by its number and replaces what an earlier attempt at the same batch
    left, so a batch that is run again counts once.  Nothing is held on the driver.
    """

    def __init__(self, spark: SparkSession, schema: ST.StructType) -> None:
        self.spark, self.schema = spark, schema
        self.path, self.checkpoint = files.shared_path(spark, "stream"), files.shared_path(spark, "stream-state")

    def write(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def start(self, stream: DataFrame, mode: str, write: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
        """Go on with the stream from what the checkpoint says is done, over all that is there."""
        return stream.writeStream.foreachBatch(write or self.write).outputMode(mode).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()

    def rows(self) -> DataFrame:
        """All batches so far, with their number as ``batch``."""
        schema = ST.StructType([*self.schema.fields, ST.StructField("batch", ST.IntegerType())])
        return self.spark.read.schema(schema).parquet(self.path) if files.existing(self.spark, [self.path])[0] else self.spark.createDataFrame([], schema)


def to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Drive a stream over what is there to its end; its rows, with the number of their ``batch``."""
    table = Table(stream.sparkSession, stream.schema)
    table.start(stream, mode).awaitTermination()
    return table.rows()


def recovered(start: Callable[[], StreamingQuery], most: int = 8, base_seconds: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> int:
    """Run a query to its end; after a failure it is started again from its checkpoint.  Returns how often it was started.

    Waits base, 2, 4 and at most 8 times base seconds.  A batch that gets through sets the count of failures back, so only ``most`` failures in a
    row end it.
    """
    failures, reached, starts = 0, -1, 0
    while True:
        query, starts = start(), starts + 1
        try:
            query.awaitTermination()
            return starts
        except Exception as error:
            done = query.lastProgress
            if done is not None and done["batchId"] > reached:
                reached, failures = done["batchId"], 0
            failures += 1
            if failures > most:
                raise RuntimeError(f"failed after {most} retries") from error
            sleep(base_seconds * min(8, 2 ** (failures - 1)))
