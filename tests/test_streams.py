"""Streams give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import corpus
from corpusloom.streaming import streams


def _drain(stream, mode):
    return streams.to_table(stream, mode).drop("batch").collect()


def test_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.repartition(3).write.parquet(f"{tmp_path}/d")
    got = _drain(streams.documents(streams.read(spark, f"{tmp_path}/d", docs.schema, 1)).select("doc_id", "rendered"), "append")
    assert sorted(got) == sorted(corpus.documents(docs).select("doc_id", "rendered").collect())


def test_replies(spark, tmp_path):
    long = "this is a sentence that is long enough"
    rows = [("2024-01-01 00:00:00", "p", None, "prompter", long), ("2024-01-01 00:10:00", "a", "p", "assistant", long), ("2024-01-01 05:00:00", "b", "p", "assistant", long), ("2023-12-31 23:59:00", "c", "p", "assistant", long)]
    df = spark.createDataFrame(rows, "ts string, message_id string, parent_id string, role string, text string").selectExpr("cast(ts as timestamp) ts", "message_id", "parent_id", "role", "text")
    df.coalesce(1).write.parquet(f"{tmp_path}/m")
    got = _drain(streams.replies(streams.read(spark, f"{tmp_path}/m", df.schema)), "append")
    assert [r.message_id for r in got] == ["a"]


def test_windowed_counts(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.coalesce(1).write.parquet(f"{tmp_path}/e")
    got = _drain(streams.windowed_counts(streams.read(spark, f"{tmp_path}/e", events.schema)), "complete")
    assert sum(r.n for r in got) == events.count()


def _stream(spark, batches, schema="k string, at long, v long"):
    rows = [(*r, b) for b, own in enumerate(batches) for r in own]
    return streams.replayed(spark, spark.createDataFrame(rows, schema + ", batch int").withColumn("at", F.timestamp_seconds("at")), "batch")


def test_sessions_and_late_rows(spark):
    hot = [("hot", 10_000 + 5 * i, 1) for i in range(300)]  # one session over many rows
    first = [("a", 10_000, 1), ("a", 10_050, 2), ("a", 10_200, 4), (None, 10_010, 8), ("b", 10_000, None), *hot]
    second = [("a", 10_120, 16), ("b", 14_000, 32)]  # joins the two sessions of "a", late but open; mark 14,000 - 600 from here on
    third = [("c", 15_000, 512)]
    fourth = [("a", 13_250, 64), ("a", 13_301, 128), ("hot", 10_100, 256), ("c", 20_000, 1024)]  # late by the mark of two batches before: 13,250 + 100 is below it
    rows = streams.to_table(streams.sessions(_stream(spark, [first, second, third, fourth]), "k", "at", "v", "100 seconds", "600 seconds"), "append")
    got = {(r.k, F_seconds(r.start), F_seconds(r.end)): (r.n, r.total) for r in rows.collect()}
    assert got == {("a", 10_000, 10_300): (4, 23), (None, 10_010, 10_110): (1, 8), ("b", 10_000, 10_100): (1, None), ("hot", 10_000, 11_595): (300, 300), ("a", 13_301, 13_401): (1, 128), ("b", 14_000, 14_100): (1, 32), ("c", 15_000, 15_100): (1, 512)}


def F_seconds(t):
    return int(t.timestamp())


def test_windows_and_late_rows(spark):
    batches = [[("a", 7200, 1), ("a", 7300, 2), ("b", 7200, 4)], [("a", 20_000, 8)], [("a", 7500, 128)], [("a", 7400, 16), ("a", 14_500, 32), ("b", 40_000, 64)]]
    rows = streams.to_table(streams.hourly(_stream(spark, batches), "at", "k", "v", "1 hour", "1 hour"), "append")
    assert sorted((r.k, F_seconds(r.start), r.n, r.total) for r in rows.collect()) == [("a", 7200, 3, 131), ("a", 14_400, 1, 32), ("a", 18_000, 1, 8), ("b", 7200, 1, 4)]


def test_recovery_counts_every_row_once(spark):
    stream = _stream(spark, [[("x", i, b)] * 5 for b, i in enumerate(range(4))])
    table, failed, waits = streams.Table(spark, stream.schema), [], []

    def write(batch, number):
        table.write(batch, number)  # written, but not yet marked as done
        if failed.count(number) < (3 if number == 2 else 1):
            failed.append(number)
            raise OSError("broken off")

    assert streams.recovered(lambda: table.start(stream, "append", write), most=3, sleep=waits.append) == 7
    assert waits == [5, 5, 5, 10, 20, 5] and sorted(r.v for r in table.rows().collect()) == [v for v in range(4) for _ in range(5)]


def test_recovery_gives_up(spark):
    stream = _stream(spark, [[("x", 1, 1)]])
    table, waits = streams.Table(spark, stream.schema), []

    def write(batch, number):
        raise OSError("always")

    with pytest.raises(RuntimeError, match="after 2 retries"):
        streams.recovered(lambda: table.start(stream, "append", write), most=2, sleep=waits.append)
    assert waits == [5, 10] and table.rows().count() == 0


def test_large_batches_are_several_files(spark, monkeypatch):
    """No task writes a whole batch, and a batch still arrives as one."""
    monkeypatch.setattr(streams, "FILE_ROWS", 100)
    stream = _stream(spark, [[("x", i, b)] * 350 for b, i in enumerate(range(3))])
    table, seen = streams.Table(spark, stream.schema), []

    def write(batch, number):
        seen.append((number, batch.select(F.input_file_name()).distinct().count(), sorted({r.v for r in batch.select("v").distinct().collect()}), batch.count()))
        table.write(batch, number)

    table.start(stream, "append", write).awaitTermination()
    assert seen == [(b, 3, [b], 350) for b in range(3)]
