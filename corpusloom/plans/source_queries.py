"""Round trips through files, and streams driven to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import corpus, tokens
from corpusloom.plans import corpus_queries
from corpusloom.plans.corpus_queries import _IDS, _STRIPPED, _uniform, table
from corpusloom.sources import files, images
from corpusloom.streaming import streams


def _scratch(spark) -> str:
    return files.shared_path(spark, "files")


def csv_roundtrip(spark, sf):
    path = _scratch(spark)
    files.write_series(table(spark, sf, "events").select("event_id", "user_id", "event_type", "value"), path)
    return files.read_series(spark, path, "event_id long, user_id long, event_type string, value double")


def token_store_roundtrip(spark, sf):
    path = _scratch(spark)
    files.write_tokens(tokens.words_to_ids(table(spark, sf, "documents")), path)
    return files.read_tokens(spark, path).select("doc_id", F.size("tokens").cast("long").alias("n"), F.sha2(F.concat_ws(" ", F.col("tokens").cast("array<string>")), 256).alias("tokens_sha256"))


def corpus_roundtrip(spark, sf):
    path = _scratch(spark)
    docs = corpus.documents(table(spark, sf, "documents")).withColumn("split", corpus.split_name("doc_id", fraction=0.1))
    files.write_corpus(docs.select(F.col("clean").alias("text"), "split"), path, escaped=True)
    read = files.read_corpus(spark, path, escaped=True)
    return read.groupBy("split").agg(F.count("*").alias("samples"), F.sum(F.char_length("text")).alias("chars"), F.sum(F.size(F.split("text", "\n")).cast("long")).alias("lines"))


def manifest_record(spark, sf):
    docs = table(spark, sf, "documents").withColumn("split", corpus.split_name("doc_id"))
    r = files.stage_record(docs, "pretrain", 480_000_000)
    return spark.createDataFrame([(r["train_samples"], r["val_samples"], r["actual_chars"], len(r["sources"]))], "train_samples long, val_samples long, actual_chars long, sources long")


def reopened_rows(spark, sf):
    """A source that breaks off twice before every eighth item, opened again each time; what it waited and how often it was opened."""
    openings, waits, taken, broken = [], [], [], {}

    def source():
        openings.append(1)
        for k in range(25):
            if k and k % 8 == 0 and broken.get(k, 0) < 2:
                broken[k] = broken.get(k, 0) + 1
                raise OSError("broken off")
            yield k

    items = files.reopened(source, taken.append, sleep=waits.append)
    if taken != list(range(25)):
        raise ValueError("items were lost or repeated")
    return spark.createDataFrame([(items, len(openings), " ".join(map(str, waits)))], "items int, openings int, waits string")


def hashed_files(spark, sf):
    """Names of customers, a file for each segment in the order of their keys, and the hash of each whole file."""
    path = _scratch(spark)
    rows = table(spark, sf, "customer").select("c_mktsegment", "c_custkey", F.col("c_name").alias("value"))
    rows.repartition("c_mktsegment").sortWithinPartitions("c_mktsegment", "c_custkey").select("c_mktsegment", "value").write.partitionBy("c_mktsegment").text(path)
    found = files.file_hashes(spark, path)
    return found.select(F.regexp_extract("path", "c_mktsegment=([^/]*)", 1).alias("segment"), F.col("length").cast("long").alias("bytes"), "sha256")


def existing_inputs(spark, sf):
    found, missing = files.existing(spark, [f"{sf}/documents.parquet", f"{sf}/nothing-here"])
    return spark.createDataFrame([(p.rsplit("/", 1)[-1], ok) for ps, ok in ((found, True), (missing, False)) for p in ps], "name string, found boolean")


def _folder(spark, sf, name):
    """A stream over the files of one table."""
    static = table(spark, sf, name)
    path = _scratch(spark)
    static.write.parquet(path)
    return streams.read(spark, path, static.schema)


def streamed_documents(spark, sf):
    return streams.to_table(streams.documents(_folder(spark, sf, "documents")).select("doc_id", "rendered"), "append").drop("batch")


def streamed_ema(spark, sf):
    out = streams.to_table(streams.ema(_folder(spark, sf, "events"), "user_id", "event_id", "value"), "update")
    return out.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("ema", "n"), 5).alias("ema"))


def _pictures(spark, sf):
    """Embeddings as pictures of eight by eight bytes."""
    byte = lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x.cast("double") + 1) * 127.5))).cast("int")
    return table(spark, sf, "embeddings").where("label is not null").select("label", F.transform("embedding", byte).alias("pixels"))


def _by_label(read):
    """Pictures of each label, their bytes added up, and added up by place, so that none can be lost or moved unseen."""
    pixel = read.select("label", F.posexplode("pixels").alias("place", "x"))
    return pixel.groupBy("label").agg(F.sum((F.col("place") == 0).cast("long")).alias("n"), F.sum("x").alias("total"), F.sum(F.col("x") * F.col("place")).alias("weighted"))


def image_records(spark, sf):
    """Pictures through the idx form."""
    images.register(spark)
    path = _scratch(spark)
    _pictures(spark, sf).write.format("idx").option("height", 8).option("width", 8).mode("append").save(path)
    return _by_label(spark.read.format("idx").schema("label int, pixels array<smallint>").load(path))


def colour_records(spark, sf):
    """Pictures, each repeated over three planes of 32 by 32, through the cifar form."""
    images.register(spark)
    path = _scratch(spark)
    _pictures(spark, sf).withColumn("pixels", F.flatten(F.array_repeat("pixels", images.CIFAR_PIXELS // 64))).write.format("cifar").mode("append").save(path)
    return _by_label(spark.read.format("cifar").schema("label int, pixels array<smallint>").load(path))


def image_labels(spark, sf):
    """The labels alone, which are read without a pixel."""
    images.register(spark)
    path = _scratch(spark)
    _pictures(spark, sf).write.format("idx").option("height", 8).option("width", 8).mode("append").save(path)
    return spark.read.format("idx").schema("label int").load(path).groupBy("label").agg(F.count("*").alias("n"))


#: Batches in which events arrive, the session's gap, the windows' width and the watermark's delay.
_BATCHES, _GAP, _WIDTH, _DELAY = 12, "6 hours", "1 hour", "3 days"
_GAP_US, _WIDTH_US, _DELAY_US = 6 * 3_600_000_000, 3_600_000_000, 72 * 3_600_000_000


def _arriving(spark, sf):
    """Events in batches of equal spans of time; every twentieth comes a batch late, and every twentieth of the earlier half five batches late."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", micros.alias("us"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    ends = events.agg(F.min("us").alias("low"), F.max("us").alias("high")).first()
    span = F.expr(f"(us - {ends.low}) * {_BATCHES} div {ends.high - ends.low + 1}")
    late = F.when((F.col("event_id") % 20 == 3) & (span < _BATCHES - 1), 1).when((F.col("event_id") % 20 == 7) & (span <= _BATCHES - 6), 5).otherwise(0)
    return events.withColumns({"batch": (span + late).cast("int"), "at": F.timestamp_micros("us")})


def streamed_sessions(spark, sf):
    stream = streams.replayed(spark, _arriving(spark, sf), "batch")
    out = streams.to_table(streams.sessions(stream, "user_id", "at", "cents", _GAP, _DELAY), "append")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n", F.col("total").alias("cents"))


def streamed_windows(spark, sf):
    stream = streams.replayed(spark, _arriving(spark, sf), "batch")
    out = streams.to_table(streams.hourly(stream, "at", "event_type", "cents", _WIDTH, _DELAY), "append")
    return out.select("event_type", F.unix_micros("start").alias("start_us"), "n", F.col("total").alias("cents"))


def streamed_replies(spark, sf):
    """Answers joined to the turn before them as both arrive, a conversation an hour; every seventh answer comes an hour too late."""
    turns = table(spark, sf, "conversations")
    name = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    late = (F.lower("role") == "assistant") & (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(7)) == 3)
    seconds = 86_400 + F.col("conv_id") * 3600 + F.col("turn") * 60 + F.when(late, 3660).otherwise(0)
    high = turns.agg(F.max("conv_id")).first()[0] or 0
    messages = turns.select(F.timestamp_seconds(seconds).alias("ts"), name(F.col("turn")).alias("message_id"), name(F.col("turn") - 1).alias("parent_id"), "role", "text", F.expr(f"cast(conv_id * 3 div {high + 1} as int)").alias("batch"))
    out = streams.to_table(streams.replies(streams.replayed(spark, messages, "batch")), "append")
    return out.select("message_id", "rendered")


def recovered_stream(spark, sf):
    """A stream over all documents that breaks off before, within and after the writing of a batch, and goes on from its checkpoint."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    stream = streams.replayed(spark, docs.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(6)).cast("int")), "batch")
    rows = stream.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    out, tried = streams.Table(spark, rows.schema), {}

    def write(batch, number):
        tried[number] = tried.get(number, 0) + 1
        if number == 1 and tried[number] <= 2:
            raise OSError("broken off before anything was written")
        if number == 3 and tried[number] == 1:
            out.write(batch.limit(1), number)
            raise OSError("broken off half way")
        out.write(batch, number)
        if number == 4 and tried[number] == 1:
            raise OSError("broken off before the batch was marked as done")

    waits = []
    starts = streams.recovered(lambda: out.start(rows, "append", write), sleep=waits.append)
    return out.rows().select("doc_id", "text_sha256", F.lit(starts).alias("starts"), F.lit(" ".join(f"{w:g}" for w in waits)).alias("waits"))


#: Events with their batch and the watermark by which rows are late in it, that of the batch before: the latest time of the batches before
#: that one, in whole milliseconds, less the delay.
_ARRIVED = f"""WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
    s AS (SELECT *, (us - (SELECT min(us) FROM e)) * {_BATCHES} // (SELECT max(us) - min(us) + 1 FROM e) AS span FROM e),
    b AS (SELECT *, span + CASE WHEN event_id % 20 = 3 AND span < {_BATCHES - 1} THEN 1 WHEN event_id % 20 = 7 AND span <= {_BATCHES - 6} THEN 5 ELSE 0 END AS batch FROM s),
    marks AS (SELECT batch, max(max(us)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) // 1000 * 1000 - {_DELAY_US} AS mark FROM b GROUP BY batch),
    a AS (SELECT b.*, coalesce(mark, 0) AS mark, (SELECT max(us) // 1000 * 1000 - {_DELAY_US} FROM e) AS last_mark FROM b JOIN marks USING (batch))"""

def _picture_sql(copies: int) -> str:
    """Sums over pictures of 64 bytes, repeated ``copies`` times; place is the place in the whole."""
    return f"""SELECT label, count(*) FILTER (WHERE k = 1) AS n, CAST(sum(x) * {copies} AS BIGINT) AS total, CAST(sum(x * ({copies} * (k - 1) + 64 * {copies * (copies - 1) // 2})) AS BIGINT) AS weighted
    FROM (SELECT label, k, least(255, greatest(0, CAST(floor((CAST(embedding[k] AS DOUBLE) + 1) * 127.5) AS BIGINT))) AS x FROM embeddings, unnest(range(1, 65)) u(k) WHERE label IS NOT NULL) GROUP BY label"""


QUERIES = {
    "image_records": (image_records, _picture_sql(1)),
    "colour_records": (colour_records, _picture_sql(48)),
    "image_labels": (image_labels, "SELECT label, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY label"),
    "streamed_sessions": (
        streamed_sessions,
        f"""{_ARRIVED},
        kept AS (SELECT *, lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS before FROM a WHERE us + {_GAP_US} > mark),
        cut AS (SELECT *, sum(CASE WHEN before IS NULL OR us > before + {_GAP_US} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS nth FROM kept)
        SELECT user_id, min(us) AS start_us, max(us) + {_GAP_US} AS end_us, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM cut GROUP BY user_id, nth, last_mark HAVING max(us) + {_GAP_US} <= last_mark""",
    ),
    "streamed_windows": (
        streamed_windows,
        f"""{_ARRIVED} SELECT event_type, us // {_WIDTH_US} * {_WIDTH_US} AS start_us, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM a
        WHERE us // {_WIDTH_US} * {_WIDTH_US} + {_WIDTH_US} > mark AND us // {_WIDTH_US} * {_WIDTH_US} + {_WIDTH_US} <= last_mark GROUP BY event_type, us // {_WIDTH_US}""",
    ),
    "streamed_replies": (
        streamed_replies,
        f"""WITH m AS (SELECT conv_id, turn, lower(role) AS role, {corpus_queries._clean('text', 12000)} AS text FROM conversations),
        r AS (SELECT a.conv_id || ':' || a.turn AS message_id, '[INST] ' || u.text || ' [/INST] ' || a.text || chr(10) || '<|endoftext|>' || chr(10) AS rendered FROM m a JOIN m u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1
        WHERE u.role = 'user' AND a.role = 'assistant' AND (a.conv_id + a.turn) % 7 <> 3 AND u.text <> '' AND a.text <> '')
        SELECT message_id, rendered FROM r WHERE length(rendered) BETWEEN 40 AND 12000""",
    ),
    "recovered_stream": (recovered_stream, "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, 5 AS starts, '5 10 5 5' AS waits FROM documents"),
    "csv_roundtrip": (csv_roundtrip, "SELECT event_id, user_id, event_type, value FROM events"),
    "token_store_roundtrip": (token_store_roundtrip, f"SELECT doc_id, len(ids) AS n, sha256(array_to_string(ids, ' ')) AS tokens_sha256 FROM (SELECT doc_id, {_IDS} AS ids FROM documents)"),
    "corpus_roundtrip": (
        corpus_roundtrip,
        corpus_queries._JUDGED + f"SELECT split, count(*) AS samples, CAST(sum(length(clean)) AS BIGINT) AS chars, CAST(sum(len(string_split(clean, chr(10)))) AS BIGINT) AS lines FROM (SELECT CASE WHEN {_uniform("'42:' || doc_id")} < 0.1 THEN 'val' ELSE 'train' END AS split, clean FROM j WHERE reason = 'keep') GROUP BY split",
    ),
    "manifest_record": (
        manifest_record,
        f"SELECT count(*) FILTER (WHERE u >= 0.01) AS train_samples, count(*) FILTER (WHERE u < 0.01) AS val_samples, CAST(sum(n) AS BIGINT) AS actual_chars, count(DISTINCT source) AS sources FROM (SELECT source, {_uniform("'42:' || doc_id")} AS u, {_STRIPPED} AS n FROM documents)",
    ),
    "existing_inputs": (existing_inputs, "SELECT * FROM (VALUES ('documents.parquet', true), ('nothing-here', false)) t(name, found)"),
    "streamed_documents": (streamed_documents, corpus_queries.QUERIES["quality_kept"][1]),
    "streamed_ema": (
        streamed_ema,
        "SELECT user_id, n, round(sum(value * pow(CAST(0.99 AS DOUBLE), n - i) * CASE WHEN i = 1 THEN CAST(1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) - CAST(0.99 AS DOUBLE) END), 5) AS ema FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) GROUP BY user_id, n",
    ),
    "reopened_rows": (reopened_rows, "SELECT 25 AS items, 7 AS openings, CAST('5.0 10.0 5.0 10.0 5.0 10.0' AS VARCHAR) AS waits"),
    "hashed_files": (hashed_files, "SELECT c_mktsegment AS segment, octet_length(encode(t)) AS bytes, sha256(t) AS sha256 FROM (SELECT c_mktsegment, string_agg(c_name, chr(10) ORDER BY c_custkey) || chr(10) AS t FROM customer GROUP BY c_mktsegment)"),
}
