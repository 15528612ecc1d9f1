"""Text, chat, mixing and sampling queries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import corpus, telemetry, tokens
from corpusloom.operators.ordered import running, shuffle_key, uniform
from corpusloom.sources import files

#: Weights of all sources; every fifth is switched off.
WEIGHTS = {f"src{k}": (k % 5) * 0.25 for k in range(20)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- SQL shared by several queries -------------------------------------------------------------

#: The cleaning chain; compatibility normalisation changes nothing in the test tables.
def _clean(column: str, most: int) -> str:
    lines = f"regexp_replace(regexp_replace(regexp_replace(coalesce({column}, ''), '[\\x00-\\x08\\x0B-\\x1F]', '', 'g'), '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g')"
    whole = f"trim(regexp_replace({lines}, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))"
    head = f"substring({whole}, 1, {most})"
    return f"CASE WHEN length({whole}) > {most} THEN trim(CASE WHEN contains({head}, ' ') THEN regexp_replace({head}, ' [^ ]*$', '', 's') ELSE {head} END, ' ' || chr(10)) ELSE {whole} END"


_JUNK = " + ".join(f"CAST(contains(lower(clean), '{p}') AS INT)" for p in T.JUNK_PHRASES)
_JUDGED = f"""
WITH c AS (SELECT doc_id, source, {_clean('text', 32000)} AS clean FROM documents),
w AS (SELECT *, CASE WHEN clean = '' THEN [] ELSE regexp_split_to_array(clean, '\\s+') END AS split FROM c),
j AS (SELECT doc_id, source, clean, CASE
  WHEN length(clean) < 180 THEN 'short'
  WHEN 100 * length(regexp_replace(clean, '[^\\p{{L}}]', '', 'g')) < 45 * length(clean) THEN 'letters'
  WHEN len(split) < 35 THEN 'words'
  WHEN len(split) > 80 AND 100 * len(list_distinct(split)) < 18 * len(split) THEN 'repeats'
  WHEN {_JUNK} >= 2 THEN 'junk' ELSE 'keep' END AS reason FROM w)
"""
_KEY = "CAST(('0x' || substring(sha256({0}), 1, 13)) AS BIGINT)"


def _uniform(text: str) -> str:
    return f"(CAST({_KEY.format(text)} AS DOUBLE) / 4503599627370496.0)"


# --- queries -----------------------------------------------------------------------------------


def clean_documents(spark, sf):
    docs = corpus.cleaned(table(spark, sf, "documents"))
    return docs.select("doc_id", "clean", F.char_length("clean").cast("long").alias("n_clean"))


def quality_reasons(spark, sf):
    return corpus.judged(table(spark, sf, "documents")).select("doc_id", "reason")


def quality_kept(spark, sf):
    return corpus.documents(table(spark, sf, "documents")).select("doc_id", "rendered")


def quality_by_source(spark, sf):
    judged = corpus.judged(table(spark, sf, "documents"))
    return judged.groupBy("source", "reason").agg(F.count("*").alias("n"), F.sum(F.char_length("clean")).alias("chars"))


def render_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.render_document(F.coalesce("text", F.lit(""))).alias("rendered"))


def one_line_texts(spark, sf):
    return table(spark, sf, "documents").where("text <> ''").select("doc_id", T.one_line(F.col("text")).alias("line"))


def word_statistics(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", T.words(F.coalesce("text", F.lit(""))).alias("w"))
    return docs.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), T.letters(F.col("text")).cast("long").alias("n_letters"), T.junk_hits(F.col("text")).cast("long").alias("n_junk"))


def normalize_roles(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.normalise_role(F.col("role")).alias("role"))


def messages(spark, sf) -> DataFrame:
    """Turns as a message tree: every turn answers the one before; ids and flags are made up from the turn."""
    t = table(spark, sf, "conversations")
    parts = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    n = F.col("conv_id") + F.col("turn")
    return t.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), parts(F.col("turn")).alias("message_id"), parts(F.col("turn") - 1).alias("parent_id"), "role", "text",
        F.when(n % 7 == 0, "de").otherwise("en").alias("lang"), F.when(n % 11 == 0, True).alias("deleted"), F.when(n % 13 == 0, False).alias("review_result"),
        F.when(n % 5 == 0, "x").when(n % 5 == 1, "2").when(n % 5 == 2, "0").alias("rank"),
    )


def reply_pairs(spark, sf):
    return corpus.reply_pairs(messages(spark, sf))


def format_conversations(spark, sf):
    return corpus.conversation_pairs(table(spark, sf, "conversations"))


def elapsed_times(spark, sf):
    seconds = F.col("l_orderkey") * 1.25 + F.col("l_linenumber") * 60
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.elapsed(seconds).alias("elapsed"))


def token_budget_chars(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.chars_for_tokens(F.col("n_chars"), 4.0).alias("target_chars"), T.chars_for_tokens(F.col("n_chars"), 3.7).alias("target_chars_37"))


def text_deltas(spark, sf):
    order = W.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", T.new_suffix(F.col("text"), F.lag("text").over(order)).alias("delta"))


def source_stats(spark, sf):
    docs = table(spark, sf, "documents").withColumn("split", corpus.split_name("doc_id"))
    return docs.groupBy("source", "split").agg(F.count("*").alias("samples"), F.sum(corpus.sample_chars(F.col("text"))).alias("chars"))


def train_val_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", corpus.split_name("doc_id", fraction=0.1).alias("split"))


def stage_summary(spark, sf):
    total = F.sum(corpus.sample_chars(F.col("text")))
    return table(spark, sf, "documents").agg(F.count("*").alias("samples"), total.alias("actual_chars"), F.lit(480_000_000).cast("long").alias("target_chars"), (total >= 480_000_000).alias("reached"))


def mix_sources(spark, sf):
    return corpus.mix(table(spark, sf, "documents").select("doc_id", "source"), WEIGHTS).select("pos", "doc_id", "source")


def random_mix(spark, sf):
    return corpus.mix(table(spark, sf, "documents").select("doc_id", "source"), WEIGHTS, random=True).select("pos", "doc_id", "source")


def budget_cut(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("pos"), corpus.sample_chars(F.col("text")).cast("long").alias("chars"))
    return corpus.budget(docs, 500_000, F.col("chars")).select("doc_id", "chars", "chars_before")


def shuffled_documents(spark, sf):
    keyed = table(spark, sf, "documents").select("doc_id", shuffle_key(7, "doc_id").alias("key"))
    return running(keyed, "key", ties=("doc_id",)).select("pos", "doc_id")


def running_chars(spark, sf):
    return running(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", F.col("n_chars")).select("doc_id", "before", "pos")


def char_milestones(spark, sf):
    return corpus.milestones(table(spark, sf, "documents").select("doc_id", "n_chars"), F.col("n_chars"), 250_000, "doc_id")


def stratified_sample(spark, sf):
    return corpus.stratified(table(spark, sf, "embeddings").select("vec_id", "label"), "label", 5, "vec_id")


def class_list(spark, sf):
    return table(spark, sf, "embeddings").select("label").distinct()


def epoch_batches(spark, sf):
    return corpus.epoch(table(spark, sf, "embeddings").select("vec_id"), "vec_id", 32, 3).select("vec_id", "batch")


def first_documents(spark, sf):
    return table(spark, sf, "documents").orderBy("doc_id").limit(24).select("doc_id", F.substring("text", 1, 1200).alias("preview"))


def union_previews(spark, sf):
    docs = table(spark, sf, "documents").select(F.lit("pretrain").alias("stage"), F.col("doc_id").alias("id"), F.substring("text", 1, 1200).alias("text"))
    chats = table(spark, sf, "conversations").select(F.lit("sft").alias("stage"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.substring("text", 1, 1200).alias("text"))
    return docs.unionByName(chats)


def key_filter(spark, sf):
    k = F.col("l_partkey")
    return table(spark, sf, "lineitem").where((k >= 32) & (k < 20000) & (k % 1000 != 0)).select("l_orderkey", "l_linenumber", "l_partkey")


def keyed_upsert(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_quantity")
    latest = F.max(F.struct("l_linenumber", "l_quantity"))["l_quantity"].alias("value")
    pick = lambda cond: rows.where(cond).groupBy("k").agg(latest)
    return telemetry.latest_by_key(pick("l_linenumber <= 2"), pick("l_linenumber > 2"), "k")


def text_hashes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


def retry_schedule(spark, sf):
    """The waits that the errors of each user would cause, each run of errors (no other event between) starting anew."""
    by = W.partitionBy("user_id").orderBy("event_id")
    marked = table(spark, sf, "events").withColumn("run", F.sum((F.col("event_type") != "error").cast("int")).over(by))
    failures = marked.where("event_type = 'error'").withColumn("attempt", F.row_number().over(W.partitionBy("user_id", "run").orderBy("event_id")))
    return failures.select("event_id", F.col("attempt").cast("long").alias("attempt"), (F.lit(5.0) * F.least(F.lit(8.0), F.pow(F.lit(2.0), F.col("attempt") - 1))).alias("wait"))


def token_counts(spark, sf):
    return tokens.words_to_ids(table(spark, sf, "documents")).agg(F.sum(F.size("tokens")).cast("long").alias("tokens"), F.count("*").alias("documents"))


def token_offsets(spark, sf):
    sized = tokens.words_to_ids(table(spark, sf, "documents")).select("doc_id", F.size("tokens").cast("long").alias("n"))
    return running(sized, "doc_id", F.col("n")).select("doc_id", "n", F.col("before").alias("start"))


def ids_with_end(spark, sf):
    return tokens.words_to_ids(table(spark, sf, "documents"), end=1).select("doc_id", F.concat_ws(" ", F.col("tokens").cast("array<string>")).alias("ids"))


def lm_windows(spark, sf):
    ids = tokens.words_to_ids(table(spark, sf, "documents"))
    found = tokens.windows(ids, 16, 4, "doc_id", seed=11)
    text = lambda c: F.concat_ws(" ", F.col(c).cast("array<string>")).alias(c)
    return found.select("doc_id", "draw", "start", text("x"), text("y"))


def context_tail(spark, sf):
    ids = tokens.words_to_ids(table(spark, sf, "documents"))
    return ids.select("doc_id", F.concat_ws(" ", tokens.tail(F.col("tokens"), 8).cast("array<string>")).alias("tail"))


def decoded_words(spark, sf):
    docs = table(spark, sf, "documents")
    vocabulary = files.written(tokens.vocabulary(docs))
    return tokens.decode(*tokens.encode(docs, vocabulary), vocabulary)


def _pieces(spark, sf, **options):
    """A model trained on all documents and the ids it gives them."""
    docs = table(spark, sf, "documents")
    model = tokens.train_sentencepiece(docs, vocab_size=1000, **options)
    return model, tokens.encode_lines(docs.select("doc_id", "text"), model)


def sentencepiece_ids(spark, sf):
    return _pieces(spark, sf)[1].select("doc_id", F.size("tokens").cast("long").alias("n_tokens"))


def sentencepiece_decoded(spark, sf):
    """What decoding makes of the ids: the text without its line ends."""
    model, ids = _pieces(spark, sf)
    return tokens.decode_lines(ids, model)


def sentencepiece_unigram(spark, sf):
    """The same round trip with the other kind of model."""
    model, ids = _pieces(spark, sf, kind="unigram")
    return tokens.decode_lines(ids, model)


def sentencepiece_metadata(spark, sf):
    """The record of a tokenised set: symbols, their ids, and the number of tokens against that of the table."""
    model, ids = _pieces(spark, sf)
    record = json.loads(tokens.metadata("documents", model, ids.agg(F.sum(F.size("tokens"))).first()[0]))
    rows = [(s, i, record["dataset"], record["tokens"] > 0) for s, i in record["special_token_ids"].items()]
    return spark.createDataFrame(rows, "symbol string, id int, dataset string, has_tokens boolean")


def manifest(spark, sf):
    docs = table(spark, sf, "documents").withColumn("split", corpus.split_name("doc_id"))
    by_source = docs.groupBy("source").agg(F.count("*").alias("samples"), F.sum(corpus.sample_chars(F.col("text"))).alias("chars"))
    return by_source.select("source", F.to_json(F.struct("samples", "chars")).alias("stats"))


_WORDS = "CASE WHEN trim(coalesce(text, ''), ' ' || chr(10)) = '' THEN [] ELSE regexp_split_to_array(trim(text, ' ' || chr(10)), '\\s+') END"
_IDS = f"list_transform({_WORDS}, lambda w: CAST(('0x' || substring(sha256(w), 1, 4)) AS INT))"
_STRIPPED = "length(trim(text, ' ' || chr(10))) + 1"

QUERIES = {
    "clean_documents": (clean_documents, f"SELECT doc_id, clean, length(clean) AS n_clean FROM (SELECT doc_id, {_clean('text', 32000)} AS clean FROM documents)"),
    "quality_reasons": (quality_reasons, _JUDGED + "SELECT doc_id, reason FROM j"),
    "quality_kept": (quality_kept, _JUDGED + "SELECT doc_id, '<|document|>' || chr(10) || clean || chr(10) || '<|endoftext|>' || chr(10) AS rendered FROM j WHERE reason = 'keep'"),
    "quality_by_source": (quality_by_source, _JUDGED + "SELECT source, reason, count(*) AS n, CAST(sum(length(clean)) AS BIGINT) AS chars FROM j GROUP BY source, reason"),
    "render_documents": (render_documents, "SELECT doc_id, '<|document|>' || chr(10) || coalesce(text, '') || chr(10) || '<|endoftext|>' || chr(10) AS rendered FROM documents"),
    "one_line_texts": (one_line_texts, "SELECT doc_id, replace(text, chr(10), ' ') AS line FROM documents WHERE text <> ''"),
    "word_statistics": (
        word_statistics,
        f"SELECT doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_distinct, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS n_letters, CAST({_JUNK.replace('clean', 'text')} AS BIGINT) AS n_junk FROM (SELECT doc_id, text, {_WORDS} AS w FROM documents)",
    ),
    "normalize_roles": (
        normalize_roles,
        "SELECT conv_id, turn, CASE WHEN r IN ('human', 'prompter') THEN 'user' WHEN r IN ('gpt', 'bot') THEN 'assistant' ELSE r END AS role FROM (SELECT conv_id, turn, trim(lower(coalesce(role, ''))) AS r FROM conversations)",
    ),
    "reply_pairs": (
        reply_pairs,
        f"""WITH m AS (SELECT conv_id * 1000 + turn AS pos, conv_id, turn, lower(role) AS role, {_clean('text', 12000)} AS text, conv_id + turn AS n FROM conversations),
        g AS (SELECT * FROM m WHERE n % 7 <> 0 AND n % 11 <> 0 AND n % 13 <> 0 AND text <> ''),
        r AS (SELECT a.pos, '[INST] ' || u.text || ' [/INST] ' || a.text || chr(10) || '<|endoftext|>' || chr(10) AS rendered FROM g a JOIN g u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1
        WHERE u.role = 'user' AND a.role = 'assistant' AND a.n % 5 <> 1)
        SELECT pos, rendered FROM r WHERE length(rendered) BETWEEN 40 AND 12000""",
    ),
    "format_conversations": (
        format_conversations,
        f"""WITH m AS (SELECT conv_id, turn, CASE WHEN lower(role) IN ('human', 'prompter') THEN 'user' WHEN lower(role) IN ('gpt', 'bot') THEN 'assistant' ELSE lower(role) END AS role, {_clean('text', 12000)} AS text FROM conversations),
        g AS (SELECT * FROM m WHERE text <> ''),
        s AS (SELECT a.conv_id, a.turn, a.text, (SELECT max(b.turn) FROM g b WHERE b.conv_id = a.conv_id AND b.role = 'assistant' AND b.turn < a.turn) AS last_answer,
          (SELECT max(b.turn) FROM g b WHERE b.conv_id = a.conv_id AND b.role = 'user' AND b.turn < a.turn) AS ask,
          (SELECT string_agg(b.text, chr(10) || chr(10) ORDER BY b.turn) FROM g b WHERE b.conv_id = a.conv_id AND b.role = 'system' AND b.turn < a.turn) AS sys FROM g a WHERE a.role = 'assistant'),
        k AS (SELECT conv_id, turn, text, last_answer, ask, CASE WHEN sys IS NULL THEN NULL ELSE {_clean('sys', 12000)} END AS sys FROM s),
        c AS (SELECT s.conv_id, s.turn, '[INST] ' || u.text || ' [/INST] ' || s.text AS plain, '[INST] ' || CASE WHEN sys IS NULL THEN '' ELSE '<<SYS>>' || chr(10) || sys || chr(10) || '<</SYS>>' || chr(10) || chr(10) END || u.text || ' [/INST] ' || s.text AS full_text
          FROM k s JOIN g u ON u.conv_id = s.conv_id AND u.turn = s.ask WHERE s.ask > coalesce(s.last_answer, -1)),
        f AS (SELECT conv_id, min(turn) AS first FROM c WHERE length(full_text) BETWEEN 40 AND 12000 GROUP BY conv_id),
        p AS (SELECT c.conv_id, c.turn, CASE WHEN c.turn = f.first THEN c.full_text ELSE c.plain END AS pair FROM c JOIN f ON c.conv_id = f.conv_id AND c.turn >= f.first),
        r AS (SELECT conv_id, string_agg(pair, chr(10) ORDER BY turn) || chr(10) || '<|endoftext|>' || chr(10) AS rendered FROM p WHERE length(pair) BETWEEN 40 AND 12000 GROUP BY conv_id)
        SELECT conv_id, rendered FROM r WHERE length(rendered) <= 12000""",
    ),
    "elapsed_times": (
        elapsed_times,
        """WITH s AS (SELECT l_orderkey, l_linenumber, l_orderkey * 1.25 + l_linenumber * 60 AS t FROM lineitem),
        p AS (SELECT l_orderkey, l_linenumber, CAST(floor(t / 3600) AS BIGINT) AS h, CAST(floor((t - floor(t / 3600) * 3600) / 60) AS BIGINT) AS m, t - floor(t / 60) * 60 AS rest FROM s),
        q AS (SELECT *, CAST(floor(rest) AS BIGINT) AS sec, (rest - floor(rest)) * 1000 AS ms FROM p)
        SELECT l_orderkey, l_linenumber, CASE WHEN h > 0 THEN h::VARCHAR || 'h ' ELSE '' END || CASE WHEN h > 0 OR m > 0 THEN m::VARCHAR || 'm ' ELSE '' END || CASE WHEN h > 0 OR m > 0 OR sec > 0 THEN sec::VARCHAR || 's ' ELSE '' END || printf('%.2f', CAST(ms AS DOUBLE)) || 'ms' AS elapsed FROM q""",
    ),
    "token_budget_chars": (token_budget_chars, "SELECT doc_id, n_chars * 4 AS target_chars, CAST(floor(n_chars * CAST(3.7 AS DOUBLE)) AS BIGINT) AS target_chars_37 FROM documents"),
    "text_deltas": (text_deltas, "SELECT conv_id, turn, substring(text, length(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '')) + 1) AS delta FROM conversations"),
    "source_stats": (
        source_stats,
        f"SELECT source, split, count(*) AS samples, CAST(sum(n) AS BIGINT) AS chars FROM (SELECT source, CASE WHEN {_uniform("'42:' || doc_id")} < 0.01 THEN 'val' ELSE 'train' END AS split, {_STRIPPED} AS n FROM documents) GROUP BY source, split",
    ),
    "train_val_split": (train_val_split, f"SELECT doc_id, CASE WHEN {_uniform("'42:' || doc_id")} < 0.1 THEN 'val' ELSE 'train' END AS split FROM documents"),
    "stage_summary": (stage_summary, f"SELECT count(*) AS samples, CAST(sum({_STRIPPED}) AS BIGINT) AS actual_chars, CAST(480000000 AS BIGINT) AS target_chars, sum({_STRIPPED}) >= 480000000 AS reached FROM documents"),
    "mix_sources": (
        mix_sources,
        f"""WITH d AS (SELECT doc_id, source, CAST((CAST(substring(source, 4) AS INT) % 5) * 0.25 AS DOUBLE) AS w, {_KEY.format("'1:' || doc_id")} AS k FROM documents WHERE CAST(substring(source, 4) AS INT) % 5 > 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k, doc_id) / w AS stride FROM d)
        SELECT row_number() OVER (ORDER BY stride, source) - 1 AS pos, doc_id, source FROM r""",
    ),
    "random_mix": (
        random_mix,
        f"""WITH d AS (SELECT doc_id, source, CAST((CAST(substring(source, 4) AS INT) % 5) * 0.25 AS DOUBLE) AS w, {_KEY.format("'1:' || doc_id")} AS k, CAST(floor(-ln(1 - {_uniform("'2:' || doc_id")}) * 1048576) AS BIGINT) + 1 AS gap FROM documents WHERE CAST(substring(source, 4) AS INT) % 5 > 0),
        r AS (SELECT *, CAST(sum(gap) OVER (PARTITION BY source ORDER BY k, doc_id) AS DOUBLE) / w AS stride FROM d)
        SELECT row_number() OVER (ORDER BY stride, source) - 1 AS pos, doc_id, source FROM r""",
    ),
    "budget_cut": (
        budget_cut,
        f"SELECT doc_id, chars, chars_before FROM (SELECT doc_id, chars, CAST(sum(chars) OVER (ORDER BY doc_id) - chars AS BIGINT) AS chars_before FROM (SELECT doc_id, {_STRIPPED} AS chars FROM documents)) WHERE chars_before < 500000",
    ),
    "shuffled_documents": (shuffled_documents, f"SELECT row_number() OVER (ORDER BY {_KEY.format("'7:' || doc_id")}, doc_id) - 1 AS pos, doc_id FROM documents"),
    "running_chars": (running_chars, "SELECT doc_id, CAST(sum(n_chars) OVER (ORDER BY doc_id) - n_chars AS BIGINT) AS before, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents"),
    "char_milestones": (char_milestones, "SELECT doc_id, chars FROM (SELECT doc_id, n_chars, CAST(sum(n_chars) OVER (ORDER BY doc_id) AS BIGINT) AS chars FROM documents) WHERE chars // 250000 > (chars - n_chars) // 250000"),
    "stratified_sample": (
        stratified_sample,
        f"SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {_KEY.format("'42:' || vec_id")}, vec_id) AS r FROM embeddings) WHERE r <= 5",
    ),
    "class_list": (class_list, "SELECT DISTINCT label FROM embeddings"),
    "epoch_batches": (epoch_batches, f"SELECT vec_id, (row_number() OVER (ORDER BY {_KEY.format("'3:' || vec_id")}, vec_id) - 1) // 32 AS batch FROM embeddings"),
    "first_documents": (first_documents, "SELECT doc_id, substring(text, 1, 1200) AS preview FROM documents ORDER BY doc_id LIMIT 24"),
    "union_previews": (union_previews, "SELECT 'pretrain' AS stage, doc_id AS id, substring(text, 1, 1200) AS text FROM documents UNION ALL SELECT 'sft', conv_id * 1000 + turn, substring(text, 1, 1200) FROM conversations"),
    "key_filter": (key_filter, "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey >= 32 AND l_partkey < 20000 AND l_partkey % 1000 <> 0"),
    "keyed_upsert": (
        keyed_upsert,
        """WITH r AS (SELECT l_orderkey AS k, l_quantity AS value, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_quantity DESC) AS n FROM lineitem) SELECT k, value FROM r WHERE n = 1""",
    ),
    "text_hashes": (text_hashes, "SELECT doc_id, sha256(text) AS sha256 FROM documents"),
    "retry_schedule": (retry_schedule, "SELECT event_id, attempt, CAST(5 * least(8, pow(2, attempt - 1)) AS DOUBLE) AS wait FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) AS attempt FROM (SELECT event_id, user_id, event_type, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events) WHERE event_type = 'error')"),
    "token_counts": (token_counts, f"SELECT CAST(sum(len({_WORDS})) AS BIGINT) AS tokens, count(*) AS documents FROM documents"),
    "token_offsets": (token_offsets, f"SELECT doc_id, n, CAST(sum(n) OVER (ORDER BY doc_id) - n AS BIGINT) AS start FROM (SELECT doc_id, len({_WORDS}) AS n FROM documents)"),
    "ids_with_end": (ids_with_end, f"SELECT doc_id, array_to_string(list_append({_IDS}, 1), ' ') AS ids FROM documents"),
    "lm_windows": (
        lm_windows,
        f"""WITH i AS (SELECT doc_id, {_IDS} AS ids FROM documents), d AS (SELECT i.doc_id, i.ids, r.range AS draw FROM i, range(4) r WHERE len(ids) >= 18),
        s AS (SELECT doc_id, ids, draw, CAST(floor({_uniform("'11:' || doc_id || ':' || draw")} * (len(ids) - 17)) AS BIGINT) AS start FROM d)
        SELECT doc_id, draw, start, array_to_string(list_slice(ids, start + 1, start + 16), ' ') AS x, array_to_string(list_slice(ids, start + 2, start + 17), ' ') AS y FROM s""",
    ),
    "context_tail": (context_tail, f"SELECT doc_id, array_to_string(list_slice(ids, greatest(len(ids) - 7, 1), len(ids)), ' ') AS tail FROM (SELECT doc_id, {_IDS} AS ids FROM documents)"),
    "decoded_words": (decoded_words, f"SELECT doc_id, array_to_string({_WORDS}, ' ') AS decoded FROM documents"),
    "sentencepiece_ids": (sentencepiece_ids, None),
    "sentencepiece_decoded": (sentencepiece_decoded, "SELECT doc_id, coalesce(replace(text, chr(10), ''), '') AS decoded FROM documents"),
    "sentencepiece_unigram": (sentencepiece_unigram, "SELECT doc_id, coalesce(replace(text, chr(10), ''), '') AS decoded FROM documents"),
    "sentencepiece_metadata": (
        sentencepiece_metadata,
        "SELECT symbol, CAST(row_number() OVER () + 3 AS INT) AS id, 'documents' AS dataset, true AS has_tokens FROM (VALUES ('<|document|>'), ('<|endoftext|>'), ('[INST]'), ('[/INST]'), ('<<SYS>>'), ('<</SYS>>')) t(symbol)",
    ),
    "manifest": (manifest, f"SELECT source, '{{\"samples\":' || count(*) || ',\"chars\":' || CAST(sum({_STRIPPED}) AS BIGINT) || '}}' AS stats FROM documents GROUP BY source"),
}
