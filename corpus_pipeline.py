"""From raw documents to packed training sequences in five stages.

Each stage reads what the one before it wrote, and decides on all of it.  All but the last return
the columns of documents, whatever other columns there are and however they are named.  A stage's
intermediate tables are deleted when the next one, which reads the written result, begins.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup, language, packing, scratch, secrets, simhash
from corpusloom.llm.queries import tokenizer_path

_left: list[str] = []


def _stage(function):
    """Drop what the stage before left, unless ``docs`` still reads it, and note what this one leaves."""

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        known = set(scratch.made(spark))
        old = [p for p in _left if p in known]
        if old and not any(p.split("/")[-1] in f for f in docs.inputFiles() for p in old):
            scratch.release(spark, old)
        before = set(scratch.made(spark))
        out = function(spark, docs, sf_dir)
        _left[:] = [p for p in scratch.made(spark) if p not in before]
        return out

    return run


def _free(docs: DataFrame, count: int) -> list[str]:
    """Column names that ``docs`` does not have."""
    taken, names, k = {c.lower() for c in docs.columns}, [], 0
    while len(names) < count:
        if (name := f"_own_{k}") not in taken:
            names.append(name)
        k += 1
    return names


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _without(docs: DataFrame, keys: list[Column], gone: DataFrame, repeated: bool) -> DataFrame:
    """``docs`` without the rows whose keys are listed in ``gone``; with ``repeated`` one row of each key.

    Few keys go to every task, and no text is moved; else the join is one sort and merge, so that neither side has
    to fit anywhere.
    """
    names = _free(docs, 2 * len(keys))
    own, other = names[: len(keys)], names[len(keys) :]
    tagged = docs.withColumns(dict(zip(own, keys)))
    matches = [tagged[a].eqNullSafe(F.col(b)) for a, b in zip(own, other)]
    kept = tagged.join(scratch.few_or_merged(scratch.materialize(gone.toDF(*other), "gone")), matches, "left_anti")
    return (kept.dropDuplicates(own) if repeated else kept).select(*_columns(docs))


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter, null and empty ones too, and texts unlike every learned language.

    Unlike are those below :data:`language.LEAST_LIKENESS` of what a text of a learned language with as
    many trigrams reaches.  Prototypes come from all labelled rows; without any only letter-less texts
    go.  Texts are read whole, however long.  Rows are judged one by one, so repeated rows fare alike.
    An empty table stays empty.
    """
    prototypes = language.fit(docs)
    if not prototypes:
        return docs.where(_text().rlike(r"\p{L}"))
    (verdict,) = _free(docs, 1)
    return docs.withColumn(verdict, language.verdict(F.col("text"), prototypes)).where(F.col(f"{verdict}.likeness") >= language.LEAST_LIKENESS).select(*_columns(docs))


@_stage
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of texts that are equal but for white space the longest, then that with the smallest id.

    Null counts as empty, and all texts of white space are equal.  A null id ranks last.  Of rows that
    repeat id and text one stays.  Texts are compared whole.  An empty table stays empty.
    """
    found = scratch.materialize(exact_dedup.exact_dedup(docs).select("doc_id", "text_hash", "kept"), "exact-decisions")
    rows = found.groupBy("doc_id", "text_hash").agg(F.max("kept").alias("any_kept"), F.count("*").alias("n"))
    repeated = not rows.where("any_kept and n > 1").isEmpty()
    gone = rows.where(~F.col("any_kept")).select("doc_id", "text_hash")
    return _without(docs, [F.col("doc_id").cast("long"), F.xxhash64(_text())], gone, repeated)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies (five-word shingles, similarity of 0.8 or more) the row with the smallest id.

    Null and word-less texts form one group.  A null id counts as the smallest.  Of rows that repeat id
    and text one stays.  Texts are compared whole.  An empty table stays empty.
    """
    members = scratch.materialize(simhash.near_duplicates(docs), "near-groups")
    first = members.groupBy("component").agg(F.min(F.struct("id", "k1", "k2")).alias("first"))
    gone = members.join(first, "component").where((F.col("k1") != F.col("first.k1")) | (F.col("k2") != F.col("first.k2"))).select("k1", "k2")
    keys = simhash.identity(F.col("doc_id").cast("long"), _text())
    repeated = not docs.groupBy(keys[0].alias("k1"), keys[1].alias("k2")).count().where("count > 1").isEmpty()
    return _without(docs, list(keys), gone, repeated)


@_stage
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces live-looking credentials in the texts; documents without one are unchanged.

    Null and empty texts have none; texts are scanned whole.  Rows that repeat are masked alike.  Only
    texts with a match of some pattern are joined to the verdicts.  An empty table stays empty.
    """
    hits = secrets.scan_secrets(docs).where("n_live > 0").groupBy("doc_id", "text_hash").agg(F.min("spans").alias("spans"))
    names = _free(docs, 5)
    own, other, spans = names[:2], names[2:4], names[4]
    candidates = secrets.may_match(_text())
    tagged = docs.where(candidates).withColumns({own[0]: F.col("doc_id").cast("long"), own[1]: F.xxhash64(_text())})
    joined = tagged.join(hits.toDF(*other, spans), [tagged[a].eqNullSafe(F.col(b)) for a, b in zip(own, other)], "left")
    masked = F.when(F.col(spans).isNull(), F.col("text")).otherwise(secrets.redact(F.col("text"), F.col(spans), ("live",)))
    joined = joined.withColumn(own[0], masked)
    new = {"text": F.col(own[0])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.char_length(own[0])).cast(docs.schema["n_chars"].dataType)
    changed = joined.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
    return docs.where(~candidates).unionAll(changed)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence.

    Null and empty texts are the end token alone; long ones are cut into pieces.  Rows that repeat are
    packed each.  An empty table gives no pieces.
    """
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: SQL cannot express the language model, the similarity groups or the packing; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
