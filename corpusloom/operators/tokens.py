"""Tokens: word ids, vocabularies, SentencePiece training and encoding, windows for language models."""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import subwords
from corpusloom.operators.ordered import running, uniform
from corpusloom.session import ship
from corpusloom.sources import files

# Ids and symbols of the trained tokenizers.
IDS = {"pad_id": 0, "bos_id": 1, "eos_id": 2, "unk_id": 3}
SYMBOLS = (T.DOCUMENT, T.END_OF_TEXT, T.INST, T.END_INST, T.SYSTEM, T.END_SYSTEM)


def words_to_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end: int | None = None) -> DataFrame:
    """``doc_id, tokens``: an id from the SHA-256 of each word, and ``end`` after the last."""
    split = T.words(F.coalesce(F.col(text_col), F.lit("")))
    ids = F.transform(split, lambda w: F.conv(F.substring(F.sha2(w, 256), 1, 4), 16, 10).cast("int"))
    return docs.select(F.col(id_col).alias("doc_id"), (F.array_append(ids, F.lit(end)) if end is not None else ids).alias("tokens"))


def vocabulary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``id, piece, n``: words from the most frequent on, then by a hash, ids from 0."""
    counts = docs.select(F.explode(T.words(F.coalesce(F.col(text_col), F.lit("")))).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))
    counts = files.written(counts)  # the ranges below read them several times
    # Words that occur once are most of the table, so the hash that orders them also deals them out.
    ranked = running(counts.withColumns({"_order": -F.col("n"), "_hash": F.xxhash64("piece")}), "_order", ties=("_hash", "piece"))
    return ranked.select(F.col("pos").cast("int").alias("id"), "piece", "n")


#: Bytes of text, at least, that share a table of their distinct words.
CHUNK_BYTES = 16 << 20


def _coder(most: int):
    """Documents in chunks of ``most`` bytes, each word as its place in a table of the chunk's distinct words; then that table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        names, part = ["chunk", "doc_id", "codes", "code", "piece"], TaskContext.get().partitionId() << 32

        def rows(n, **columns):
            kinds = {"codes": pa.list_(pa.int32()), "code": pa.int32(), "piece": pa.string()}
            held = {"chunk": pa.array(np.full(n, part, dtype=np.int64))} | columns
            return pa.RecordBatch.from_arrays([held[c] if c in held else pa.nulls(n, kinds.get(c, doc_id)) for c in names], names=names)

        def coded(table):
            ids, lines = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns)
            split = pc.split_pattern(lines, " ")
            n = np.where(np.asarray(pc.binary_length(lines)) > 0, np.asarray(pc.list_value_length(split)), 0)
            words = split.flatten()
            words = words.filter(pc.not_equal(words, "")).dictionary_encode()
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            yield rows(len(ids), doc_id=ids, codes=pa.ListArray.from_arrays(offsets, words.indices))
            yield rows(len(words.dictionary), code=pa.array(np.arange(len(words.dictionary), dtype=np.int32)), piece=words.dictionary)

        held, size, doc_id = [], 0, None
        for batch in batches:
            doc_id = batch.column(0).type
            upto, start = np.cumsum(np.asarray(pc.binary_length(batch.column(1)), dtype=np.int64)), 0
            while start < batch.num_rows:
                before = int(upto[start - 1]) if start else 0
                end = min(batch.num_rows, int(np.searchsorted(upto, before + most - size)) + 1)
                held.append(batch.slice(start, end - start))
                size += int(upto[end - 1]) - before
                start = end
                if size >= most:
                    yield from coded(pa.Table.from_batches(held))
                    held, size, part = [], 0, part + 1
        if held:
            yield from coded(pa.Table.from_batches(held))

    return run


def encode(docs: DataFrame, vocab: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``chunk, doc_id, codes`` and ``chunk, code, id``: the words of each document by their codes in its chunk, and the id of each code.

    A word meets the vocabulary once a chunk of documents, however often it occurs there, and no text is moved.  Unknown words have
    a null id; a document without words has no codes.  Rows that repeat are encoded each.  A task holds one chunk: ``CHUNK_BYTES``
    of text and the rest of the last document.
    """
    line = F.array_join(T.words(F.coalesce(F.col(text_col), F.lit(""))), " ")  # no word holds a space
    kind = docs.schema[id_col].dataType.simpleString()
    coded = docs.select(F.col(id_col).alias("doc_id"), line.alias("line")).mapInArrow(_coder(chunk_bytes or CHUNK_BYTES), f"chunk long, doc_id {kind}, codes array<int>, code int, piece string")
    coded = files.written(coded)
    words = coded.where(F.col("code").isNotNull()).select("chunk", "code", "piece").join(vocab.select("piece", "id"), "piece", "left")
    return coded.where(F.col("codes").isNotNull()).select("chunk", "doc_id", "codes"), words.select("chunk", "code", "id")


def _decoder(left: pa.Table, right: pa.Table) -> pa.Table:
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    codes = left.column("codes").combine_chunks()
    codes = pa.concat_arrays(codes.chunks) if isinstance(codes, pa.ChunkedArray) else codes
    n, flat = np.asarray(pc.list_value_length(codes)), codes.flatten()
    if right.num_rows:
        found = pc.index_in(flat, value_set=right.column("code").combine_chunks())
        words = right.column("piece").combine_chunks().take(found.drop_null())
        known = np.concatenate([[0], np.cumsum(np.asarray(pc.is_valid(found)))])
    else:
        words, known = pa.array([], pa.string()), np.zeros(len(flat) + 1)
    offsets = known[np.concatenate([[0], np.cumsum(n)])].astype(np.int32)
    decoded = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), words), " ")
    return pa.table({"doc_id": left.column("doc_id"), "decoded": decoded})


def decode(docs: DataFrame, words: DataFrame, vocab: DataFrame) -> DataFrame:
    """``doc_id, decoded``: the words of each document, joined by spaces, from what :func:`encode` returns; unknown ones are left out."""
    ship(docs.sparkSession)
    named = words.join(vocab.select("id", "piece"), "id").select(F.col("chunk").alias("of"), "code", "piece")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.groupBy("chunk").cogroup(named.groupBy("of")).applyInArrow(_decoder, f"doc_id {kind}, decoded string")


def windows(ids: DataFrame, size: int, draws: int, id_col: str, seed: int) -> DataFrame:
    """``draws`` random windows of ``size`` tokens and the same one further on, from rows with at least ``size + 2``.

    The start lies in [0, n - size - 1), so the last possible start is never drawn.
    """
    n = F.size("tokens")
    drawn = ids.where(n >= size + 2).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))).alias("draw"))
    start = F.floor(uniform(seed, id_col, "draw") * (n - size - 1))
    drawn = drawn.withColumn("start", start)
    at = F.col("start").cast("int")
    return drawn.select(id_col, "draw", "start", F.slice("tokens", at + 1, size).alias("x"), F.slice("tokens", at + 2, size).alias("y"))


def tail(tokens: Column, most: int) -> Column:
    return F.slice(tokens, F.greatest(F.size(tokens) - most + 1, F.lit(1)), most)


#: Rows from which the small variant trains.
SMALL_ROWS = 200_000


def train_sentencepiece(docs: DataFrame, vocab_size: int = 12_000, kind: str = "bpe", coverage: float = 0.9995, text_col: str = "text", small: bool = False) -> bytes:
    """A SentencePiece model of ``kind`` bpe or unigram, trained from all texts.

    Training reads every distinct word of the corpus with the number of times it occurs, over the executors
    (:mod:`corpusloom.operators.subwords`); none is left out, and the driver holds the pieces alone.  Special symbols must come out as
    one piece each.  ``small`` leaves the library's options at their defaults and has it read lines of
    :data:`SMALL_ROWS` random rows on the driver instead, which is what that variant is.
    """
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("t"))
    if not small:
        model = subwords.train(texts, "t", vocab_size, kind, coverage, SYMBOLS, IDS)
        check_symbols(model)
        return model
    import tempfile

    import sentencepiece

    with tempfile.TemporaryDirectory() as folder:  # on the driver, where the library reads and writes
        path = f"{folder}/input"
        few = int(min(1.0, SMALL_ROWS / max(1, texts.count())) * (1 << 62))
        some = texts.where(F.xxhash64("t").bitwiseAND(F.lit((1 << 62) - 1)) <= few).limit(SMALL_ROWS)
        with open(path, "w", encoding="utf-8") as f:
            f.writelines(f"{line}\n" for row in some.toLocalIterator() for line in row.t.split("\n") if line.strip())
        out = io.BytesIO()
        sentencepiece.SentencePieceTrainer.train(input=path, model_writer=out, model_type=kind, vocab_size=vocab_size, hard_vocab_limit=False, minloglevel=2)
    return out.getvalue()


def check_symbols(model: bytes, symbols: tuple[str, ...] = SYMBOLS) -> None:
    import sentencepiece

    encoder = sentencepiece.SentencePieceProcessor(model_proto=model)
    if broken := [s for s in symbols if len(encoder.encode(s)) != 1]:
        raise ValueError(f"no single piece for {', '.join(broken)}")


def encode_lines(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, tokens``: ids line by line without line ends, so breaks leave no trace in the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        import sentencepiece

        encoder = sentencepiece.SentencePieceProcessor(model_proto=model)
        for batch in batches:
            ids = [[i for line in (t or "").split("\n") for i in encoder.encode(line)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, tokens array<int>")


def metadata(dataset: str, model: bytes, tokens: int) -> str:
    """A JSON record of a tokenised data set."""
    import sentencepiece

    encoder = sentencepiece.SentencePieceProcessor(model_proto=model)
    record = {"dataset": dataset, "vocab_size": encoder.vocab_size(), "special_tokens": list(SYMBOLS), "special_token_ids": {s: encoder.piece_to_id(s) for s in SYMBOLS}, "tokens": tokens, "model_sha256": hashlib.sha256(model).hexdigest()}
    return json.dumps(record, sort_keys=True)


def decode_lines(ids: DataFrame, model: bytes) -> DataFrame:
    """``doc_id, decoded``: the text of each document's ids; line ends left no ids, so lines run together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        import sentencepiece

        decoder = sentencepiece.SentencePieceProcessor(model_proto=model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decoder.decode(t or []) for t in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "decoded"])

    return ids.select("doc_id", "tokens").mapInArrow(run, "doc_id long, decoded string")
