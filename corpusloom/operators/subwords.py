"""Pieces of words learned over the executors: each round is a job over all distinct words, the driver keeps the pieces alone.

Words are held in blocks of symbols (code points, and numbers beyond them for merged pieces), so a round is a few array operations.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import ship
from corpusloom.sources import files

#: The sign for the space before a word, and a character that stands for what no piece may hold.
SPACE, BARRIER = "▁", "\0"
#: Characters of a piece at most.
MOST_CHARS = 16
#: A round merges the pairs with at least this share of the most frequent pair's count.
SHARE = 0.75
#: Pairs of a round that reach the driver, and rounds after which the merged blocks are written.
CANDIDATES, ROUNDS = 4096, 2
#: Seeds for each piece of a unigram model, and the share of them that a round keeps.
SEEDS, KEPT = 4, 0.75
_BLOCK_WORDS = 20_000
_BLOCK = "symbols binary, sizes binary, n binary"
_FIRST_ID = 0x110000
#: Symbols up to which pairs are counted in one table of their products, of 8 bytes each.
_DENSE = 3500

_LOW = 0xFFFFFFFF

Block = tuple[np.ndarray, np.ndarray, np.ndarray]


def distinct_words(texts: DataFrame, text_col: str, barred: Sequence[str]) -> DataFrame:
    """``w, n``: every distinct word with the space before it, as :data:`SPACE`, and how often it occurs; ``barred`` strings become barriers."""
    signs = "|".join("".join(f"\\{c}" if not c.isalnum() else c for c in s) for s in barred)
    text = F.regexp_replace(F.col(text_col), signs, BARRIER) if signs else F.col(text_col)
    split = texts.select(F.explode(F.regexp_extract_all(text, F.lit(r" ?[^ \n\t]+"), F.lit(0))).alias("w"))
    return files.written(split.groupBy(F.translate("w", " ", SPACE).alias("w")).agg(F.count("*").alias("n")))


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            yield np.frombuffer(row[0], np.int32), np.frombuffer(row[1], np.int32), np.frombuffer(row[2], np.int64)


def _record(block: Block) -> pa.RecordBatch:
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in block], names=["symbols", "sizes", "n"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: list[str] = []
    counts: list[np.ndarray] = []

    def block() -> pa.RecordBatch:
        symbols = np.frombuffer("".join(words).encode("utf-32-le"), np.int32)
        return _record((symbols, np.array([len(w) for w in words], np.int32), np.concatenate(counts)))

    for batch in batches:
        words += batch.column(0).to_pylist()
        counts.append(batch.column(1).to_numpy())
        if len(words) >= _BLOCK_WORDS:
            yield block()
            words, counts = [], []
    if words:
        yield block()


def _codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << 32 | b


def merged(block: Block, steps: Sequence[tuple[np.ndarray, np.ndarray]]) -> Block:
    """``block`` after ``steps``, each the sorted pairs that are merged and the symbols they become; words of one symbol are left out."""
    symbols, sizes, n = block
    word = np.repeat(np.arange(len(n)), sizes)
    for pairs, ids in steps:
        table = np.zeros((2, int(max(pairs.max() >> 32, (pairs & _LOW).max(), symbols.max(initial=0))) + 1), dtype=bool)
        table[0, pairs >> 32], table[1, pairs & _LOW] = True, True
        place = np.flatnonzero(table[0][symbols[:-1]] & table[1][symbols[1:]] & (word[:-1] == word[1:]))
        code = _codes(symbols[place], symbols[place + 1])
        at = np.minimum(np.searchsorted(pairs, code), len(pairs) - 1)
        place, at = place[pairs[at] == code], at[pairs[at] == code]
        if len(place):
            # Neighbouring hits come from repeats of one symbol: every other one counts.
            nth = np.arange(len(place))
            nth -= np.maximum.accumulate(np.where(np.concatenate([[True], np.diff(place) > 1]), nth, 0))
            place, at = place[nth % 2 == 0], at[nth % 2 == 0]
            keep = np.ones(len(symbols), dtype=bool)
            keep[place + 1] = False
            symbols = symbols.copy()
            symbols[place] = ids[at]
            symbols, word = symbols[keep], word[keep]
    sizes = np.bincount(word, minlength=len(n)).astype(np.int32)
    several = sizes > 1
    return symbols[several[word]], sizes[several], n[several]


def _totals(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """``key, n`` with the weights of equal keys added up within a task."""
    import pyarrow as pa

    keys, sums = np.empty(0, np.int64), np.empty(0, np.int64)
    for key, weight in parts:
        keys, at = np.unique(np.concatenate([keys, key]), return_inverse=True)
        sums = np.bincount(at, np.concatenate([sums, weight]), len(keys)).astype(np.int64)
        if len(keys) > 1_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["key", "n"])
            keys, sums = keys[:0], sums[:0]
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["key", "n"])


def _pairs(blocks: Iterator[Block], used: np.ndarray, out: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes and weights of neighbours within a word that are both of the ``used`` symbols (sorted), without the codes in ``out``."""
    place = np.full(int(used.max(initial=0)) + 1, -1, dtype=np.int32)
    place[used] = np.arange(len(used))
    table = np.zeros(len(used) ** 2) if len(used) <= _DENSE else None
    for symbols, sizes, n in blocks:
        word = np.repeat(np.arange(len(n)), sizes)
        at = np.where(symbols < len(place), place[np.minimum(symbols, len(place) - 1)], -1)
        inside = (word[:-1] == word[1:]) & (at[:-1] >= 0) & (at[1:] >= 0)
        if table is not None:
            np.add.at(table, at[:-1][inside].astype(np.int64) * len(used) + at[1:][inside], n[word[:-1][inside]].astype(float))
        else:
            code = _codes(symbols[:-1][inside], symbols[1:][inside])
            fine = ~np.isin(code, out)
            yield code[fine], n[word[:-1][inside][fine]]
    if table is not None:
        found = np.flatnonzero(table)
        code = _codes(used[found // len(used)], used[found % len(used)])
        fine = ~np.isin(code, out)
        yield code[fine], table[found[fine]].astype(np.int64)


def characters(blocks: DataFrame) -> list[tuple[str, int]]:
    """Every character and how often it occurs, the most frequent first; no more rows than Unicode has characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _totals((symbols, np.repeat(n, sizes)) for symbols, sizes, n in _arrays(batches))

    rows = blocks.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("key <> 0").orderBy(F.desc("n"), "key").collect()
    return [(chr(r.key), r.n) for r in rows]


def covered(chars: list[tuple[str, int]], coverage: float) -> list[tuple[str, int]]:
    """The most frequent characters that make up ``coverage`` of all; the others are written as bytes."""
    least, held, kept = coverage * sum(n for _, n in chars), 0, []
    for c, n in chars:
        if held >= least:
            break
        kept.append((c, n))
        held += n
    return kept


def _kind(c: str) -> str:
    """Digits, the script of a letter, or a sign: what one piece does not mix."""
    return "digit" if c.isnumeric() else unicodedata.name(c, "?").split(" ")[0] if c.isalpha() else "mark" if unicodedata.combining(c) else "sign"


def allowed(piece: str) -> bool:
    body = piece.removeprefix(SPACE)
    return len(piece) <= MOST_CHARS and SPACE not in body and BARRIER not in body and len({_kind(c) for c in body} - {"mark"}) <= 1


def merges(words: DataFrame, most: int, coverage: float) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """``pieces, characters``, each with its count: at most ``most`` less the characters pieces, in the order in which pairs are merged.

    Each round counts all pairs of neighbouring symbols and merges the most frequent, and with it those of nearly its count (:data:`SHARE`) that share no symbol's place
    with one merged before, so that neither changes the other's count.
    """
    ship(words.sparkSession)
    blocks = files.written(words.mapInArrow(_blocks, _BLOCK))
    chars = covered(characters(blocks), coverage)
    known = {c for c, _ in chars}
    texts: dict[int, str] = {}
    ids: dict[str, int] = {}
    found: list[tuple[str, int]] = []
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    refused: set[int] = set()
    while len(found) < most - len(chars):
        out, used = np.array(sorted(refused), np.int64), np.array(sorted([*map(ord, known), *texts]), np.int32)

        def run(batches: Iterator[pa.RecordBatch], steps=tuple(steps), out=out, used=used) -> Iterator[pa.RecordBatch]:
            yield from _totals(_pairs((merged(block, steps) for block in _arrays(batches)), used, out))

        rows = blocks.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(CANDIDATES).collect()
        if not rows:
            break
        firsts, seconds, top, taken = set(), set(), None, {}
        for r in rows:
            a, b = r.key >> 32, r.key & _LOW
            halves = [texts.get(s) or chr(s) for s in (a, b)]
            piece = "".join(halves)
            if not allowed(piece):
                refused.add(r.key)
                continue
            top = r.n if top is None else top
            if r.n < SHARE * top or len(found) >= most - len(chars):
                break
            if a in seconds or b in firsts or (a == b and (a in firsts or b in seconds)):
                continue
            if piece not in ids:
                ids[piece] = _FIRST_ID + len(ids)
                texts[ids[piece]] = piece
                found.append((piece, r.n))
            firsts.add(a)
            seconds.add(b)
            taken[r.key] = ids[piece]
        if not taken:
            continue  # all that came were refused; the next round leaves them out
        steps.append((np.array(sorted(taken), np.int64), np.array([taken[k] for k in sorted(taken)], np.int64)))
        if len(steps) == ROUNDS:

            def apply(batches: Iterator[pa.RecordBatch], steps=tuple(steps)) -> Iterator[pa.RecordBatch]:
                for block in _arrays(batches):
                    yield _record(merged(block, steps))

            blocks, steps = files.written(blocks.mapInArrow(apply, _BLOCK)), []
    return found, chars


def model(kind: str, pieces: list[tuple[str, float]], symbols: Sequence[str], ids: dict[str, int], coverage: float) -> bytes:
    """A SentencePiece model of the ``pieces`` and their scores, behind control symbols, ``symbols`` and bytes."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    out, types = pb.ModelProto(), pb.ModelProto.SentencePiece
    meta = {ids["pad_id"]: ("<pad>", types.CONTROL), ids["bos_id"]: ("<s>", types.CONTROL), ids["eos_id"]: ("</s>", types.CONTROL), ids["unk_id"]: ("<unk>", types.UNKNOWN)}
    first = [meta[k] for k in sorted(meta)] + [(s, types.USER_DEFINED) for s in symbols] + [(f"<0x{b:02X}>", types.BYTE) for b in range(256)]
    for piece, score, type_ in [*((p, 0.0, t) for p, t in first), *((p, s, types.NORMAL) for p, s in pieces)]:
        out.pieces.add(piece=piece, score=score, type=type_)
    spec = out.trainer_spec
    spec.model_type, spec.vocab_size, spec.character_coverage, spec.byte_fallback, spec.hard_vocab_limit = {"unigram": 1, "bpe": 2}[kind], len(out.pieces), coverage, True, False
    spec.user_defined_symbols.extend(symbols)
    for name, k in ids.items():
        setattr(spec, name, k)
    out.normalizer_spec.name, out.normalizer_spec.add_dummy_prefix = "identity", False
    return out.SerializeToString()


def piece_counts(words: DataFrame, trained: bytes) -> dict[int, int]:
    """How often the best segmentations of all words use each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        encoder = sentencepiece.SentencePieceProcessor(model_proto=trained)

        def parts():
            for batch in batches:
                found = encoder.encode(batch.column(0).to_pylist(), num_threads=1)
                n = np.repeat(batch.column(1).to_numpy(), [len(x) for x in found])
                yield np.fromiter(chain.from_iterable(found), np.int64, len(n)), n

        yield from _totals(parts())

    return {r.key: r.n for r in words.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()}


def train(texts: DataFrame, text_col: str, vocab_size: int, kind: str, coverage: float, symbols: Sequence[str], ids: dict[str, int]) -> bytes:
    """A model of ``kind`` bpe or unigram from all words of ``texts``.

    bpe ranks pieces in the order of their merges.  unigram begins with :data:`SEEDS` times as many merged pieces; each round counts the pieces of
    the best segmentation of every word, sets scores to log frequencies and keeps the :data:`KEPT` share whose loss would cost most likelihood.
    """
    if kind not in ("bpe", "unigram"):
        raise ValueError(f"unknown kind {kind!r}; known: bpe, unigram")
    room = vocab_size - len(ids) - len(symbols) - 256
    words = distinct_words(texts, text_col, symbols)
    found, chars = merges(words, room if kind == "bpe" else SEEDS * room, coverage)
    if kind == "bpe":
        return model(kind, [(p, -float(k)) for k, (p, _) in enumerate([*found, *chars])], symbols, ids, coverage)
    import sentencepiece

    first = len(ids) + len(symbols) + 256
    weight = dict([*found, *chars])
    last = False
    while True:
        total = max(1.0, float(sum(weight.values())))
        pieces = [(p, float(np.log(max(n, 0.5) / total))) for p, n in weight.items()]
        trained = model(kind, pieces, symbols, ids, coverage)
        if last:
            return trained
        counts = piece_counts(words, trained)
        weight = {p: counts.get(first + k, 0) for k, (p, _) in enumerate(pieces)}
        last = len(weight) <= max(room, len(chars))
        if last:
            continue
        encoder, score = sentencepiece.SentencePieceProcessor(model_proto=trained), dict(pieces)

        def loss(piece: str) -> float:
            other = [x for x in encoder.nbest_encode(piece, nbest_size=2, out_type=str) if x != [piece]]
            return weight[piece] * (score[piece] - sum(score.get(x, 0.0) for x in other[0])) if other else float("inf")

        several = sorted((p for p in weight if len(p) > 1), key=lambda p: (-loss(p), p))
        keep = set(several[: max(room, int(KEPT * len(weight))) - len(chars)])
        weight = {p: n for p, n in weight.items() if len(p) == 1 or p in keep}
