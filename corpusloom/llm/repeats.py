"""Removal of long repeated byte strings by suffix order and longest-previous-factor arrays.

No task can hold the suffix array of a corpus, so suffixes are dealt out by content first.  Every
string of ``length`` bytes is assigned to the leftmost of its k-grams with the smallest hash, its
anchor.  Equal strings have equal anchors at equal places, so only anchors that occur more than
once are of interest, and the strings assigned to one anchor value can be judged on their own.  A
place of an anchor gives one piece of text, which holds all strings assigned to it; mappers and
owners combine equal pieces.  Owners sort the suffixes of the pieces, and the longest-previous-factor
array, from the previous and the next suffix in that order that begin earlier, tells which of them
are later copies.

An anchor with more distinct pieces than one owner should hold, such as the edge of a passage that
a third of the texts share, is split by content: its strings are dealt again by anchors of longer
grams, up to the whole string, where nothing but equal strings meet and those are combined.  Texts
that are equal as a whole are reduced to one before all that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import scratch

LENGTH = 200
#: Bytes of the first k-grams that serve as anchors.
GRAM = 32
#: Bytes of pieces up to which one owner judges an anchor value; beyond, its strings are dealt by longer grams.
OWNER_BYTES = 1 << 20
#: Bytes of pieces, of whole anchors, that are sorted at once.
SORT_BYTES = 1 << 18
#: Bytes of distinct pieces that a mapper combines before it sends them.
MAPPER_BYTES = 24 << 20
_STRETCH = 1 << 18
_PLACE_BITS = 20
_ODD = 0x9E3779B97F4A7C15
_PIECES = "anchor long, digest binary, piece binary, n long, none boolean, id long, tid long, start long, parent binary"
_JUDGED = "digest binary, first long, last long, tid long, start long, others boolean"


def grams(length: int) -> list[int]:
    """Gram sizes of the rounds of dealing: each leaves a string fewer grams to choose from, the last only itself."""
    width = length - GRAM + 1
    widths = sorted({width, *(max(1, width // part) for part in (2, 10, 40)), 1}, reverse=True)
    return [length - w + 1 for w in widths]


@lru_cache(1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64)


def _gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """64-bit hash of each string of ``gram`` bytes, put together from strings of powers of two."""
    part, size, factor = _byte_values()[data], 1, _ODD
    h, done = None, 0
    while True:
        if gram & size:
            h = part if h is None else h[: len(part) - done] * np.uint64(factor) + part[done:]
            done += size
        if done == gram:
            break
        part = part[:-size] * np.uint64(factor) + part[size:]
        factor, size = factor * factor & 0xFFFFFFFFFFFFFFFF, 2 * size
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor values of ``data`` and the first and last start of the strings assigned to each."""
    found: list[tuple[np.ndarray, ...]] = []
    whole = np.frombuffer(data, dtype=np.uint8)
    width = length - gram + 1
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    with np.errstate(over="ignore"):
        for at in range(0, len(data) - length + 1, _STRETCH):
            h = _gram_hashes(whole[at : at + _STRETCH + length - 1], gram)
            least = (h & ~mask) | np.arange(len(h), dtype=np.uint64)  # ties go to the left
            span = 1
            while 2 * span <= width:
                least = np.minimum(least[:-span], least[span:])
                span *= 2
            if span < width:
                least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
            place = (least & mask).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            last = np.append(first[1:], len(place)) - 1
            found.append((h[place[first]], first + at, last + at))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found))


def suffix_array(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of all starts of the pieces with ``length`` bytes, and what neighbours share.

    Starts are numbered through the pieces.  Ranks of strings of 8, 16, 32, ... bytes are doubled up
    to ``length``; equal strings are in the order of their starts.  The second array has, for each but
    the last in suffix order, the number of leading bytes it shares with the next, ``length`` at most.
    """
    data = np.frombuffer(b"".join(pieces) + bytes(length + 8), dtype=np.uint8)
    starts = np.concatenate([np.arange(len(p) - length + 1) + end - len(p) for p, end in zip(pieces, np.cumsum([len(p) for p in pieces]).tolist())])
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    eight = np.ascontiguousarray(words).view(">u8").ravel().astype("<u8")
    ranks = {8: np.unique(eight, return_inverse=True)[1]}
    size = 8
    while 2 * size <= length:
        before = ranks[size]
        key = before[:-size] * np.int64(len(data)) + before[size:]
        size *= 2
        ranks[size] = np.unique(key, return_inverse=True)[1]
    rest = length - size
    key = ranks[size][starts] * np.int64(len(data)) + ranks[size][starts + rest]
    order = np.argsort(key, kind="stable")
    a, b = starts[order[:-1]], starts[order[1:]]
    shared = np.zeros(len(a), dtype=np.int64)
    while size >= 8:  # lengths of 8 bytes and more by ranks, the rest byte by byte
        same = (shared + size <= length) & (ranks[size][np.minimum(a + shared, len(ranks[size]) - 1)] == ranks[size][np.minimum(b + shared, len(ranks[size]) - 1)])
        shared += np.where(same, size, 0)
        if not (same & (shared + size <= length)).any():
            size //= 2
    for _ in range(7):
        same = (shared < length) & (data[a + np.minimum(shared, length)] == data[b + np.minimum(shared, length)])
        if not same.any():
            break
        live = np.flatnonzero(same)
        # A byte is only counted where all before it were equal.
        shared[live] += 1
    return order, shared


def longest_previous_factors(order: list[int], shared: list[int]) -> dict[int, int]:
    """For each suffix the longest beginning it shares with one that comes before it in the text.

    ``order`` lists the suffixes' places in suffix order, ``shared[k]`` is the beginning that the
    k-th and the next have in common.  One sweep with a stack: when a suffix is taken off, its
    neighbours are the previous and the next in suffix order that begin earlier, and the longer of
    the two shared beginnings is its factor.
    """
    out: dict[int, int] = {}
    stack: list[tuple[int, int]] = []  # place, beginning shared with the one below
    for k, place in enumerate([*order, -1]):
        common = shared[k - 1] if stack and place >= 0 else 0
        while stack and place < stack[-1][0]:
            top, below = stack.pop()
            out[top] = max(below, common)
            common = min(common, below)
        stack.append((place, common))
    return out


def repeated_starts(pieces: list[bytes], length: int, keep_first: bool) -> list[np.ndarray]:
    """For distinct pieces, in the order of the corpus, a flag for each of their strings of ``length`` bytes.

    The flag says that the string occurs at another start too; with ``keep_first`` at an earlier one.
    """
    counts = [len(p) - length + 1 for p in pieces]
    order, shared = suffix_array(pieces, length)
    total = len(order)
    flags = np.zeros(total, dtype=bool)
    # A factor of full length needs a neighbour that shares it; the sweep passes over all others.
    full = shared >= length
    member = np.flatnonzero(np.concatenate([full, [False]]) | np.concatenate([[False], full]))
    if len(member):
        between = np.minimum.reduceat(shared[: member[-1]], member[:-1]).tolist()
        places = order[member]
        for top in (None,) if keep_first else (None, total - 1):  # seen from the other end, the first has an earlier one too
            factors = longest_previous_factors((places if top is None else top - places).tolist(), between)
            at = np.array([p for p, f in factors.items() if f >= length], dtype=np.int64)
            flags[at if top is None else top - at] = True
    return np.split(flags, np.cumsum(counts)[:-1])


def _runs(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last place of each run of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return zip(edges[::2].tolist(), (edges[1::2] - 1).tolist())


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    import pyarrow as pa

    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    names, types = zip(*((f.split()[0], kinds[f.split()[1]]) for f in schema.split(",")))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=list(names))


def _text_mapper(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each text and stretch of input: its key, size, the packed text, its anchors."""
        import pyarrow as pa

        names = ["key", "n", "packed", "hashes", "often"]
        types = [pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        pack, seen = zstandard.ZstdCompressor(level=1).compress, set()
        for batch in batches:
            rows = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key in seen:
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(key)
                values, count = np.unique(anchors(data, length)[0], return_counts=True)
                rows.append((key, len(data), pack(data), values.view(np.int64).tolist(), count.tolist()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


class _Pieces:
    """Distinct pieces seen so far with how often and where first, sent once a task as long as memory allows."""

    def __init__(self):
        self._held: dict[bytes, list] = {}
        self._bytes = 0

    def add(self, anchor: int, piece: bytes, n: int, place: tuple) -> bytes:
        digest = hashlib.blake2b(piece, digest_size=16, key=anchor.to_bytes(8, "little", signed=True)).digest()
        entry = self._held.get(digest)
        if entry is None:
            self._held[digest] = [anchor, piece, n, place]
            self._bytes += len(piece) + 300
        else:
            entry[2] += n
            entry[3] = min(entry[3], place)
        return digest

    def send(self, all_: bool = False) -> Iterator[pa.RecordBatch]:
        if not all_ and self._bytes < MAPPER_BYTES:
            return
        rows = [(anchor, digest, piece, n, place[0], place[1] if not place[0] else None, *place[2:], None) for digest, (anchor, piece, n, place) in self._held.items()]
        self._held, self._bytes = {}, 0
        for k in range(0, len(rows), 10_000):
            yield _batch(rows[k : k + 10_000], _PIECES)


def _piece_mapper(length: int):
    """Of each text the pieces of its wanted anchors: a row for every place, and one for every distinct piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pieces = zstandard.ZstdDecompressor().decompress, _Pieces()
        for batch in batches:
            rows = []
            for tid, id_, packed, wanted in zip(*(batch.column(i).to_pylist() for i in range(4))):
                data, wanted = unpack(packed), set(wanted)
                for value, first, last in zip(*(a.tolist() for a in _signed(anchors(data, length)))):
                    if value in wanted:
                        digest = pieces.add(value, data[first : last + length], 1, (id_ is None, id_ or 0, tid, first))
                        rows.append((None, digest, None, None, None, None, tid, first, None))
                if len(rows) > 20_000:
                    yield _batch(rows, _PIECES)
                    rows = []
                yield from pieces.send()
            if rows:
                yield _batch(rows, _PIECES)
        yield from pieces.send(True)

    return run


def _divider(length: int, gram: int):
    """Pieces of too large anchors in pieces of anchors of longer grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _Pieces()
        for batch in batches:
            rows = []
            for parent, piece, n, none, id_, tid, start in zip(*(batch.column(i).to_pylist() for i in range(7))):
                for value, first, last in zip(*(a.tolist() for a in _signed(anchors(piece, length, gram)))):
                    digest = pieces.add(value, piece[first : last + length], n, (none, id_ or 0, tid, start + first))
                    rows.append((None, digest, None, None, None, None, None, first, parent))
            if rows:
                yield _batch(rows, _PIECES)
            yield from pieces.send()
        yield from pieces.send(True)

    return run


def _signed(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return found[0].view(np.int64), found[1], found[2]


def _owner(length: int, keep_first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Judges the pieces of one anchor value after another; equal ones, by their bytes, are one."""
        current, group = None, {}  # piece -> digest, how often, first place
        waiting: list[tuple] = []
        size = 0
        found: list[tuple] = []

        def close():
            nonlocal size
            for piece, (digest, n, place) in group.items():
                if n > 1:
                    found.append((digest, 0, len(piece) - length, *(place[2:] if keep_first else (None, None)), True if keep_first else None))
            if len(group) > 1:  # the strings of a single piece all differ
                waiting.extend((place, piece, digest) for piece, (digest, _, place) in group.items())
                size += sum(map(len, group))

        def judge():
            nonlocal size
            waiting.sort()
            if waiting:
                for (place, _, digest), flags in zip(waiting, repeated_starts([w[1] for w in waiting], length, keep_first)):
                    found.extend((digest, a, b, *(place[2:] if keep_first else (None, None)), False if keep_first else None) for a, b in _runs(flags))
            waiting.clear()
            size = 0

        for batch in batches:
            for value, digest, piece, n, none, id_, tid, start in zip(*(batch.column(i).to_pylist() for i in range(8))):
                if value != current:
                    close()
                    current, group = value, {}
                    if size > SORT_BYTES:
                        judge()
                place = (none, id_ or 0, tid, start)
                entry = group.get(piece)
                group[piece] = (digest, n, place) if entry is None else (digest, entry[1] + n, min(entry[2], place))
            if len(found) > 20_000:
                yield _batch(found, _JUDGED)
                found.clear()
        close()
        judge()
        if found:
            yield _batch(found, _JUDGED)

    return run


def _cutter(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spans to remove from a text, and what is left of it."""
        import pyarrow as pa

        unpack = zstandard.ZstdDecompressor().decompress
        names = ["key", "n_removed", "cut_sha", "spans"]
        types = [pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        for batch in batches:
            rows = []
            for key, packed, ranges in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data, spans, left, at = unpack(packed), [], hashlib.sha256(), 0
                for first, last in sorted((r["first"], r["last"]) for r in ranges):
                    if spans and first <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], last + length)
                    else:
                        spans.append([first, last + length])
                for a, b in spans:
                    left.update(data[at:a])
                    at = b
                left.update(data[at:])
                rows.append((key, sum(b - a for a, b in spans), left.digest(), [{"start": a, "end": b} for a, b in spans]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def _applies(place: list[Column]) -> Column:
    """Whether a judged range holds at a place: at every one, at the first of its piece, or at all others."""
    first = place[0].eqNullSafe(F.col("j.tid")) & place[1].eqNullSafe(F.col("j.start"))
    return F.col("j.others").isNull() | (first != F.col("j.others"))


def _judge(pieces: DataFrame, length: int, keep_first: bool, rounds: list[int], owner_bytes: int) -> DataFrame:
    """Ranges of repeated starts by digest of a piece (:data:`_JUDGED`); anchors that are too large go to the next round."""
    own = pieces.where("anchor is not null")
    columns = ["anchor", "digest", "piece", "n", "none", "id", "tid", "start"]
    deal = lambda rows: rows.select(*columns).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_owner(length, keep_first), _JUDGED)
    if not rounds:
        return deal(own)
    large = scratch.materialize(own.groupBy("anchor").agg(F.sum(F.octet_length("piece")).alias("size")).where(F.col("size") > owner_bytes).select("anchor"), "repeat-large")
    if large.isEmpty():
        return deal(own)
    place = F.struct("none", "id", "tid", "start")
    hot = own.join(large, "anchor", "left_semi").groupBy("digest").agg(F.first("piece").alias("piece"), F.sum("n").alias("n"), F.min(place).alias("p"))
    hot = scratch.materialize(hot.select("digest", "piece", "n", "p.*"), "repeat-hot")
    divided = scratch.materialize(hot.mapInArrow(_divider(length, rounds[0]), _PIECES), "repeat-divided")
    judged = _judge(divided, length, keep_first, rounds[1:], owner_bytes).alias("j")
    parts = divided.where("anchor is null").select("digest", F.col("parent"), F.col("start").alias("offset"))
    firsts = hot.select(F.col("digest").alias("parent"), F.col("tid").alias("first_tid"), F.col("start").alias("first_start"))
    parts = parts.join(firsts, "parent") if keep_first else parts.withColumns({"first_tid": F.lit(None).cast("long"), "first_start": F.lit(None).cast("long")})
    back = parts.join(judged, F.col("j.digest") == parts["digest"]).where(_applies([F.col("first_tid"), F.col("first_start") + F.col("offset")]))
    mark = F.lit(False if keep_first else None).cast("boolean")
    back = back.select(F.col("parent").alias("digest"), (F.col("j.first") + F.col("offset")).alias("first"), (F.col("j.last") + F.col("offset")).alias("last"), F.col("first_tid").alias("tid"), F.col("first_start").alias("start"), mark.alias("others"))
    known = lambda c: F.col(c) if keep_first else F.lit(None).cast("long").alias(c)
    copied = hot.where("n > 1").select("digest", F.lit(0).cast("long").alias("first"), (F.octet_length("piece") - length).cast("long").alias("last"), known("tid"), known("start"), F.lit(True if keep_first else None).cast("boolean").alias("others"))
    return deal(own.join(large, "anchor", "left_anti")).unionAll(back).unionAll(copied)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_first: bool = True, owner_bytes: int = OWNER_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` for every row.

    A byte of a text in UTF-8 is removed if a string of ``length`` bytes covers it that also starts
    elsewhere, in the same text or another; with ``keep_first`` only if it starts earlier, in the
    order of ids and places.  Strings are judged on the input.  ``spans`` are the removed runs.

    Null counts as empty; texts shorter than ``length`` keep everything; long texts are read whole, in
    stretches.  Texts are told apart by SHA-256 and pieces by 128 bits of BLAKE2b; strings are compared
    by their bytes.  Rows that repeat a text are elsewhere to each other (with ``keep_first`` the rows of
    the smallest id stay).  Null ids come last.  Other columns are ignored, whatever their names.  An
    empty table gives an empty result.
    """
    if length <= GRAM or length >= 1 << (_PLACE_BITS - 1):
        raise ValueError(f"length must exceed {GRAM}")
    first_gram, *rounds = grams(length)
    assert first_gram == GRAM
    spark = docs.sparkSession
    scratch.prepare(spark)
    text = F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("key"), text.alias("data"))
    copies = rows.groupBy("key").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))
    texts = scratch.materialize(rows.select("key", "data").mapInArrow(_text_mapper(length), "key binary, n long, packed binary, hashes array<long>, often array<long>"), "repeat-texts")
    places = texts.select("key", F.explode(F.arrays_zip("hashes", "often")).alias("a")).select("key", F.col("a.hashes").alias("anchor"), F.col("a.often").alias("often"))
    tagged = places.withColumn("tag", F.xxhash64("key"))
    shared = tagged.groupBy("anchor").agg(F.min("tag").alias("low"), F.max("tag").alias("high"), F.max("often").alias("most")).where("low <> high or most > 1")
    wanted = places.join(shared.select("anchor"), "anchor").groupBy("key").agg(F.collect_set("anchor").alias("wanted"))
    chosen = texts.select("key", "packed").join(wanted, "key").join(copies.select("key", "first_id"), "key").dropDuplicates(["key"])
    chosen = scratch.materialize(chosen.select(F.monotonically_increasing_id().alias("tid"), F.col("first_id").alias("id"), "key", "packed", "wanted"), "repeat-chosen")
    pieces = scratch.materialize(chosen.select("tid", "id", "packed", "wanted").mapInArrow(_piece_mapper(length), _PIECES), "repeat-pieces")
    judged = _judge(pieces, length, keep_first, rounds, owner_bytes).alias("j")
    at = pieces.where("anchor is null").select("digest", "tid", "start").alias("p")
    ranges = at.join(judged, F.col("p.digest") == F.col("j.digest")).where(_applies([F.col("p.tid"), F.col("p.start")]))
    ranges = ranges.select("p.tid", (F.col("p.start") + F.col("j.first")).alias("first"), (F.col("p.start") + F.col("j.last")).alias("last"))
    ranges = ranges.groupBy("tid").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    cut = chosen.select("tid", "key", "packed").join(ranges, "tid").select("key", "packed", "ranges").mapInArrow(_cutter(length), "key binary, n_removed long, cut_sha binary, spans array<struct<start:long,end:long>>")
    whole = texts.select("key", "n").dropDuplicates(["key"])
    by_key = whole.join(copies, "key").join(cut, "key", "left")
    joined = rows.select("id", "key").join(by_key, "key")
    copied = (F.col("copies") > 1) & (F.col("n") >= length)
    gone = copied & ~F.col("id").eqNullSafe(F.col("first_id")) if keep_first else copied
    nothing = F.unhex(F.sha2(F.lit("").cast("binary"), 256))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    spans = F.when(gone, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("end")))).otherwise(F.coalesce("spans", none))
    return joined.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_bytes"),
        F.when(gone, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.size(spans).cast("long").alias("n_spans"),
        F.lower(F.hex(F.when(gone, nothing).otherwise(F.coalesce("cut_sha", "key")))).alias("kept_sha256"),
        spans.alias("spans"),
    )


def apply_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the spans."""
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join(out) + text[at:]
