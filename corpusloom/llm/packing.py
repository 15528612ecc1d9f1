"""Packing tokenised documents into windows by non-negative least squares.

A document fills as many whole windows as it can; what remains is a shorter piece.  Only the
histogram of remaining lengths decides how those are combined: combinations of a few lengths that
fill a window are enumerated, the number of times each is used is the non-negative least-squares
solution against the histogram, rounded and never above what is there.  What is left over fills windows greedily, and where a
window stays open and pieces are left, one of them is cut to close it, at a multiple of :data:`GRAIN` ids; its tail is packed
like any other piece.  The plan's size depends on the window, not on the corpus.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import scratch

WINDOW = 4096
#: A remainder is cut at multiples of so many ids, at which the checksum of what comes before is kept.
GRAIN = 32
#: Pieces of one length above which they are planned by themselves, as often as that can be repeated.
MANY = 16
#: Words whose ids a worker remembers.
CACHED_WORDS = 300_000


# What the word tokenizer's own normaliser and splitter do on plain words, that is
# words of printable ASCII and Latin-1 letters, which NFC leaves alone.
_PLAIN = re.compile(r"[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_PLAIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")


def _byte_letters() -> dict[int, int]:
    """The letters by which byte-level tokenizers write bytes: printable ones as they are, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 0x100 + k for k, b in enumerate(hidden)}


class WordEncoder:
    """Ids of a tokenizer whose tokens never span ASCII white space, remembered by word.

    The text is cut at ASCII white space.  A new plain word is split here and only parts that are
    new go through the tokenizer's model; any other new word goes through the whole tokenizer.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._ids: dict[bytes, bytes] = {}
        self._parts: dict[str, bytes] = {}
        self._letters = _byte_letters()
        self._cached = cached

    def _learn(self, words: list[bytes]) -> None:
        if len(self._ids) + len(words) > self._cached:
            self._ids.clear()
        if len(self._parts) > self._cached:
            self._parts.clear()
        odd, parts, letters, tokenize = [], self._parts, self._letters, self._tokenizer.model.tokenize
        for word in words:
            text = word.decode("utf-8")
            if not _PLAIN.fullmatch(text) or "<|" in text:
                odd.append(word)
                continue
            out = []
            for part in _PLAIN_SPLIT.findall(text.lower()):
                ids = parts.get(part)
                if ids is None:
                    written = part.encode("utf-8").decode("latin-1").translate(letters)
                    ids = parts[part] = b"".join([t.id.to_bytes(4, "little") for t in tokenize(written)])
                out.append(ids)
            self._ids[word] = b"".join(out)
        for word, got in zip(odd, self._tokenizer.encode_batch([w.decode("utf-8") for w in odd], add_special_tokens=False)):
            self._ids[word] = np.array(got.ids, dtype="<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        words = (text or "").encode("utf-8").split()
        parts = list(map(self._ids.get, words))
        if None in parts:
            missing = list(dict.fromkeys(w for w, p in zip(words, parts) if p is None))
            whole = len(self._ids) + len(missing) > self._cached
            self._learn(missing)
            if whole:  # what was known is forgotten
                known = self._ids
                rest = list(dict.fromkeys(w for w in words if w not in known))
                if len(rest) + len(known) > self._cached:
                    return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
                self._learn(rest)
            parts = list(map(self._ids.get, words))
        return b"".join(parts)


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:  # workers are reused, so the words stay known from task to task
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def marks(part: memoryview) -> bytes:
    """Checksums of the first 0, GRAIN, 2 GRAIN and so on ids of a piece, four bytes each."""
    out, crc = [0], 0
    for k in range(0, len(part) - 4 * GRAIN, 4 * GRAIN):
        crc = zlib.crc32(part[k : k + 4 * GRAIN], crc)
        out.append(crc)
    return np.array(out, dtype="<u4").tobytes()


def crc_between(before: int, upto: int, ids: int) -> int:
    """Checksum of the last ``ids`` ids of a run, from that of what comes before them and that of the whole run."""
    zeros = bytes(4 * ids)
    return upto ^ zlib.crc32(zeros, before) ^ zlib.crc32(zeros)


def _cutter(path: str, end_id: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        encode, end = _encoder(path).encode, end_id.to_bytes(4, "little")
        names = ["id", "start", "length", "crc", "total", "marks"]
        for batch in batches:
            rows = []
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = encode(text) + end
                total = len(data) // 4
                view = memoryview(data)
                for a in range(0, total, window):
                    part = view[4 * a : 4 * (a + window)]
                    whole = len(part) == 4 * window
                    rows.append((id_, a, len(part) // 4, zlib.crc32(part), total, None if whole else marks(part)))
            if rows:
                *numbers, kept = zip(*rows)
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in numbers], pa.array(kept, pa.binary())], names=names)

    return run


def fillings(lengths: np.ndarray, window: int, breadth: int = 24, depth: int = 4, slack: int = 8) -> list[tuple[int, ...]]:
    """Combinations of at most ``depth`` of the sorted ``lengths`` that leave at most ``slack`` of a window free.

    For each longest member, ``breadth`` second members spread over what fits are tried, and the
    window is completed with the longest that fit.
    """
    have = lengths.tolist()
    found: set[tuple[int, ...]] = set()
    for a in have:
        top = bisect_right(have, min(a, window - a))
        picks = {int(round(x)) for x in np.linspace(0, top - 1, breadth)} if top else set()
        for k in sorted(picks):
            combo = [a, have[k]]
            rest = window - a - have[k]
            while rest > slack and len(combo) < depth:
                k2 = bisect_right(have, rest)
                if not k2:
                    break
                combo.append(have[k2 - 1])
                rest -= have[k2 - 1]
            if rest <= slack:
                found.add(tuple(sorted(combo, reverse=True)))
        if window - a <= slack:
            found.add((a,))
    return sorted(found, reverse=True)


def nonnegative_least_squares(columns: list[np.ndarray], target: np.ndarray, steps: int = 3000, tolerance: float = 1e-4) -> np.ndarray:
    """min |A x - target| over x >= 0, A given by the row numbers (with repeats) of each column's ones.

    Accelerated projected gradient; A is sparse, so a step costs as much as its ones are many.  Ends when no entry moves by more than
    ``tolerance`` of the largest, or a hundredth.
    """
    if not columns:
        return np.empty(0)
    rows = np.concatenate(columns)
    cols = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    n = len(columns)
    # A bound on the largest eigenvalue of A'A: the largest row sum times the largest column sum.
    bound = np.bincount(rows, minlength=len(target)).max() * max(len(c) for c in columns)
    x, y, t = np.zeros(n), np.zeros(n), 1.0
    for _ in range(steps):
        residual = np.bincount(rows, weights=y[cols], minlength=len(target)) - target
        new = np.maximum(0, y - np.bincount(cols, weights=residual[rows], minlength=n) / bound)
        if np.abs(new - x).max() <= max(0.01, tolerance * new.max()):
            return new
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def plan(histogram: dict[int, int], window: int = WINDOW) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Combinations of lengths and how often each is used, and the pieces of each length that are left over."""
    left = {n: c for n, c in histogram.items() if c > 0}
    out: list[tuple[tuple[int, ...], int]] = []
    lengths = np.array(sorted(left), dtype=np.int64)
    combos = fillings(lengths, window)
    at = {int(n): k for k, n in enumerate(lengths)}
    target = np.array([left[int(n)] for n in lengths], dtype=float)
    counts = nonnegative_least_squares([np.array([at[n] for n in c]) for c in combos], target)
    for k in np.argsort(-counts, kind="stable"):
        combo = combos[k]
        times = min(int(round(counts[k])), *(left.get(n, 0) // combo.count(n) for n in set(combo)))
        if times > 0:
            out.append((combo, times))
            for n in combo:
                left[n] -= times
    return out, {n: c for n, c in left.items() if c}


class Slots:
    """Where pieces go: the pieces of one length are ranked, and a row is (first rank, end, from, to, sequence of the first, offset).

    Ids ``from`` to ``to`` of the ranks stand at ``offset`` of one sequence each.
    """

    def __init__(self, base: int) -> None:
        self.rows: dict[int, list[tuple[int, int, int, int, int, int]]] = {}
        self.base = base
        self._open: dict[int, list[list[int]]] = {}  # what is left: length of what remains -> [length, from, first rank, end]

    def add(self, length: int, start: int, first: int, end: int) -> None:
        if end > first:
            self._open.setdefault(length - start, []).append([length, start, first, end])

    def count(self, remaining: int) -> int:
        return sum(e[3] - e[2] for e in self._open.get(remaining, ()))

    def take(self, remaining: int, times: int, offset: int, most: int | None = None) -> None:
        """``times`` pieces with so much remaining, one a sequence from the base on, cut after ``most`` ids if that is given."""
        sequence, entries = self.base, self._open[remaining]
        while times:
            length, start, first, end = entry = entries[-1]
            n = min(times, end - first)
            upto = length if most is None else start + most
            self.rows.setdefault(length, []).append((first, first + n, start, upto, sequence, offset))
            if upto < length:
                self.add(length, upto, first, first + n)
            entry[2] += n
            if entry[2] == end:
                entries.pop()
            times, sequence = times - n, sequence + n

    def lengths(self) -> list[int]:
        return sorted(n for n in self._open if self.count(n))

    def fill(self, window: int, grain: int = GRAIN, many: int = MANY) -> None:
        """Fill sequences with all that is open.  Cutting one length at least halves the number of its pieces each time."""
        for remaining in range(window, 0, -1):  # tails are shorter than what they are cut from
            count = self.count(remaining)
            if count < many:
                continue
            copies = window // remaining
            rest = (window - copies * remaining) // grain * grain
            times = count // (copies + (rest > 0))
            for k in range(copies):
                self.take(remaining, times, k * remaining)
            if rest:
                self.take(remaining, times, copies * remaining, rest)
            self.base += times
        have = self.lengths()
        counts = {n: self.count(n) for n in have}

        def use(n: int, offset: int, most: int | None = None) -> None:
            self.take(n, 1, offset, most)
            counts[n] -= 1
            if not counts[n]:
                del counts[n], have[bisect_right(have, n) - 1]
            if most is not None:
                tail = n - most
                if tail not in counts:
                    insort(have, tail)
                counts[tail] = counts.get(tail, 0) + 1

        while have:
            rest = window
            while rest and (k := bisect_right(have, rest)):  # the longest that still fits
                n = have[k - 1]
                use(n, window - rest)
                rest -= n
            if have and rest >= grain:  # what is left is longer: the longest gives a part
                use(have[-1], window - rest, rest // grain * grain)
            self.base += 1


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``tokenizer`` is the path of a tokenizers file, the same on every executor, whose tokens do not
    span ASCII white space.  Sequences are numbered from 0 and filled from offset 0 without gaps.

    A null or empty text is the single id ``end_id``.  Long texts fill whole windows first, and what remains of a text may be
    cut again.  Null ids are kept as null.  Repeated rows are
    packed each on their own.  Other columns are ignored.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch.prepare(spark)
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    # Written first: dealing by ranges reads its input twice, and tokenising is the costly part.
    pieces = scratch.materialize(rows.mapInArrow(_cutter(tokenizer, end_id, window), "id long, start long, length long, crc long, total long, marks binary"), "cut")
    # Ranges of (length, id, start) put equal lengths side by side, split over tasks where they are many.
    placed = pieces.repartitionByRange("length", "id", "start").sortWithinPartitions("length", "id", "start")
    numbered = scratch.materialize(placed.withColumn("place", F.monotonically_increasing_id()), "pieces")
    part = F.shiftright("place", 33).alias("part")
    # A range holds few lengths: at most as many rows as tasks and lengths together.
    runs = numbered.groupBy(part, "length").agg(F.min("place").alias("first"), F.count("*").alias("n")).collect()
    runs.sort(key=lambda r: (r.length, r.part))
    histogram: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    for r in runs:
        before[r.part, r.length] = histogram.get(r.length, 0) - r.first
        histogram[r.length] = histogram.get(r.length, 0) + r.n
    whole = histogram.pop(window, 0)
    combos, left = plan(histogram, window)
    slots = Slots(whole)
    slots.rows[window] = [(0, whole, 0, window, 0, 0)]
    taken: dict[int, int] = {}
    for combo, times in combos:
        offset = 0
        for n in combo:
            first = taken.get(n, 0)
            slots.rows.setdefault(n, []).append((first, first + times, 0, n, slots.base, offset))
            taken[n] = first + times
            offset += n
        slots.base += times
    for n in left:
        slots.add(n, 0, taken.get(n, 0), histogram[n])
    slots.fill(window)
    # By length and place of the cut: ranks in order.
    tables: dict[int, list[np.ndarray]] = {}
    for n, rows_ in slots.rows.items():
        by_start: dict[int, list] = {}
        for row in sorted(rows_):
            by_start.setdefault(row[2], []).append(row)
        tables[n] = [np.array(r, dtype=np.int64).T for _, r in sorted(by_start.items())]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            id_, start, length, crc, total, kept, at = batch.columns
            n, places, crcs = length.to_numpy(), at.to_numpy(), crc.to_numpy()
            found = []
            for p, m in {(int(p), int(m)) for p, m in zip(places >> 33, n)}:
                own = np.flatnonzero((n == m) & (places >> 33 == p))
                rank = places[own] + before[p, m]
                for first, end, low, high, sequence, offset in tables[m]:
                    k = np.maximum(np.searchsorted(first, rank, side="right") - 1, 0)
                    there = (first[k] <= rank) & (rank < end[k])
                    k, rows_ = k[there], own[there]
                    found.append(np.stack([rows_, low[k], high[k], sequence[k] + rank[there] - first[k], offset[k]]))
            rows_, low, high, sequence, offset = np.concatenate(found, axis=1)
            sums = crcs[rows_]
            for j in np.flatnonzero((low > 0) | (high < n[rows_])).tolist():
                known = np.frombuffer(kept[int(rows_[j])].as_py(), dtype="<u4")
                a, b = int(low[j]), int(high[j])
                sums[j] = crc_between(int(known[a // GRAIN]), int(crcs[rows_[j]]) if b == n[rows_[j]] else int(known[b // GRAIN]), b - a)
            pick = pa.array(rows_)
            yield pa.RecordBatch.from_arrays(
                [id_.take(pick), pa.array(start.to_numpy()[rows_] + low), pa.array(high - low), pa.array(sums), total.take(pick), pa.array(sequence), pa.array(offset)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return numbered.select("id", "start", "length", "crc", "total", "marks", "place").mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
