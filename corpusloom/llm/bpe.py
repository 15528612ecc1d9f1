"""Byte-level BPE as a streaming transducer, and the way back as a state machine.

A text streams through a transducer whose states are word boundaries (:class:`Stream`).  What lies
before a boundary that no later character can move is stable and its tokens are emitted; what lies
after is held.  A word may be as long as the text, so within a word merging works on a window: from
the merge list follows how far to the right a token can depend on what comes next
(:meth:`Merges.lookahead`), and tokens that end that far before the end of the window are final and
are emitted too.  So the transducer holds a bounded number of bytes, whatever the text.

No token spans a word boundary, so at a boundary the sufficient lookahead is zero: all tokens of a finished word are stable, and
finishing a word is what emits nearly all tokens of ordinary text.  The window's lookahead decides in words longer than
:data:`HELD`.  What was emitted for a word before is remembered; :meth:`Encoder.learn` makes the transitions of many new
words at once, with the same merges, before their texts stream through.  Both change speed only.
"""

from __future__ import annotations

import codecs
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import scratch

# Fixed value: the pattern by which byte-level tokenizers cut a text into words.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Bytes merged at once beyond the lookahead.
WINDOW = 4096
#: Bytes up to which a word is remembered, and characters held back before a word is taken for a long one.
SHORT, HELD = 256, 1024
#: Words and pieces between spaces that a worker remembers, each.
REMEMBERED = 400_000
#: Characters of a text that are cut into words at once.
STRETCH = 1 << 16
_NONE = 1 << 62


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: printable ones as they are, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


class Merges:
    """Vocabulary and merge list of a byte-level tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], {c: b for b, c in byte_letters().items()}
        as_bytes = lambda token: bytes(letters[c] for c in token)
        vocab = model["vocab"]
        self.token_bytes: dict[int, bytes] = {i: as_bytes(t) for t, i in vocab.items()}
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes |= {i: t.encode("utf-8") for t, i in self.special.items()}
        self.byte_id = [vocab[byte_letters()[b]] for b in range(256)]
        #: (left id, right id) -> rank * 2 ** 32 + merged id
        self.ranks: dict[tuple[int, int], int] = {}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        for rank, (a, b) in enumerate(pairs):
            self.ranks.setdefault((vocab[a], vocab[b]), rank << 32 | vocab[a + b])
        self.merged = [as_bytes(a) + as_bytes(b) for a, b in pairs]
        # The same ranks for many words at once: sorted pair keys and what belongs to them.
        keys = np.array([a << 20 | b for a, b in self.ranks], dtype=np.int64)
        order = np.argsort(keys)
        self._keys, self._values = keys[order], np.array(list(self.ranks.values()), dtype=np.int64)[order]
        self._byte_ids = np.array(self.byte_id, dtype=np.int64)

    @property
    def lookahead(self) -> int:
        """Bytes to the right of a token boundary that suffice to make it final.

        Whether a merge takes place can depend on text to its right only through a merge of smaller
        rank that overlaps its right end, that one through another of still smaller rank, and so on
        to the end of what is known.  So the longest stretch is that of a chain of tokens with
        falling ranks, each beginning inside the one before: taken in the order of their ranks, a
        token reaches as far as the furthest earlier token that starts with one of its ends.
        """
        reach: dict[bytes, int] = {}  # proper beginning -> furthest reach of a token that starts so
        most = 1
        for token in self.merged:
            n = len(token)
            far = n
            for k in range(1, n):
                if (r := reach.get(token[k:])) is not None and k + r > far:
                    far = k + r
            for k in range(1, n):
                head = token[:k]
                if reach.get(head, 0) < far:
                    reach[head] = far
            most = max(most, far)
        return most

    def merge(self, data: bytes) -> list[int]:
        """Ids of ``data`` taken as one whole word."""
        ids = [self.byte_id[b] for b in data]
        if len(ids) > 64:
            return self._merge_long(ids)
        get, none = self.ranks.get, repeat(_NONE)
        while len(ids) > 1:
            ranks = list(map(get, zip(ids, ids[1:]), none))
            best = min(ranks)
            if best == _NONE:
                break
            k = ranks.index(best)
            ids[k : k + 2] = [best & 0xFFFFFFFF]
        return ids

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._values[at], _NONE)

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Ids, as little-endian unsigned 32-bit integers, of many short words; in each round every word makes its next merge."""
        ids = self._byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        rank = np.full(len(ids), _NONE, dtype=np.int64)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self._rank(ids[inner], ids[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(starts, len(ids)))
            best = np.minimum.reduceat(rank, starts)
            going = np.repeat(best < _NONE, sizes)
            if not going.all():
                done.append((word[~going], ids[~going]))
                ids, word, rank = ids[going], word[going], rank[going]
                sizes, best = sizes[best < _NONE], best[best < _NONE]
                if not len(ids):
                    break
            hits = np.flatnonzero(rank == np.repeat(best, sizes))
            hits = hits[np.concatenate([[True], word[hits[1:]] != word[hits[:-1]]])]  # the first of each word
            ids[hits] = rank[hits] & 0xFFFFFFFF
            stay = np.ones(len(ids), dtype=bool)
            stay[hits + 1] = False
            moved = np.cumsum(stay) - 1
            ids, word, rank, hits = ids[stay], word[stay], rank[stay], moved[hits]
            for left in (hits, hits[hits > 0] - 1):
                inside = left[left + 1 < len(ids)]
                same = word[inside] == word[inside + 1]
                rank[left] = _NONE
                inside = inside[same]
                rank[inside] = self._rank(ids[inside], ids[inside + 1])
        words_done = np.concatenate([w for w, _ in done]) if done else np.empty(0, np.int64)
        ids_done = np.concatenate([i for _, i in done]) if done else np.empty(0, np.int64)
        order = np.argsort(words_done, kind="stable")
        cuts = (4 * np.concatenate([[0], np.cumsum(np.bincount(words_done, minlength=len(words)))])).tolist()
        data = ids_done[order].astype("<u4").tobytes()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of candidate merges over a linked list."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k, pair in enumerate(zip(ids, ids[1:])) if (r := self.ranks.get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            j = after[k] if ids[k] >= 0 else n
            if j >= n or self.ranks.get((ids[k], ids[j])) != r:
                continue
            ids[k], ids[j] = r & 0xFFFFFFFF, -1
            after[k] = after[j]
            if after[j] < n:
                before[after[j]] = k
                if (x := self.ranks.get((ids[k], ids[after[j]]))) is not None:
                    heapq.heappush(heap, (x, k))
            if before[k] >= 0 and (x := self.ranks.get((ids[before[k]], ids[k]))) is not None:
                heapq.heappush(heap, (x, before[k]))
        return [i for i in ids if i >= 0]


class Window:
    """Ids of one word from its bytes, a part at a time; holds at most lookahead + window + part bytes."""

    def __init__(self, merges: Merges, lookahead: int, window: int = WINDOW):
        self._merges, self._lookahead, self._window = merges, lookahead, window
        self._held = b""

    def feed(self, part: bytes) -> list[int]:
        self._held += part
        out: list[int] = []
        while len(self._held) >= self._lookahead + self._window:
            view = self._held[: self._lookahead + self._window]
            end, stable = 0, len(view) - self._lookahead
            for i in self._merges.merge(view):
                size = len(self._merges.token_bytes[i])
                if end + size > stable:
                    break
                end += size
                out.append(i)
            if not end:  # one token longer than the window
                self._window *= 2
                continue
            self._held = self._held[end:]
        return out

    def finish(self) -> list[int]:
        out, self._held = self._merges.merge(self._held), b""
        return out


#: What goes on with a word that has begun with a letter, a number or something else; white space is apart.
_RUNS = tuple(map(regex.compile, (r"\p{L}*", r"\p{N}*", r"[^\s\p{L}\p{N}]*")))
_SPACE = regex.compile(r"\s*")


class Stream:
    """Ids of one text from its characters, a part at a time; between parts it holds a bounded number of them.

    States: between words, with the characters held whose words the next part may still change; or
    inside a long word of one kind, whose bytes go through a :class:`Window`.
    """

    def __init__(self, encoder: Encoder):
        self._encoder = encoder
        self._held = ""
        self._inside: tuple[regex.Pattern, Window] | None = None

    def held(self) -> int:
        return len(self._held) + (len(self._inside[1]._held) if self._inside else 0)

    def feed(self, part: str) -> Iterator[bytes]:
        text = self._held + part
        if self._inside:
            text = yield from self._go_on(text)
        if text:
            end = self._encoder.boundary(text)
            if end:
                yield self._encoder.words(text[:end])
                text = text[end:]
            if len(text) > HELD:
                text = yield from self._by_words(text)
        self._held = text

    def finish(self) -> Iterator[bytes]:
        if self._inside:
            if self._inside[0] is _SPACE:  # white space at the end of a text is one word
                yield _packed(self._inside[1].feed(self._held.encode("utf-8")))
                self._held = ""
            yield _packed(self._inside[1].finish())
            self._inside = None
        if self._held:
            yield self._encoder.words(self._held)
            self._held = ""

    def _go_on(self, text: str) -> Iterator[bytes]:
        """Feed the open word; what is left of ``text`` where it ends."""
        pattern, window = self._inside
        end = pattern.match(text).end()
        if pattern is _SPACE and end:
            end -= 1  # the last white space may go with the next word, or be a word
        for k in range(0, end, HELD):
            yield _packed(window.feed(text[k : min(k + HELD, end)].encode("utf-8")))
        rest = text[end:]
        if len(rest) > (pattern is _SPACE and rest[:1].isspace()):
            yield _packed(window.finish())
            self._inside = None
        return rest

    def _by_words(self, text: str) -> Iterator[bytes]:
        """Emit all words but those that the next characters may change; a long one that is left is opened."""
        at = 0
        for m in WORD.finditer(text):
            if m.end() > len(text) - 2:  # a contraction takes up to two more
                break
            at = m.end()
            yield self._encoder.word(m[0])
        text = text[at:]
        if len(text) > HELD:
            first = text[1] if text[0] == " " and not text[1].isspace() else text[0]
            kind = _SPACE if first.isspace() else next(p for p in _RUNS if p.match(first).end())
            self._inside = kind, Window(self._encoder.merges, self._encoder.lookahead)
            if text[0] == " " and kind is not _SPACE:
                yield _packed(self._inside[1].feed(b" "))
                text = text[1:]
            text = yield from self._go_on(text)
        return text


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


class Encoder:
    """Ids of texts, with the words met so far remembered."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.merges = Merges(path)
        self.lookahead = self.merges.lookahead
        self._remembered = remembered
        self._words: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}  # what stands between two spaces -> ids of it with the space before
        special = sorted(self.merges.special, key=len, reverse=True)
        self._special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def word(self, word: str) -> bytes:
        """Ids of a word that is known to its end."""
        if (known := self._words.get(word)) is not None:
            return known
        window = Window(self.merges, self.lookahead)
        data = word.encode("utf-8")
        out = _packed(window.feed(data) + window.finish())
        if len(data) < SHORT:
            if len(self._words) >= self._remembered:
                self._words.clear()
            self._words[word] = out
        return out

    def _cut(self, text: str) -> bytes:
        get, word = self._words.get, self.word
        return b"".join([get(w) or word(w) for w in WORD.findall(text)])

    def words(self, text: str) -> bytes:
        """Ids of text that ends at a word boundary; words never span a space that follows something else than white space."""
        first, *pieces = text.split(" ")
        if not pieces or first[-1:].isspace():
            return self._cut(text)
        last = pieces.pop()
        found = list(map(self._pieces.get, pieces))
        if None in found:
            for piece in dict.fromkeys(p for p, f in zip(pieces, found) if f is None):
                if not piece or piece[-1].isspace():  # the next space follows white space
                    return self._cut(text)
            if len(self._pieces) + len(pieces) > self._remembered:
                self._pieces.clear()
            known = self._pieces
            for piece in pieces:
                if piece not in known:
                    known[piece] = self._cut(" " + piece)
            found = map(known.get, pieces)
        return self._cut(first) + b"".join(found) + self._cut(" " + last)

    def learn(self, texts: Iterable[str | None]) -> None:
        """Remember the words of many texts at once, as the transducer would meet them; changes speed only."""
        pieces: set[str] = set()
        for text in texts:
            if text and len(text) <= STRETCH:
                pieces.update(text.split(" ")[1:-1])
        new = [p for p in pieces.difference(self._pieces) if p and not p[-1].isspace() and len(p) < 64]
        if len(self._pieces) + len(new) > self._remembered:
            self._pieces.clear()
            new = [p for p in pieces if p and not p[-1].isspace() and len(p) < 64][: self._remembered]
        cut = [WORD.findall(" " + p) for p in new]
        unknown = list({w for ws in cut for w in ws if w not in self._words})
        if len(self._words) + len(unknown) > self._remembered:
            self._words.clear()
            unknown = list({w for ws in cut for w in ws})
        for k in range(0, len(unknown), 4096):
            some = unknown[k : k + 4096]
            self._words.update(zip(some, self.merges.merge_many([w.encode("utf-8") for w in some])))
        get = self._words.__getitem__
        self._pieces.update((p, b"".join(map(get, ws))) for p, ws in zip(new, cut))

    def encode(self, text: str | None) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, a part at a time."""
        text = text or ""
        at = 0
        for m in [*(self._special.finditer(text) if self._special else ()), None]:
            end = m.start() if m else len(text)
            stream = Stream(self)
            for k in range(at, end, STRETCH):
                yield from stream.feed(text[k : min(k + STRETCH, end)])
            yield from stream.finish()
            if m:
                yield self.merges.special[m[0]].to_bytes(4, "little")
                at = m.end()

    @staticmethod
    def boundary(text: str) -> int:
        """The last place before a space that follows something else than white space, which no later text can move; else 0."""
        at = len(text)
        while (at := text.rfind(" ", 1, at)) > 0:
            if not text[at - 1].isspace():
                return at
        return 0


class Decoder:
    """Text from ids, a part at a time; holds at most the first bytes of one character.

    Bytes that are not UTF-8 become U+FFFD, one for each longest beginning of a character.
    """

    def __init__(self, token_bytes: dict[int, bytes]):
        self._bytes = token_bytes
        self._machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self._machine.decode(b"".join(map(self._bytes.__getitem__, ids)))

    def finish(self) -> str:
        return self._machine.decode(b"", True)


@lru_cache(4)
def _encoder(path: str) -> Encoder:  # workers are reused, so words stay known from task to task
    return Encoder(path)


@lru_cache(4)
def _token_bytes(path: str) -> dict[int, bytes]:
    return Merges(path).token_bytes


def tokenize(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids`` of every row; ``ids`` is binary, little-endian unsigned 32-bit integers.

    ``tokenizer`` is the path of a byte-level tokenizers file, the same on every executor.  Its
    special tokens are recognised where their strings occur.  Null and empty texts have no ids.  Texts
    of any length stream through the transducer.  Rows are independent, so repeated rows and null ids
    pass through.  Other columns are ignored, whatever their names.  An empty table gives an empty result.
    """
    scratch.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        encoder = _encoder(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            encoder.learn(texts)
            ids = [b"".join(encoder.encode(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def detokenize(tokens: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """``tokens`` with the text of its ids as ``decoded``; null ids give the empty text, an unknown id fails."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        table, out = _token_bytes(tokenizer), []
        for data in column:
            ids, machine, parts = np.frombuffer(data or b"", dtype="<u4"), Decoder(table), []
            for k in range(0, len(ids), STRETCH):
                parts.append(machine.feed(ids[k : k + STRETCH].tolist()))
            out.append("".join(parts) + machine.finish())
        return pd.Series(out, dtype=object)

    return tokens.withColumn("decoded", run(F.col(ids_col)))
