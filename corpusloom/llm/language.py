"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A trigram's vector binds the letters' vectors,
permuted by their place, by multiplication; a text bundles the vectors of its trigrams by addition;
a language's prototype bundles those of all its training texts.  A text's language is that of the
prototype with the largest cosine.

A letter's vector is drawn from its code point, so there is no table of letters and no limit to the
scripts.  A text is summed up by the counts of its trigrams, and the vectors are touched once per
distinct trigram of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import scratch

DIMENSIONS = 1024
UNKNOWN = "und"
#: Share of the cosine that a text of a learned language is expected to reach, below which a text is of none.
LEAST_LIKENESS = 0.2
_SEED = np.uint64(0x9E3779B97F4A7C15)
_STRETCH = 1 << 20
_POINT_BITS = 21
#: Trigrams whose vectors are held at once.
_HELD = 1 << 14


@lru_cache(1)
def _letters() -> np.ndarray:
    """The lower-case letter of each code point that is one, else 0, the gap between words."""
    out = np.zeros(0x110000, dtype=np.int64)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            out[point] = ord(c.lower()[0])
    return out


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """(points, dimensions) of +1 and -1 as int8, from a mixing function of the code point alone."""
    words = points.astype(np.uint64)[:, None] * np.uint64(DIMENSIONS) + np.arange(DIMENSIONS // 64, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (words + np.uint64(1)) * _SEED
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little")
    return (bits * np.int8(2) - np.int8(1)).astype(np.int8)


def trigram_vectors(grams: np.ndarray) -> np.ndarray:
    """(trigrams, dimensions): the letters' vectors, turned by their place, multiplied."""
    mask = (1 << _POINT_BITS) - 1
    letters, place = np.unique(np.concatenate([grams >> 2 * _POINT_BITS, grams >> _POINT_BITS & mask, grams & mask]), return_inverse=True)
    last = letter_vectors(letters)
    first, second = np.roll(last, 2, axis=1), np.roll(last, 1, axis=1)
    a, b, c = np.split(place, 3)
    return first[a] * second[b] * last[c]


def trigram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of ``text`` that hold a letter, and how often each occurs."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    text = text or ""
    for k in range(0, len(text), _STRETCH):  # stretches overlap by two places, so no trigram is lost
        part = text[max(0, k - 2) : k + _STRETCH]
        codes = _letters()[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        if k == 0:
            codes = np.concatenate([[0], codes])
        if k + _STRETCH >= len(text):
            codes = np.concatenate([codes, [0]])
        if len(codes) < 3:
            continue
        grams = (codes[:-2] << 2 * _POINT_BITS) | (codes[1:-1] << _POINT_BITS) | codes[2:]
        found.append(np.unique(grams[grams > 0], return_counts=True))
    if len(found) == 1:
        return found[0]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ids, place = np.unique(np.concatenate([i for i, _ in found]), return_inverse=True)
    return ids, np.bincount(place, weights=np.concatenate([n for _, n in found])).astype(np.int64)


def bundles(counted: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(texts, dimensions): for each text the sum of its trigrams' vectors, each as often as it occurs."""
    out = np.zeros((len(counted), DIMENSIONS), dtype=np.float32)
    all_ids = np.unique(np.concatenate([i for i, _ in counted])) if counted else np.empty(0, np.int64)
    for k in range(0, len(all_ids), _HELD):
        held = all_ids[k : k + _HELD]
        table = trigram_vectors(held)
        for row, (ids, counts) in enumerate(counted):
            a, b = np.searchsorted(ids, [held[0], held[-1] + 1])
            if a < b:
                out[row] += counts[a:b].astype(np.float32) @ table[np.searchsorted(held, ids[a:b])].astype(np.float32)
    return out


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bundles by language over one partition: a number for each language and dimension, and one for the trigrams."""
    import pyarrow as pa

    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        by_lang: dict[str, list] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by_lang.setdefault(lang, []).append(trigram_counts(text))
        for lang, counted in by_lang.items():
            ids, place = np.unique(np.concatenate([i for i, _ in counted]), return_inverse=True)
            counts = np.bincount(place, weights=np.concatenate([n for _, n in counted]), minlength=len(ids))
            total = totals.setdefault(lang, np.zeros(DIMENSIONS + 1, dtype=np.int64))
            total[DIMENSIONS] += int(counts.sum())
            for k in range(0, len(ids), _HELD):
                total[:DIMENSIONS] += np.rint(counts[k : k + _HELD] @ trigram_vectors(ids[k : k + _HELD])).astype(np.int64)
    for lang, total in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(total)), pa.array(np.arange(len(total))), pa.array(total)], names=["lang", "place", "n"])


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", training: Column | None = None) -> dict[str, np.ndarray]:
    """Prototypes by language, each the bundle of all its texts divided by their trigrams.

    All rows of ``training`` with a text and a language count.  The driver gets DIMENSIONS + 1 numbers
    a language, however many texts there are; languages are few.
    """
    scratch.prepare(docs.sparkSession)
    rows = docs if training is None else docs.where(training)
    rows = rows.select(rows[text_col].cast("string").alias("text"), rows[lang_col].cast("string").alias("lang")).where("text is not null and lang is not null")
    sums = rows.mapInArrow(_tally, "lang string, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).collect()
    totals: dict[str, np.ndarray] = {}
    for r in sums:
        totals.setdefault(r.lang, np.zeros(DIMENSIONS + 1))[r.place] = r.n
    return {lang: (t[:DIMENSIONS] / t[DIMENSIONS]).astype(np.float32) for lang, t in sorted(totals.items()) if t[DIMENSIONS]}


def classify(texts: list[str | None], prototypes: dict[str, np.ndarray]) -> list[tuple[str, float, float]]:
    """Most similar language, its cosine (0 at least), and the likeness of each text; ``und`` for one without a letter.

    The likeness divides the cosine by what a text of that language with as many trigrams is expected
    to reach: of T trigrams drawn from a language in which two are equal with probability q, the bundle
    has the cosine sqrt(T q / (1 + T q)) with the prototype.
    """
    langs = sorted(prototypes)
    counted = [trigram_counts(t) for t in texts]
    if not langs:
        return [(UNKNOWN, 0.0, 0.0)] * len(counted)
    matrix = np.stack([prototypes[x] for x in langs])
    norms = np.maximum(np.linalg.norm(matrix, axis=1), 1e-12)
    equal = norms**2 / DIMENSIONS
    sums = bundles(counted)
    cosines = sums @ matrix.T / norms / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    out = []
    for (ids, counts), row in zip(counted, cosines):
        if not len(ids):
            out.append((UNKNOWN, 0.0, 0.0))
            continue
        best = int(np.argmax(row))
        score = float(min(1.0, max(0.0, row[best])))
        spread = float(counts.sum()) ** 2 / float((counts.astype(float) ** 2).sum()) * equal[best]
        out.append((langs[best], score, score / float(np.sqrt(spread / (1 + spread)))))
    return out


def verdict(text: Column, prototypes: dict[str, np.ndarray]) -> Column:
    """``lang_pred, score, likeness`` of a text column."""

    @F.pandas_udf("lang_pred string, score double, likeness double")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(classify(texts.tolist(), prototypes), columns=["lang_pred", "score", "likeness"])

    return run(text.cast("string"))


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``likeness`` appended (columns of these names are replaced).

    Only the text is an input, and all of it, however long.  Null, empty and letter-less texts give
    ``und`` with score 0, as does every text when nothing was learned.  Equal texts get equal results;
    ties of the cosine go to the language that sorts first.  An empty table gives an empty result.
    """
    scratch.prepare(docs.sparkSession)
    own = ("lang_pred", "score", "likeness")
    name = next(n for k in range(len(docs.columns) + 1) if (n := f"_verdict_{k}") not in docs.columns)
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in own]
    return docs.select(*others, verdict(docs[text_col], prototypes).alias(name)).select(*others, *[F.col(f"{name}.{c}") for c in own])
