"""A quality classifier: support vectors on n-gram indicators scaled by naive Bayes.

A text is the set of its n-grams: characters (single ones, and 2 or 3 of their classes), word shapes (1 to 3
words) and the pattern in which neighbouring words repeat, hashed into :data:`BUCKETS`.  Each indicator is scaled by the log ratio of its smoothed frequencies in the two classes, a
text's vector is brought to length 1, and a linear hinge-loss model is fitted by dual coordinate descent.  Its margins on
rows it has not seen are turned into a score by a logistic curve.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import scratch

BUCKETS = 1 << 18
#: Labelled rows, expected number, of which a model is fitted; all of them where there are fewer.
TRAINING_ROWS = 12_000
#: Share of these that is kept for the logistic curve.
HELD_BACK = 0.25
#: A long text is taken in stretches, cut within their last characters.
_STRETCH, _TAIL = 1 << 20, 1 << 12
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each code point: 1 upper case, 2 other letter, 3 digit, 4 white space, else a number of its own from 8."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for point in range(0x110000):
        c = chr(point)
        out[point] = 1 if c.isupper() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c.isspace() else point + 8
    return out


def _hashed(kind: int, *parts: np.ndarray) -> np.ndarray:
    """Buckets of tuples of numbers."""
    h = np.full(len(parts[0]), kind + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ p.astype(np.uint64)) * _MIX
            h ^= h >> np.uint64(29)
    return (h >> np.uint64(46)).astype(np.int32)


def _runs(kinds: np.ndarray) -> np.ndarray:
    """``kinds`` with each run of equal members shortened to two."""
    if len(kinds) < 3:
        return kinds
    return kinds[np.concatenate([[True, True], (kinds[2:] != kinds[1:-1]) | (kinds[1:-1] != kinds[:-2])])]


def _starts(gap: np.ndarray) -> np.ndarray:
    """Places, among those that are no gap, where words begin."""
    words = np.cumsum(gap)[~gap]
    return np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))


def _summed(members: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each stretch of ``members`` that begins at ``first``, order included."""
    place = np.arange(len(members)) - np.repeat(first, np.diff([*first, len(members)]))
    with np.errstate(over="ignore"):
        mixed = (members.astype(np.uint64) + np.uint64(1)) * (np.uint64(2) * place.astype(np.uint64) + np.uint64(1)) * _MIX
        mixed ^= mixed >> np.uint64(31)
        return np.add.reduceat(mixed * _MIX, first)


def _part(points: np.ndarray) -> list[np.ndarray]:
    kinds = _classes()[points]
    out = [_hashed(0, points)]
    out += [_hashed(n, *[kinds[k : len(kinds) - n + 1 + k] for k in range(n)]) for n in (2, 3) if len(kinds) >= n]
    # A word's shape is a hash of its runs of classes; white space ends words.
    short = _runs(kinds)
    gap = short == 4
    if not gap.all():
        shapes = _summed(short[~gap], _starts(gap))
        out += [_hashed(3 + n, *[shapes[k : len(shapes) - n + 1 + k] for k in range(n)]) for n in (1, 2, 3) if len(shapes) >= n]
        # Which of the words before it a word repeats.
        words = _summed(points[kinds != 4], _starts(kinds == 4))
        same = sum((np.concatenate([np.zeros(min(k, len(words)), bool), words[k:] == words[:-k]]).astype(np.uint64) << np.uint64(k) for k in (1, 2, 3, 4)), np.zeros(len(words), np.uint64))
        out += [_hashed(6 + n, *[same[k : len(same) - n + 1 + k] for k in range(n)]) for n in (1, 3) if len(same) >= n]
    return out


def _stretches(text: str) -> Iterator[str]:
    """Pieces of a long text that end before a word, each beginning three words before the end of the one before."""
    k = 0
    while len(text) - k > _STRETCH:
        end = k + _STRETCH
        tail = [m.start() for m in re.finditer(r"\S+", text[end - _TAIL : end])]
        if len(tail) > 4:
            yield text[k : end - _TAIL + tail[-1]]
            k = end - _TAIL + tail[-4]
        else:  # words longer than a thousand characters are cut
            yield text[k:end]
            k = end - 2
    yield text[k:]


def indicators(text: str | None) -> np.ndarray:
    """The distinct buckets of the n-grams of the whole text, ascending."""
    found = np.empty(0, dtype=np.int32)
    for piece in _stretches(text) if text else ():
        points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        found = np.unique(np.concatenate([found, *_part(points)]))
    return found


@dataclass(frozen=True)
class Model:
    """``score = 1 / (1 + exp(-(slope * margin + offset)))``; the margin is weights . x, x the scaled indicators at length 1."""

    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, ids: np.ndarray) -> float:
        r = self.ratios[ids]
        length = float(np.sqrt((r * r).sum()))
        return self.bias + (float(r @ self.weights[ids]) / length if length > 0 else 0.0)

    def score(self, text: str | None) -> float:
        z = self.slope * self.margin(indicators(text)) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def log_ratios(rows: list[np.ndarray], labels: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """log of each indicator's share among the label-1 rows over that among the others, counts smoothed."""
    counts = [np.full(BUCKETS, smoothing) for _ in range(2)]
    for ids, y in zip(rows, labels):
        counts[int(y)][ids] += 1
    return (np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())).astype(np.float32)


def descend(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, cost: np.ndarray, bias_feature: float = 1.0, tolerance: float = 0.02, most: int = 200, seed: int = 5) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss: rows of (ids, values), labels of +1 and -1, and the cost of each row.

    Ends when the projected gradients of a whole pass lie within ``tolerance`` of each other.
    """
    w, b = np.zeros(BUCKETS), 0.0
    alpha = np.zeros(len(rows))
    norms = np.array([float((v * v).sum()) for _, v in rows]) + bias_feature**2
    rng = np.random.default_rng(seed)
    for _ in range(most):
        high, low = -np.inf, np.inf
        for i in rng.permutation(len(rows)):
            ids, v = rows[i]
            g = labels[i] * (float(w[ids] @ v) + b * bias_feature) - 1
            projected = min(g, 0.0) if alpha[i] <= 0 else max(g, 0.0) if alpha[i] >= cost[i] else g
            high, low = max(high, projected), min(low, projected)
            if abs(projected) > 1e-12:
                new = min(max(alpha[i] - g / norms[i], 0.0), cost[i])
                step = (new - alpha[i]) * labels[i]
                w[ids] += step * v
                b += step * bias_feature
                alpha[i] = new
        if high - low < tolerance:
            break
    return w, b * bias_feature


def _logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the most likely logistic curve, by Newton's steps; targets are smoothed, so it stays finite."""
    n1, n0 = float(labels.sum()), float(len(labels) - labels.sum())
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, offset = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -40, 40)))
        g = np.array([((p - target) * margins).sum(), (p - target).sum()])
        h = p * (1 - p)
        hess = np.array([[(h * margins**2).sum(), (h * margins).sum()], [(h * margins).sum(), h.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, g)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(slope, 0.0), offset


def train(rows: list[np.ndarray], labels: np.ndarray, cost: float = 4.0) -> Model:
    """A model of bucket lists and labels of 0 and 1, in an order that means nothing (the last share is held back).

    Both classes weigh the same.  With rows of one class or none the score is the smoothed share of label 1.
    """
    n, n1 = len(rows), int(labels.sum())
    if n1 == 0 or n1 == n:
        return Model(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), 0.0, 0.0, float(np.log((n1 + 1) / (n - n1 + 1))))

    def fit(some: range) -> tuple[np.ndarray, np.ndarray, float]:
        own, y = [rows[k] for k in some], labels[some.start : some.stop]
        ratios = log_ratios(own, y)
        scaled = []
        for ids in own:
            r = ratios[ids].astype(np.float64)
            scaled.append((ids, r / max(float(np.sqrt((r * r).sum())), 1e-12)))
        share = np.where(y == 1, 0.5 / max(int(y.sum()), 1), 0.5 / max(len(y) - int(y.sum()), 1)) * len(y)
        w, b = descend(scaled, np.where(y == 1, 1.0, -1.0), cost * share)
        return ratios, w.astype(np.float32), b

    kept = n - int(HELD_BACK * n)
    ratios, w, b = fit(range(kept))
    apart = Model(ratios, w, b, 1.0, 0.0)
    held = range(kept, n) if 0 < int(labels[kept:].sum()) < n - kept else range(n)  # few rows: the curve sees what the model saw
    slope, offset = _logistic(np.array([apart.margin(rows[k]) for k in held]), labels[held.start : held.stop])
    return Model(ratios, w, b, slope, offset)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", training: Column | None = None, most: int = TRAINING_ROWS) -> Model:
    """A model of the labelled rows that ``training`` (a condition on the id) lets through, of about ``most`` of them.

    Which rows are taken is a matter of a hash of the id.  Labels other than 0 and 1 and null ids are left out, and of several labels of
    a document the largest holds.  The ids taken go to every task, and the indicators of their texts to the driver: both are bounded by
    ``most``.  Of an id with several texts one is taken, by a hash, so that a frequent id adds no more than another.
    """
    spark = docs.sparkSession
    scratch.prepare(spark)
    known = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("y")).where("id is not null and y in (0, 1)")
    if training is not None:
        known = known.withColumnRenamed("id", id_col).where(training).withColumnRenamed(id_col, "id")
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    total = known.count()
    taken = known if total <= most else known.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < int(most / total * (1 << 30)))

    @F.pandas_udf("array<int>")
    def buckets(texts: pd.Series) -> pd.Series:
        return pd.Series([indicators(t) for t in texts])

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).join(F.broadcast(taken), "id")  # about ``most`` short rows
    once = rows.groupBy("id").agg(F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text"), F.first("y").alias("y"))
    table = once.select("id", "y", buckets("text").alias("ids")).toArrow()
    ids = table.column("ids").combine_chunks()
    offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
    # An order that does not depend on how rows arrived, nor on the ids' meaning.
    order = np.argsort(table.column("id").to_numpy() * int(_MIX >> np.uint64(1)) % (1 << 61), kind="stable")
    return train([flat[offsets[k] : offsets[k + 1]] for k in order], table.column("y").to_numpy()[order])


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` appended (columns of these names are replaced).

    Only the text is an input, and all of it.  Null and empty texts have no indicators and get the score of the bias alone.  Equal texts get equal
    scores; rows that repeat are scored each.  An empty table gives an empty result.
    """
    scratch.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for texts in batches:
            yield pd.Series([own.score(t) for t in texts], dtype="float64")

    name = next(n for k in range(len(docs.columns) + 1) if (n := f"_score_{k}") not in docs.columns)
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("score", "predicted")]
    scored = docs.select(*others, run(docs[text_col].cast("string")).alias(name))
    return scored.select(*others, F.col(name).alias("score"), (F.col(name) >= threshold).cast("int").alias("predicted"))
