"""Codes by pruned rounds against plain rounds."""

import hashlib
import math
import random

import numpy as np
import pytest

from corpusloom.llm import queries, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, codes int, error string"


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts if kept else 0
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for c in cut:
                members.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            for k, own in members.items():
                books[p][k] = [sum(col) // len(own) for col in zip(*own)]
    out, by_label = [], {}
    for (i, _, y), c in zip(kept, cut):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), y))
        by_label[y] = by_label.get(y, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, code, e, by_label[y], digest) for i, code, e, y in out), key=repr)


def run(spark, rows, tmp_path):
    path = f"{tmp_path}/t{random.random()}"
    spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    got = queries.op12_vector_codes(spark, path)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def awkward(n, width=16, seed=1):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([0.0, 0.25, -0.25, 0.5, rng.gauss(0, 1)]) for _ in range(width)], rng.choice([0, 1, 1, 1, None])) for i in rng.sample(range(10 * n), n)]
    rows += [rows[0]] * 3 + [(n * 20 + k, list(rows[1][1]), 1) for k in range(n)]  # repeated rows, one vector very often
    rows += [(5, None, 1), (6, [None] * width, 1), (7, [float("nan")] + [0.0] * (width - 1), 1), (8, [float("inf")] * width, 0), (9, [-float("inf")] * width, 0)]
    return rows + [(None, [0.125] * width, None), (None, [0.5] * width, 3)]


@pytest.mark.parametrize("n", [60, 5])
def test_rounds(spark, tmp_path, n):
    rows = awkward(n)
    assert run(spark, rows, tmp_path) == brute(rows)


def test_all_vectors_equal_and_none_at_all(spark, tmp_path):
    rows = [(i, [0.5] * 8, i % 2) for i in range(40)]
    assert run(spark, rows, tmp_path) == brute(rows)
    assert run(spark, [], tmp_path) == [] and run(spark, [(1, None, 2)], tmp_path) == []


def test_lengths_that_cannot_be_cut(spark, tmp_path):
    with pytest.raises(ValueError, match="equal parts"):
        run(spark, [(1, [1.0] * 9, 0)], tmp_path)
    with pytest.raises(Exception, match="components of the first"):
        run(spark, [(1, [1.0] * 8, 0), (2, [1.0] * 16, 0)], tmp_path)


def test_bounds_spare_distances_and_never_change_a_code():
    rng = np.random.default_rng(4)
    x = rng.integers(-5, 6, (4000, 6)) * 100 + rng.integers(-2, 3, (4000, 6))
    entries, at = x[:16].copy(), np.zeros(len(x), dtype=np.int64)
    upper, lower = np.full(len(x), np.inf, dtype=np.float32), np.zeros((len(x), 16), dtype=np.float32)
    measured = []
    for _ in range(8):
        measured.append(vector_codes.assign(x, entries, at, upper, lower))
        squared = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (at == squared.argmin(axis=1)).all()
        assert (upper.astype(float) ** 2 >= squared[np.arange(len(x)), at] * (1 - 1e-12)).all() and (lower.astype(float) ** 2 <= squared * (1 + 1e-12)).all()
        sums, counts = np.zeros((16, 6), dtype=np.int64), np.bincount(at, minlength=16)
        np.add.at(sums, at, x)
        after = vector_codes.next_entries(entries, sums, counts)
        moved = vector_codes._root(vector_codes._apart(entries, after), up=True)
        upper, lower = vector_codes.shift(moved, at, upper, lower)
        entries = after
    assert measured[-1] < measured[0] / 3
