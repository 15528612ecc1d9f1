"""The quality classifier on rows it has not seen, and its parts against plain forms."""

import random
import zlib

import numpy as np
import pytest

from corpusloom.llm import quality, queries
from tests.llm.cases import documents, frame


def test_held_out_rows(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op11_quality(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    known = [(r.score, labels[r.doc_id]) for r in held if r.doc_id in labels]
    pairs = [(a > b) + 0.5 * (a == b) for a, y in known if y == 1 for b, z in known if z == 0]
    assert sum(pairs) / len(pairs) > 0.97
    good = [s for s, y in known if y == 1]
    assert sum(s >= 0.7 for s in good) / len(good) > 0.97


def test_awkward_documents(spark, tmp_path):
    frame(spark, documents()).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 0, 0), (4, 0, None), (None, 1, 1), (5, None, 0), (7, 0, 0), (20, 1, 0), (14, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op11_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(documents()) and all(0 <= r.score <= 1 for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add(r.score)
    assert by_id[5] == by_id[6] and by_id[1] == by_id[2] == by_id[14]  # null and empty, and equal texts


@pytest.mark.parametrize("labels, score", [([], 0.5), ([(1, 1), (2, 1)], None), ([(1, 0)], None)])
def test_nothing_or_one_class_to_learn_from(spark, labels, score):
    docs = frame(spark, documents(), clash=False)
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    scores = {r.score for r in quality.score(docs, model).collect()}
    assert len(scores) == 1 and (score is None or scores == {score})
    assert quality.score(docs.limit(0), model).count() == 0


def test_a_bounded_number_of_rows_is_taken(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "case when id % 4 = 0 then '### ### @@@ junk' else concat('words of prose ', id) end as text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 4 <> 0 as int) as quality")
    model = quality.fit(docs, labels, most=400)
    assert model.score("### @@@ junk") < 0.3 and model.score("some words of prose 5") > 0.7


def test_long_texts_are_read_whole(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice(["alpha", "BETA", "x1", "gamma!", "|", "gamma!"]) for _ in range(4000))
    whole = quality.indicators(text)
    monkeypatch.setattr(quality, "_STRETCH", 5000)
    monkeypatch.setattr(quality, "_TAIL", 500)
    assert set(whole) - set(quality.indicators(text)) == set()
    assert set(quality.indicators("y" * 30_000 + " #@#")) >= set(quality.indicators("#@#"))


def test_descent_reaches_the_least_hinge_loss():
    rng = np.random.default_rng(2)
    y = rng.choice([-1.0, 1.0], 120)
    dense = rng.normal(size=(120, 6)) + y[:, None] * 0.4
    rows = [(np.arange(6), v) for v in dense]
    w, b = quality.descend(rows, y, np.full(120, 0.5), tolerance=1e-6, most=5000)
    loss = lambda w, b: 0.5 * (w @ w + b * b) + 0.5 * np.maximum(0, 1 - y * (dense @ w + b)).sum()
    least = loss(w[:6], b)
    assert all(least <= loss(w[:6] + d[:6], b + d[6]) + 1e-6 for d in rng.normal(size=(300, 7)) * rng.choice([0.3, 0.03, 0.003], (300, 1)))


def test_ratios():
    rows, labels = [np.array([1, 2]), np.array([2]), np.array([2, 3])], np.array([1, 1, 0])
    r = quality.log_ratios(rows, labels)
    n = quality.BUCKETS
    assert r[1] == pytest.approx(np.log(2 / (n + 3)) - np.log(1 / (n + 2)), abs=1e-6) and r[3] < r[2] < r[1]
