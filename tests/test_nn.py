"""Gradients against finite differences, optimisers, training over DataFrames, generation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.nn import layers as L
from corpusloom.nn.model import LOSSES, Model, Optimizer, generate

RNG = np.random.default_rng(0)


def _tied():
    table = L.TokenEmbedding(7, 8)
    return [table, L.PositionalEmbedding(8), *L.transformer_block(2, 10), L.RMSNorm(), L.TiedDense(table)]


CASES = {
    "dense": ((5,), [L.Dense(4, "tanh"), L.Dense(3, "softmax")], None),
    "sigmoid": ((5,), [L.Dense(4, "sigmoid"), L.Dense(3)], None),
    "time": ((3, 5), [L.TimeDistributedDense(4, "gelu")], None),
    "convolution": ((2, 7, 6), [L.Convolution(3, 3, stride=2, padding=1, act="tanh"), L.Flatten(), L.Dense(2)], None),
    "pooling": ((2, 6, 6), [L.Convolution(2, 3), L.MaxPooling(2), L.GlobalAveragePooling()], None),
    "reshape": ((6,), [L.Reshape((2, 3)), L.LayerNorm(), L.Flatten()], None),
    "rms": ((4, 6), [L.RMSNorm()], None),
    "attention": ((4, 6), [L.MultiHeadAttention(2, causal=True)], None),
    "rotary": ((4, 8), [L.MultiHeadAttention(2, causal=False, rotary=True)], None),
    "residual": ((4, 6), [L.Residual(L.LayerNorm(), L.MultilayerPerceptron(8))], None),
    "old block": ((4, 6), L.transformer_block(2, 8, modern=False), None),
    "tied": ((5,), _tied(), 7),
}


@pytest.mark.parametrize("name", CASES)
def test_gradients(name):
    shape, chain, words = CASES[name]
    model = Model(shape, *chain, seed=3)
    x = RNG.integers(0, words, (3, *shape)) if words else RNG.normal(size=(3, *shape))
    out = model.predict(x)
    if words:
        model.loss, y = "sparse_softmax_crossentropy", RNG.integers(0, out.shape[-1], out.shape[:-1])
        scale = 1.0
    else:
        model.loss, y = "mse", RNG.normal(size=out.shape)
        scale = out.shape[-1]  # the gradient is that of the sum
    grads = model.gradient(x, y, train=False)[0]
    loss = lambda: LOSSES[model.loss](y, model.predict(x))[0] * scale
    for path, (layer, n) in model.chain.parameters().items():
        p = layer.params[n]
        for at in {tuple(RNG.integers(0, s) for s in p.shape) for _ in range(4)}:
            old, e = p[at], 1e-5
            p[at] = old + e
            up = loss()
            p[at] = old - e
            down = loss()
            p[at] = old
            assert grads[path][at] == pytest.approx((up - down) / (2 * e), rel=1e-4, abs=1e-6), path


def test_input_gradient_of_pooling_ties():
    layer = L.MaxPooling(2)
    layer.forward(np.ones((1, 1, 2, 2)))
    assert layer.backward(np.full((1, 1, 1, 1), 3.0)).tolist() == [[[[3, 3], [3, 3]]]]


def test_dropout_scales():
    layer = L.Dropout(0.25, seed=1)
    y = layer.forward(np.ones((200, 200)), train=True)
    assert set(np.round(np.unique(y), 6)) == {0.0, 1.333333} and abs(y.mean() - 1) < 0.02
    assert (layer.backward(np.ones_like(y)) == y).all() and (layer.forward(y) == y).all()


def test_softmax_jacobian():
    x = RNG.normal(size=(2, 3, 4))
    s = L.softmax(x)
    assert np.allclose(L.softmax_jacobian(x)[1, 2], np.diag(s[1, 2]) - np.outer(s[1, 2], s[1, 2]))


def test_unknown_names():
    for make in (lambda: L.Dense(2, "nope"), lambda: Optimizer("nope"), lambda: Model((2,), L.Dense(2)).compile("nope", Optimizer())):
        with pytest.raises(ValueError):
            make()


def test_optimisers():
    p, g = {"a.weights": np.array([1.0, 2.0]), "a.biases": np.array([1.0])}, {"a.weights": np.array([3.0, 4.0]), "a.biases": np.array([0.0])}
    assert Optimizer("sgd", 0.1).step(p, g)["a.weights"].tolist() == [0.7, 1.6]
    assert np.allclose(Optimizer("sgd", 1.0, clip=1.0).step(p, g)["a.weights"], [0.4, 1.2], atol=1e-5)
    assert np.allclose(Optimizer("adam", 0.1).step(p, g)["a.weights"], [0.9, 1.9])
    decayed = Optimizer("adamw", 0.1, decay=0.5).step(p, g)
    assert np.allclose(decayed["a.weights"], [0.95 - 0.1, 1.9 - 0.1]) and decayed["a.biases"].tolist() == [1.0]


def test_counts():
    assert Model((3, 32, 32), L.Convolution(32, 3), L.MaxPooling(), L.Flatten(), L.Dense(10)).count() == (27 + 1) * 32 + (32 * 225 + 1) * 10


def test_training_over_dataframes_equals_training_on_arrays(spark):
    x, y = RNG.normal(size=(60, 4)), RNG.integers(0, 3, 60)
    df = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)], "x array<double>, y int").repartition(5)
    make = lambda: Model((4,), L.Dense(8, "relu"), L.Dense(3), seed=1).compile("sparse_softmax_crossentropy", Optimizer("adam", 0.05))
    far, near = make(), make()
    for _ in range(3):
        loss, accuracy = far.step(df, "x", "y")
        grads, total, right, n = near.gradient(x, y)
        near.set(near.optimizer.step(near.get(), {k: g / n for k, g in grads.items()}))
        assert loss == pytest.approx(total / n) and accuracy == pytest.approx(right / n)
    for a, b in zip(far.get().values(), near.get().values()):
        assert np.allclose(a, b)
    test = far.test(df, "x", "y").first()
    assert (test.n, test.correct) == (60, int((near.predict(x).argmax(axis=1) == y).sum()))


def test_save_and_load(spark, tmp_path):
    a, b = (Model((4,), L.Dense(3, "relu"), L.Dense(2), seed=s) for s in (1, 2))
    a.save(spark, f"{tmp_path}/m")
    b.load(spark, f"{tmp_path}/m")
    x = RNG.normal(size=(2, 4))
    assert (a.predict(x) == b.predict(x)).all()


def test_generation():
    table = L.TokenEmbedding(9, 8)
    model = Model((4,), table, L.PositionalEmbedding(6), *L.transformer_block(2, 8), L.TiedDense(table), seed=5)
    events = list(generate(model, [1, 2, 3], 10, 4, set(), lambda ids: "".join(map(str, ids)), temperature=0.7, seed=1))
    assert [e["type"] for e in events] == ["token"] * 10 + ["end"] and len(events[-1]["new_ids"]) == 4
    assert "".join(e["text"] for e in events[:-1]) == "".join(map(str, events[-1]["generated_ids"]))
    assert list(generate(model, [1], 10, 4, set(range(9)), str))[0]["generated_ids"] == []


def test_training_goes_over_the_whole_epoch(spark, tmp_path):
    from corpusloom.plans import numeric_queries

    rng = np.random.default_rng(2)
    rows = [(k, int(k % 10), rng.normal(size=64).tolist()) for k in range(1100)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = numeric_queries.train_steps(spark, str(tmp_path)).collect()
    assert [r.step for r in got] == [0, 1, 2, 3, 4]  # 4 batches of 256 and one of 76


@pytest.mark.parametrize("part_rows", [4096, 100])
def test_dealt_steps_are_those_of_whole_batches(spark, part_rows, monkeypatch):
    """Each step reads the partitions of its batch alone and gives what a job over the whole table gives."""
    from corpusloom.nn import model as M

    monkeypatch.setattr(M, "PART_ROWS", part_rows)
    monkeypatch.setattr(M, "PARTS", 2)
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(k, k * 7 % 1100 // 256, int(k % 10), rng.normal(size=8).tolist()) for k in range(1100)], "id long, batch long, label int, v array<double>").repartition(3).cache()
    made = lambda: Model((8,), L.Dense(10, "linear"), seed=1).compile("sparse_softmax_crossentropy", Optimizer("adam", 0.01))
    asked, run = [], type(spark.sparkContext).runJob
    monkeypatch.setattr(type(spark.sparkContext), "runJob", lambda self, rdd, f, partitions=None, allowLocal=False: asked.append((list(partitions), rdd.getNumPartitions())) or run(self, rdd, f, partitions))
    got = made().fit_dealt(rows, "batch", 256, "id", "v", "label")
    parts = -(-256 // part_rows)
    assert [len(p) for p, _ in asked] == [parts] * 5 and all(n > parts for _, n in asked)
    expected = made().fit((rows.where(F.col("batch") == k) for k in range(5)), "v", "label")
    for a, b in zip(got, expected, strict=True):
        assert a.keys() == b.keys() and all(abs(a[c] - b[c]) < 1e-9 for c in a)
