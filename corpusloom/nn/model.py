"""A model: a chain of layers with a loss and an optimiser, trained and applied over DataFrames.

Each step is one job: the parameters go out with the task, every partition returns one summed
gradient, and these are added in a tree, so what reaches the driver is one gradient.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.nn.layers import Chain, Layer, TiedDense, softmax
from corpusloom.session import ship

#: Rows of one part of a batch, and parts of a partition of :meth:`Model.fit_dealt`.
PART_ROWS, PARTS = 4096, 16

_NO_DECAY = ("biases", "b_out", "scale", "shift", "table")


def _rows_of(y: np.ndarray) -> int:
    return int(np.prod(y.shape[:-1]))


def _one_hot(y: np.ndarray, classes: int) -> np.ndarray:
    return np.eye(classes)[y.astype(np.int64)]


def _sparse(y, out):
    p = softmax(out)
    picked = np.take_along_axis(p, y[..., None].astype(np.int64), axis=-1)[..., 0]
    return float(-np.log(np.maximum(picked, 1e-300)).sum()), p - _one_hot(y, out.shape[-1])


def _clipped(y, out):
    t, p = _one_hot(y, out.shape[-1]), np.clip(out, 1e-12, 1 - 1e-12)
    return float(-(t * np.log(p)).sum()), -t / p


#: name -> function of labels and outputs, giving the summed loss and its gradient before division by the rows.
LOSSES: dict[str, Callable] = {
    "mse": lambda y, out: (float(((y - out) ** 2).sum() / out.shape[-1]), 2 * (out - y)),
    "categorical_crossentropy": _clipped,
    "softmax_crossentropy": lambda y, out: (_clipped(y, out)[0], out - _one_hot(y, out.shape[-1])),
    "sparse_softmax_crossentropy": _sparse,
}


class Optimizer:
    """Gradient descent; with moments Adam, with decay AdamW.  Gradients can be clipped by their common norm."""

    def __init__(self, kind: str = "adam", rate: float = 1e-3, beta1: float = 0.9, beta2: float = 0.999, epsilon: float = 1e-8, decay: float = 0.01, clip: float | None = None):
        if kind not in ("sgd", "adam", "adamw"):
            raise ValueError(f"unknown optimizer {kind!r}; known: sgd, adam, adamw")
        self.kind, self.rate, self.beta1, self.beta2, self.epsilon, self.decay, self.clip = kind, rate, beta1, beta2, epsilon, decay, clip
        self.m: dict[str, np.ndarray] = {}
        self.v: dict[str, np.ndarray] = {}
        self.t = 0

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        if self.clip is not None:
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            grads = {n: g * min(1.0, self.clip / (size + 1e-6)) for n, g in grads.items()}
        self.t += 1
        out = {}
        for n, p in params.items():
            g = grads[n]
            if self.kind == "sgd":
                out[n] = p - self.rate * g
                continue
            self.m[n] = self.beta1 * self.m.get(n, 0) + (1 - self.beta1) * g
            self.v[n] = self.beta2 * self.v.get(n, 0) + (1 - self.beta2) * g * g
            update = self.m[n] / (1 - self.beta1**self.t) / (np.sqrt(self.v[n] / (1 - self.beta2**self.t)) + self.epsilon)
            decay = self.decay if self.kind == "adamw" and n.rsplit(".", 1)[-1] not in _NO_DECAY else 0.0
            out[n] = p * (1 - self.rate * decay) - self.rate * update
        return out


class Model:
    def __init__(self, shape: tuple[int, ...], *layers: Layer, seed: int = 0):
        self.shape, self.chain = tuple(shape), Chain(*layers)
        self.output_shape = self.chain.build(self.shape, np.random.default_rng(seed))
        self.loss: str | None = None
        self.optimizer: Optimizer | None = None

    def compile(self, loss: str, optimizer: Optimizer) -> Model:
        if loss not in LOSSES:
            raise ValueError(f"unknown loss {loss!r}; known: {', '.join(LOSSES)}")
        self.loss, self.optimizer = loss, optimizer
        return self

    def count(self) -> int:
        return self.chain.count()

    def get(self) -> dict[str, np.ndarray]:
        return {path: layer.params[n] for path, (layer, n) in self.chain.parameters().items()}

    def set(self, values: dict[str, np.ndarray]) -> None:
        for path, (layer, n) in self.chain.parameters().items():
            layer.params[n] = values[path]

    def gradient(self, x: np.ndarray, y: np.ndarray, train: bool = True) -> tuple[dict[str, np.ndarray], float, int, int]:
        """Gradients summed over the rows, summed loss, correct rows, rows."""
        out = self.chain.forward(x, train)
        loss, dy = LOSSES[self.loss](y, out)
        self.chain.backward(dy)
        grads = {path: layer.grads[n] for path, (layer, n) in self.chain.parameters().items()}
        for layer in self.chain.layers:
            if isinstance(layer, TiedDense):
                table, share = layer.tied_grad()
                path = next(p for p, (owner, _) in self.chain.parameters().items() if owner is table)
                grads[path] = grads[path] + share
        right = int((out.argmax(axis=-1) == y).sum()) if self.loss != "mse" else 0
        return grads, loss, right, _rows_of(out)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.chain.forward(x)

    # --- over DataFrames ---------------------------------------------------------------------

    def _arrays(self, batch: pd.DataFrame, x: str) -> np.ndarray:
        return np.stack(batch[x].to_list()).astype(float).reshape(len(batch), *self.shape)

    def step(self, rows: DataFrame, x: str, y: str) -> tuple[float, float]:
        """One optimiser step on all of ``rows``; returns their mean loss and accuracy before it."""
        if self.loss is None:
            raise RuntimeError("compile the model first")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for batch in batches:
                if len(batch):
                    grads, loss, right, n = self.gradient(self._arrays(batch, x), np.array(batch[y].to_list()))
                    flat = np.concatenate([[loss, right, n], *(g.ravel() for g in grads.values())])
                    total = flat if total is None else total + flat
            if total is not None:
                yield pd.DataFrame({"sums": [total.tolist()]})

        parts = rows.select(x, y).mapInPandas(run, "sums array<double>").rdd.map(lambda r: np.array(r.sums))
        add = lambda a, b: b if a is None else a if b is None else a + b
        return self._moved(parts.treeAggregate(None, add, add))

    def _moved(self, total: np.ndarray | None) -> tuple[float, float]:
        """Steps by the summed gradients behind loss, correct rows and rows; returns mean loss and accuracy."""
        if total is None:
            return 0.0, 0.0
        loss, right, n = total[:3]
        at, grads, params = 3, {}, self.get()
        for path, p in params.items():
            grads[path] = total[at : at + p.size].reshape(p.shape) / n
            at += p.size
        self.set(self.optimizer.step(params, grads))
        return float(loss / n), float(right / n)

    def fit_dealt(self, rows: DataFrame, batch: str, size: int, order: str, x: str, y: str, beta: float = 0.99) -> list[dict]:
        """A step for each batch of ``rows``, numbered from 0 in ``batch`` and of ``size`` rows at most; the metrics of :meth:`fit`.

        Rows are dealt once, so that a step's job runs on the partitions of its batch alone: parts of at most :data:`PART_ROWS` rows in the order of ``order``, of small batches
        :data:`PARTS` to a partition, of large ones dealt over partitions.  What all steps read is thus the rows, a bounded number of times.
        """
        if self.loss is None:
            raise RuntimeError("compile the model first")
        ship(rows.sparkSession)
        last = rows.agg(F.max(batch)).first()[0]
        if last is None:
            return []
        parts = -(-size // PART_ROWS)
        held = max(1, PARTS // parts)  # batches of one group of partitions
        part = F.pmod(F.xxhash64(order), F.lit(parts)).cast("int")
        dealt = rows.select((F.floor(F.col(batch) / held) * parts + part).cast("int").alias("place"), F.col(batch).cast("long").alias("batch"), order, x, y)
        dealt = dealt.repartitionById((last // held + 1) * parts, F.col("place")).sortWithinPartitions("batch", order)

        def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def record(at: int, own: list[pd.DataFrame]) -> pd.DataFrame:
                whole = pd.concat(own)
                labels = np.array(whole[y].to_list(), dtype=float)
                return pd.DataFrame({"batch": [at], "x": [np.stack(whole[x].to_list()).astype(float).tobytes()], "y": [labels.tobytes()], "n": [len(whole)], "single": [labels.ndim == 1]})

            at, own = None, []
            for some in batches:
                for k, group in some.groupby("batch"):
                    if at is not None and k != at:
                        yield record(at, own)
                        own = []
                    at, own = k, [*own, group]
            if own:
                yield record(at, own)

        records = dealt.mapInPandas(packed, "batch long, x binary, y binary, n long, single boolean").rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
        context, metrics, ema = rows.sparkSession.sparkContext, [], None
        try:
            for k in range(last + 1):

                def run(found: Iterator[tuple], k: int = k) -> Iterator[np.ndarray]:
                    for at, xs, ys, n, single in found:
                        if at == k:
                            labels = np.frombuffer(ys)
                            grads, loss, right, count = self.gradient(np.frombuffer(xs).reshape(n, *self.shape), labels if single else labels.reshape(n, -1))
                            yield np.concatenate([[loss, right, count], *(g.ravel() for g in grads.values())])

                group = k // held * parts
                sums = context.runJob(records, run, list(range(group, group + parts)))
                loss, accuracy = self._moved(np.sum(sums, axis=0) if sums else None)
                ema = loss if ema is None else beta * ema + (1 - beta) * loss
                metrics.append({"step": k, "loss": loss, "ema_loss": ema, "accuracy": accuracy, "learning_rate": self.optimizer.rate})
        finally:
            records.unpersist()
        return metrics

    def fit(self, batches: Iterator[DataFrame], x: str, y: str, rate: Callable[[int], float] | None = None, augment: Callable[[DataFrame], DataFrame] | None = None, beta: float = 0.99, ema: float | None = None, on_step: Callable[[dict], None] | None = None) -> list[dict]:
        """A step for each batch, in order; returns ``step, loss, ema_loss, accuracy, learning_rate`` of each."""
        metrics = []
        for k, batch in enumerate(batches):
            if rate is not None:
                self.optimizer.rate = rate(k)
            loss, accuracy = self.step(batch if augment is None else augment(batch), x, y)
            ema = loss if ema is None else beta * ema + (1 - beta) * loss
            metrics.append({"step": k, "loss": loss, "ema_loss": ema, "accuracy": accuracy, "learning_rate": self.optimizer.rate})
            if on_step is not None:
                on_step(metrics[-1])
        return metrics

    def transform(self, rows: DataFrame, x: str, out: str = "prediction") -> DataFrame:
        """``rows`` with the output of the model as an array."""

        @F.pandas_udf("array<double>")
        def run(xs: pd.Series) -> pd.Series:
            y = self.predict(self._arrays(pd.DataFrame({x: xs}), x))
            return pd.Series(list(y.reshape(len(y), -1)))

        return rows.withColumn(out, run(F.col(x)))

    def test(self, rows: DataFrame, x: str, y: str) -> DataFrame:
        """One row: ``n, correct, accuracy``."""
        best = F.array_position("prediction", F.array_max("prediction")) - 1
        return self.transform(rows, x).agg(F.count("*").alias("n"), F.sum((best == F.col(y)).cast("long")).alias("correct")).withColumn("accuracy", F.col("correct") / F.col("n"))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(n, json.dumps(p.shape), p.ravel().tolist()) for n, p in self.get().items()]
        spark.createDataFrame(rows, "name string, shape string, value array<double>").write.mode("overwrite").parquet(path)

    def load(self, spark: SparkSession, path: str) -> None:
        self.set({r.name: np.array(r.value).reshape(json.loads(r.shape)) for r in spark.read.parquet(path).collect()})


def next_token(logits: np.ndarray, temperature: float, rng: np.random.Generator) -> int:
    if temperature <= 0:
        return int(logits.argmax())
    return int(rng.choice(len(logits), p=softmax(logits / temperature)))


def generate(model: Model, prompt: list[int], most: int, context: int, stops: set[int], decode: Callable[[list[int]], str], temperature: float = 1.0, seed: int = 0, trim: bool = True) -> Iterator[dict]:
    """Token events and one end event; the context keeps its last ``context`` ids, a stop id ends it."""
    rng, ids, made, text = np.random.default_rng(seed), list(prompt[-context:]), [], ""
    for _ in range(most):
        token = next_token(model.predict(np.array([ids]))[0, -1], temperature, rng)
        if token in stops:
            break
        ids = [*ids, token][-context:] if trim else [*ids, token]
        made.append(token)
        whole = decode(made)
        yield {"type": "token", "id": token, "text": whole[len(text) :]}
        text = whole
    yield {"type": "end", "generated_ids": made, "new_ids": ids}
