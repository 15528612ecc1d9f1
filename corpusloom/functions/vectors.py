"""Vectors as arrays of doubles: activations, norms, losses, optimiser steps; all inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import let

def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def variance(v: Column) -> Column:
    """Over the population."""
    return let(mean(v), lambda m: total(F.transform(v, lambda x: (x - m) * (x - m)))) / F.size(v)


def argmax(v: Column) -> Column:
    """First place, from 0, of the largest value."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def softmax(v: Column, temperature: float = 1.0) -> Column:
    e = let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp((x - top) / temperature)))
    return let(e, lambda e: let(total(e), lambda z: F.transform(e, lambda x: x / z)))


def logsumexp(v: Column) -> Column:
    return let(F.array_max(v), lambda top: top + F.ln(total(F.transform(v, lambda x: F.exp(x - top)))))


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == label).cast("double"))


_K, _A = math.sqrt(2.0 / math.pi), 0.044715

#: name -> (function, derivative), each of a column.
ACTIVATIONS = {
    "linear": (lambda x: x, lambda x: F.lit(1.0)),
    "sigmoid": (lambda x: 1 / (1 + F.exp(-x)), lambda x: 1 / (1 + F.exp(-x)) * (1 - 1 / (1 + F.exp(-x)))),
    "relu": (lambda x: F.greatest(x, F.lit(0.0)), lambda x: (x > 0).cast("double")),
    "tanh": (F.tanh, lambda x: 1 - F.tanh(x) * F.tanh(x)),
    "gelu": (
        lambda x: 0.5 * x * (1 + F.tanh(_K * (x + _A * x * x * x))),
        lambda x: 0.5 * (1 + F.tanh(_K * (x + _A * x * x * x))) + 0.5 * x * (1 - F.tanh(_K * (x + _A * x * x * x)) * F.tanh(_K * (x + _A * x * x * x))) * _K * (1 + 3 * _A * x * x),
    ),
}


def activation(name: str, derivative: bool = False):
    if name not in ACTIVATIONS:
        raise ValueError(f"unknown activation {name!r}; known: {', '.join(ACTIVATIONS)}")
    return ACTIVATIONS[name][derivative]


def layer_norm(v: Column, epsilon: float = 1e-5) -> Column:
    return let(F.struct(mean(v).alias("m"), F.sqrt(variance(v) + epsilon).alias("s")), lambda p: F.transform(v, lambda x: (x - p["m"]) / p["s"]))


def rms_norm(v: Column, epsilon: float = 1e-5) -> Column:
    return let(F.sqrt(dot(v, v) / F.size(v) + epsilon), lambda s: F.transform(v, lambda x: x / s))


def rotate(v: Column, position: Column, width: int, base: float = 10000.0) -> Column:
    """Rotary position embedding over pairs of neighbours; ``width`` is the even length of ``v``."""
    if width % 2:
        raise ValueError("rotary embedding needs an even width")
    angle = lambda i: position / F.pow(F.lit(base), 2 * F.floor(i / 2) / width)
    return F.transform(v, lambda x, i: F.when(i % 2 == 0, x * F.cos(angle(i)) - F.get(v, i + 1) * F.sin(angle(i))).otherwise(x * F.cos(angle(i)) + F.get(v, i - 1) * F.sin(angle(i))))


def squared_error(y: Column, y_hat: Column) -> Column:
    """Mean over the elements; its gradient, 2 (y_hat - y), is taken without the 1 / n."""
    return total(F.zip_with(y, y_hat, lambda a, b: (a - b) * (a - b))) / F.size(y)


def squared_error_gradient(y: Column, y_hat: Column) -> Column:
    return F.zip_with(y, y_hat, lambda a, b: 2 * (b - a))


def cross_entropy(y: Column, p: Column) -> Column:
    """Of one row, with probabilities kept within 1e-12 of 0 and 1."""
    return -total(F.zip_with(y, p, lambda a, b: a * F.ln(F.least(F.greatest(b, F.lit(1e-12)), F.lit(1 - 1e-12)))))


def sparse_cross_entropy(label: Column, logits: Column) -> Column:
    return logsumexp(logits) - F.get(logits, label)


def softmax_gradient(y: Column, p: Column, rows: Column | float = 1.0) -> Column:
    return F.zip_with(y, p, lambda a, b: (b - a) / rows)


def clip_by_norm(g: Column, most: float, epsilon: float = 1e-6) -> Column:
    return let(F.least(F.lit(1.0), most / (norm(g) + epsilon)), lambda scale: F.transform(g, lambda x: x * scale))


def sgd(params: Column, grads: Column, rate: float = 0.01) -> Column:
    return F.zip_with(params, grads, lambda p, g: p - rate * g)


def adam_moments(m: Column, v: Column, grads: Column, beta1: float = 0.9, beta2: float = 0.999) -> tuple[Column, Column]:
    return F.zip_with(m, grads, lambda a, g: beta1 * a + (1 - beta1) * g), F.zip_with(v, grads, lambda a, g: beta2 * a + (1 - beta2) * g * g)


def adam(params: Column, m: Column, v: Column, step: int, rate: float = 1e-3, beta1: float = 0.9, beta2: float = 0.999, epsilon: float = 1e-8, decay: float = 0.0) -> Column:
    """Adam from updated moments; with ``decay`` AdamW (leave it at 0 for biases, norms and embeddings)."""
    update = F.zip_with(m, v, lambda a, b: (a / (1 - beta1**step)) / (F.sqrt(b / (1 - beta2**step)) + epsilon))
    return F.zip_with(params, update, lambda p, u: p * (1 - rate * decay) - rate * u)


def windows(v: Column, width: int, stride: int = 1) -> Column:
    """All stretches of ``width`` values, ``stride`` apart."""
    return F.transform(F.sequence(F.lit(1), F.size(v) - width + 1, F.lit(stride)), lambda i: F.slice(v, i, width))


def max_pool(v: Column, width: int) -> Column:
    return F.transform(windows(v, width, width), F.array_max)


def causal_row(i: Column, size: int) -> Column:
    """Row ``i`` of the lower-triangular mask."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: (j <= i).cast("int"))


def rate_absolute(step: Column, total_steps: int, peak: float, warmup: int = 1000, floor: float = 0.05) -> Column:
    """Linear warm-up, then cosine decay to ``floor`` times the peak; steps beyond the end stay at the last."""
    s = F.least(step, F.lit(total_steps - 1))
    low = peak * floor
    decay = low + (peak - low) * 0.5 * (1 + F.cos(math.pi * (s - warmup) / max(1, total_steps - warmup)))
    return F.when(s < warmup, peak * (s + 1) / warmup).otherwise(decay)


def rate_multiplier(step: Column, total_steps: int, warmup: int, floor: float = 0.05) -> Column:
    """The same as a factor that starts at 0 and is not held at the end."""
    return F.when(step < warmup, step / warmup).otherwise(floor + (1 - floor) * 0.5 * (1 + F.cos(math.pi * (step - warmup) / (total_steps - warmup))))


def to_pixels(v: Column) -> Column:
    """Values of [0, 1] as 0 to 255."""
    return F.transform(v, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), x * 255)).cast("int"))
