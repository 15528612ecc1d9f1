"""Layers with hand-written gradients.

A layer owns its parameters (``params``) and, after ``backward``, their gradients (``grads``), both
by name.  ``build`` receives the shape of one sample and returns the shape of its output; the first
axis of all arrays is the batch.
"""

from __future__ import annotations

import math

import numpy as np

Shape = tuple[int, ...]


# --- activations -----------------------------------------------------------------------------


def _gelu_parts(x):
    k, a = math.sqrt(2 / math.pi), 0.044715
    return np.tanh(k * (x + a * x**3)), k * (1 + 3 * a * x * x)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def softmax_jacobian(x: np.ndarray) -> np.ndarray:
    """For any number of leading axes (batch, time, heads): diag(s) - s s'."""
    s = softmax(x)
    return s[..., :, None] * np.eye(s.shape[-1]) - s[..., :, None] * s[..., None, :]


def _gelu_slope(x):
    t, inner = _gelu_parts(x)
    return 0.5 * (1 + t) + 0.5 * x * (1 - t * t) * inner


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


#: name -> (function, vector-Jacobian product of input and output gradient)
ACTIVATIONS = {
    "linear": (lambda x: x, lambda x, dy: dy),
    "sigmoid": (_sigmoid, lambda x, dy: dy * _sigmoid(x) * (1 - _sigmoid(x))),
    "relu": (lambda x: np.maximum(x, 0), lambda x, dy: dy * (x > 0)),
    "tanh": (np.tanh, lambda x, dy: dy * (1 - np.tanh(x) ** 2)),
    "gelu": (lambda x: 0.5 * x * (1 + _gelu_parts(x)[0]), lambda x, dy: dy * _gelu_slope(x)),
    "softmax": (softmax, lambda x, dy: (s := softmax(x)) * (dy - (dy * s).sum(axis=-1, keepdims=True))),
}


def activation(name: str):
    if name not in ACTIVATIONS:
        raise ValueError(f"unknown activation {name!r}; known: {', '.join(ACTIVATIONS)}")
    return ACTIVATIONS[name]


# --- layers ----------------------------------------------------------------------------------


class Layer:
    """The interface; on its own it passes its input through."""

    def __init__(self):
        self.params: dict[str, np.ndarray] = {}
        self.grads: dict[str, np.ndarray] = {}

    def build(self, shape: Shape, rng: np.random.Generator) -> Shape:
        return shape

    def forward(self, x: np.ndarray, train: bool = False) -> np.ndarray:
        return x

    def backward(self, dy: np.ndarray) -> np.ndarray:
        return dy

    def children(self) -> list[Layer]:
        return []

    def parameters(self, prefix: str = "") -> dict[str, tuple[Layer, str]]:
        """All parameters by path, those of inner layers too; shared ones once."""
        out = {f"{prefix}{n}": (self, n) for n in self.params}
        for k, child in enumerate(self.children()):
            out |= child.parameters(f"{prefix}{k}.")
        return out

    def count(self) -> int:
        return sum(layer.params[n].size for layer, n in self.parameters().values())


class Flatten(Layer):
    def build(self, shape, rng):
        return (math.prod(shape),)

    def forward(self, x, train=False):
        self._shape = x.shape
        return x.reshape(len(x), -1)

    def backward(self, dy):
        return dy.reshape(self._shape)


class Reshape(Flatten):
    def __init__(self, shape: Shape):
        super().__init__()
        self._to = tuple(shape)

    def build(self, shape, rng):
        if math.prod(shape) != math.prod(self._to):
            raise ValueError(f"{shape} does not fit into {self._to}")
        return self._to

    def forward(self, x, train=False):
        self._shape = x.shape
        return x.reshape(len(x), *self._to)


class Dropout(Layer):
    """Zeroes a share of the values in training and scales the rest up."""

    def __init__(self, share: float, seed: int = 0):
        super().__init__()
        self.share, self._rng, self._mask = share, np.random.default_rng(seed), None

    def forward(self, x, train=False):
        self._mask = (self._rng.random(x.shape) >= self.share) / (1 - self.share) if train and self.share else None
        return x if self._mask is None else x * self._mask

    def backward(self, dy):
        return dy if self._mask is None else dy * self._mask


class Dense(Layer):
    """Affine map of the last axis and an activation; any axes before it (time) are kept."""

    def __init__(self, units: int, act: str = "linear"):
        super().__init__()
        self.units, (self._act, self._pull) = units, activation(act)

    def build(self, shape, rng):
        self.params = {"weights": rng.normal(0, math.sqrt(2 / shape[-1]), (shape[-1], self.units)), "biases": np.zeros(self.units)}
        return (*shape[:-1], self.units)

    def forward(self, x, train=False):
        self._x = x
        self._z = x @ self.params["weights"] + self.params["biases"]
        return self._act(self._z)

    def backward(self, dy):
        dz = self._pull(self._z, dy)
        self.grads = {"weights": np.tensordot(self._x, dz, (range(dz.ndim - 1),) * 2), "biases": dz.sum(axis=tuple(range(dz.ndim - 1)))}
        return dz @ self.params["weights"].T


class TimeDistributedDense(Dense):
    """:class:`Dense` on (time, features)."""


class Convolution(Layer):
    """2-D convolution of (channels, height, width) as one product over unfolded windows."""

    def __init__(self, filters: int, size: int = 3, stride: int = 1, padding: int = 0, act: str = "linear"):
        super().__init__()
        self.filters, self.size, self.stride, self.padding, (self._act, self._pull) = filters, size, stride, padding, activation(act)

    def build(self, shape, rng):
        c, h, w = shape
        out = lambda n: (n + 2 * self.padding - self.size) // self.stride + 1
        if min(out(h), out(w)) < 1:
            raise ValueError(f"a window of {self.size} does not fit into {shape}")
        self.params = {"weights": rng.normal(0, math.sqrt(2 / (c * self.size**2)), (self.filters, c, self.size, self.size)), "biases": np.zeros(self.filters)}
        return (self.filters, out(h), out(w))

    def forward(self, x, train=False):
        p = self.padding
        self._padded = np.pad(x, ((0, 0), (0, 0), (p, p), (p, p)))
        self._windows = np.lib.stride_tricks.sliding_window_view(self._padded, (self.size, self.size), (2, 3))[:, :, :: self.stride, :: self.stride]
        self._z = np.einsum("bchwij,fcij->bfhw", self._windows, self.params["weights"], optimize=True) + self.params["biases"][:, None, None]
        return self._act(self._z)

    def backward(self, dy):
        dz = self._pull(self._z, dy)
        self.grads = {"weights": np.einsum("bchwij,bfhw->fcij", self._windows, dz, optimize=True), "biases": dz.sum(axis=(0, 2, 3))}
        dx, (h, w), s = np.zeros_like(self._padded), dz.shape[2:], self.stride
        for i in range(self.size):
            for j in range(self.size):
                dx[:, :, i : i + s * h : s, j : j + s * w : s] += np.einsum("bfhw,fc->bchw", dz, self.params["weights"][:, :, i, j])
        p = self.padding
        return dx[:, :, p : dx.shape[2] - p, p : dx.shape[3] - p]


class MaxPooling(Layer):
    """Largest value of each window; values that tie each get the whole gradient."""

    def __init__(self, size: int = 2, stride: int | None = None):
        super().__init__()
        self.size, self.stride = size, stride or size

    def build(self, shape, rng):
        return (shape[0], *((n - self.size) // self.stride + 1 for n in shape[1:]))

    def forward(self, x, train=False):
        self._x = x
        windows = np.lib.stride_tricks.sliding_window_view(x, (self.size, self.size), (2, 3))[:, :, :: self.stride, :: self.stride]
        self._top = windows.max(axis=(4, 5))
        return self._top

    def backward(self, dy):
        dx, (h, w), s = np.zeros_like(self._x), dy.shape[2:], self.stride
        for i in range(self.size):
            for j in range(self.size):
                at = np.s_[:, :, i : i + s * h : s, j : j + s * w : s]
                dx[at] += dy * (self._x[at] == self._top)
        return dx


class GlobalAveragePooling(Layer):
    def build(self, shape, rng):
        return shape[:1]

    def forward(self, x, train=False):
        self._shape = x.shape
        return x.mean(axis=(2, 3))

    def backward(self, dy):
        return np.broadcast_to(dy[:, :, None, None] / math.prod(self._shape[2:]), self._shape)


class TokenEmbedding(Layer):
    def __init__(self, words: int, width: int):
        super().__init__()
        self.words, self.width = words, width

    def build(self, shape, rng):
        self.params = {"table": rng.normal(0, 0.02, (self.words, self.width))}
        return (*shape, self.width)

    def forward(self, x, train=False):
        self._ids = x.astype(np.int64)
        return self.params["table"][self._ids]

    def backward(self, dy):
        grad = np.zeros_like(self.params["table"])
        np.add.at(grad, self._ids, dy)
        self.grads = {"table": grad}
        return np.zeros(self._ids.shape)


class PositionalEmbedding(Layer):
    def __init__(self, most: int = 512):
        super().__init__()
        self.most = most

    def build(self, shape, rng):
        if shape[0] > self.most:
            raise ValueError(f"{shape[0]} places, at most {self.most}")
        self.params = {"table": rng.normal(0, 0.02, (self.most, shape[1]))}
        return shape

    def forward(self, x, train=False):
        return x + self.params["table"][: x.shape[1]]

    def backward(self, dy):
        grad = np.zeros_like(self.params["table"])
        grad[: dy.shape[1]] = dy.sum(axis=0)
        self.grads = {"table": grad}
        return dy


class RMSNorm(Layer):
    def __init__(self, epsilon: float = 1e-5):
        super().__init__()
        self.epsilon = epsilon

    def build(self, shape, rng):
        self.params = {"scale": np.ones(shape[-1])}
        return shape

    def forward(self, x, train=False):
        self._size = np.sqrt((x * x).mean(axis=-1, keepdims=True) + self.epsilon)
        self._unit = x / self._size
        return self._unit * self.params["scale"]

    def backward(self, dy):
        axes = tuple(range(dy.ndim - 1))
        self.grads = {"scale": (dy * self._unit).sum(axis=axes)}
        d = dy * self.params["scale"]
        return (d - self._unit * (d * self._unit).mean(axis=-1, keepdims=True)) / self._size


class LayerNorm(RMSNorm):
    def build(self, shape, rng):
        super().build(shape, rng)
        self.params["shift"] = np.zeros(shape[-1])
        return shape

    def forward(self, x, train=False):
        return super().forward(x - x.mean(axis=-1, keepdims=True), train) + self.params["shift"]

    def backward(self, dy):
        dx = super().backward(dy)
        self.grads["shift"] = dy.sum(axis=tuple(range(dy.ndim - 1)))
        return dx - dx.mean(axis=-1, keepdims=True)


def causal_mask(size: int) -> np.ndarray:
    return np.tril(np.ones((size, size), dtype=bool))


def rotation(size: int, width: int, base: float = 10000.0) -> tuple[np.ndarray, np.ndarray]:
    """Cosines and sines of rotary embeddings by place and pair."""
    if width % 2:
        raise ValueError("rotary embedding needs an even width")
    angles = np.arange(size)[:, None] / base ** (np.arange(0, width, 2) / width)
    return np.cos(angles), np.sin(angles)


def rotate(x: np.ndarray, cos: np.ndarray, sin: np.ndarray) -> np.ndarray:
    """Turn each pair of neighbours by its angle; with ``-sin`` back again, which is the gradient."""
    out = np.empty_like(x)
    out[..., 0::2] = x[..., 0::2] * cos - x[..., 1::2] * sin
    out[..., 1::2] = x[..., 1::2] * cos + x[..., 0::2] * sin
    return out


class MultiHeadAttention(Layer):
    def __init__(self, heads: int, causal: bool = True, rotary: bool = False):
        super().__init__()
        self.heads, self.causal, self.rotary = heads, causal, rotary

    def build(self, shape, rng):
        width = shape[1]
        if width % self.heads:
            raise ValueError(f"{self.heads} heads do not divide {width}")
        spread = math.sqrt(1 / width)
        self.params = {n: rng.normal(0, spread, (width, width)) for n in ("q", "k", "v", "out")} | {"b_out": np.zeros(width)}
        return shape

    def _split(self, x):
        return x.reshape(*x.shape[:2], self.heads, -1).transpose(0, 2, 1, 3)

    def _join(self, x):
        return x.transpose(0, 2, 1, 3).reshape(x.shape[0], x.shape[2], -1)

    def forward(self, x, train=False):
        self._x, p = x, self.params
        q, k, v = (self._split(x @ p[n]) for n in "qkv")
        if self.rotary:
            self._turn = rotation(x.shape[1], q.shape[-1])
            q, k = rotate(q, *self._turn), rotate(k, *self._turn)
        scores = q @ k.swapaxes(-1, -2) / math.sqrt(q.shape[-1])
        if self.causal:
            scores = np.where(causal_mask(x.shape[1]), scores, -np.inf)
        self._q, self._k, self._v, self._p = q, k, v, softmax(scores)
        self._mixed = self._join(self._p @ v)
        return self._mixed @ p["out"] + p["b_out"]

    def backward(self, dy):
        p, x = self.params, self._x
        flat = lambda a, b: np.tensordot(a, b, ((0, 1), (0, 1)))
        self.grads = {"out": flat(self._mixed, dy), "b_out": dy.sum(axis=(0, 1))}
        d = self._split(dy @ p["out"].T)
        dv = self._p.swapaxes(-1, -2) @ d
        dp = d @ self._v.swapaxes(-1, -2)
        ds = self._p * (dp - (dp * self._p).sum(axis=-1, keepdims=True)) / math.sqrt(self._q.shape[-1])
        dq, dk = ds @ self._k, ds.swapaxes(-1, -2) @ self._q
        if self.rotary:
            cos, sin = self._turn
            dq, dk = rotate(dq, cos, -sin), rotate(dk, cos, -sin)
        dx = np.zeros_like(x)
        for name, g in (("q", dq), ("k", dk), ("v", dv)):
            g = self._join(g)
            self.grads[name] = flat(x, g)
            dx += g @ p[name].T
        return dx


class Chain(Layer):
    """Layers one after another."""

    def __init__(self, *layers: Layer):
        super().__init__()
        self.layers = list(layers)

    def children(self):
        return self.layers

    def build(self, shape, rng):
        for layer in self.layers:
            shape = layer.build(shape, rng)
        return shape

    def forward(self, x, train=False):
        for layer in self.layers:
            x = layer.forward(x, train)
        return x

    def backward(self, dy):
        for layer in reversed(self.layers):
            dy = layer.backward(dy)
        return dy


class MultilayerPerceptron(Chain):
    """Up, activation, down to the width it came from."""

    def __init__(self, hidden: int, act: str = "gelu"):
        super().__init__()
        self.hidden, self.act = hidden, act

    def build(self, shape, rng):
        self.layers = [Dense(self.hidden, self.act), Dense(shape[-1])]
        return super().build(shape, rng)


class Residual(Chain):
    """Input plus what the inner layers make of it."""

    def build(self, shape, rng):
        if super().build(shape, rng) != shape:
            raise ValueError("a residual block must keep the shape")
        return shape

    def forward(self, x, train=False):
        return x + super().forward(x, train)

    def backward(self, dy):
        return dy + super().backward(dy)


class TiedDense(Layer):
    """Logits by the transposed table of a :class:`TokenEmbedding`, whose gradient it adds to."""

    def __init__(self, embedding: TokenEmbedding):
        super().__init__()
        self._embedding = embedding

    def build(self, shape, rng):
        self.params = {"biases": np.zeros(self._embedding.words)}
        return (*shape[:-1], self._embedding.words)

    def forward(self, x, train=False):
        self._x = x
        return x @ self._embedding.params["table"].T + self.params["biases"]

    def backward(self, dy):
        axes = tuple(range(dy.ndim - 1))
        self.grads = {"biases": dy.sum(axis=axes)}
        self._share = np.tensordot(dy, self._x, (axes, axes))
        return dy @ self._embedding.params["table"]

    def tied_grad(self) -> tuple[TokenEmbedding, np.ndarray]:
        return self._embedding, self._share


def transformer_block(heads: int, hidden: int, modern: bool = True) -> list[Layer]:
    """Attention and perceptron, each residual after a norm: RMS norm with rotary places, or layer norm without."""
    norm = RMSNorm if modern else LayerNorm
    return [Residual(norm(), MultiHeadAttention(heads, rotary=modern)), Residual(norm(), MultilayerPerceptron(hidden))]
