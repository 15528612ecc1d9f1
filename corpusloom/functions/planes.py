"""Convolution and pooling of images that are arrays of numbers, channel by channel and row by row, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _at(v: Column, channel: int, row: Column, column: Column, height: int, width: int) -> Column:
    """A pixel, 0 beyond the edges."""
    inside = (row >= 0) & (row < height) & (column >= 0) & (column < width)
    return F.when(inside, F.get(v, (row * width + column + channel * height * width).cast("int"))).otherwise(0.0)


def _places(height: int, width: int, kernel: tuple[int, int], stride: int, pad: int) -> tuple[int, int]:
    return (height + 2 * pad - kernel[0]) // stride + 1, (width + 2 * pad - kernel[1]) // stride + 1


def convolve(v: Column, shape: tuple[int, int, int], kernels: Sequence[Sequence[Sequence[Sequence[float]]]], bias: Sequence[float] | None = None, stride: int = 1, pad: int = 0) -> Column:
    """Images of ``shape`` (channels, height, width) by kernels (out, in, height, width): an array of the same layout, its channels those of ``kernels``.

    The kernel is laid on as it is, not turned.  Only the kernels' entries are written out, not the places, so the plan does not grow with the image.
    """
    channels, height, width = shape
    rows, columns = _places(height, width, (len(kernels[0][0]), len(kernels[0][0][0])), stride, pad)

    def of(kernel: Sequence[Sequence[Sequence[float]]], offset: float) -> Column:
        def place(k: Column) -> Column:
            r, c = F.floor(k / columns) * stride - pad, k % columns * stride - pad
            terms = [_at(v, ch, r + i, c + j, height, width) * float(w) for ch in range(channels) for i, line in enumerate(kernel[ch]) for j, w in enumerate(line)]
            return reduce(lambda a, b: a + b, terms) + offset

        return F.transform(F.sequence(F.lit(0), F.lit(rows * columns - 1)), place)

    return F.concat(*[of(k, float(b)) for k, b in zip(kernels, bias or [0.0] * len(kernels))])


def max_pool(v: Column, shape: tuple[int, int, int], size: int, stride: int | None = None) -> Column:
    """The largest value of each window of ``size`` by ``size``, channel by channel."""
    channels, height, width = shape
    stride = stride or size
    rows, columns = _places(height, width, (size, size), stride, 0)

    def place(k: Column) -> Column:
        ch, rest = F.floor(k / (rows * columns)), k % (rows * columns)
        corner = ch * height * width + F.floor(rest / columns) * stride * width + rest % columns * stride
        return F.greatest(*[F.get(v, (corner + i * width + j).cast("int")) for i in range(size) for j in range(size)])

    return F.transform(F.sequence(F.lit(0), F.lit(channels * rows * columns - 1)), place)


def max_pool_gradient(v: Column, gradient: Column, shape: tuple[int, int, int], size: int) -> Column:
    """The gradient of the pixels under windows that do not overlap: all that reach their window's largest value get its gradient, ties too; the rest 0."""
    channels, height, width = shape
    rows, columns = height // size, width // size
    most = max_pool(v, shape, size)

    def pixel(x: Column, k: Column) -> Column:
        ch, rest = F.floor(k / (height * width)), k % (height * width)
        r, c = F.floor(rest / width / size), F.floor(rest % width / size)
        window = (ch * rows * columns + r * columns + c).cast("int")
        return F.when((r < rows) & (c < columns) & (x == F.get(most, window)), F.get(gradient, window)).otherwise(0.0)

    return F.transform(v, pixel)
