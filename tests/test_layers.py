"""Column forms of layers against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import planes
from corpusloom.operators import attention
from corpusloom.sources import files


@pytest.mark.parametrize("stride, pad", [(1, 0), (1, 1), (2, 1), (3, 2)])
def test_convolution(spark, stride, pad):
    rng = random.Random(stride)
    c, h, w, out, kh, kw = 2, 5, 4, 3, 3, 2
    x = [rng.uniform(-1, 1) for _ in range(c * h * w)]
    kernels = [[[[rng.uniform(-1, 1) for _ in range(kw)] for _ in range(kh)] for _ in range(c)] for _ in range(out)]
    bias = [0.5, -1.0, 0.0]
    rows, columns = (h + 2 * pad - kh) // stride + 1, (w + 2 * pad - kw) // stride + 1
    expected = []
    for o in range(out):
        for r in range(rows):
            for q in range(columns):
                total = bias[o]
                for ch in range(c):
                    for i in range(kh):
                        for j in range(kw):
                            y, z = r * stride - pad + i, q * stride - pad + j
                            if 0 <= y < h and 0 <= z < w:
                                total += kernels[o][ch][i][j] * x[ch * h * w + y * w + z]
                expected.append(total)
    got = spark.createDataFrame([(x,)], "v array<double>").select(planes.convolve(F.col("v"), (c, h, w), kernels, bias, stride, pad)).first()[0]
    assert got == pytest.approx(expected)


def test_pooling_shares_gradients_among_ties(spark):
    x = [1.0, 1.0, 0.0, 3.0, 2.0, 0.0, 1.0, 1.0, 5.0, 5.0, 1.0, 1.0, 5.0, 5.0, 1.0, 0.5]
    df = spark.createDataFrame([(x, [0.1, 0.2, 0.3, 0.4])], "v array<double>, g array<double>")
    most, gradient = df.select(planes.max_pool(F.col("v"), (1, 4, 4), 2), planes.max_pool_gradient(F.col("v"), F.col("g"), (1, 4, 4), 2)).first()
    assert most == [2.0, 3.0, 5.0, 1.0]
    assert gradient == [0, 0, 0, 0.2, 0.1, 0, 0, 0, 0.3, 0.3, 0.4, 0.4, 0.3, 0.3, 0.4, 0]
    assert df.select(planes.max_pool(F.col("v"), (1, 4, 4), 2, stride=1)).first()[0] == [2.0, 1.0, 3.0, 5.0, 5.0, 1.0, 5.0, 5.0, 1.0]


@pytest.mark.parametrize("causal, turned", [(True, False), (False, False), (True, True)])
def test_attention(spark, causal, turned):
    rng = random.Random(3)
    rows = [(s, p, [rng.gauss(0, 3) for _ in range(8)], [rng.gauss(0, 3) for _ in range(8)], [rng.gauss(0, 1) for _ in range(8)]) for s in (0, 1) for p in range(5 + s)]
    got = {(r.s, r.p): r.attended for r in attention.multi_head(spark.createDataFrame(rows, "s int, p int, q array<double>, k array<double>, v array<double>"), "s", "p", "q", "k", "v", 8, 2, causal, turned).collect()}

    def turn(x, place):
        if not turned:
            return x
        out = []
        for i in range(0, 4, 2):
            a = place / 10000 ** (i / 4)
            out += [x[i] * math.cos(a) - x[i + 1] * math.sin(a), x[i + 1] * math.cos(a) + x[i] * math.sin(a)]
        return out

    for s, p, q, _, _ in rows:
        expected = []
        for h in (0, 4):
            seen = [r for r in rows if r[0] == s and (r[1] <= p or not causal)]
            scores = [sum(a * b for a, b in zip(turn(q[h : h + 4], p), turn(r[3][h : h + 4], r[1]))) / 2 for r in seen]
            e = [math.exp(x - max(scores)) for x in scores]
            expected += [sum(w * r[4][h + j] for w, r in zip(e, seen)) / sum(e) for j in range(4)]
        assert got[s, p] == pytest.approx(expected)
    with pytest.raises(ValueError):
        attention.multi_head(spark.range(1), "id", "id", "id", "id", "id", 8, 3)


def test_switch_and_arguments(spark):
    a, b = files.Source("a", 1, "x"), files.Source("b", 1, "y")
    assert files.switched(a, b, False) is a and files.switched(a, b, True) is b
    row = spark.createDataFrame([(1, 'q"\\', None)], "n int, t string, m double").select(files.arguments_json(n=F.col("n"), text=F.col("t"), none=F.col("m")).alias("j")).first()
    assert row.j == '{"n":"1","text":"q\\"\\\\","none":null}'


def test_corpus_with_blank_lines_comes_back(spark, tmp_path):
    texts = ["a\n\nb", "a\n\\\nb\n\n\n\\\\\nc", "plain", "\\", "x\\\n\ny\\", "one\u2028\n\ntwo"]
    files.write_corpus(spark.createDataFrame([(t, "train") for t in texts], "text string, split string"), f"{tmp_path}/c", escaped=True)
    assert sorted(r.text for r in files.read_corpus(spark, f"{tmp_path}/c", escaped=True).collect()) == sorted(texts)
