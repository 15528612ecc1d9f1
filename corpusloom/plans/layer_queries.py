"""Layers and optimiser steps as column expressions, and inputs that can be switched."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from corpusloom.functions import planes
from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.operators import attention
from corpusloom.plans.corpus_queries import table
from corpusloom.plans.numeric_queries import _V, _fmt, _out, _vectors
from corpusloom.sources import files

#: Two kernels over two channels of four by eight, and their offsets.
_KERNELS = [[[[round(math.sin(1 + o * 18 + c * 9 + i * 3 + j), 3) for j in range(3)] for i in range(3)] for c in range(2)] for o in range(2)]
_BIAS = [0.25, -0.5]


def convolution_2d(spark, sf):
    """Embeddings as two planes of four by eight, padded by one, each second place."""
    return _vectors(spark, sf).select("vec_id", _out("y", planes.convolve(F.col("v"), (2, 4, 8), _KERNELS, _BIAS, stride=2, pad=1), 5))


def pooling_2d(spark, sf):
    """Largest values of two by two of an image of eight by eight, cut to quarters so that there are ties, and what becomes of their gradients."""
    rows = _vectors(spark, sf).withColumn("q", F.transform("v", lambda x: F.floor(x * 8) / 8.0))
    gradient = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda k: k / 16.0)
    return rows.select("vec_id", _out("most", planes.max_pool(F.col("q"), (1, 8, 8), 2)), _out("gradient", planes.max_pool_gradient(F.col("q"), gradient, (1, 8, 8), 2)))


_HEADS = 4


def _heads(spark, sf, **how):
    rows = _vectors(spark, sf).select(F.floor(F.col("vec_id") / 8).alias("seq"), (F.col("vec_id") % 8).alias("place"), F.transform("v", lambda x: x * 10).alias("v"))
    return attention.multi_head(rows, "seq", "place", "v", "v", "v", 64, _HEADS, **how).select("seq", "place", _out("y", F.col("attended"), 5))


def attention_heads(spark, sf):
    return _heads(spark, sf)


def attention_turned(spark, sf):
    """Queries and keys turned by their places, and every place seeing all others."""
    return _heads(spark, sf, causal=False, turned=True)


_RATE, _DECAY, _STEPS = 0.01, 0.1, 3


def adamw_steps(spark, sf):
    """Three steps with growing gradients, each from the moments of the one before; rows of label 0 stand for biases, which do not decay."""
    rows = _vectors(spark, sf).select("vec_id", (F.col("label") == 0).alias("bias"), F.col("v").alias("p"), F.reverse("v").alias("g"), *[F.transform("v", lambda x: F.lit(0.0)).alias(c) for c in ("a", "b")])
    for step in range(1, _STEPS + 1):
        m, v = V.adam_moments(F.col("a"), F.col("b"), F.transform("g", lambda x: x * float(step)))
        rows = rows.withColumns({"a": m, "b": v})
        rows = rows.withColumn("p", F.when(F.col("bias"), V.adam(F.col("p"), F.col("a"), F.col("b"), step, _RATE)).otherwise(V.adam(F.col("p"), F.col("a"), F.col("b"), step, _RATE, decay=_DECAY)))
    return rows.select("vec_id", _out("p", F.col("p")))


def switched_source(spark, sf):
    """The corpus from either of two inputs, as the switch says, in the same form."""
    first, other = files.Source("documents", 1.0, f"{sf}/documents.parquet"), files.Source("benchmark", 1.0, f"{sf}/benchmark.parquet")
    parts = []
    for switch in (False, True):
        read = files.read_source(spark, files.switched(first, other, switch))
        parts.append(read.select(F.lit(switch).alias("direct"), T.strip(F.coalesce("text", F.lit(""))).alias("text"), F.lit(files.switched(first, other, switch).name).alias("source")))
    return parts[0].unionAll(parts[1]).where("text <> ''").groupBy("direct", "source").agg(F.count("*").alias("samples"), F.sum(F.char_length("text") + 1).alias("chars"))


def argument_records(spark, sf):
    """Each order as a record of named arguments, all of them text, in one line of JSON."""
    return table(spark, sf, "orders").select("o_orderkey", files.arguments_json(key=F.col("o_orderkey"), status=F.col("o_orderstatus"), day=F.col("o_orderdate").cast("date"), priority=F.col("o_orderpriority"), note=F.lit(None).cast("string")).alias("arguments"))


def _convolved() -> str:
    kernels = []
    for o, kernel in enumerate(_KERNELS):
        terms = []
        for c in range(2):
            for i in range(3):
                for j in range(3):
                    r, q = f"(k // 4 * 2 - 1 + {i})", f"(k % 4 * 2 - 1 + {j})"
                    terms.append(f"CASE WHEN {r} BETWEEN 0 AND 3 AND {q} BETWEEN 0 AND 7 THEN v[{c} * 32 + {r} * 8 + {q} + 1] * CAST({kernel[c][i][j]} AS DOUBLE) ELSE 0 END")
        kernels.append(f"list_transform(range(8), lambda k: {' + '.join(terms)} + CAST({_BIAS[o]} AS DOUBLE))")
    return f"SELECT vec_id, {_fmt(f'list_concat({kernels[0]}, {kernels[1]})', 5)} AS y FROM {_V}"


def _adamw() -> str:
    d = lambda x: f"CAST({x} AS DOUBLE)"
    sql = f"(SELECT vec_id, label, v AS p, list_reverse(v) AS g, list_transform(v, lambda x: {d(0)}) AS a, list_transform(v, lambda x: {d(0)}) AS b FROM {_V})"
    for s in range(1, _STEPS + 1):
        moved = f"(SELECT vec_id, label, p, g, list_transform(range(1, 65), lambda i: {d(0.9)} * a[i] + (1 - {d(0.9)}) * g[i] * {s}) AS a, list_transform(range(1, 65), lambda i: {d(0.999)} * b[i] + (1 - {d(0.999)}) * g[i] * {s} * g[i] * {s}) AS b FROM {sql})"
        kept = f"(CASE WHEN label = 0 THEN {d(1)} ELSE 1 - {d(_RATE)} * {d(_DECAY)} END)"
        sql = f"(SELECT vec_id, label, g, a, b, list_transform(range(1, 65), lambda i: p[i] * {kept} - {d(_RATE)} * (a[i] / {d(1 - 0.9**s)}) / (sqrt(b[i] / {d(1 - 0.999**s)}) + 1e-8)) AS p FROM {moved})"
    return f"SELECT vec_id, {_fmt('p')} AS p FROM {sql}"


def _attended(causal: bool, turned: bool) -> str:
    size = 64 // _HEADS
    angle = f"(place / pow(CAST(10000 AS DOUBLE), 2 * (i // 2) / CAST({size} AS DOUBLE)))"
    spun = f"list_transform(range({size}), lambda i: CASE WHEN i % 2 = 0 THEN u[i + 1] * cos{angle} - u[i + 2] * sin{angle} ELSE u[i + 1] * cos{angle} + u[i] * sin{angle} END)"
    return f"""WITH h AS (SELECT vec_id // 8 AS seq, vec_id % 8 AS place, head, list_transform(v[head * {size} + 1:(head + 1) * {size}], lambda x: x * 10) AS u FROM {_V}, unnest(range({_HEADS})) t(head)),
        r AS (SELECT *, {spun if turned else 'u'} AS t FROM h),
        s AS (SELECT a.seq, a.place, a.head, b.u, list_sum(list_transform(range(1, {size} + 1), lambda i: a.t[i] * b.t[i])) / {math.sqrt(size)} AS s FROM r a JOIN r b ON a.seq = b.seq AND a.head = b.head {'AND b.place <= a.place' if causal else ''}),
        e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY seq, place, head)) AS e FROM s),
        y AS (SELECT seq, place, head, j, sum(e * u[j]) / sum(e) AS y FROM e, unnest(range(1, {size} + 1)) t(j) GROUP BY ALL)
        SELECT seq, place, {_fmt('list(y ORDER BY head, j)', 5)} AS y FROM y GROUP BY seq, place"""


_Q = f"(SELECT vec_id, list_transform(v, lambda x: floor(x * 8) / CAST(8 AS DOUBLE)) AS q FROM {_V})"
_MOST = "list_transform(range(16), lambda k: greatest(q[k // 4 * 16 + k % 4 * 2 + 1], q[k // 4 * 16 + k % 4 * 2 + 2], q[k // 4 * 16 + k % 4 * 2 + 9], q[k // 4 * 16 + k % 4 * 2 + 10]))"

QUERIES = {
    "convolution_2d": (convolution_2d, _convolved()),
    "pooling_2d": (
        pooling_2d,
        f"SELECT vec_id, {_fmt('most')} AS most, {_fmt('list_transform(range(64), lambda k: CASE WHEN q[k + 1] = most[k // 16 * 4 + k % 8 // 2 + 1] THEN (k // 16 * 4 + k % 8 // 2 + 1) / CAST(16 AS DOUBLE) ELSE 0 END)')} AS gradient FROM (SELECT *, {_MOST} AS most FROM {_Q})",
    ),
    "attention_heads": (attention_heads, _attended(True, False)),
    "attention_turned": (attention_turned, _attended(False, True)),
    "adamw_steps": (adamw_steps, _adamw()),
    "switched_source": (
        switched_source,
        "SELECT direct, source, count(*) AS samples, CAST(sum(length(t) + 1) AS BIGINT) AS chars FROM (SELECT false AS direct, 'documents' AS source, regexp_replace(regexp_replace(coalesce(text, ''), '^\\s+', ''), '\\s+$', '') AS t FROM documents UNION ALL SELECT true, 'benchmark', regexp_replace(regexp_replace(coalesce(text, ''), '^\\s+', ''), '\\s+$', '') FROM benchmark) WHERE t <> '' GROUP BY ALL",
    ),
    "argument_records": (
        argument_records,
        "SELECT o_orderkey, CAST(json_object('key', o_orderkey::VARCHAR, 'status', o_orderstatus, 'day', o_orderdate::DATE::VARCHAR, 'priority', o_orderpriority, 'note', NULL) AS VARCHAR) AS arguments FROM orders",
    ),
}
