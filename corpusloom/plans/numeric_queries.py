"""Statistics, series, vector and network queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.nn import layers as L
from corpusloom.nn.model import Model, Optimizer, generate
from corpusloom.operators import corpus, telemetry
from corpusloom.operators.ordered import uniform
from corpusloom.plans.corpus_queries import _uniform, table
from corpusloom.sources import files

_SCALE = 1e5
#: Factor of the attention products: beyond 1 / sqrt(64), so that without taking off the largest the exponential would overflow.
_SHARP = 2000.0


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("v"))


def _out(name, column, digits=6):
    """A vector as text of rounded values, so that engines can be compared."""
    return F.array_join(F.transform(column, lambda x: F.format_string(f"%.{digits}f", F.round(x, digits) + 0.0)), " ").alias(name)


#: Averages of short series have few decimals and often lie half way between two rounded values, where engines may differ.
_OFF = 0.123456789


def _steady(name, column):
    return (F.floor(F.col(column) * 100000 + _OFF) / 100000.0).alias(name)


def _steady_sql(text):
    return f"floor(({text}) * 100000 + CAST({_OFF} AS DOUBLE)) / CAST(100000 AS DOUBLE) AS ema"


def regression_fit(spark, sf):
    fit = telemetry.regression(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", _SCALE)
    return fit.select("n", "df", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r_squared", "stderr", "t", "s", "s_reported")])


def regression_test(spark, sf):
    fit = telemetry.slope_test(telemetry.regression(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", _SCALE))
    return fit.select("n", *[F.round(c, 6).alias(c) for c in ("slope", "t", "p", "t_crit", "ci_low", "ci_high")])


def projection_fit(spark, sf):
    return telemetry.projection_fit(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


def _residuals(spark, sf):
    rows = table(spark, sf, "lineitem")
    return telemetry.residuals(rows, telemetry.regression(rows, "l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice")


def regression_residuals(spark, sf):
    return _residuals(spark, sf).select("l_orderkey", "l_linenumber", F.round("fitted", 3).alias("fitted"), F.round("residual", 3).alias("residual"))


def residual_histogram(spark, sf):
    return telemetry.histogram(_residuals(spark, sf), "residual", 20).select("bin", F.col("n").cast("long").alias("n"))


def size_grid(spark, sf):
    k = spark.range(100).select((1 + F.col("id") * 19 / 99.0).alias("k"))
    points = k.select((F.col("k") * F.col("k") * 1000 + F.col("k") * 500).alias("params"), "k")
    targets = spark.range(15).select(F.col("id").alias("i"), (1e3 + F.col("id") * (5e5 - 1e3) / 14).alias("target"))
    return telemetry.interpolate(points, targets, "params", "k", "target").select("i", F.round("value", 6).alias("k"))


def argmax_accuracy(spark, sf):
    p = V.softmax(F.col("v"))
    return _vectors(spark, sf).select((V.argmax(p) == F.col("label")).cast("int").alias("right")).agg(F.count("*").alias("n"), F.sum("right").alias("correct"), F.round(F.avg("right"), 9).alias("accuracy"))


def softmax_ranking(spark, sf):
    rows = _vectors(spark, sf).withColumn("p", V.softmax(F.col("v")))
    ranked = F.array_sort(F.transform("p", lambda x, i: F.struct((-F.round(x, 9)).alias("d"), i.alias("class"))))
    return rows.select("vec_id", F.posexplode(ranked).alias("place", "c")).select("vec_id", "place", F.col("c.class").alias("class"), (-F.col("c.d")).alias("confidence"))


def label_names(spark, sf):
    # The names of the classes.
    names = spark.createDataFrame([(i, n) for i, n in enumerate("airplane automobile bird cat deer dog frog horse ship truck".split())], "label int, name string")
    return table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("int").alias("label")).join(F.broadcast(names), "label").select("vec_id", "name")


def embedding_gather(spark, sf):
    vectors = _vectors(spark, sf).select(F.col("vec_id").alias("token"), F.get("v", F.lit(0)).alias("first"), F.get("v", F.lit(63)).alias("last"), V.total(F.col("v")).alias("total"))
    ids = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 500).alias("token"))
    return ids.join(vectors, "token").select("l_orderkey", "l_linenumber", "token", F.round("first", 6).alias("first"), F.round("last", 6).alias("last"), F.round("total", 6).alias("total"))


def epoch_metrics(spark, sf):
    batches = table(spark, sf, "events").select((F.col("event_id") % 50).alias("epoch"), F.col("value").alias("loss"), (F.col("event_id") % 32 + 1).alias("size"))
    return batches.groupBy("epoch").agg(F.round(F.sum(F.col("loss") * F.col("size")) / F.sum("size"), 6).alias("loss"), F.sum("size").alias("rows"))


def heldout_loss(spark, sf):
    sampled = table(spark, sf, "events").withColumn("u", uniform(5, "event_id")).where("u < 0.1")
    return sampled.agg(F.count("*").alias("batches"), F.round(F.avg("value"), 6).alias("loss"))


def generalisation_gap(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").withColumn("split", corpus.split_name("doc_id", fraction=0.3))
    right = ((F.char_length("text") > 1000).cast("int") == F.col("quality")).cast("double")
    wide = joined.groupBy("quality").pivot("split", ["train", "val"]).agg(F.avg(right))
    return wide.select("quality", F.round("train", 6).alias("train"), F.round("val", 6).alias("val"), F.round(F.col("train") - F.col("val"), 6).alias("gap"))


def vector_moments(spark, sf):
    v = F.col("v")
    return _vectors(spark, sf).select("vec_id", F.round(V.mean(v), 6).alias("mean"), F.round(V.variance(v), 6).alias("variance"), F.round(F.array_max(v), 6).alias("most"), V.argmax(v).alias("argmax"))


def vector_norms(spark, sf):
    v = F.col("v")
    per_row = _vectors(spark, sf).select("label", V.dot(v, v).alias("square"))
    return per_row.groupBy("label").agg(F.round(F.sqrt(F.sum("square")), 6).alias("norm"), F.round(F.avg(F.sqrt("square")), 6).alias("mean_norm"))


def param_counts(spark, sf):
    k = spark.range(1, 101).select(F.col("id").alias("k"))
    conv1, conv2 = (3 * 9 + 1) * 32 * F.col("k"), (32 * F.col("k") * 9 + 1) * 64 * F.col("k")
    dense1, dense2, out = (64 * F.col("k") * 36 + 1) * 128 * F.col("k"), (128 * F.col("k") + 1) * 64 * F.col("k"), (64 * F.col("k") + 1) * 10
    return k.select("k", conv1.alias("conv1"), conv2.alias("conv2"), dense1.alias("dense1"), (conv1 + conv2 + dense1 + dense2 + out).alias("total"))


def ema_by_user(spark, sf):
    return telemetry.final_ema(table(spark, sf, "events").select("user_id", "ts", "event_id", "value"), "user_id", ("ts", "event_id"), "value").select("user_id", "n", _steady("ema", "ema"))


def ema_steps(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", "value")
    return telemetry.ema(rows, "user_id", ("event_id",), "value").select("event_id", _steady("ema", "ema"))


def resumed_ema(spark, sf):
    """The average of the later half of each user's events, resumed from that of the earlier; equal to the uninterrupted one."""
    user = W.partitionBy("user_id")
    rows = table(spark, sf, "events").select("user_id", "event_id", "value")
    rows = rows.withColumn("late", F.row_number().over(user.orderBy("event_id")) > F.floor(F.count("*").over(user) / 2))
    early = telemetry.final_ema(rows.where("not late"), "user_id", ("event_id",), "value")
    late = telemetry.ema(rows.where("late"), "user_id", ("event_id",), "value", seeds=early)
    return late.groupBy("user_id").agg(F.max_by("ema", "event_id").alias("ema"), F.max("event_id").alias("last")).select("user_id", _steady("ema", "ema"), "last")


def running_metrics(spark, sf):
    cents = table(spark, sf, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))  # exact in any order of adding
    ran = telemetry.running_mean(cents, "user_id", ("event_id",), "cents")
    return ran.select("event_id", F.col("step").cast("long").alias("step"), "mean")


def checkpoint_steps(spark, sf):
    return telemetry.checkpoints(table(spark, sf, "events"), "event_id", 100).select("event_id", "user_id")


def _steps(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("step"))


def lr_schedule_abs(spark, sf):
    """The rate at each event, events being the steps."""
    return _steps(spark, sf).select("step", F.round(V.rate_absolute(F.col("step"), 2000, 3e-4, 100, 0.05), 10).alias("rate"))


def lr_schedule_mult(spark, sf):
    return _steps(spark, sf).select("step", F.round(V.rate_multiplier(F.col("step"), 2000, 20, 0.05), 8).alias("rate"))


def activations(spark, sf):
    x = F.col("x")
    return _vectors(spark, sf).select("vec_id", F.posexplode("v").alias("place", "x")).select("vec_id", "place", *[F.round(V.activation(n)(x), 6).alias(n) for n in V.ACTIVATIONS], *[F.round(V.activation(n, True)(x), 6).alias(f"{n}_slope") for n in V.ACTIVATIONS])


def softmax_rows(spark, sf):
    return _vectors(spark, sf).select("vec_id", _out("p", V.softmax(F.col("v"))))


def one_hot_labels(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.array_join(F.transform(V.one_hot(F.col("label"), 10), lambda x: x.cast("int").cast("string")), "").alias("bits"))


def pixels(spark, sf):
    scaled = F.transform("v", lambda x: F.round(x, 3))
    return _vectors(spark, sf).select("vec_id", F.array_join(V.to_pixels(scaled).cast("array<string>"), " ").alias("pixels"))


def greedy_tokens(spark, sf):
    return _vectors(spark, sf).select("vec_id", V.argmax(F.col("v")).alias("token"))


def sampled_tokens(spark, sf):
    """A token drawn at temperature 0.8 by inverting the cumulative distribution at a repeatable number."""
    rows = _vectors(spark, sf).select("vec_id", V.softmax(F.col("v"), 0.8).alias("p"), uniform(9, "vec_id").alias("u"))
    below = F.size(F.filter(F.sequence(F.lit(1), F.lit(63)), lambda i: V.total(F.slice("p", F.lit(1), i)) <= F.col("u")))
    return rows.select("vec_id", below.alias("token"))


def dropout_mask(spark, sf):
    rows = _vectors(spark, sf).select("vec_id", F.posexplode("v").alias("place", "x")).withColumn("u", uniform(13, "vec_id", "place"))
    return rows.select("vec_id", "place", F.round(F.when(F.col("u") < 0.75, F.col("x") / 0.75).otherwise(0.0), 6).alias("x"))


def squared_errors(spark, sf):
    y, p = V.one_hot(F.col("label"), 64), V.softmax(F.col("v"))
    return _vectors(spark, sf).select("vec_id", F.round(V.squared_error(y, p), 6).alias("mse"), _out("gradient", V.squared_error_gradient(y, p)))


def cross_entropies(spark, sf):
    logits, y = F.col("v"), V.one_hot(F.col("label"), 64)
    rows = _vectors(spark, sf).select(V.cross_entropy(y, V.softmax(logits)).alias("dense"), V.sparse_cross_entropy(F.col("label"), logits).alias("sparse"))
    return rows.agg(F.round(F.avg("dense"), 6).alias("dense"), F.round(F.avg("sparse"), 6).alias("sparse"))


def entropy_gradients(spark, sf):
    return _vectors(spark, sf).select("vec_id", _out("gradient", V.softmax_gradient(V.one_hot(F.col("label"), 64), V.softmax(F.col("v")), 4.0)))


def _step(spark, sf):
    zeros = F.transform("v", lambda x: F.lit(0.0))
    return _vectors(spark, sf).select("vec_id", F.col("v").alias("p"), F.reverse("v").alias("g"), zeros.alias("zero"))


def sgd_step(spark, sf):
    return _step(spark, sf).select("vec_id", _out("p", V.sgd(F.col("p"), F.col("g"), 0.1)))


def adam_step(spark, sf):
    m, v = V.adam_moments(F.col("zero"), F.col("zero"), F.col("g"))
    return _step(spark, sf).select("vec_id", "p", m.alias("m"), v.alias("v")).select("vec_id", _out("p", V.adam(F.col("p"), F.col("m"), F.col("v"), 1, 0.01)))


def adamw_step(spark, sf):
    m, v = V.adam_moments(F.col("zero"), F.col("zero"), F.col("g"))
    return _step(spark, sf).select("vec_id", "p", m.alias("m"), v.alias("v")).select("vec_id", _out("p", V.adam(F.col("p"), F.col("m"), F.col("v"), 1, 0.01, decay=0.1)))


def clipped_gradients(spark, sf):
    return _step(spark, sf).select("vec_id", _out("g", V.clip_by_norm(F.col("g"), 1.0)))


def clipped_together(spark, sf):
    return telemetry.clipped_together(_step(spark, sf), "g", 5.0).select("vec_id", _out("g", F.col("g"), 9))


def causal_mask(spark, sf):
    """What each turn of a conversation may see of sixteen places."""
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(V.causal_row(F.col("turn"), 16).cast("array<string>"), "").alias("mask"))


def layer_norms(spark, sf):
    return _vectors(spark, sf).select("vec_id", _out("normed", V.layer_norm(F.col("v")), 5))


def rms_norms(spark, sf):
    return _vectors(spark, sf).select("vec_id", _out("normed", V.rms_norm(F.col("v")), 5))


def rotary(spark, sf):
    return _vectors(spark, sf).select("vec_id", _out("turned", V.rotate(F.col("v"), F.col("vec_id") % 32, 64), 5))


def sliding_windows(spark, sf):
    return _vectors(spark, sf).select("vec_id", F.posexplode(V.windows(F.col("v"), 4, 2)).alias("place", "w")).select("vec_id", "place", F.round(V.total(F.col("w")), 6).alias("total"))


def convolution_1d(spark, sf):
    kernel = F.array(*[F.lit(x) for x in (0.25, 0.5, -0.25)])
    return _vectors(spark, sf).select("vec_id", _out("y", F.transform(V.windows(F.col("v"), 3), lambda w: V.dot(w, kernel)), 5))


def pooled(spark, sf):
    v = F.col("v")
    return _vectors(spark, sf).select("vec_id", _out("most", V.max_pool(v, 4)), F.round(V.mean(v), 6).alias("mean"))


def _weights(rows: int, units: int):
    """Fixed weights of a dense layer: sin of the place."""
    return [[float(np.sin(i * units + j + 1)) for i in range(rows)] for j in range(units)]


def dense_forward(spark, sf):
    units = [F.greatest(V.dot(F.col("v"), F.array(*[F.lit(w) for w in row])), F.lit(0.0)) for row in _weights(64, 4)]
    return _vectors(spark, sf).select("vec_id", _out("y", F.array(*units), 5))


def attention_scores(spark, sf):
    """Causal softmax of scaled products within groups of eight vectors, the largest taken off before the exponential."""
    rows = _vectors(spark, sf).select((F.floor(F.col("vec_id") / 8)).alias("seq"), (F.col("vec_id") % 8).alias("place"), "v")
    keys = rows.select("seq", F.col("place").alias("key"), F.col("v").alias("k"))
    scored = rows.join(keys, "seq").where("key <= place").select("seq", "place", "key", (V.dot(F.col("v"), F.col("k")) * _SHARP).alias("s"))
    tops = scored.groupBy("seq", "place").agg(F.max("s").alias("top"))
    raised = scored.join(tops, ["seq", "place"]).withColumn("e", F.exp(F.col("s") - F.col("top")))
    total = F.sum("e").over(W.partitionBy("seq", "place"))  # at most eight rows
    return raised.select("seq", "place", "key", F.round(F.col("e") / total, 6).alias("weight"))


def residual_sum(spark, sf):
    x = F.col("v")
    return _vectors(spark, sf).select("vec_id", _out("y", F.zip_with(x, V.layer_norm(x), lambda a, b: a + b), 5))


def embedding_gradient(spark, sf):
    """Gradients added up by token, as the table of an embedding receives them."""
    rows = _vectors(spark, sf).select((F.col("vec_id") % 7).alias("token"), F.posexplode("v").alias("place", "g"))
    return rows.groupBy("token", "place").agg(F.round(F.sum("g"), 5).alias("g"))


def augmented_images(spark, sf):
    """Embeddings as 8 x 8 images, flipped at random and cropped at random from a border of two."""
    u = lambda k: uniform(k, "vec_id")
    rows = _vectors(spark, sf).select("vec_id", "v", (u(21) < 0.5).alias("flip"), F.floor(u(22) * 5).alias("top"), F.floor(u(23) * 5).alias("left"))
    at = lambda i: (F.floor(i / 8) + F.col("top") - 2, F.when(F.col("flip"), 7 - (i % 8 + F.col("left") - 2)).otherwise(i % 8 + F.col("left") - 2))
    inside = lambda y, x: (y >= 0) & (y < 8) & (x >= 0) & (x < 8)
    pixel = lambda i: F.when(inside(*at(i)), F.get("v", (at(i)[0] * 8 + at(i)[1]).cast("int"))).otherwise(0.0)
    return rows.select("vec_id", "flip", "top", "left", F.round(V.total(F.transform(F.sequence(F.lit(0), F.lit(63)), pixel)), 5).alias("total"))


def _model() -> Model:
    return Model((64,), L.Dense(16, "relu"), L.Dense(10, "linear"), seed=1).compile("sparse_softmax_crossentropy", Optimizer("adam", 0.01))


#: Rows of a batch; each step is a job.
_BATCH = 256


def train_steps(spark, sf):
    """One whole epoch."""
    rows = files.written(corpus.epoch(_vectors(spark, sf), "vec_id", _BATCH, 3))
    metrics = _model().fit_dealt(rows, "batch", _BATCH, "vec_id", "v", "label")
    return spark.createDataFrame([(m["step"], float(m["loss"]), float(m["ema_loss"]), float(m["accuracy"])) for m in metrics], "step long, loss double, ema_loss double, accuracy double")


def _fixed_model() -> Model:
    """Two dense layers whose weights are sines of their places."""
    model = Model((64,), L.Dense(16, "relu"), L.Dense(10, "linear"), seed=1)
    places = lambda rows, columns: np.sin(np.arange(rows * columns).reshape(rows, columns) + 1.0)
    model.set({path: places(*p.shape) if p.ndim == 2 else np.zeros_like(p) for path, p in model.get().items()})
    return model


def predictions(spark, sf):
    out = _fixed_model().transform(_vectors(spark, sf), "v")
    return out.select("vec_id", V.argmax(F.col("prediction")).alias("class"), _out("logits", F.col("prediction"), 5))


def loaded_predictions(spark, sf):
    """The same by a model of other weights that has read the saved ones."""
    path = files.shared_path(spark, "model")
    _fixed_model().save(spark, path)
    model = Model((64,), L.Dense(16, "relu"), L.Dense(10, "linear"), seed=7)
    model.load(spark, path)
    out = model.transform(_vectors(spark, sf), "v")
    return out.select("vec_id", V.argmax(F.col("prediction")).alias("class"), _out("logits", F.col("prediction"), 5))


def image_layers(spark, sf):
    """Embeddings as 8 x 8 images through the 2-D layers: reshape, padded convolution, largest of 2 x 2, flatten."""
    model = Model((64,), L.Reshape((1, 8, 8)), L.Convolution(1, 3, padding=1, act="relu"), L.MaxPooling(2), L.Flatten())
    model.set({path: np.array(_KERNEL).reshape(p.shape) if p.ndim == 4 else np.zeros_like(p) for path, p in model.get().items()})
    return model.transform(_vectors(spark, sf), "v").select("vec_id", _out("y", F.col("prediction"), 5))


def pooled_images(spark, sf):
    """The mean of each image by the layer that averages."""
    model = Model((64,), L.Reshape((1, 8, 8)), L.GlobalAveragePooling())
    return model.transform(_vectors(spark, sf), "v").select("vec_id", F.round(F.get("prediction", F.lit(0)), 6).alias("mean"))


def _sines(model: Model) -> Model:
    """Weights set to sines of their places, those of the k-th matrix moved on by 100 k; vectors to zero."""
    values, k = {}, 0
    for path, p in model.get().items():
        values[path] = np.sin(np.arange(p.size) + 1.0 + 100 * k).reshape(p.shape) if p.ndim == 2 else np.zeros_like(p)
        k += p.ndim == 2
    model.set(values)
    return model


def attention_outputs(spark, sf):
    """Embeddings as eight steps of eight values through causal attention of two heads."""
    model = _sines(Model((8, 8), L.MultiHeadAttention(2)))
    return model.transform(_vectors(spark, sf), "v").select("vec_id", _out("y", F.col("prediction"), 5))


def perceptron_outputs(spark, sf):
    """Steps with their places added, through the perceptron and a dense layer of each step."""
    model = _sines(Model((8, 8), L.PositionalEmbedding(16), L.MultilayerPerceptron(16), L.TimeDistributedDense(4)))
    return model.transform(_vectors(spark, sf), "v").select("vec_id", _out("y", F.col("prediction"), 5))


def tied_logits(spark, sf):
    """Labels as tokens, embedded and compared with the same table."""
    words = L.TokenEmbedding(10, 4)
    model = _sines(Model((1,), words, L.TiedDense(words)))
    rows = table(spark, sf, "embeddings").select("vec_id", F.array(F.col("label").cast("double")).alias("ids"))
    return model.transform(rows, "ids").select("vec_id", _out("y", F.col("prediction"), 5))


def gradient_step(spark, sf):
    """Weights and biases (the last place) of a linear classifier after one step of descent on all rows."""
    model = _sines(Model((64,), L.Dense(10))).compile("sparse_softmax_crossentropy", Optimizer("sgd", 0.1))
    model.step(_vectors(spark, sf), "v", "label")
    stacked = np.vstack(list(model.get().values()))
    rows = [(i, k, round(float(w), 6)) for i, row in enumerate(stacked) for k, w in enumerate(row)]
    return spark.createDataFrame(rows, "place int, class int, weight double")


def size_sweep(spark, sf):
    """Accuracy on both splits and their difference for several hidden widths, one step each."""
    rows = _vectors(spark, sf).withColumn("split", corpus.split_name("vec_id", fraction=0.2))
    out = []
    for width in (4, 8):
        model = Model((64,), L.Dense(width, "relu"), L.Dense(10), seed=1).compile("sparse_softmax_crossentropy", Optimizer("adam", 0.05))
        model.step(rows.where("split = 'train'"), "v", "label")
        accuracy = [model.test(rows.where(F.col("split") == s), "v", "label").first().accuracy for s in ("train", "val")]
        out.append((width, model.count(), *accuracy, accuracy[0] - accuracy[1]))
    return spark.createDataFrame(out, "layer_size int, param_num long, train double, val double, accuracy_difference double")


def generated_tokens(spark, sf):
    table_ = L.TokenEmbedding(32, 8)
    model = Model((6,), table_, L.PositionalEmbedding(16), *L.transformer_block(2, 16), L.RMSNorm(), L.TiedDense(table_), seed=2)
    events = generate(model, [1, 5, 9], 12, 16, {0}, lambda ids: " ".join(map(str, ids)), temperature=0.0)
    return spark.createDataFrame([(k, e["type"], e.get("id"), e.get("text")) for k, e in enumerate(events)], "place int, type string, id int, text string")


# --- SQL ---------------------------------------------------------------------------------------

_V = "(SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
_FMT = "array_to_string(list_transform({0}, lambda x: printf('%.{1}f', round(x, {1}) + 0.0)), ' ')"
_P = "(SELECT vec_id, label, list_transform(e, lambda x: x / list_sum(e)) AS p FROM (SELECT vec_id, label, list_transform(w, lambda x: exp(x - list_max(w))) AS e FROM (SELECT vec_id, label, v AS w FROM {0})))".format(_V)
_Y = "list_transform(range(10), lambda i: CASE WHEN i = label THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"


def _fmt(column, digits=6):
    return _FMT.format(column, digits)


_FIT = """(SELECT count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM (SELECT l_extendedprice / 100000 AS x, l_quantity AS y FROM lineitem))"""
_LINE = "(SELECT regr_slope(l_extendedprice, l_quantity) AS m, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem)"
_STEP = f"(SELECT vec_id, v AS p, list_reverse(v) AS g FROM {_V})"
_ADAM = "(({0} * CAST(0.1 AS DOUBLE)) / (1 - CAST(0.9 AS DOUBLE))) / (sqrt((CAST(1 - 0.999 AS DOUBLE) * {0} * {0}) / (CAST(1 - 0.999 AS DOUBLE))) + 1e-8)"
_X8 = f"(SELECT vec_id, w, list_sum(w) / 64 AS m, list_sum(list_transform(w, lambda x: x * x)) / 64 AS q FROM (SELECT vec_id, v AS w FROM {_V}))"

#: Weights of the 3 x 3 convolution.
_KERNEL = [0.5, -0.25, 0.125, 1.0, -0.5, 0.25, -1.0, 0.75, 0.375]
_LOGITS = f"""WITH h AS (SELECT vec_id, list_transform(range(16), lambda j: greatest(CAST(0 AS DOUBLE), list_sum(list_transform(range(64), lambda i: v[i + 1] * sin(CAST(i * 16 + j + 1 AS DOUBLE)))))) AS h FROM {_V}),
    o AS (SELECT vec_id, list_transform(range(10), lambda k: list_sum(list_transform(range(16), lambda j: h[j + 1] * sin(CAST(j * 10 + k + 1 AS DOUBLE))))) AS o FROM h)
    SELECT vec_id, CAST(list_position(o, list_max(o)) - 1 AS INT) AS class, {_fmt('o', 5)} AS logits FROM o"""



def _product(values, rows, columns, matrix=0):
    """A row of ``values`` times a matrix of :func:`_sines`."""
    return f"list_transform(range({columns}), lambda j: list_sum(list_transform(range({rows}), lambda i: {values}[i + 1] * sin(CAST(i * {columns} + j + {1 + 100 * matrix} AS DOUBLE)))))"


QUERIES = {
    "regression_fit": (
        regression_fit,
        f"SELECT n, n - 2 AS df, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r_squared, round(se, 6) AS stderr, round(slope / se, 6) AS t, round(s, 6) AS s, round(sqrt(se * se * (n - 2) / (n - 1)), 6) AS s_reported FROM (SELECT *, sqrt(rv) AS s, sqrt(rv / sxx) AS se FROM (SELECT *, (syy - sxy * sxy / sxx) / (n - 2) AS rv FROM {_FIT}))",
    ),
    "regression_test": (
        regression_test,
        # The quantile by its expansion in 1 / df, exact to six digits from some hundred rows on; the tail by Simpson's rule over the density, 0 to six digits beyond 40.
        f"""SELECT n, round(slope, 6) AS slope, round(slope / se, 6) AS t, CASE WHEN abs(slope / se) > 40 THEN CAST(slope < 0 AS DOUBLE) ELSE round(0.5 - slope / se * exp(lgamma((d + 1) / 2) - lgamma(d / 2)) / sqrt(d * pi()) * list_sum(list_transform(range(4001), lambda k: (CASE WHEN k % 4000 = 0 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + pow(slope / se * k / 4000, 2) / d, -(d + 1) / 2))) / CAST(12000 AS DOUBLE), 6) END AS p, round(q, 6) AS t_crit, round(slope - q * se, 6) AS ci_low, round(slope + q * se, 6) AS ci_high
        FROM (SELECT *, z + (pow(z, 3) + z) / (4 * d) + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / (96 * d * d) + (3 * pow(z, 7) + 19 * pow(z, 5) + 17 * pow(z, 3) - 15 * z) / (384 * d * d * d) AS q
        FROM (SELECT n, slope, sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) AS se, CAST(n - 2 AS DOUBLE) AS d, CAST(1.959963984540054 AS DOUBLE) AS z FROM {_FIT}))""",
    ),
    "projection_fit": (projection_fit, "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem"),
    "regression_residuals": (regression_residuals, f"SELECT l_orderkey, l_linenumber, round(m * l_quantity + b, 3) AS fitted, round(l_extendedprice - (m * l_quantity + b), 3) AS residual FROM lineitem, {_LINE}"),
    "residual_histogram": (
        residual_histogram,
        f"WITH r AS (SELECT l_extendedprice - (m * l_quantity + b) AS x FROM lineitem, {_LINE}), e AS (SELECT min(x) AS lo, max(x) AS hi FROM r), c AS (SELECT CAST(least(floor((x - lo) / ((hi - lo) / 20)), 19) AS INT) AS bin, count(*) AS n FROM r, e GROUP BY 1) SELECT CAST(s.range AS INT) AS bin, coalesce(c.n, 0) AS n FROM range(20) s LEFT JOIN c ON c.bin = s.range",
    ),
    "size_grid": (
        size_grid,
        "WITH p AS (SELECT range AS i, CAST(1 + range * CAST(19 AS DOUBLE) / 99 AS DOUBLE) AS k FROM range(100)), q AS (SELECT k * k * 1000 + k * 500 AS x, k AS y, i FROM p), s AS (SELECT a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, a.i AS i FROM q a JOIN q b ON b.i = a.i + 1), t AS (SELECT range AS i, 1000 + range * CAST(499000 AS DOUBLE) / 14 AS target FROM range(15)) SELECT t.i, round(y0 + (y1 - y0) / (x1 - x0) * (target - x0), 6) AS k FROM t JOIN s ON (s.i = 0 OR target >= x0) AND (s.i = 98 OR target < x1)",
    ),
    "argmax_accuracy": (argmax_accuracy, f"SELECT count(*) AS n, CAST(sum(r) AS BIGINT) AS correct, round(avg(r), 9) AS accuracy FROM (SELECT CASE WHEN list_position(p, list_max(p)) - 1 = label THEN 1 ELSE 0 END AS r FROM {_P})"),
    "softmax_ranking": (
        softmax_ranking,
        f"SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY round(x, 9) DESC, class) - 1 AS INT) AS place, class, round(x, 9) AS confidence FROM (SELECT vec_id, CAST(r.range AS INT) AS class, p[r.range + 1] AS x FROM {_P}, range(64) r)",
    ),
    "label_names": (label_names, "SELECT vec_id, (['airplane', 'automobile', 'bird', 'cat', 'deer', 'dog', 'frog', 'horse', 'ship', 'truck'])[label + 1] AS name FROM embeddings"),
    "embedding_gather": (embedding_gather, "SELECT l_orderkey, l_linenumber, l_partkey % 500 AS token, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(CAST(embedding[64] AS DOUBLE), 6) AS last, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM lineitem JOIN embeddings ON vec_id = l_partkey % 500"),
    "epoch_metrics": (epoch_metrics, "SELECT event_id % 50 AS epoch, round(sum(value * (event_id % 32 + 1)) / sum(event_id % 32 + 1), 6) AS loss, CAST(sum(event_id % 32 + 1) AS BIGINT) AS rows FROM events GROUP BY 1"),
    "heldout_loss": (heldout_loss, f"SELECT count(*) AS batches, round(avg(value), 6) AS loss FROM events WHERE {_uniform("'5:' || event_id")} < 0.1"),
    "generalisation_gap": (
        generalisation_gap,
        f"SELECT quality, round(train, 6) AS train, round(val, 6) AS val, round(train - val, 6) AS gap FROM (SELECT quality, avg(CASE WHEN u >= 0.3 THEN r END) AS train, avg(CASE WHEN u < 0.3 THEN r END) AS val FROM (SELECT quality, {_uniform("'42:' || d.doc_id")} AS u, CASE WHEN (CASE WHEN length(text) > 1000 THEN 1 ELSE 0 END) = quality THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS r FROM documents d JOIN labels l ON l.doc_id = d.doc_id) GROUP BY quality)",
    ),
    "vector_moments": (
        vector_moments,
        f"SELECT vec_id, round(m, 6) AS mean, round(list_sum(list_transform(v, lambda x: (x - m) * (x - m))) / 64, 6) AS variance, round(list_max(v), 6) AS most, CAST(list_position(v, list_max(v)) - 1 AS INT) AS argmax FROM (SELECT vec_id, v, list_sum(v) / 64 AS m FROM {_V})",
    ),
    "vector_norms": (vector_norms, f"SELECT label, round(sqrt(sum(s)), 6) AS norm, round(avg(sqrt(s)), 6) AS mean_norm FROM (SELECT label, list_sum(list_transform(v, lambda x: x * x)) AS s FROM {_V}) GROUP BY label"),
    "param_counts": (
        param_counts,
        "SELECT k, 28 * 32 * k AS conv1, (288 * k + 1) * 64 * k AS conv2, (2304 * k + 1) * 128 * k AS dense1, 28 * 32 * k + (288 * k + 1) * 64 * k + (2304 * k + 1) * 128 * k + (128 * k + 1) * 64 * k + (64 * k + 1) * 10 AS total FROM (SELECT range AS k FROM range(1, 101))",
    ),
    "ema_by_user": (
        ema_by_user,
        "SELECT user_id, n, " + _steady_sql("sum(value * pow(CAST(0.99 AS DOUBLE), n - i) * CASE WHEN i = 1 THEN CAST(1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) - CAST(0.99 AS DOUBLE) END)") + " FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) GROUP BY user_id, n",
    ),
    "ema_steps": (
        ema_steps,
        "WITH r AS (SELECT event_id, user_id, CAST(value AS DOUBLE) AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events) SELECT a.event_id, " + _steady_sql("sum(b.value * pow(CAST(0.99 AS DOUBLE), a.i - b.i) * CASE WHEN b.i = 1 THEN CAST(1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) - CAST(0.99 AS DOUBLE) END)") + " FROM r a JOIN r b ON a.user_id = b.user_id AND b.i <= a.i GROUP BY a.event_id",
    ),
    "resumed_ema": (
        resumed_ema,
        "WITH r AS (SELECT event_id, user_id, CAST(value AS DOUBLE) AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, " + _steady_sql("sum(value * pow(CAST(0.99 AS DOUBLE), n - i) * CASE WHEN i = 1 THEN CAST(1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) - CAST(0.99 AS DOUBLE) END)") + ", max(event_id) AS last FROM r GROUP BY user_id",
    ),
    "running_metrics": (running_metrics, "SELECT event_id, row_number() OVER w AS step, avg(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"),
    "checkpoint_steps": (checkpoint_steps, "SELECT event_id, user_id FROM events WHERE event_id % 100 = 0 AND event_id > 0"),
    "lr_schedule_abs": (
        lr_schedule_abs,
        "SELECT event_id AS step, round(CASE WHEN least(event_id, 1999) < 100 THEN CAST(3e-4 AS DOUBLE) * (least(event_id, 1999) + 1) / 100 ELSE CAST(3e-4 AS DOUBLE) * 0.05 + CAST(3e-4 AS DOUBLE) * 0.95 * 0.5 * (1 + cos(pi() * (least(event_id, 1999) - 100) / 1900)) END, 10) AS rate FROM events",
    ),
    "lr_schedule_mult": (lr_schedule_mult, "SELECT event_id AS step, round(CASE WHEN event_id < 20 THEN CAST(event_id AS DOUBLE) / 20 ELSE 0.05 + CAST(0.95 AS DOUBLE) * 0.5 * (1 + cos(pi() * (event_id - 20) / 1980)) END, 8) AS rate FROM events"),
    "activations": (
        activations,
        f"WITH x AS (SELECT vec_id, CAST(r.range AS INT) AS place, v[r.range + 1] AS x, sqrt(CAST(2 AS DOUBLE) / pi()) AS k FROM {_V}, range(64) r), g AS (SELECT *, tanh(x) AS th, tanh(k * (x + CAST(0.044715 AS DOUBLE) * x * x * x)) AS t, 1 / (1 + exp(-x)) AS s FROM x) SELECT vec_id, place, round(x, 6) AS linear, round(s, 6) AS sigmoid, round(greatest(x, 0), 6) AS relu, round(th, 6) AS tanh, round(0.5 * x * (1 + t), 6) AS gelu, CAST(1 AS DOUBLE) AS linear_slope, round(s * (1 - s), 6) AS sigmoid_slope, CASE WHEN x > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS relu_slope, round(1 - th * th, 6) AS tanh_slope, round(0.5 * (1 + t) + 0.5 * x * (1 - t * t) * k * (1 + 3 * CAST(0.044715 AS DOUBLE) * x * x), 6) AS gelu_slope FROM g",
    ),
    "softmax_rows": (softmax_rows, f"SELECT vec_id, {_fmt('p')} AS p FROM {_P}"),
    "one_hot_labels": (one_hot_labels, "SELECT vec_id, array_to_string(list_transform(range(10), lambda i: CASE WHEN i = label THEN '1' ELSE '0' END), '') AS bits FROM embeddings"),
    "pixels": (pixels, f"SELECT vec_id, array_to_string(list_transform(v, lambda x: CAST(CAST(floor(greatest(CAST(0 AS DOUBLE), least(CAST(255 AS DOUBLE), round(x, 3) * 255))) AS INT) AS VARCHAR)), ' ') AS pixels FROM {_V}"),
    "greedy_tokens": (greedy_tokens, f"SELECT vec_id, CAST(list_position(v, list_max(v)) - 1 AS INT) AS token FROM {_V}"),
    "sampled_tokens": (
        sampled_tokens,
        f"WITH e AS (SELECT vec_id, list_transform(w, lambda x: exp((x - list_max(w)) / CAST(0.8 AS DOUBLE))) AS e FROM (SELECT vec_id, v AS w FROM {_V})) SELECT vec_id, CAST(len(list_filter(range(1, 64), lambda i: list_sum(list_slice(e, 1, i)) / list_sum(e) <= {_uniform("'9:' || vec_id")})) AS INT) AS token FROM e",
    ),
    "dropout_mask": (dropout_mask, f"SELECT vec_id, CAST(r.range AS INT) AS place, round(CASE WHEN {_uniform("'13:' || vec_id || ':' || r.range")} < 0.75 THEN v[r.range + 1] / CAST(0.75 AS DOUBLE) ELSE 0 END, 6) AS x FROM {_V}, range(64) r"),
    "squared_errors": (
        squared_errors,
        f"SELECT vec_id, round(list_sum(list_transform(d, lambda x: x * x)) / 64, 6) AS mse, {_fmt('list_transform(d, lambda x: 2 * x)')} AS gradient FROM (SELECT vec_id, list_transform(range(64), lambda i: p[i + 1] - CASE WHEN i = label THEN 1 ELSE 0 END) AS d FROM {_P})",
    ),
    "cross_entropies": (
        cross_entropies,
        f"SELECT round(avg(-ln(p[label + 1])), 6) AS dense, round(avg(-ln(p[label + 1])), 6) AS sparse FROM {_P}",
    ),
    "entropy_gradients": (entropy_gradients, f"SELECT vec_id, {_fmt('list_transform(range(64), lambda i: (p[i + 1] - CASE WHEN i = label THEN 1 ELSE 0 END) / 4)')} AS gradient FROM {_P}"),
    "sgd_step": (sgd_step, f"SELECT vec_id, {_fmt('list_transform(range(1, 65), lambda i: p[i] - CAST(0.1 AS DOUBLE) * g[i])')} AS p FROM {_STEP}"),
    "adam_step": (adam_step, f"SELECT vec_id, {_fmt('list_transform(range(1, 65), lambda i: p[i] - CAST(0.01 AS DOUBLE) * ' + _ADAM.format('g[i]') + ')')} AS p FROM {_STEP}"),
    "adamw_step": (adamw_step, f"SELECT vec_id, {_fmt('list_transform(range(1, 65), lambda i: p[i] * CAST(0.999 AS DOUBLE) - CAST(0.01 AS DOUBLE) * ' + _ADAM.format('g[i]') + ')')} AS p FROM {_STEP}"),
    "clipped_gradients": (clipped_gradients, f"SELECT vec_id, {_fmt('list_transform(g, lambda x: x * least(CAST(1 AS DOUBLE), 1 / (n + 1e-6)))')} AS g FROM (SELECT vec_id, g, sqrt(list_sum(list_transform(g, lambda x: x * x))) AS n FROM {_STEP})"),
    "clipped_together": (clipped_together, f"SELECT vec_id, {_fmt('list_transform(g, lambda x: x * least(CAST(1 AS DOUBLE), 5 / (n + 1e-6)))', 9)} AS g FROM {_STEP}, (SELECT sqrt(sum(list_sum(list_transform(v, lambda x: x * x)))) AS n FROM {_V})"),
    "causal_mask": (causal_mask, "SELECT conv_id, turn, repeat('1', CAST(least(turn + 1, 16) AS INT)) || repeat('0', CAST(greatest(15 - turn, 0) AS INT)) AS mask FROM conversations"),
    "layer_norms": (layer_norms, f"SELECT vec_id, {_fmt('list_transform(w, lambda x: (x - m) / sqrt(s + 1e-5))', 5)} AS normed FROM (SELECT *, list_sum(list_transform(w, lambda x: (x - m) * (x - m))) / 64 AS s FROM {_X8})"),
    "rms_norms": (rms_norms, f"SELECT vec_id, {_fmt('list_transform(w, lambda x: x / sqrt(q + 1e-5))', 5)} AS normed FROM {_X8}"),
    "rotary": (
        rotary,
        f"SELECT vec_id, {_fmt('list_transform(range(64), lambda i: CASE WHEN i % 2 = 0 THEN w[i + 1] * cos((vec_id % 32) / pow(CAST(10000 AS DOUBLE), 2 * (i // 2) / CAST(64 AS DOUBLE))) - w[i + 2] * sin((vec_id % 32) / pow(CAST(10000 AS DOUBLE), 2 * (i // 2) / CAST(64 AS DOUBLE))) ELSE w[i + 1] * cos((vec_id % 32) / pow(CAST(10000 AS DOUBLE), 2 * (i // 2) / CAST(64 AS DOUBLE))) + w[i] * sin((vec_id % 32) / pow(CAST(10000 AS DOUBLE), 2 * (i // 2) / CAST(64 AS DOUBLE))) END)', 5)} AS turned FROM {_X8}",
    ),
    "sliding_windows": (sliding_windows, f"SELECT vec_id, CAST(r.range AS INT) AS place, round(v[2 * r.range + 1] + v[2 * r.range + 2] + v[2 * r.range + 3] + v[2 * r.range + 4], 6) AS total FROM {_V}, range(31) r"),
    "convolution_1d": (convolution_1d, f"SELECT vec_id, {_fmt('list_transform(range(1, 63), lambda i: CAST(0.25 AS DOUBLE) * v[i] + CAST(0.5 AS DOUBLE) * v[i + 1] - CAST(0.25 AS DOUBLE) * v[i + 2])', 5)} AS y FROM {_V}"),
    "pooled": (pooled, f"SELECT vec_id, {_fmt('list_transform(range(16), lambda i: list_max(list_slice(v, 4 * i + 1, 4 * i + 4)))')} AS most, round(list_sum(v) / 64, 6) AS mean FROM {_V}"),
    "dense_forward": (dense_forward, f"SELECT vec_id, {_fmt('list_transform(range(4), lambda j: greatest(CAST(0 AS DOUBLE), list_sum(list_transform(range(64), lambda i: w[i + 1] * sin(CAST(i * 4 + j + 1 AS DOUBLE))))))', 5)} AS y FROM {_X8}"),
    "attention_scores": (
        attention_scores,
        f"WITH r AS (SELECT vec_id // 8 AS seq, vec_id % 8 AS place, v FROM {_V}), s AS (SELECT a.seq, a.place, b.place AS key, list_sum(list_transform(range(1, 65), lambda i: a.v[i] * b.v[i])) * {_SHARP} AS s FROM r a JOIN r b ON a.seq = b.seq AND b.place <= a.place), e AS (SELECT seq, place, key, exp(s - max(s) OVER (PARTITION BY seq, place)) AS e FROM s) SELECT seq, place, key, round(e / sum(e) OVER (PARTITION BY seq, place), 6) AS weight FROM e",
    ),
    "residual_sum": (residual_sum, f"SELECT vec_id, {_fmt('list_transform(w, lambda x: x + (x - m) / sqrt(s + 1e-5))', 5)} AS y FROM (SELECT *, list_sum(list_transform(w, lambda x: (x - m) * (x - m))) / 64 AS s FROM {_X8})"),
    "embedding_gradient": (embedding_gradient, f"SELECT vec_id % 7 AS token, CAST(r.range AS INT) AS place, round(sum(v[r.range + 1]), 5) AS g FROM {_V}, range(64) r GROUP BY 1, 2"),
    "augmented_images": (
        augmented_images,
        f"""WITH r AS (SELECT vec_id, v, {_uniform("'21:' || vec_id")} < 0.5 AS flip, CAST(floor({_uniform("'22:' || vec_id")} * 5) AS BIGINT) AS top, CAST(floor({_uniform("'23:' || vec_id")} * 5) AS BIGINT) AS "left" FROM {_V}),
        p AS (SELECT vec_id, flip, top, "left", v, i.range // 8 + top - 2 AS y, CASE WHEN flip THEN 7 - (i.range % 8 + "left" - 2) ELSE i.range % 8 + "left" - 2 END AS x FROM r, range(64) i)
        SELECT vec_id, flip, top, "left", round(sum(CASE WHEN x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7 THEN v[y * 8 + x + 1] ELSE 0 END), 5) AS total FROM p GROUP BY ALL""",
    ),
    "train_steps": (train_steps, None),
    "predictions": (predictions, _LOGITS),
    "loaded_predictions": (loaded_predictions, _LOGITS),
    "image_layers": (
        image_layers,
        f"""WITH p AS (SELECT vec_id, o.range // 8 AS y, o.range % 8 AS x, greatest(CAST(0 AS DOUBLE), list_sum(list_transform(range(9), lambda k: {_KERNEL}[k + 1] * CASE WHEN o.range // 8 + k // 3 - 1 BETWEEN 0 AND 7 AND o.range % 8 + k % 3 - 1 BETWEEN 0 AND 7
        THEN v[(o.range // 8 + k // 3 - 1) * 8 + o.range % 8 + k % 3 - 1 + 1] ELSE 0 END))) AS z FROM {_V}, range(64) o),
        m AS (SELECT vec_id, y // 2 AS y, x // 2 AS x, max(z) AS z FROM p GROUP BY ALL) SELECT vec_id, {_fmt('list(z ORDER BY y, x)', 5)} AS y FROM m GROUP BY vec_id""",
    ),
    "pooled_images": (pooled_images, f"SELECT vec_id, round(list_sum(v) / 64, 6) AS mean FROM {_V}"),
    "attention_outputs": (
        attention_outputs,
        f"""WITH x AS (SELECT vec_id, s.range AS t, list_slice(v, 8 * s.range + 1, 8 * s.range + 8) AS x FROM {_V}, range(8) s),
        p AS (SELECT vec_id, t, {_product('x', 8, 8)} AS q, {_product('x', 8, 8, 1)} AS k, {_product('x', 8, 8, 2)} AS w FROM x),
        s AS (SELECT a.vec_id, a.t, h.range AS h, list_sum(list_transform(range(1, 5), lambda i: a.q[4 * h.range + i] * b.k[4 * h.range + i])) / 2 AS s, b.w FROM p a JOIN p b ON a.vec_id = b.vec_id AND b.t <= a.t, range(2) h),
        e AS (SELECT vec_id, t, h, w, exp(s - max(s) OVER (PARTITION BY vec_id, t, h)) AS e FROM s),
        m AS (SELECT vec_id, t, h, c.range AS c, sum(e * w[4 * h + c.range + 1]) / sum(e) AS m FROM e, range(4) c GROUP BY ALL),
        j AS (SELECT vec_id, t, list(m ORDER BY h, c) AS m FROM m GROUP BY vec_id, t),
        o AS (SELECT vec_id, t, {_product('m', 8, 8, 3)} AS o FROM j)
        SELECT vec_id, {_fmt('flatten(list(o ORDER BY t))', 5)} AS y FROM o GROUP BY vec_id""",
    ),
    "perceptron_outputs": (
        perceptron_outputs,
        f"""WITH x AS (SELECT vec_id, s.range AS t, list_transform(range(8), lambda i: v[8 * s.range + i + 1] + sin(CAST(8 * s.range + i + 1 AS DOUBLE))) AS x FROM {_V}, range(8) s),
        z AS (SELECT vec_id, t, {_product('x', 8, 16, 1)} AS z FROM x),
        h AS (SELECT vec_id, t, list_transform(z, lambda a: 0.5 * a * (1 + tanh(sqrt(CAST(2 AS DOUBLE) / pi()) * (a + CAST(0.044715 AS DOUBLE) * a * a * a)))) AS h FROM z),
        d AS (SELECT vec_id, t, {_product('h', 16, 8, 2)} AS d FROM h),
        o AS (SELECT vec_id, t, {_product('d', 8, 4, 3)} AS o FROM d)
        SELECT vec_id, {_fmt('flatten(list(o ORDER BY t))', 5)} AS y FROM o GROUP BY vec_id""",
    ),
    "tied_logits": (tied_logits, f"SELECT vec_id, {_fmt('list_transform(range(10), lambda k: list_sum(list_transform(range(4), lambda i: sin(CAST(label * 4 + i + 1 AS DOUBLE)) * sin(CAST(k * 4 + i + 1 AS DOUBLE)))))', 5)} AS y FROM embeddings"),
    "gradient_step": (
        gradient_step,
        f"""WITH z AS (SELECT label, v, {_product('v', 64, 10)} AS z FROM {_V}), e AS (SELECT label, v, list_transform(z, lambda a: exp(a - list_max(z))) AS e FROM z),
        d AS (SELECT list_append(v, CAST(1 AS DOUBLE)) AS v, list_transform(range(10), lambda k: e[k + 1] / list_sum(e) - CASE WHEN k = label THEN 1 ELSE 0 END) AS d FROM e)
        SELECT CAST(i.range AS INT) AS place, CAST(k.range AS INT) AS class, round(CASE WHEN i.range < 64 THEN sin(CAST(i.range * 10 + k.range + 1 AS DOUBLE)) ELSE 0 END - CAST(0.1 AS DOUBLE) * avg(v[i.range + 1] * d[k.range + 1]), 6) AS weight
        FROM d, range(65) i, range(10) k GROUP BY i.range, k.range""",
    ),
    "size_sweep": (size_sweep, None),
    "generated_tokens": (generated_tokens, None),
}
