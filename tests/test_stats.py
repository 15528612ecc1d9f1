"""Regression, Student's t, series and files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import stats
from corpusloom.functions import vectors as V
from corpusloom.operators import telemetry, tokens
from corpusloom.sources import files


def test_line_through_five_points(spark):
    # The points of the example and its line.
    df = spark.createDataFrame(list(zip([0.011, 0.045, 0.117, 0.161, 0.203], [0.20, 0.40, 1.20, 1.60, 2.00])), "x double, y double")
    for fit in (telemetry.projection_fit(df, "x", "y").first(), telemetry.regression(df, "x", "y").first()):
        assert fit.slope == pytest.approx(9.6571139369) and fit.intercept == pytest.approx(0.0428259632)


def test_regression_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(1e6, 5e7, 60)
    y = 0.75 + 1e-9 * x + rng.normal(0, 0.02, 60)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    fit = telemetry.slope_test(telemetry.regression(df, "x", "y", 1e7)).first()
    slope, intercept = np.polyfit(x / 1e7, y, 1)
    left = y - slope * x / 1e7 - intercept
    s = np.sqrt((left**2).sum() / 58)
    se = s / np.sqrt(((x / 1e7 - (x / 1e7).mean()) ** 2).sum())
    assert (fit.slope, fit.intercept, fit.s, fit.stderr, fit.t) == pytest.approx((slope, intercept, s, se, slope / se))
    assert fit.s_reported == pytest.approx(np.sqrt(se**2 * 58 / 59))
    assert (fit.ci_low, fit.ci_high) == pytest.approx((slope - 2.0017174830 * se, slope + 2.0017174830 * se))


def test_student_t():
    # Known quantiles of the distribution.
    for p, df, t in ((0.975, 1, 12.7062047362), (0.975, 10, 2.2281388520), (0.95, 5, 2.0150483733), (0.995, 30, 2.7499956536)):
        assert stats.t_quantile(p, df) == pytest.approx(t, rel=1e-8)
        assert stats.t_upper(t, df) == pytest.approx(1 - p, rel=1e-7)
    assert stats.t_upper(0, 7) == pytest.approx(0.5) and stats.t_upper(-2.0, 7) == pytest.approx(1 - stats.t_upper(2.0, 7))


def test_histogram_includes_the_upper_edge(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 10)], "v double")
    assert [r.n for r in telemetry.histogram(df, "v", 5).orderBy("bin").collect()] == [2, 1, 0, 0, 1]
    assert [r.n for r in telemetry.histogram(df.where("v = 1"), "v", 3).orderBy("bin").collect()] == [1, 0, 0]


def test_moving_average_resumes(spark):
    values = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0]
    rows = [(1, k, v) for k, v in enumerate(values)] + [(2, 0, 7.0)]
    df = spark.createDataFrame(rows, "k long, t long, v double")
    expected = values[0]
    for v in values[1:]:
        expected = 0.99 * expected + 0.01 * v
    assert {r.k: r.ema for r in telemetry.final_ema(df, "k", ("t",), "v").collect()} == {1: pytest.approx(expected), 2: 7.0}
    early = telemetry.final_ema(df.where("t < 3"), "k", ("t",), "v").collect()
    late = telemetry.ema(df.where("t >= 3"), "k", ("t",), "v", seeds={r.k: r.ema for r in early})
    assert late.orderBy(F.desc("t")).first().ema == pytest.approx(expected)


def test_schedules(spark):
    df = spark.createDataFrame([(s,) for s in (0, 9, 10, 99, 100, 500)], "s long")
    absolute = [r[0] for r in df.select(V.rate_absolute(F.col("s"), 100, 1.0, 10, 0.1)).collect()]
    assert absolute[:3] == pytest.approx([0.1, 1.0, 1.0]) and absolute[3] == absolute[4] == absolute[5]
    factor = [r[0] for r in df.select(V.rate_multiplier(F.col("s"), 100, 10, 0.05)).collect()]
    assert factor[0] == 0 and factor[4] == pytest.approx(0.05) and factor[5] != factor[4]


def test_window_starts_stay_below_the_last(spark):
    df = spark.createDataFrame([(k, list(range(18))) for k in range(200)] + [(999, list(range(17)))], "id long, tokens array<int>")
    got = tokens.windows(df, 16, 2, "id", 3).collect()
    assert len(got) == 400 and {r.start for r in got} == {0} and all(r.y == [v + 1 for v in r.x] for r in got)


def test_corpus_files(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    df = spark.createDataFrame([("a\nb ", "train"), (" c", "val"), ("d", "train")], "text string, split string")
    files.write_corpus(df, path)
    assert sorted((r.text, r.split) for r in files.read_corpus(spark, path).collect()) == [("a\nb", "train"), ("c", "val"), ("d", "train")]
    found, missing = files.existing(spark, [path, f"file://{tmp_path}/none"])
    assert (found, missing) == ([path], [f"file://{tmp_path}/none"])


def test_retries():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 6:
            raise OSError
        return "done"

    assert files.with_retries(flaky, 8, 2.0, waits.append) == "done" and waits == [2, 4, 8, 16, 16]
    with pytest.raises(RuntimeError):
        files.with_retries(lambda: 1 / 0, 2, 1.0, waits.append)


def test_sentencepiece_symbols_are_single_pieces(spark):
    df = spark.createDataFrame([("the quick brown fox jumps over the lazy dog " * 20,)], "text string")
    model = tokens.train_sentencepiece(df, vocab_size=400)
    tokens.check_symbols(model)
    ids = tokens.encode_lines(spark.createDataFrame([(1, "the fox\nthe dog"), (2, None)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    joined = tokens.encode_lines(spark.createDataFrame([(1, "the fox"), (2, "the dog")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert ids[0].tokens == joined[0].tokens + joined[1].tokens and ids[1].tokens == []
    with pytest.raises(ValueError):
        tokens.check_symbols(model, ("zzzzqqq",))


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_sentencepiece_trains_without_words_on_the_driver(spark, kind, monkeypatch):
    """No table of words is fetched, every word counts, and texts come back whole; unknown characters too."""
    from pyspark.sql.classic.dataframe import DataFrame

    def fetched(*_, **__):
        raise AssertionError("words reach the driver")

    monkeypatch.setattr(DataFrame, "toLocalIterator", fetched)
    monkeypatch.setattr(DataFrame, "toPandas", fetched)
    texts = ["lower lowest slower " * 30 + "[INST] 2024 x1", "newer newest " * 50 + "wide", "aaaa aaa banana", None, "rare \u4e2d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = tokens.train_sentencepiece(docs, vocab_size=320, kind=kind)
    got = tokens.decode_lines(tokens.encode_lines(docs, model), model).orderBy("doc_id").collect()
    assert [r.decoded for r in got] == [t or "" for t in texts]
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
    assert pieces.vocab_size() <= 320 and len(pieces.encode(" newest")) <= 2 and len(pieces.encode(" lower")) <= 2


def test_pieces_merge_as_in_a_plain_loop(spark, monkeypatch):
    """With one merge a round the pieces are those of byte-pair encoding word by word."""
    from corpusloom.operators import subwords

    monkeypatch.setattr(subwords, "SHARE", 1.0)
    rng = np.random.default_rng(4)
    words = {subwords.SPACE + "".join(rng.choice(list("abcd"), rng.integers(1, 7))): int(rng.integers(1, 1000)) for _ in range(60)}
    df = spark.createDataFrame(list(words.items()), "w string, n long").repartition(3)
    split, expected = {w: list(w) for w in words}, []
    for _ in range(12):
        counts = {}
        for w, parts in split.items():
            for pair in zip(parts, parts[1:]):
                counts[pair] = counts.get(pair, 0) + words[w]
        best = max(counts, key=counts.get)
        expected.append("".join(best))
        for w, parts in split.items():
            out = []
            while parts:
                hit = tuple(parts[:2]) == best
                out.append("".join(parts[: 2 if hit else 1]))
                parts = parts[2 if hit else 1 :]
            split[w] = out
    found, chars = subwords.merges(df, 12 + 5, 1.0)
    assert [p for p, _ in found] == expected and {c for c, _ in chars} == set("abcd" + subwords.SPACE)


def test_words_are_decoded_over_chunks(spark):
    texts = [None, "", " \n", "a b  a", "c", "b c\na", "z unknown a", *(f"w{i % 7} w{i} " * 5 for i in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    vocab = tokens.vocabulary(docs).where("piece <> 'unknown'").localCheckpoint()
    rows, words = tokens.encode(docs, vocab, chunk_bytes=300)
    rows, words = rows.localCheckpoint(), words.localCheckpoint()
    assert rows.select("chunk").distinct().count() > 3
    # Each distinct word is one row a chunk, not one a document.
    split = {r.doc_id: r.chunk for r in rows.collect()}
    expected = {(split[i], w) for i, t in enumerate(texts) for w in (t or "").split()}
    assert words.count() == len(expected) < sum(len(set((t or "").split())) for t in texts)
    assert [r.id for r in words.collect()].count(None) == 1
    got = {r.doc_id: r.decoded for r in tokens.decode(rows, words, vocab).collect()}
    assert got == {i: " ".join(w for w in (t or "").split() if w != "unknown") for i, t in enumerate(texts)}
    none = docs.where("doc_id < 0")
    assert tokens.decode(*tokens.encode(none, vocab), vocab).count() == 0
    blank = docs.where("doc_id < 3")
    assert [r.decoded for r in tokens.decode(*tokens.encode(blank, vocab), vocab).collect()] == ["", "", ""]
