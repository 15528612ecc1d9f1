"""Edge rows of cleaning, gating, chat rendering, mixing and budgets."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import corpus
from corpusloom.operators.ordered import running

CLEAN = [
    (None, ""),
    ("a\rb", "ab"),
    ("a\r\nb", "a\nb"),
    ("x  \n y", "x\ny"),
    ("a\u001cb\u0000c\u0008d", "abcd"),
    ("ﬁ ①", "fi 1"),
    ("  a \t b  ", "a b"),
    ("a\n\n\n\nb\n \n \n\nc", "a\n\nb\n\nc"),
    ("  a \u0085\nb ", "a\nb"),
    ("ＡＢ　Ｃ", "AB C"),
    ("tab\tin\x0bside\x0c", "tab inside"),
]


@pytest.mark.parametrize("text, expected", CLEAN)
def test_clean_text(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(T.clean_text(F.col("t"))).first()[0] == expected


def test_clean_text_cuts_at_a_word(spark):
    df = spark.createDataFrame([("aaa bbb ccc",), ("aaaaaaaaaaaa",), ("aaa bbbb",), ("aaaaaaa b",)], "t string")
    assert [r[0] for r in df.select(T.clean_text(F.col("t"), 8)).collect()] == ["aaa bbb", "aaaaaaaa", "aaa bbbb", "aaaaaaa"]


def _words(n, distinct):
    return " ".join(f"wordy{k % distinct:02d}x" for k in range(n))


QUALITY = [
    ("w" * 179, "short"),
    ("w" * 180, "words"),
    ("ab345 " * 44 + "c", "letters"),
    ("a" * 45 + "1" * 55 + "a" * 45 + "1" * 55, "words"),
    ("a" * 89 + "1" * 111, "letters"),
    (_words(34, 34), "words"),
    (_words(35, 35), "keep"),
    (_words(81, 14), "repeats"),
    (_words(80, 14), "keep"),
    (_words(100, 18), "keep"),
    (_words(100, 17), "repeats"),
    (_words(40, 40) + " Click HERE", "keep"),
    (_words(40, 40) + " Click HERE and Cookie Policy", "junk"),
]


@pytest.mark.parametrize("text, reason", QUALITY)
def test_quality_gate(spark, text, reason):
    assert corpus.judged(spark.createDataFrame([(text,)], "text string")).first().reason == reason


def test_roles(spark):
    df = spark.createDataFrame([(r,) for r in ("Human ", "prompter", "GPT", "bot", "assistant", "System", None, " Tool")], "r string")
    assert [r[0] for r in df.select(T.normalise_role(F.col("r"))).collect()] == ["user", "user", "assistant", "assistant", "assistant", "system", "", "tool"]


def test_pair_limits(spark):
    render = lambda u, a, s="": spark.range(1).select(T.render_pair(F.lit(u), F.lit(a), F.lit(s))).first()[0]
    frame = len("[INST]  [/INST] ")
    assert render("", "a" * 50) == "" == render("a" * 50, "")
    assert render("u" * 20, "a" * (39 - frame - 20)) == ""
    assert render("u" * 20, "a" * (40 - frame - 20)) != ""
    assert len(render("u" * 20, "a" * (12000 - frame - 20))) == 12000
    assert render("u" * 20, "a" * (12001 - frame - 20)) == ""
    assert render("hello there", "general remark of length", "be kind") == "[INST] <<SYS>>\nbe kind\n<</SYS>>\n\nhello there [/INST] general remark of length"


def _chat(spark, turns):
    rows = [(1, k, r, t) for k, (r, t) in enumerate(turns)]
    got = corpus.conversation_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    return got[0].rendered if got else None


LONG = "this is a sentence that is long enough"


def test_conversations(spark):
    end = "\n<|endoftext|>\n"
    pair = lambda u, a: f"[INST] {u} [/INST] {a}"
    assert _chat(spark, [("user", "first"), ("user", LONG), ("gpt", LONG)]) == pair(LONG, LONG) + end
    assert _chat(spark, [("assistant", LONG), ("user", LONG)]) is None
    assert _chat(spark, [("system", "s1"), ("system", "s2"), ("user", LONG), ("bot", LONG), ("system", "s3"), ("human", LONG), ("assistant", LONG)]) == pair(f"<<SYS>>\ns1\n\ns2\n<</SYS>>\n\n{LONG}", LONG) + "\n" + pair(LONG, LONG) + end
    # A pair that is too short uses up its question but not the system text.
    assert _chat(spark, [("user", "a"), ("assistant", "b"), ("system", "s"), ("assistant", LONG), ("user", LONG), ("assistant", LONG)]) == pair(f"<<SYS>>\ns\n<</SYS>>\n\n{LONG}", LONG) + end
    assert _chat(spark, [("user", LONG), ("user", "  "), ("tool", "x"), ("assistant", ""), ("assistant", LONG)]) == pair(LONG, LONG) + end
    assert _chat(spark, [("user", LONG), ("assistant", "x" * 13000)]) is None or len(_chat(spark, [("user", LONG), ("assistant", "x" * 13000)])) <= 12000


def test_gathered_system_text_is_cut_as_a_whole(spark):
    first, second = "w " * 3999 + "ww", "x" * 7001
    expected = f"[INST] <<SYS>>\n{first[: first.rfind(' ')]}\n<</SYS>>\n\n{LONG} [/INST] {LONG}\n<|endoftext|>\n"
    assert _chat(spark, [("system", first), ("system", second), ("user", LONG), ("assistant", LONG)]) == expected


def test_running_totals_with_one_hot_key(spark):
    """Four of five rows share a key; they are dealt over ranges by the tie."""
    from corpusloom.operators import ordered

    rows = [(0 if k % 5 else 1 + k, k, k % 7) for k in range(20_000)]
    df = spark.createDataFrame(rows, "key long, tie long, n long").repartition(4)
    got = {r.tie: (r.pos, r.before) for r in ordered.running(df, "key", F.col("n"), ties=("tie",)).collect()}
    before = 0
    for pos, (_, tie, n) in enumerate(sorted(rows)):
        assert got[tie] == (pos, before)
        before += n
    sizes = sorted(r["count"] for r in ordered.with_ranges(df, "key", 64, ("tie",)).groupBy("_range", "_part").count().collect())
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2]


def test_running_totals_with_a_hot_key_and_ties_of_text(spark):
    from corpusloom.operators import ordered

    rows = [(0 if k % 5 else 1 + k, f"document-{k * 7919 % 20_000:09d}", k % 7) for k in range(20_000)]
    df = spark.createDataFrame(rows, "key long, tie string, n long").repartition(4)
    got = {r.tie: (r.pos, r.before) for r in ordered.running(df, "key", F.col("n"), ties=("tie",)).collect()}
    before = 0
    for pos, (_, tie, n) in enumerate(sorted(rows)):
        assert got[tie] == (pos, before)
        before += n
    sizes = sorted(r["count"] for r in ordered.with_ranges(df, "key", 64, ("tie",)).groupBy("_range", "_part").count().collect())
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2]


def test_reply_pairs(spark):
    schema = "pos long, message_id string, parent_id string, role string, text string, lang string, deleted boolean, review_result boolean, rank string"
    rows = [
        (1, "p", None, "prompter", "old " + LONG, "en", None, None, None),
        (2, "a0", "p", "assistant", LONG, "en", False, True, None),
        (3, "p", None, "prompter", "new " + LONG, "en", False, None, None),
        (4, "a1", "p", "assistant", LONG, "en", None, None, "0"),
        (5, "a2", "p", "assistant", LONG, "en", None, None, "1"),
        (6, "a3", "p", "assistant", LONG, "en", None, None, "x"),
        (7, "a4", "p", "assistant", LONG, "en", True, None, None),
        (8, "a5", "p", "assistant", LONG, "en", None, False, None),
        (9, "a6", "p", "assistant", LONG, "de", None, None, None),
        (10, "a7", "q", "assistant", LONG, "en", None, None, None),
        (11, "q", None, "prompter", LONG, "en", None, None, None),
        (12, "", "p", "assistant", LONG, "en", None, None, None),
        (13, "a8", "p", "assistant", " ", "en", None, None, None),
    ]
    got = {r.pos: r.rendered for r in corpus.reply_pairs(spark.createDataFrame(rows, schema)).collect()}
    expected = lambda u: f"[INST] {u} {LONG} [/INST] {LONG}\n<|endoftext|>\n"
    assert got == {2: expected("old"), 4: expected("new"), 6: expected("new")}


def test_running_totals_match_a_loop(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(40), k, rng.randrange(100)) for k in range(500)]
    df = running(spark.createDataFrame(rows, "key long, id long, v long").repartition(7), "key", F.col("v"), ties=("id",), ranges=16)
    total = 0
    for place, (r, (_, i, v)) in enumerate(zip(sorted(df.collect(), key=lambda r: r.pos), sorted(rows))):
        assert (r.pos, r.id, r.before) == (place, i, total)
        total += v


def test_budget_stops_with_the_row_that_reaches_it(spark):
    df = spark.createDataFrame([(k, 10) for k in range(10)], "pos long, n long")
    kept = lambda target: corpus.budget(df, target, F.col("n")).count()
    assert [kept(x) for x in (0, 1, 10, 11, 95, 100, 1000)] == [0, 1, 1, 2, 10, 10, 10]


def test_mix_keeps_shares_and_uses_up_sources(spark):
    rows = [(k, "a") for k in range(300)] + [(1000 + k, "b") for k in range(30)] + [(2000, "off"), (2001, None)]
    got = [r.source for r in corpus.mix(spark.createDataFrame(rows, "doc_id long, source string"), {"a": 0.75, "b": 0.25, "off": 0.0}).orderBy("pos").collect()]
    assert len(got) == 330 and got[:100].count("b") == 25 and set(got[130:]) == {"a"}


def test_stratified_sample(spark):
    df = spark.createDataFrame([(k, k % 3) for k in range(100)] + [(200, 9)], "id long, label long")
    got = corpus.stratified(df, "label", 5, "id").groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {0: 5, 1: 5, 2: 5, 9: 1}


def test_elapsed(spark):
    df = spark.createDataFrame([(0.0,), (0.25,), (59.5,), (60.0,), (3600.0,), (3725.125,)], "s double")
    assert [r[0] for r in df.select(T.elapsed(F.col("s"))).collect()] == ["0.00ms", "250.00ms", "59s 500.00ms", "1m 0s 0.00ms", "1h 0m 0s 0.00ms", "1h 2m 5s 125.00ms"]
