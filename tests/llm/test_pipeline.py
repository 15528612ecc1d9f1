import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from corpusloom.llm import exact_dedup
from corpusloom.llm.queries import tokenizer_path
from tests.llm.cases import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _docs():
    rng = random.Random(9)
    base = [f"w{rng.randrange(9000)}" for _ in range(120)]
    near = base.copy()
    near[50] = "changed"
    far = base.copy()
    far[::7] = ["x"] * len(far[::7])
    rows = [(k, prose(rng, 40), "en", f"s{k % 4}") for k in range(10, 30)]
    rows += [(1, " ".join(base), "en", "s1"), (2, " ".join(near), "en", "s2"), (3, " ".join(far), "en", "s3"), (4, "\n".join(base), "en", "s1"), (5, " ".join(base) + " \n ", "en", "s1")]
    rows += [(6, None, "en", "s1"), (7, "", "en", "s1"), (8, "123 456 !!", "en", "s1"), (9, "12 34", None, "s1")]
    rows += [(40, prose(rng, 30) + " token = 0123456789abcdef0123456789abcdef " + prose(rng, 30), "en", "s1")]
    rows += [(41 + k, prose(rng, 30) + " password=EXAMPLEEXAMPLE1 " + prose(rng, 30), "en", f"s{k}") for k in range(4)]
    rows += [(50, prose(rng, 20), "en", "s1")] * 2
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


#: Columns besides the documents' own, with names that the stages use inside.
CLASHING = "_own_0 string, _own_1 long, _text_hash string, _node long, spans string, k1 long, id string, text_hash long, `a.b` string, kept boolean"
_OTHERS = ("o", 1, "h", 2, "s", 3, "i", 4, "d", True)


def _run(spark, stage, rows, clash=False):
    wide = [(*r, *_OTHERS) for r in rows] if clash else rows
    docs = spark.createDataFrame(wide, f"{SCHEMA}, {CLASHING}" if clash else SCHEMA)
    out = stage(spark, docs.repartition(3, "source"), "")
    return out.columns, [tuple(r) for r in out.collect()]


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_stages_keep_columns_whatever_their_names(spark, name, stage):
    rng = random.Random(3)
    rows = [*_docs(), (60, prose(rng, 60_000), "en", "s1", None), (None, prose(rng, 30), None, None, None), (61, "token=0a1b2c3d4e5f6071 " * 400, "en", "s2", 1)]
    columns, plain = _run(spark, stage, rows)
    wide_columns, wide = _run(spark, stage, rows, clash=True)
    if name == "packing":
        assert wide_columns == columns and collections.Counter(r[:5] for r in wide) == collections.Counter(r[:5] for r in plain)
    else:
        assert wide_columns == columns + [c.split()[0].strip("`") for c in CLASHING.split(", ")]
        assert collections.Counter(wide) == collections.Counter((*r, *_OTHERS) for r in plain)


def test_language_stage_drops_what_is_of_no_language(spark):
    rng = random.Random(8)
    noise = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n))
    rows = [(k, prose(rng, 60), "en", "a", 1) for k in range(100)]
    odd = [(200 + k, noise("qxzjkwvbp", n), None, "a", 1) for k, n in enumerate((20, 50, 300))] + [(210, noise("абвгдежзиклмн", 80), None, "a", 1)]
    _, got = _run(spark, P.identify_language, rows + odd)
    assert sorted(r[0] for r in got) == list(range(100))


def test_near_stage_keeps_one_of_rows_that_repeat(spark):
    rng = random.Random(4)
    rows = [(7, prose(rng, 50), "en", "s1", 1)] * 3 + [(8, prose(rng, 50), "en", "s1", 1)]
    _, got = _run(spark, P.drop_near_copies, rows)
    assert sorted(r[0] for r in got) == [7, 8]


def test_language_stage_drops_only_texts_without_a_language(spark):
    columns, got = _run(spark, P.identify_language, _docs())
    assert columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert collections.Counter(got) == collections.Counter(r for r in _docs() if r[0] not in (6, 7, 8, 9))


def test_exact_stage_keeps_one_row_of_equal_texts(spark):
    columns, got = _run(spark, P.drop_exact_copies, _docs())
    groups = collections.defaultdict(list)
    for r in _docs():
        groups[(r[1] or "").translate(str.maketrans("", "", exact_dedup.IGNORED))].append((-len(r[1] or ""), r[0]))
    assert sorted(r[0] for r in got) == sorted(min(g)[1] for g in groups.values()) and len(columns) == 5
    assert set(got) <= set(_docs())


def test_near_stage_keeps_one_of_each_group(spark):
    rows = [r for r in _docs() if r[0] not in (4, 5, 6, 7)][:-1]
    _, got = _run(spark, P.drop_near_copies, rows)
    shingles = lambda t: {tuple((t or "").lower().split()[k : k + 5]) for k in range(max(1, len((t or "").split()) - 4))}
    sets = {r[0]: shingles(r[1]) for r in rows}
    gone = {b for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert gone == {2}
    assert sorted(r[0] for r in got) == sorted(set(sets) - gone)


def test_stages_agree_where_keys_are_too_many_to_send(spark, monkeypatch):
    few = [sorted(_run(spark, stage, _docs())[1], key=repr) for stage in (P.drop_exact_copies, P.drop_near_copies)]
    monkeypatch.setattr(P.scratch, "few_or_merged", lambda keys: keys.hint("merge"))
    assert [sorted(_run(spark, stage, _docs())[1], key=repr) for stage in (P.drop_exact_copies, P.drop_near_copies)] == few
    monkeypatch.undo()
    keys = P.scratch.materialize(spark.range(5).toDF("k"), "keys")
    for most in (4, 5):
        assert spark.range(9).join(P.scratch.few_or_merged(keys, most), F.col("id") == F.col("k"), "left_anti").count() == 4


def test_secret_stage_masks_live_values_only(spark):
    rows = [r for r in _docs() if r[0] not in (6,)][:-1] + [(70 + k, f"password = {word}", "en", "s1", 20) for k, word in enumerate(("changeme", "undefined", "yourpassword"))]
    _, got = _run(spark, P.mask_secrets, rows)
    before, after = {r[0]: r for r in rows}, {r[0]: r for r in got}
    assert after.keys() == before.keys()
    changed = {i for i in before if before[i] != after[i]}
    assert changed == {40}
    assert after[40][1] == before[40][1].replace("0123456789abcdef0123456789abcdef", "[SECRET]") and after[40][4] == len(after[40][1])


def test_packing_stage_packs_every_id(spark):
    from tokenizers import Tokenizer

    _, got = _run(spark, P.pack_sequences, _docs())
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    expected = collections.Counter()
    for i, t, *_ in _docs():
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        expected[i, 0, len(ids), zlib.crc32(ids.tobytes()), len(ids)] += 1
    # Nothing has to be cut here: all fits into one sequence, or the texts are short.
    assert collections.Counter(r[:5] for r in got) == expected


def test_stages_run_one_after_another(spark, tmp_path):
    spark.createDataFrame(_docs(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    ids = sorted({r.doc_id for r in P.run(spark, str(tmp_path)).collect()})
    # 5 is the longest of its exact copies, and 2 a near copy of it with a smaller id.
    assert ids == sorted({2, 3, *range(10, 30), 40, 41, 42, 43, 44, 50})


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_stages_take_an_empty_table(spark, name, stage):
    assert _run(spark, stage, [])[1] == []


def test_contract():
    assert [n for n, _ in P.STAGES] == ["language", "exact_dedup", "near_dedup", "secrets", "packing"] and P.ORACLE_SQL is None
