"""Documents with every awkward case, and helpers."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau".split()

#: Columns besides the documents' own, with names that operators use inside.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, key string, rid long, id string, norm string, bucket long, fp long, hashes string, h string, u long, kept boolean, place string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(seed=1):
    """(doc_id, text, lang, source): nulls, empties, white space, copies, near copies, ties, repeated rows, a very long text."""
    rng = random.Random(seed)
    base = prose(rng, 120)
    near = base.split(" ")
    near[60] = "other"
    passage = prose(rng, 60)
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "b"),
        (3, base + "  \n", "en", "a"),
        (4, " ".join(near), "en", "a"),
        (5, None, "en", "a"),
        (6, "", None, "b"),
        (7, " \t\n", "de", None),
        (8, "word", "de", "b"),
        (9, "WORD", "de", "b"),
        (10, "1234 !!", "de", "b"),
        (11, prose(rng, 80) + " " + passage + " " + prose(rng, 30), "en", "c"),
        (12, prose(rng, 10) + " " + passage, "en", "c"),
        (13, prose(rng, 30), "fr", "c"),
        (13, prose(rng, 30), "fr", "c"),
        (14, base, "en", "c"),
        (14, base, "en", "c"),
        (None, prose(rng, 25), "en", "a"),
        (None, base, "en", "a"),
        (20, prose(rng, 30_000), "en", "a"),
        (21, "é" * 5000, "fr", "a"),
        (22, "日本語 😀 テスト ÀÉÎ ß", "ja", "a"),
    ]
    return rows


def frame(spark, rows, clash=True):
    if not clash:
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    wide = [(i, t, l, s, None if t is None else len(t), "k", 7, "i", "n", 3, 9, "x", "h", 4, False, "p") for i, t, l, s in rows]
    return spark.createDataFrame(wide, CLASH).repartition(3, "lang")


def collect(df):
    return [r.asDict(recursive=True) for r in df.collect()]
