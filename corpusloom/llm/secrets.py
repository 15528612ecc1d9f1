"""Secret scanning with corpus-wide ownership frequency, in DataFrame and SQL functions only.

Three base patterns and one for random-looking tokens propose candidates.  Each candidate value is
hashed, and over the whole corpus the distinct repositories and owners that hold it are counted.  A
value that several owners hold, or two of them in many repositories, has been copied around, as
examples from documentation are.  Any other value belongs to its owner, in however many repositories
that owner repeats it: if it looks live, that is random and no placeholder, it is taken for a
credential in use.  The verdict is added as a span of its own over the value, beside the base spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import scratch

# The base patterns (kind, pattern, group that holds the value, least length of that group).
PATTERNS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Added by the method: long runs that mix letters and digits.
RANDOM = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{32,}"
#: A value that so many owners hold, or two owners in so many repositories, counts as an example.
SHARED_OWNERS, SHARED_REPOSITORIES = 3, 20
#: Bits of entropy per character and characters that a live-looking value has at least, and runs in one of its parts, or else classes of characters.
LIVE_ENTROPY, LIVE_CHARS, LIVE_RUNS, LIVE_CLASSES = 2.5, 8, 4, 3
# Words of values that are there to be replaced.
PLACEHOLDERS = "change changeme example sample placeholder dummy redacted undefined your yourpassword xxxx xxxxx xxxxxx xxxxxxxx test".split()
#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "random", "live", "example", "placeholder")


#: Matches summed at once where the places of a text's matches are added up.
_BLOCK = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body refers to it."""
    return F.get(F.transform(F.array(value), body), 0)


def _running(steps: Column) -> Column:
    """Sums of an array up to each element: of whole blocks before it, and within its own."""
    add = lambda array: F.aggregate(array, F.lit(0).cast("bigint"), lambda s, x: s + x)
    blocks = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _BLOCK).cast("int"))
    sums = F.transform(blocks, lambda b: add(F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK))))
    offsets = lambda t: F.transform(t, lambda x, b: add(F.slice(t, F.lit(1), b)))
    within = lambda o: F.transform(steps, lambda x, i: F.get(o, F.floor(i / _BLOCK).cast("int")) + add(F.slice(steps, i - i % _BLOCK + 1, i % _BLOCK + 1)))
    return _let(sums, lambda t: _let(offsets(t), within))


def _spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches as array of (start, kind number, end, value start, value).

    Splitting at the matches gives the texts between them, whose lengths place the matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    matches = F.zip_with(found, value, lambda w, v: F.struct(F.char_length(w).cast("bigint").alias("size"), v.alias("value")))
    parts = F.zip_with(matches, gaps, lambda m, g: F.struct((m["size"] + F.char_length(g)).alias("step"), m["size"].alias("size"), m["value"].alias("value")))
    number = KINDS.index(kind)

    def span(part: Column, end: Column) -> Column:
        # A group that ends the match ends where the match does.
        return F.struct((end - part["size"]).alias("start"), F.lit(number).alias("kind"), end.alias("end"), (end - F.char_length(part["value"])).alias("value_start"), part["value"].alias("value"))

    placed = _let(parts, lambda p: _let(F.transform(p, lambda x: x["step"]), lambda steps: F.zip_with(p, _running(steps), span)))
    row = "array<struct<start:bigint,kind:int,end:bigint,value_start:bigint,value:string>>"
    good = F.filter(placed, lambda s: F.char_length(s["value"]) >= least)
    return F.when(text.rlike(pattern), good.cast(row)).otherwise(F.array().cast(row))


def _listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def may_match(text: Column) -> Column:
    """Whether any pattern matches somewhere in ``text``."""
    found = text.rlike(RANDOM)
    for _, pattern, _, _ in PATTERNS:
        found = found | text.rlike(pattern)
    return found


def entropy(value: Column) -> Column:
    """Bits per character of a value by how often each of its characters occurs in it."""
    n = F.char_length(value)
    letters = F.array_distinct(F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0)))

    def share(letter: Column) -> Column:
        return (n - F.char_length(F.replace(value, letter, F.lit("")))) / n

    return F.aggregate(letters, F.lit(0.0), lambda bits, letter: bits - share(letter) * F.log2(share(letter)))


def looks_live(value: Column) -> Column:
    """Whether a value is long and mixed enough to be random, and no placeholder.

    A value is cut at its signs.  In a part, letters that read as words (several of one case, a capital before them or not) are one run, as are
    neighbouring digits; every other letter is a run of its own.  Names, paths and variables have few runs
    (``process.env.TOKEN`` one a part, ``user2name`` three), random strings many.  A value with few runs is live only if it mixes
    three classes of characters and is no name or path of names.  A value is a placeholder if one of its
    words, whole, is listed; letters within a longer run do not count.
    """
    parts = F.split(value, "[^A-Za-z0-9]+")
    runs = F.transform(parts, lambda p: F.char_length(F.regexp_replace(F.regexp_replace(p, "([A-Z]?[a-z]{2,}|[A-Z]{2,}(?![a-z]))+", "w"), "[0-9]+", "d")))
    words = F.split(F.lower(value), "[^a-z0-9]+")
    classes = sum((value.rlike(c).cast("int") for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")), F.lit(0))
    mixed = (F.array_max(runs) >= LIVE_RUNS) | ((classes >= LIVE_CLASSES) & ~value.rlike(r"\A[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*\z"))
    return (F.char_length(value) >= LIVE_CHARS) & mixed & ~F.arrays_overlap(words, F.array(*[F.lit(w) for w in PLACEHOLDERS])) & (entropy(value) >= LIVE_ENTROPY)


def ownership(candidates: DataFrame, shared_owners: int = SHARED_OWNERS, shared_repositories: int = SHARED_REPOSITORIES) -> DataFrame:
    """``hash, owners, repositories, kind`` of values from ``hash, owner, repository, live``.

    A value that a third of all rows hold is counted in parts: by repository, then by owner, then as a
    whole, each reduced before it is dealt out.
    """
    by_repository = candidates.groupBy("hash", "owner", "repository").agg(F.max("live").alias("live"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.max("live").alias("live"))
    counted = by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.max("live").alias("live"))
    copied = (F.col("owners") >= shared_owners) | ((F.col("owners") >= 2) & (F.col("repositories") >= shared_repositories))
    kind = F.when(copied, KINDS.index("example")).when(F.col("live"), KINDS.index("live")).otherwise(KINDS.index("placeholder"))
    return counted.select("hash", "owners", "repositories", kind.alias("kind"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str | None = None, shared_owners: int = SHARED_OWNERS, shared_repositories: int = SHARED_REPOSITORIES) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, n_placeholder, rid, text_hash`` for every row.

    Positions are code points, ends exclusive.  ``spans`` lists the base spans and what the method
    adds: ``random`` for long mixed runs that no base value covers, and over each candidate value
    ``example`` if it is widely copied (:func:`ownership`), else ``live`` or ``placeholder`` by
    :func:`looks_live`.  Without ``repository_col`` each id is a repository of its owner.

    Null and empty texts have no spans; texts are scanned whole, however long.  A null owner or
    repository counts as one.  Rows that repeat are rows of their own, of one repository.  Other columns
    are ignored, whatever their names.  An empty table gives an empty result.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    owner = F.coalesce(docs[owner_col].cast("string"), F.lit("")) if owner_col in docs.columns else F.lit("")
    repository = F.coalesce(docs[repository_col or id_col].cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), docs[id_col].cast("long").alias("id"), owner.alias("owner"), repository.alias("repository"), text.alias("text"))
    base = F.concat(*[_spans(F.col("text"), *p) for p in PATTERNS])
    extra = _spans(F.col("text"), "random", RANDOM, 0, 32)
    scanned = rows.select("rid", "id", "owner", "repository", F.xxhash64("text").alias("text_hash"), base.alias("base"), extra.alias("extra"))
    # A random run inside a base value adds nothing.
    fresh = F.filter("extra", lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]") & ~F.exists("base", lambda b: (b["value_start"] <= x["start"]) & (x["end"] <= b["end"])))
    scanned = scratch.materialize(scanned.withColumn("extra", fresh), "secret-spans")
    values = F.array_distinct(F.transform(F.concat("base", "extra"), lambda s: F.struct(s["value_start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))))
    found = scanned.select("rid", "owner", "repository", F.explode(values).alias("c"))
    candidates = found.select("rid", "owner", "repository", "c.start", "c.end", F.sha2("c.value", 256).alias("hash"), looks_live(F.col("c.value")).alias("live"))
    kinds = ownership(candidates, shared_owners, shared_repositories).select("hash", "kind")
    verdicts = candidates.select("rid", "start", "end", "hash").join(kinds, "hash").groupBy("rid").agg(F.collect_list(F.struct("start", "kind", "end")).alias("verdicts"))
    lean = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    number = lambda a, k: F.size(F.filter(a, lambda s: s["kind"] == KINDS.index(k))).cast("long")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    out = scanned.join(verdicts, "rid", "left").withColumn("verdicts", F.coalesce("verdicts", none))
    return out.select(
        F.col("id").alias("doc_id"),
        *[number("base", k).alias(f"n_{k}") for k, *_ in PATTERNS],
        F.sha2(_listed(lean("base")), 256).alias("base_sha256"),
        _listed(F.concat(lean("base"), lean("extra"), "verdicts")).alias("spans"),
        number("verdicts", "live").alias("n_live"),
        number("verdicts", "example").alias("n_example"),
        number("verdicts", "placeholder").alias("n_placeholder"),
        "rid",
        "text_hash",
    )


def redact(text: Column, spans: Column, kinds: tuple[str, ...] = ("assign", "access", "hex", "random"), mark: str = "[SECRET]") -> Column:
    """``text`` with every listed span of the kinds replaced by ``mark``; spans that overlap or touch become one."""
    listed = F.filter(F.transform(F.split(spans, ","), lambda s: F.split(s, ":")), lambda p: F.element_at(p, 1).isin(*kinds))
    pairs = F.transform(listed, lambda p: F.struct(F.element_at(p, 2).cast("int").alias("start"), F.element_at(p, 3).cast("int").alias("end")))

    def step(state: Column, s: Column) -> Column:
        inside = s["start"] <= state["at"]
        first = (state["at"] == 0) & (state["out"] == "")
        gap = F.when(inside & ~first, F.lit("")).otherwise(F.concat(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mark)))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], gap).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(pairs, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.lit(2147483647))))
    return F.when(F.size(pairs) > 0, done).otherwise(text)
