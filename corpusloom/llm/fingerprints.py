"""Document fingerprints by consistent weighted sampling, in DataFrame and SQL functions only.

A text's terms are its five-word shingles, weighted by how often they occur.  For a term of weight
S, with r and c from a Gamma(2, 1) distribution and b uniform, all fixed by the term, the sample is
t = floor(ln S / r + b), and its rank ln c - r (t - b) - r; the term and t of the smallest rank
are kept.  Two weighted sets keep the same sample with the probability of their generalised Jaccard
similarity.  Each of a term's occurrences is dealt by hash of term and number to one of the strata,
so that a stratum holds a part of the weight of each term, and one sample is drawn in each stratum.
The occurrences that two texts share are the same in both, so every stratum with terms agrees with
the expected probability of the generalised Jaccard similarity of the whole texts, whatever the
weights, and the share of strata that agree estimates it.  A text costs one draw at most for each
of its occurrences, as opposed to one for each term and stratum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm import scratch

WIDTH = 5
#: Strata, a power of two up to 128.
STRATA = 64
#: Bytes of text that a bucket of neighbouring documents should hold, and quantiles of the ids that bound them.
BUCKET_BYTES, QUANTILES = 6 << 20, 128
#: Numbers of neighbouring buckets that are put in order at once.
_STRETCH = 4096


def _uniforms(x: Column) -> tuple[Column, Column]:
    """Two numbers in (0, 1) from the halves of a 64-bit hash."""
    scale = 2.0**-32
    return (F.shiftrightunsigned(x, 32) + 0.5) * scale, (x.bitwiseAND(F.lit(0xFFFFFFFF)) + 0.5) * scale


def _draw(term: Column, weight: Column) -> Column:
    """A sample as one number: stratum, rank and a digest of the sample, from the highest bits down."""
    more = F.xxhash64(term, F.lit(1))
    (u1, u2), (u3, u4) = _uniforms(term), _uniforms(more)
    beta = _uniforms(F.xxhash64(term, F.lit(2)))[0]
    ln_c, r = F.ln(-F.ln(u1 * u2)), -F.ln(u3 * u4)
    t = F.floor(F.ln(weight.cast("double")) / r + beta)
    once = weight == 1  # then t is 0
    rank = F.when(once, ln_c + r * (beta - 1)).otherwise(ln_c + r * (beta - t - 1))
    digest = F.when(once | (t == 0), term).otherwise(F.xxhash64(term, t)).bitwiseAND(F.lit((1 << 24) - 1))
    # Ranks beyond the range would be astronomically rare and only tie.
    place = ((F.greatest(F.least(rank, F.lit(250.0)), F.lit(-250.0)) + 256.0) * 4194304.0).cast("long")
    return F.shiftleft(_stratum(term), 56).bitwiseOR(F.shiftleft(place, 24)).bitwiseOR(digest)


def _dealt(term: Column, number: Column) -> Column:
    """Term within its stratum, which is the highest bits, for the occurrence of that number.

    The first occurrence, most often the only one, goes where the term's own highest bits say.
    """
    stratum = F.xxhash64(term, F.lit(3), number).bitwiseAND(F.lit(STRATA - 1))
    bits = STRATA.bit_length() - 1
    other = F.shiftleft(stratum, 64 - bits).bitwiseOR(F.shiftrightunsigned(F.xxhash64(term, F.lit(4), stratum), bits))
    return F.when((number == 0) | (stratum == F.shiftrightunsigned(term, 64 - bits)), term).otherwise(other)


def _stratum(dealt: Column) -> Column:
    return F.shiftrightunsigned(dealt, 64 - (STRATA.bit_length() - 1))


def with_signature(df: DataFrame, text: str, out: str, width: int = WIDTH) -> DataFrame:
    """``df`` with the signature of column ``text`` appended: an array of longs, one for each stratum that has terms.

    Null and word-less texts have an empty signature; a text of fewer words has itself as its term.
    """
    c = lambda name: f"_{out}_{name}"
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+"), "")
    h, s, p = F.col(c("hashes")), F.col(c("sorted")), F.col(c("starts"))
    df = df.withColumn(c("hashes"), F.transform(words, lambda w: F.xxhash64(w)))
    several = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))
    short = F.array(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x)))
    none = F.array().cast("array<bigint>")
    terms = F.when(F.size(h) >= width, several).when(F.size(h) > 0, short).otherwise(none)
    df = df.withColumn(c("sorted"), F.sort_array(terms)).drop(c("hashes"))
    starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
    df = df.withColumn(c("starts"), starts)
    count = lambda at, j: F.coalesce(F.get(p, j + 1), F.size(s)) - at
    # Where no term repeats, every term is dealt as it is and has weight 1.
    df = df.withColumn(c("single"), F.size(p) == F.size(s))
    single = F.col(c("single"))
    dealt = F.flatten(F.transform(p, lambda at, j: F.transform(F.sequence(F.lit(0), count(at, j) - 1), lambda k: _dealt(F.get(s, at), k))))
    df = df.withColumn(c("dealt"), F.when(single, s).otherwise(F.sort_array(dealt))).drop(c("sorted"), c("starts"))
    df = df.withColumnRenamed(c("dealt"), c("sorted")).withColumn(c("starts"), F.when(single, F.lit(None)).otherwise(starts))
    draws = F.when(single, F.transform(s, lambda x: _draw(x, F.lit(1)))).otherwise(F.transform(p, lambda at, j: _draw(F.get(s, at), count(at, j))))
    df = df.withColumn(c("draws"), F.sort_array(draws)).drop(c("sorted"), c("starts"), c("single"))
    d = F.col(c("draws"))
    first = F.filter(d, lambda x, i: (i == 0) | (F.shiftright(x, 56) != F.shiftright(F.get(d, i - 1), 56)))
    return df.withColumn(out, first).drop(c("draws"))


def likeness(a: str | Column, b: str | Column) -> Column:
    """Share of the strata with terms in either that hold the same sample; 1 if neither has terms."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    strata = lambda s: F.transform(s, lambda x: F.shiftright(x, 56))
    either = F.size(F.array_union(strata(a), strata(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def as_text(signature: str) -> Column:
    """A signature as hexadecimal digits, 16 for each stratum."""
    return F.lower(F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def _buckets(rows: DataFrame) -> tuple[Column, int]:
    """A bucket number that never falls as ids grow, made so that each bucket holds about BUCKET_BYTES."""
    size = rows.agg(F.sum(F.octet_length("text")).alias("size"), F.percentile_approx("id", [k / QUANTILES for k in range(QUANTILES + 1)], 10_000).alias("bounds")).first()
    bounds = sorted(set(size.bounds or []))
    if len(bounds) < 2:
        return F.lit(0).cast("long"), 1
    # Between two quantiles ids are divided evenly.
    parts = max(1, -(-(size["size"] or 0) // (BUCKET_BYTES * (len(bounds) - 1))))
    if not size["size"] or size["size"] <= BUCKET_BYTES:
        return F.lit(0).cast("long"), 1
    merge = max(1, (len(bounds) - 1) * BUCKET_BYTES // size["size"])
    bounds = [*bounds[:-1:merge], bounds[-1]]
    starts = F.array(*[F.lit(b) for b in bounds[:-1]])
    ends = F.array(*[F.lit(b) for b in bounds[1:]])
    q = F.greatest(F.size(F.filter(starts, lambda b: b <= F.col("id"))) - 1, F.lit(0))
    low, high = F.get(starts, q).cast("double"), F.get(ends, q).cast("double")
    inner = F.least(F.greatest(F.floor((F.col("id") - low) * parts / F.greatest(high - low, F.lit(1.0))), F.lit(0)), F.lit(parts - 1))
    last = (len(bounds) - 1) * parts
    return F.coalesce((q * parts + inner).cast("long"), F.lit(last).cast("long")), last + 1


def fingerprint_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row with its signature, the signature of its edited text, and their likeness.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``.  The next document is that with the next larger id, after the last the first; the
    edited text has its last floor(n / 2) code points replaced by as many of the next document's
    first, or all if there are fewer.

    Null counts as empty.  Rows of one id follow each other by a hash of their texts, null ids come
    last.  A single row is its own next.  Texts are read whole, however long.  Other columns are ignored,
    whatever their names.  An empty table gives an empty result.
    """
    scratch.prepare(docs.sparkSession)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("id"), text.alias("text"))
    bucket, _ = _buckets(rows)
    rows = rows.select("id", "text", bucket.alias("bucket"), F.xxhash64("text").alias("h"), F.col("id").isNull().alias("last"))
    # The first document of each bucket also stands at the end of the bucket before it.
    firsts = scratch.materialize(rows.groupBy("bucket").agg(F.min(F.struct("last", "id", "h")).alias("first")), "fingerprint-firsts")
    stretch = F.floor(F.col("bucket") / _STRETCH)
    nearby = W.partitionBy("stretch").orderBy("bucket")
    ordered = firsts.withColumn("stretch", stretch).withColumn("to", F.lag("bucket").over(nearby))
    # Across stretches, each a row: the last bucket of the stretch before, and for the very first the last of all.
    ends = ordered.groupBy("stretch").agg(F.max("bucket").alias("end"))
    whole = W.orderBy("stretch")
    ends = ends.select("stretch", F.lag("end").over(whole).alias("before"), F.last("end").over(whole.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("end"))
    heads = ordered.join(ends, "stretch").select(
        F.coalesce("to", "before", "end").alias("to"), F.when(F.coalesce("to", "before").isNull(), 2).otherwise(1).alias("border"), F.col("first.id").alias("head_id"), F.col("first.h").alias("head_h")
    )
    borders = rows.drop("bucket").join(heads, F.col("id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h"))).select("id", "text", F.col("to").alias("bucket"), "h", "last", "border")
    placed = rows.select("id", "text", "bucket", "h", "last", F.lit(0).alias("border")).unionAll(borders)
    signed = with_signature(placed, "text", "signature")
    order = W.partitionBy("bucket").orderBy("border", "last", "id", "h")
    paired = signed.withColumns({"next_text": F.lead("text").over(order), "next_signature": F.lead("signature").over(order)}).where("border = 0")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    paired = paired.select("id", n.cast("long").alias("n_chars"), "signature", "next_signature", edited.alias("edited"))
    both = with_signature(paired, "edited", "edited_signature")
    return both.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text("signature").alias("fingerprint"),
        as_text("edited_signature").alias("edited_fingerprint"),
        likeness("signature", "edited_signature").alias("near_edited"),
        likeness("signature", "next_signature").alias("near_next"),
    )
