"""One query for each operator, over its whole table with production parameters, and the SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, exact_dedup, fingerprints, html_extract, language, packing, prefix_trie, quality, repeats, secrets, simhash, vector_codes, warc


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file, the same on every executor; ``CORPUSLOOM_TOKENIZERS`` names another folder."""
    folder = os.environ.get("CORPUSLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; fold 2 is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = tokenizer_path("byte_bpe_50k.json")
    tokens = bpe.detokenize(bpe.tokenize(_table(spark, sf_dir, "documents"), tokenizer), tokenizer)
    return tokens.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_neighbours(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents")).drop("text_hash")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents")).drop("rid", "text_hash")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"), keep_first=False).drop("spans")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    prototypes = language.fit(docs, training=F.coalesce(fold() != 2, F.lit(True)))
    return language.predict(docs.select("doc_id", "text"), prototypes).select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents")).drop("rid")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), training=F.coalesce(fold() != 2, F.lit(True)))
    return quality.score(docs, model).select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(_table(spark, sf_dir, "embeddings"))
    return vector_codes.code_digest(coded, books)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.numbered_turns(_table(spark, sf_dir, "conversations"))
    conv = F.col("conv_id")
    lengths, rebuilt = prefix_trie.shared_heads(turns, base=conv - conv % 5, taken=F.crc32(conv.cast("string").cast("binary")) % 9, most=8)
    return prefix_trie.prefix_trie(lengths, rebuilt).drop("k1", "k2")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extract": op1_html_extract,
    "op2_bpe": op2_bpe,
    "op3_fingerprints": op3_fingerprints,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_warc": op5_warc,
    "op6_packing": op6_packing,
    "op7_secret_scan": op7_secret_scan,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_language_id": op9_language_id,
    "op10_simhash": op10_simhash,
    "op11_quality": op11_quality,
    "op12_vector_codes": op12_vector_codes,
    "op13_prefix_trie": op13_prefix_trie,
}

_NORMAL = "regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')"



def _code_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS, scale: int = vector_codes.SCALE) -> str:
    """The plain rounds, each an assignment of all parts to all entries."""
    best = "SELECT rid, part, min({d} * {n} + e) AS m FROM part JOIN c{r} USING (part) GROUP BY rid, part"
    d = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {scale})::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"part AS MATERIALIZED (SELECT rid, vec_id, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS x FROM kept, unnest(range({parts})) u(part))",
        f"c0 AS MATERIALIZED (SELECT part, e, x AS c FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id, v) - 1 AS e FROM part JOIN (SELECT rid, v FROM kept) USING (rid)) WHERE e < {entries})",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED ({best.format(d=d, n=entries, r=r)})")
        if r < rounds:
            sums = f"SELECT a.part, a.m % {entries} AS e, place, sum(x[place])::BIGINT AS s, count(*) AS n FROM a{r} a JOIN part p ON p.rid = a.rid AND p.part = a.part, unnest(range(1, len(x) + 1)) u(place) GROUP BY ALL"
            means = f"SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY place) AS c FROM ({sums}) GROUP BY ALL"
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT o.part, o.e, coalesce(w.c, o.c) AS c FROM c{r} o LEFT JOIN ({means}) w USING (part, e))")
    return f"""WITH {", ".join(steps)},
        coded AS (SELECT rid, string_agg(printf('%02x', m % {entries}), '' ORDER BY part) AS code, sum(m // {entries})::BIGINT AS error FROM a{rounds} GROUP BY rid)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) FROM c{rounds}) AS codebooks_sha256 FROM coded JOIN kept USING (rid)"""


#: CRC-32 of the decimal form of conv_id, byte by byte through the table of its polynomial.
_CRC_TABLE = "list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295)"

#: For the operators that SQL can express; the tests hold the others against brute force.
ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": f"""SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
        FROM (SELECT doc_id, length(coalesce(text, '')) AS n, {_NORMAL} AS norm FROM documents) WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)""",
    "op5_warc": """SELECT page_id, b AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN b >= 1000 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN b >= 1000 AND page_id <> m THEN m END AS refers_to
        FROM (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS b, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS m FROM pages)""",
    "op12_vector_codes": _code_sql(),
    "op13_prefix_trie": f"""WITH tab AS (SELECT {_CRC_TABLE} AS crc),
        turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, dg) - 1 AS pos, dg, b
            FROM (SELECT conv_id, turn, substr(sha256(length(r) || ':' || r || x), 1, 32) AS dg, octet_length(encode(x)) AS b
                FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL))),
        conv AS (SELECT conv_id, n, {_CRC} % 9 AS h, conv_id - conv_id % 5 AS base FROM (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id), tab),
        plan AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS m FROM conv c LEFT JOIN conv b ON b.conv_id = c.base),
        steps AS (SELECT p.conv_id, pos, dg, b FROM plan p JOIN turns t ON t.conv_id = p.base AND pos < m UNION ALL SELECT p.conv_id, m + pos - h, dg, b FROM plan p JOIN turns t ON t.conv_id = p.conv_id AND pos >= h),
        seqs AS (SELECT conv_id, list(dg ORDER BY pos) AS l, list(b ORDER BY pos) AS bs FROM steps GROUP BY conv_id UNION ALL SELECT conv_id, [], [] FROM plan WHERE conv_id NOT IN (SELECT conv_id FROM steps)),
        rows AS (SELECT conv_id, d, array_to_string(l[1:d], ',') AS k, CASE WHEN d > 0 THEN array_to_string(l[1:d - 1], ',') END AS pk, coalesce(bs[d], 0) AS b, len(l) = d AS ends FROM seqs, unnest(range(0, len(l) + 1)) u(d)),
        node AS (SELECT k, d, any_value(pk) AS pk, any_value(b) AS b, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ids FROM rows GROUP BY k, d),
        kids AS (SELECT pk, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY pk, d),
        known AS (SELECT node.*, coalesce(n, 0) AS n_children FROM node LEFT JOIN kids ON kids.pk = k AND kids.d = node.d),
        sums AS (SELECT r.k, r.d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * w.b) AS saved FROM known w JOIN rows r ON r.conv_id = w.conv_id AND r.d <= w.d GROUP BY r.k, r.d)
        SELECT v.conv_id, v.d AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(v.ids) AS ends_sha256
        FROM known v JOIN sums s ON s.k = v.k AND s.d = v.d LEFT JOIN node p ON p.k = v.pk AND p.d = v.d - 1""",
}
