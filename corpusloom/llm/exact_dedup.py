"""Exact deduplication through an extendible-hash index on shared files.

The index is a Parquet table in the shared folder plus a directory of bucket addresses.  Mappers
write one *member* entry per row and one *text* entry per distinct text of a bounded stretch of
their input, so a text that a third of all rows repeat reaches its owner only a few times per
mapper.  A mapper sends a text at once and then holds its SHA-256 alone; repeats follow as an entry without the text.  The directory starts with one bucket and doubles until no bucket holds more than
``bucket_bytes``.  Beyond 16 address bits, where a flat directory would outgrow the driver, an
overfull address has a directory of its own, of which only the depth has to be known.  Owner tasks
then stream their buckets in key order: entries with one key form a chain, and within a chain texts
are compared byte by byte, so colliding keys never merge different texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import scratch

#: Characters that do not count when texts are compared.
IGNORED = "\x20\x09\x0a\x0b\x0c\x0d"
#: Address bits of the histogram from which the directory is built; doublings beyond go on below each address.
ADDRESS_BITS = 16
#: Most doublings below one address.
FURTHER_BITS = 31
#: A mapper forgets the texts it has already sent beyond so many bytes.
MAPPER_BYTES = 32 << 20
#: What a mapper holds of a text that it has sent: its key, its digest and its best row.
ENTRY_BYTES = 600

_MEMBER, _TEXT = 0, 1


def build_directory(histogram: dict[int, int], bits: int, capacity: int) -> tuple[int, np.ndarray, list[tuple[int, int]]]:
    """Split overfull buckets by directory doubling.

    ``histogram`` gives bytes per address of ``bits`` leading key bits.  Returns the global depth,
    the directory (bucket number for each of ``2 ** depth`` addresses) and the buckets as
    (first address bits, local depth).  An address with too much load is left to :func:`further_depths`.
    """
    load = np.zeros(1 << bits, dtype=np.int64)
    for address, size in histogram.items():
        load[address] = size
    upto = np.concatenate([[0], np.cumsum(load)])
    done: list[tuple[int, int]] = []
    pending = [(0, 0)]
    while pending:
        prefix, depth = pending.pop()
        width = 1 << (bits - depth)
        if depth < bits and upto[(prefix + 1) * width] - upto[prefix * width] > capacity:
            pending += [(2 * prefix + 1, depth + 1), (2 * prefix, depth + 1)]
        else:
            done.append((prefix, depth))
    depth = max(d for _, d in done)
    done.sort(key=lambda b: b[0] << (bits - b[1]))
    directory = np.empty(1 << depth, dtype=np.int32)
    for number, (prefix, local) in enumerate(done):
        directory[prefix << (depth - local) : (prefix + 1) << (depth - local)] = number
    return depth, directory, done


def further_depths(histogram: dict[int, int], bits: int, capacity: int) -> np.ndarray:
    """How many more key bits split each address of ``bits`` bits so that its load fits ``capacity`` on average."""
    depths = np.zeros(1 << bits, dtype=np.int8)
    for address, size in histogram.items():
        depths[address] = min(FURTHER_BITS, (max(size - 1, 0) // capacity).bit_length())
    return depths


def bucket_of(key: int, depth: int, directory: np.ndarray, further: np.ndarray) -> int:
    """The bucket of a signed 64-bit key: its number in the directory, and above that its place below the address."""
    key &= 0xFFFFFFFFFFFFFFFF
    bits = len(further).bit_length() - 1
    number = int(directory[key >> (64 - depth)]) if depth else 0
    deeper = int(further[key >> (64 - bits)]) if depth == bits else 0
    return (((key << bits) & 0xFFFFFFFFFFFFFFFF) >> (64 - deeper)) << 32 | number if deeper else number


_INDEX = "kind byte, bucket long, key long, sha binary, rid long, id long, n long, tag long, members long, norm binary"


def _values(column: pa.Array) -> Iterator:
    """The values of a column, one after another, so that of long texts few are held as Python objects."""
    return (x.as_py() for k in range(0, len(column), 16) for x in column.slice(k, 16))


def _mapper(depth: int, directory: np.ndarray, further: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        names = ["kind", "bucket", "key", "sha", "rid", "id", "n", "tag", "members", "norm"]
        types = [pa.int8(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

        def pack(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        seen: dict[tuple[int, bytes], list] = {}

        def repeats():
            rows = [(_TEXT, bucket, key, sha, best[3], best[2], -best[0], None, members, None) for (key, sha), (bucket, best, members) in seen.items() if members]
            for k in range(0, len(rows), 4096):
                yield pack(rows[k : k + 4096])

        for batch in batches:
            rows, size = [], 0
            for rid, id_, n, tag, key, sha, norm in zip(*map(_values, batch.columns)):
                bucket = bucket_of(key, depth, directory, further)
                rows.append((_MEMBER, bucket, key, sha, rid, id_, n, tag, 1, None))
                entry = seen.get((key, sha))
                if entry is None:
                    seen[key, sha] = [bucket, (-n, id_ is None, id_, rid), 0]
                    rows.append((_TEXT, bucket, key, sha, rid, id_, n, None, 1, norm))
                    size += len(norm)
                    if size > 4 << 20:
                        yield pack(rows)
                        rows, size = [], 0
                else:
                    entry[2] += 1
                    entry[1] = min(entry[1], (-n, id_ is None, id_, rid))
            if rows:
                yield pack(rows)
            if len(seen) * ENTRY_BYTES > MAPPER_BYTES:
                yield from repeats()
                seen = {}
        yield from repeats()

    return run


def _owner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of one key after another; only the open chain is held.  Emits texts with several members.

    Entries without a text count for the text of the same key and SHA-256, which the same mapper sent.
    """
    import pyarrow as pa

    names, types = ["key", "sha", "keep_rid", "keep_id", "size"], [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    open_key, chain, repeats = None, {}, []

    def close():
        by_sha = {entry[0]: entry for entry in chain.values()}
        for sha, rank, members in repeats:
            entry = by_sha[sha]
            entry[2] += members
            entry[1] = min(entry[1], rank)
        return [(open_key, sha, best[3], best[2], size) for sha, best, size in chain.values() if size > 1]

    for batch in batches:
        rows = []
        for key, sha, rid, id_, n, members, norm in zip(*map(_values, batch.columns)):
            if key != open_key:
                rows += close()
                open_key, chain, repeats = key, {}, []
            rank = (-n, id_ is None, id_, rid)
            if norm is None:
                repeats.append((sha, rank, members))
                continue
            entry = chain.get(norm)  # equal only if the bytes are equal
            if entry is None:
                chain[norm] = [sha, rank, members]
            else:
                entry[2] += members
                entry[1] = min(entry[1], rank)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
    if rows := close():
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 4 << 20, key_bits: int = 64) -> DataFrame:
    """Group rows whose texts are equal after deleting every character of :data:`IGNORED`.

    One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256, text_hash`` (the last is
    xxhash64 of the original text).  The row with the
    most code points in its original text stays, then the smallest id, then the first in file order.

    Null text counts as empty; empty texts form one group.  A null id ranks after all others and is
    returned as null.  Rows that repeat an id and a text are separate rows of which one is kept.
    Texts of any length are compared whole; a task holds one batch of them and the open chain.
    Other columns are ignored, whatever their names.  An empty table gives an empty result.
    ``key_bits`` below 64 weakens the key, which tests use to force chains.
    """
    spark = docs.sparkSession
    scratch.prepare(spark)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), docs[id_col].cast("long").alias("id"), F.char_length(text).cast("long").alias("n"), F.xxhash64(text).alias("tag"), F.translate(text, IGNORED, "").alias("norm"))
    key = F.xxhash64("norm")
    if key_bits < 64:
        key = F.shiftleft(F.shiftright(key, 64 - key_bits), 64 - key_bits)
    address = F.shiftrightunsigned(key, 64 - ADDRESS_BITS).alias("address")
    # Repeats count here too, so the directory may be finer than needed, never coarser.
    sizes = rows.groupBy(address).agg(F.sum(F.octet_length("norm") + 64).alias("size")).collect()  # at most 2 ** ADDRESS_BITS rows
    histogram = {r.address: r["size"] for r in sizes}
    depth, directory, _ = build_directory(histogram, ADDRESS_BITS, bucket_bytes)
    further = further_depths(histogram, ADDRESS_BITS, bucket_bytes)
    keyed = rows.select("rid", "id", "n", "tag", key.alias("key"), F.unhex(F.sha2("norm", 256)).alias("sha"), F.col("norm").cast("binary").alias("norm"))
    index = scratch.materialize(keyed.mapInArrow(_mapper(depth, directory, further), _INDEX), "exact-index")
    members = index.where(F.col("kind") == _MEMBER).select("rid", "id", "tag", "key", "sha")
    texts = index.where(F.col("kind") == _TEXT).select("bucket", "key", "sha", "rid", "id", "n", "members", "norm")
    owned = texts.repartition("bucket").sortWithinPartitions("key").select("key", "sha", "rid", "id", "n", "members", "norm")
    groups = owned.mapInArrow(_owner, "key long, sha binary, keep_rid long, keep_id long, size long")
    joined = members.join(groups, ["key", "sha"], "left")
    alone = F.col("keep_rid").isNull()
    return joined.select(
        F.col("id").alias("doc_id"),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.col("tag").alias("text_hash"),
    )
