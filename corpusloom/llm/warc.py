"""WARC archives compressed with Zstandard: one frame a record, the dictionary in a leading skippable frame.

Archives are written through Spark's own file committer, so they can go to any store that Spark
writes and a lost executor leaves no half archive.  The text sink writes a row's bytes as they are
and ends it with a separator; with an empty skippable frame as separator, which every Zstandard
reader passes over, rows of frames are a valid archive.  A file holds a fixed number of rows,
so each starts with the row that carries the dictionary.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import scratch

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
EMPTY_FRAME = "\x50\x2a\x4d\x18\x00\x00\x00\x00"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")

#: Payloads below this many bytes are always stored.
LEAST_REVISIT = 1000
#: Rows of a file, the dictionary's included, and the compressed bytes after which a file is filled up with empty rows.
FILE_ROWS, FILE_BYTES = 2048, 16 << 20
#: Bound on the sample of pages from which the dictionary is trained, and its size.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 4096, 32 << 10
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_DATE = "1970-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive or record that breaks the format."""


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary for the samples; too few of them are used as they are, none give none."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def dictionary_frame(dictionary: bytes) -> bytes:
    body = zstandard.ZstdCompressor(level=3).compress(dictionary) if dictionary else b""
    return struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response, or a revisit without payload when ``refers_to`` is given."""
    digest = hashlib.sha1(payload).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest.hex())}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='/:?#[]@!$&()*+,;=%-._~' + chr(39))}")
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest.hex())}", f"Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes, what: str) -> tuple[str, dict[str, str], int]:
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise WarcError(f"{what}: headers do not end")
    first, *lines = data[:end].decode("utf-8").split("\r\n")
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise WarcError(f"{what}: malformed header {line[:80]!r}")
        out[name.strip().lower()] = value.strip()
    return first, out, end + 4


def parse_record(data: bytes) -> dict:
    """Headers and payload of the one record in ``data``; raises :class:`WarcError` where a header or length is wrong."""
    version, head, at = _headers(data, "record")
    if version not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"unknown version {version[:20]!r}")
    if lacking := [h for h in REQUIRED if h not in head]:
        raise WarcError(f"record lacks {', '.join(lacking)}")
    if not head["content-length"].isdigit():
        raise WarcError(f"Content-Length is {head['content-length']!r}")
    size = int(head["content-length"])
    block, tail = data[at : at + size], data[at + size :]
    if len(block) != size or tail != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {size}; the frame holds {len(data) - at - 4} bytes")
    status, http, body = _headers(block, "block")
    if not status.startswith("HTTP/"):
        raise WarcError("block is no HTTP response")
    payload = block[body:]
    if not http.get("content-length", "").isdigit():
        raise WarcError("block says no Content-Length")
    kind, declared = head["warc-type"], int(http["content-length"])
    algorithm, _, digest = head.get("warc-payload-digest", "").partition(":")
    if algorithm != "sha1":
        raise WarcError("no SHA-1 payload digest")
    digest = base64.b32decode(digest).hex()
    if kind == "response":
        if declared != len(payload):
            raise WarcError(f"payload has {len(payload)} bytes, its header says {declared}")
        if hashlib.sha1(payload).hexdigest() != digest:
            raise WarcError("payload does not match its digest")
    elif kind == "revisit":
        if payload or head.get("warc-profile") != REVISIT_PROFILE or "refers-to-page-id" not in head:
            raise WarcError("malformed revisit record")
    else:
        raise WarcError(f"unexpected record type {kind!r}")
    number = lambda name: int(head[name]) if name in head else None
    return {"page_id": number("page-id"), "url": head.get("warc-target-uri"), "payload": payload if kind == "response" else None, "payload_bytes": declared, "payload_digest": digest, "record_type": kind, "refers_to": number("refers-to-page-id")}


def read_archive(content: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame decoded at a time, with the dictionary of its leading skippable frame."""
    view, at, dictionary = memoryview(content), 0, None
    decompressor = zstandard.ZstdDecompressor()
    while at < len(view):
        if at + 8 > len(view):
            raise WarcError("archive ends within a frame header")
        magic, size = struct.unpack_from("<II", view, at)
        if magic in SKIPPABLE:
            if at + 8 + size > len(view):
                raise WarcError("archive ends within a skippable frame")
            if magic == DICTIONARY_MAGIC and at == 0 and size:
                body = bytes(view[8 : 8 + size])
                if body[:4] == struct.pack("<I", FRAME_MAGIC):
                    body = zstandard.ZstdDecompressor().decompress(body)
                dictionary = zstandard.ZstdCompressionDict(body)
                decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise WarcError(f"no frame at byte {at}")
        frame, parts, step = decompressor.decompressobj(), [], 2048
        try:
            while not frame.eof:
                if at >= len(view):
                    raise WarcError("archive ends within a frame")
                chunk = view[at : at + step]
                parts.append(frame.decompress(chunk))
                at += len(chunk) - len(frame.unused_data)
                step = min(2 * step, 1 << 20)
        except zstandard.ZstdError as e:
            raise WarcError(f"frame does not decode: {e}") from None
        yield b"".join(parts)


def _framer(dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        head = dictionary_frame(dictionary)
        compressor = zstandard.ZstdCompressor(level=3, write_checksum=True, **({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))
        pack = lambda frames: pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])
        rows = held = 0
        for batch in batches:
            frames = []
            for page_id, url, html, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if not rows:
                    frames.append(head)
                    rows, held = 1, 0
                frames.append(compressor.compress(make_record(page_id, url, html.encode("utf-8"), refers_to)))
                rows += 1
                held += len(frames[-1])
                if held > FILE_BYTES:
                    frames += [b""] * (FILE_ROWS - rows)
                    rows = FILE_ROWS
                if rows == FILE_ROWS:
                    rows = 0
            if frames:
                yield pack(frames)

    return run


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_revisit: int = LEAST_REVISIT) -> None:
    """Write a record per row of ``pages`` to archives below ``path``.

    Of rows with equal payloads of at least ``least_revisit`` bytes that with the largest id is a
    response and the others revisit it.  Null html is an empty payload; rows with a null id revisit
    the largest id there is, and are responses if there is none.  Rows that repeat the largest id
    and the payload are responses too.  Pages of any length are one frame each.  An empty table writes no
    record.  Other columns are ignored.
    """
    spark = pages.sparkSession
    scratch.prepare(spark)
    html = F.coalesce(pages[html_col].cast("string"), F.lit(""))
    rows = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].cast("string").alias("url"), html.alias("html"))
    keyed = rows.withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    # Page sample for the dictionary: bounded whatever the number of tasks, and of no effect on what is read back.
    place = F.xxhash64("id", "url").bitwiseAND(F.lit((1 << 62) - 1))
    few = int(min(1.0, SAMPLE_PAGES / max(1, rows.count())) * (1 << 62))
    sample = rows.where(place <= few).select(F.substring("html", 1, SAMPLE_BYTES).alias("html")).limit(SAMPLE_PAGES).collect()
    dictionary = train_dictionary([r.html.encode("utf-8") for r in sample])
    large = F.octet_length("html") >= least_revisit
    repeated = keyed.where(large).groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    # Few repeated payloads go to every task, and no html is dealt out.
    joined = keyed.join(scratch.few_or_merged(scratch.materialize(repeated, "repeated-payloads")), "digest", "left")
    refers_to = F.when(F.col("id").eqNullSafe(F.col("first")), F.lit(None)).otherwise(F.col("first"))
    frames = joined.select("id", "url", "html", refers_to.cast("long").alias("refers_to")).mapInArrow(_framer(dictionary), "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", FILE_ROWS).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives below ``path``: ``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to``.

    Fails on the first record whose headers, lengths or digest are wrong.  Archives without a record give no rows.  A task reads one archive at a
    time, of about 16 MB or one longer record, and decodes one record at a time.  Records that repeat are rows each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names)
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for data in read_archive(content.as_py()):
                    rows.append(parse_record(data))
                    size += len(data)
                    if size > 8 << 20:
                        yield pack(rows)
                        rows, size = [], 0
                if rows:
                    yield pack(rows)

    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, **columns: str) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back: one row for each page, repeated ones too.

    Null html is an empty payload of 0 bytes; null ids and addresses come back as null; pages of any length come back whole.  An empty table gives
    an empty result.  ``columns`` name the columns as in :func:`write_archives`.
    """
    path = scratch.new_path(pages.sparkSession, "warc")
    write_archives(pages, path, **columns)
    return read_archives(pages.sparkSession, path)
