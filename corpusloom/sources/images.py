"""Image sets in their usual binary forms, as data sources of their own: ``idx`` (two files of big-endian headers) and ``cifar`` (records of labels and planes).

``spark.read.format("idx").load(folder)`` and ``df.write.format("idx").save(folder)``.  A folder holds any number of file sets and a list of
those that a finished write has committed, so files of failed attempts are never read.  Files are cut into partitions of
:data:`RECORDS` images and read from their place; only what the schema asks for is read (labels alone never touch the pixels).
Folders may be in any file system that Arrow opens.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Images of one partition, and of one file that a task writes.
RECORDS = 20_000
#: Bytes of pictures that a writer holds, and pictures that are taken out of a batch or a file at once.
FILE_BYTES, AT_ONCE = 16 << 20, 1000
_LIST = "_committed"
# Headers of the idx form (unsigned bytes; three dimensions, or one), and bytes of a picture of three planes.
_PIXELS, _LABELS = 0x803, 0x801
CIFAR_PIXELS = 3072


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _committed(path: str) -> list[dict]:
    """File sets of all finished writes."""
    from pyarrow import fs

    store, base = _open(path)
    found = []
    for f in sorted(store.get_file_info(fs.FileSelector(base)), key=lambda f: f.path):
        if f.base_name.startswith(_LIST):
            found += json.loads(store.open_input_stream(f.path).read())
    return found


@dataclass
class Stretch(InputPartition):
    name: str
    first: int
    count: int
    shape: tuple[int, ...]


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class _Reader(DataSourceReader):
    """Labels by value are left out before their pixels are read where a filter names one label."""

    def __init__(self, schema: StructType, path: str, layout: str) -> None:
        self.columns, self.path, self.layout, self.label = [f.name for f in schema.fields], path, layout, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("label",) and self.label is None:
                self.label = f.value
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return [Stretch(s["name"], k, min(RECORDS, s["count"] - k), tuple(s["shape"])) for s in _committed(self.path) for k in range(0, s["count"], RECORDS)]

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        store, base = _open(self.path)
        size = int(np.prod(part.shape))

        def bytes_of(name: str, at: int, count: int) -> np.ndarray:
            with store.open_input_file(f"{base}/{name}") as f:
                f.seek(at)
                data = f.read(count)
            if len(data) != count:
                raise ValueError(f"{name} is shorter than its header says")
            return np.frombuffer(data, dtype=np.uint8)

        for k in range(part.first, part.first + part.count, AT_ONCE):
            count = min(AT_ONCE, part.first + part.count - k)
            labels = pixels = None
            if self.layout == "idx":
                if "label" in self.columns or self.label is not None:
                    _checked(bytes_of(f"{part.name}-labels", 0, 8), _LABELS)
                    labels = bytes_of(f"{part.name}-labels", 8 + k, count)
                if "pixels" in self.columns:
                    _checked(bytes_of(f"{part.name}-images", 0, 8), _PIXELS)
                    pixels = bytes_of(f"{part.name}-images", 16 + k * size, count * size).reshape(-1, size)
            else:
                whole = bytes_of(f"{part.name}-batch", k * (1 + size), count * (1 + size)).reshape(-1, 1 + size)
                labels, pixels = whole[:, 0], whole[:, 1:]
            some = np.arange(count) if self.label is None else np.flatnonzero(labels == self.label)
            columns = {}
            for c in self.columns:
                if c == "label":
                    columns[c] = pa.array(labels[some].astype(np.int32))
                elif c == "pixels":
                    flat = pixels[some].astype(np.int16)
                    columns[c] = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * size), pa.array(flat.ravel()))
                elif c == "height":
                    columns[c] = pa.array(np.full(len(some), part.shape[-2], dtype=np.int32))
                elif c == "width":
                    columns[c] = pa.array(np.full(len(some), part.shape[-1], dtype=np.int32))
                else:
                    raise ValueError(f"there is no column {c}")
            yield pa.RecordBatch.from_pydict(columns)


def _bytes(values: np.ndarray) -> bool:
    return not len(values) or bool(values.min() >= 0 and values.max() < 256)


def _checked(head: np.ndarray, magic: int) -> None:
    if struct.unpack(">I", head[:4].tobytes())[0] != magic:
        raise ValueError("this is no file of the idx form")


class _Writer(DataSourceArrowWriter):
    """Files of at most :data:`RECORDS` images and :data:`FILE_BYTES`; a set of names in the folder's list makes them count."""

    def __init__(self, path: str, layout: str, shape: tuple[int, ...]) -> None:
        self.path, self.layout, self.shape = path, layout, shape

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, base = _open(self.path)
        store.create_dir(base, recursive=True)
        size, files, labels, pixels = int(np.prod(self.shape)), [], [], []
        most = max(1, min(RECORDS, FILE_BYTES // size))

        def flush() -> None:
            if not labels:
                return
            name, y, x = uuid.uuid4().hex, np.concatenate(labels), np.concatenate(pixels)
            if self.layout == "idx":
                with store.open_output_stream(f"{base}/{name}-labels") as f:
                    f.write(struct.pack(">II", _LABELS, len(y)) + y.tobytes())
                with store.open_output_stream(f"{base}/{name}-images") as f:
                    f.write(struct.pack(">IIII", _PIXELS, len(y), *self.shape[-2:]) + x.tobytes())
            else:
                with store.open_output_stream(f"{base}/{name}-batch") as f:
                    f.write(np.concatenate([y[:, None], x], axis=1).tobytes())
            files.append({"name": name, "count": len(y), "shape": list(self.shape)})
            labels.clear()
            pixels.clear()

        held = 0
        for batch in batches:
            at, k = {n: k for k, n in enumerate(batch.schema.names)}, 0
            while k < batch.num_rows:
                some = batch.slice(k, min(AT_ONCE, most - held))
                k += some.num_rows
                y, x = some.column(at["label"]), some.column(at["pixels"])
                flat = x.flatten()
                sizes = np.diff(x.offsets.to_numpy())
                if y.null_count or x.null_count or flat.null_count or (sizes != size).any() or not _bytes(y.to_numpy()) or not _bytes(flat.to_numpy()):
                    raise ValueError(f"an image needs a label from 0 to 255 and {size} pixels")
                labels.append(y.to_numpy().astype(np.uint8))
                pixels.append(flat.to_numpy().astype(np.uint8).reshape(-1, size))
                held += some.num_rows
                if held >= most:
                    flush()
                    held = 0
        flush()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = _open(self.path)
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/{_LIST}-{uuid.uuid4().hex}") as f:
            f.write(json.dumps([x for m in messages if m is not None for x in m.files]).encode())


class Idx(DataSource):
    """Grey images; options of a write: ``height`` and ``width`` (28 each if not given)."""

    layout = "idx"

    @classmethod
    def name(cls) -> str:
        return "idx"

    def schema(self) -> str:
        return "label int, pixels array<smallint>, height int, width int"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options["path"], self.layout)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("image sets are appended to, not overwritten")
        return _Writer(self.options["path"], self.layout, self.shape())

    def shape(self) -> tuple[int, ...]:
        return int(self.options.get("height", 28)), int(self.options.get("width", 28))


class Cifar(Idx):
    """Colour images of 32 by 32 as three planes, each behind its label."""

    layout = "cifar"

    @classmethod
    def name(cls) -> str:
        return "cifar"

    def shape(self) -> tuple[int, ...]:
        return 3, 32, 32


def register(spark: SparkSession) -> None:
    """Make both forms known to the session, and bound the batches of pictures that a worker gets."""
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size)) > FILE_BYTES:
        spark.conf.set(size, str(FILE_BYTES))
    if not spark.conf.get("spark.sql.python.filterPushdown.enabled", None) == "true":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Idx)
    spark.dataSource.register(Cifar)
