"""The idx and cifar forms, written and read."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ShortType

from corpusloom.session import ship
from corpusloom.sources import images


def _images(spark, n, size):
    rng = np.random.default_rng(n)
    rows = [(int(rng.integers(0, 10)), [int(v) for v in rng.integers(0, 256, size)]) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "label int, pixels array<int>")


@pytest.mark.parametrize("form, size", [("idx", 12), ("cifar", 3072)])
def test_round_trip(spark, tmp_path, form, size, monkeypatch):
    ship(spark)
    images.register(spark)
    rows, df = _images(spark, 23, size)
    for part in (df.limit(10), df.subtract(df.limit(10))):
        part.repartition(3).write.format(form).option("height", 3).option("width", 4).mode("append").save(f"file://{tmp_path}/x")
    read = spark.read.format(form).load(f"file://{tmp_path}/x")
    assert sorted((r.label, r.pixels) for r in read.select("label", "pixels").collect()) == sorted(rows)
    assert read.agg(F.min("height"), F.max("width")).first() == ((3, 4) if form == "idx" else (32, 32))
    label = rows[0][0]
    assert sorted(r.pixels for r in read.where(F.col("label") == label).collect()) == sorted(p for y, p in rows if y == label)


def test_labels_alone_do_not_touch_the_pixels(spark, tmp_path):
    images.register(spark)
    rows, df = _images(spark, 9, 12)
    df.coalesce(1).write.format("idx").option("height", 3).option("width", 4).mode("append").save(f"file://{tmp_path}/x")
    for f in tmp_path.glob("x/*-images"):
        f.unlink()
    only = spark.read.format("idx").schema("label int").load(f"file://{tmp_path}/x")
    assert sorted(r.label for r in only.collect()) == sorted(y for y, _ in rows)


def test_files_are_cut_into_partitions(tmp_path, monkeypatch):
    monkeypatch.setattr(images, "RECORDS", 4)
    name = "a"
    x = np.arange(10 * 4, dtype=np.uint8).reshape(10, 4)
    (tmp_path / f"{name}-labels").write_bytes(struct.pack(">II", 0x801, 10) + bytes(range(10)))
    (tmp_path / f"{name}-images").write_bytes(struct.pack(">IIII", 0x803, 10, 2, 2) + x.tobytes())
    (tmp_path / "_committed-1").write_text('[{"name": "a", "count": 10, "shape": [2, 2]}]')
    reader = images.Idx({"path": str(tmp_path)}).reader(images.StructType().add("label", "integer").add("pixels", ArrayType(ShortType())))
    parts = reader.partitions()
    assert [(p.first, p.count) for p in parts] == [(0, 4), (4, 4), (8, 2)]
    got = [(b["label"].to_pylist(), b["pixels"].to_pylist()) for p in parts for b in reader.read(p)]
    assert sum((y for y, _ in got), []) == list(range(10)) and sum((p for _, p in got), []) == x.tolist()


def test_broken_and_uncommitted_files(spark, tmp_path):
    images.register(spark)
    (tmp_path / "b-labels").write_bytes(struct.pack(">II", 0x802, 1) + b"x")
    reader = images.Idx({"path": str(tmp_path)}).reader(images.StructType().add("label", "integer"))
    assert reader.partitions() == []  # no list names it
    with pytest.raises(ValueError, match="idx form"):
        list(reader.read(images.Stretch("b", 0, 1, (1, 1))))
    (tmp_path / "b-labels").write_bytes(struct.pack(">II", 0x801, 900) + b"x")
    with pytest.raises(ValueError, match="shorter"):
        list(reader.read(images.Stretch("b", 0, 900, (1, 1))))
    with pytest.raises(Exception, match="an image needs"):
        spark.createDataFrame([(1, [1, 2, 3])], "label int, pixels array<int>").write.format("idx").option("height", 2).option("width", 2).mode("append").save(f"file://{tmp_path}/y")


def test_a_writer_holds_and_a_reader_reads_a_bounded_number_of_bytes(tmp_path, monkeypatch):
    """Files are cut by bytes, and pictures are read a few at a time."""
    monkeypatch.setattr(images, "FILE_BYTES", 7 * 3072)
    monkeypatch.setattr(images, "AT_ONCE", 3)
    x = np.random.default_rng(1).integers(0, 256, (20, 3072))
    form = images.Cifar({"path": str(tmp_path)})
    writer = form.writer(None, False)
    batch = images.pa.RecordBatch.from_pydict({"label": images.pa.array(np.arange(20) % 10, images.pa.int32()), "pixels": images.pa.array(x.tolist(), images.pa.list_(images.pa.int32()))})
    done = writer.write(iter([batch.slice(0, 11), batch.slice(11)]))
    writer.commit([done])
    assert [f["count"] for f in done.files] == [7, 7, 6]
    reader = form.reader(images.StructType().add("label", "integer").add("pixels", ArrayType(ShortType())))
    got = [b for p in reader.partitions() for b in reader.read(p)]
    assert max(b.num_rows for b in got) == 3
    assert sorted((y, v) for b in got for y, v in zip(b["label"].to_pylist(), b["pixels"].to_pylist())) == sorted(zip((np.arange(20) % 10).tolist(), x.tolist()))
