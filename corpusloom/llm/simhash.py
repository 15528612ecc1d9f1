"""SimHash fingerprints and near-duplicate components by bit-sliced comparison.

Two 64-bit fingerprints at distance 3 or less agree on at least two of five blocks of bits, so
each fingerprint is filed under all ten pairs of blocks and only fingerprints of one file are
compared.  A file holds its fingerprints as 64 bit planes.  Comparing every fingerprint with the
one ``s`` places further on is then 64 exclusive-ors of planes, summed by carry-save counters for
64 fingerprints per machine word; words in which every lane has exceeded the radius are dropped on
the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm import scratch
from corpusloom.llm.components import connected_components

RADIUS = 3
#: Bit positions at which the five blocks begin and end.
BLOCKS = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))
_SEED = 42
_CHUNK = 1 << 15
#: Filed fingerprints compared at once.
_FILED_ROWS = 1 << 16
#: Words of one bit plane, over all shifts compared at once.
_AT_ONCE = 1 << 15


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of ``width`` words, repeats included, ASCII letters lower-cased."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, dtype="<u8")
    width = min(width, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    a, b, digest = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), xxhash.xxh64_intdigest
    return np.array([digest(joined[i:j], _SEED) for i, j in zip(a, b)], dtype="<u8")


def simhash(hashes: np.ndarray) -> int:
    """64 bits, each 1 if set in over half of the hashes; zero without hashes."""
    total = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), _CHUNK):
        total += np.unpackbits(hashes[k : k + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned SimHash of ``text``."""
    return simhash(shingle_hashes(text, width))


def _planes(values: np.ndarray) -> np.ndarray:
    """(64, words) bit planes of unsigned 64-bit values, lane i in bit i % 64 of word i // 64, one spare word."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    packed = np.packbits(bits, axis=1, bitorder="little")
    size = (len(values) + 63) // 64 + 1
    out = np.zeros((64, size * 8), dtype=np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view("<u8")


def within_radius(planes: np.ndarray, run: np.ndarray, s: int, shifts: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Places i and j = i + s .. i + s + shifts - 1 of one run whose values differ in at most ``radius`` bits.

    All shifts begin in one word, so ``s % 64 + shifts`` is at most 64; they are compared at once.
    """
    offset, first = divmod(s, 64)
    size = planes.shape[1] - offset
    bits = np.arange(first, first + shifts, dtype=np.uint64)[:, None]
    same = np.zeros((shifts, size * 64), dtype=np.uint8)
    for k in range(min(shifts, len(run) - s)):
        same[k, : len(run) - s - k] = run[: len(run) - s - k] == run[s + k :]
    valid = np.packbits(same, axis=1, bitorder="little").view("<u8").ravel()
    alive = np.flatnonzero(valid)
    want = valid[alive]
    # counts[k] holds bit k of every lane's distance; over marks lanes that left the counters' range.
    counts = [np.zeros(len(alive), dtype="<u8") for _ in range(max(1, radius.bit_length()))]
    over = np.zeros(len(alive), dtype="<u8")
    for block in range(0, 64, 8):
        own = planes[block : block + 8]
        after = np.concatenate([own[:, offset + 1 :], np.zeros((8, 1), dtype="<u8")], axis=1)
        shifted = (own[:, None, offset:] >> bits) | ((after[:, None, :] << np.uint64(1)) << (np.uint64(63) - bits))
        a, b = own[:, alive % size], shifted.reshape(8, -1)[:, alive]
        for bit in range(8):
            carry = a[bit] ^ b[bit]
            for k, c in enumerate(counts):
                counts[k], carry = c ^ carry, c & carry
            over |= carry
        full = (~over & want) != 0
        if not full.all():
            alive, over, want = alive[full], over[full], want[full]
            counts = [c[full] for c in counts]
            if not len(alive):
                return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    # A distance exceeds the radius where, at the first bit in which they differ, the distance has the one.
    equal, more = ~np.zeros_like(over), over
    for k in reversed(range(len(counts))):
        if radius >> k & 1:
            equal = equal & counts[k]
        else:
            more, equal = more | (equal & counts[k]), equal & ~counts[k]
    good = ~more & want
    word, lane = np.nonzero(np.unpackbits(good.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    shift, at = np.divmod(alive[word], size)
    place = at * 64 + lane
    return place, place + s + shift


def link_runs(run: np.ndarray, values: np.ndarray, radius: int = RADIUS, parent: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """For values filed in runs (equal, adjacent run numbers): each value's group root, and the links that join the groups.

    The links are pairs of positions that were compared; there are at most as many as values.

    Values of one run within ``radius`` of each other are in one group, directly or by a chain.
    A run is dropped from further comparison once all its values are in one group.  ``parent`` goes
    on from an earlier call with a smaller radius.
    """
    n = len(values)
    parent = np.arange(n) if parent is None else parent.copy()

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def flatten() -> None:
        while True:
            up = parent[parent]
            if (up == parent).all():
                return
            parent[:] = up

    where = np.arange(n)
    links: list[tuple[int, int]] = []
    s, planes, local = 1, None, None
    while True:
        # Keep the runs that are longer than s and not yet one group.
        lab, inverse, count = np.unique(run[where], return_inverse=True, return_counts=True)
        roots = parent[where]
        low, high = np.full(len(lab), n), np.full(len(lab), -1)
        np.minimum.at(low, inverse, roots)
        np.maximum.at(high, inverse, roots)
        keep = (count > s) & (low < high)
        if not keep.any():
            flatten()
            return parent, links
        mask = keep[inverse]
        if planes is None or not mask.all():
            where = where[mask]
            planes, local = _planes(values[where]), run[where]
        shifts = int(min(64 - s % 64, count[keep].max() - s, max(1, _AT_ONCE // planes.shape[1])))
        a, b = within_radius(planes, local, s, shifts, radius)
        s += shifts
        if len(a):
            a, b = where[a], where[b]
            open_ = parent[a] != parent[b]
            for i, j in zip(a[open_].tolist(), b[open_].tolist()):
                x, y = root(i), root(j)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    links.append((i, j))
            flatten()


def _linker(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        held: list[tuple[np.ndarray, ...]] = []

        def emit(parts):
            table, masked, fp, cls = (np.concatenate(c) for c in zip(*parts))
            new = np.concatenate([[True], (table[1:] != table[:-1]) | (masked[1:] != masked[:-1])])
            runs = np.cumsum(new)
            several = np.bincount(runs)[runs] > 1
            if not several.any():
                return None
            fp, cls, runs = fp[several], cls[several], runs[several]
            links = np.array(link_runs(runs, fp.view("<u8"), radius)[1], dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(cls[links[:, 0]]), pa.array(cls[links[:, 1]])], names=["u", "v"]) if len(links) else None

        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)))
            rows += batch.num_rows
            if rows > _FILED_ROWS:
                whole = tuple(np.concatenate(c) for c in zip(*held))
                # The last run may go on in the next batch, so it is held back.
                cut = rows - int(((whole[0] == whole[0][-1]) & (whole[1] == whole[1][-1])).sum())
                if cut and (out := emit([tuple(c[:cut] for c in whole)])) is not None:
                    yield out
                held, rows = [tuple(c[cut:] for c in whole)], rows - cut
        if held and (out := emit(held)) is not None:
            yield out

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``rid, id, fp`` for every row, written to the shared folder (``fp`` as signed 64-bit)."""
    scratch.prepare(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            fp = np.array([fingerprint(t, width) for t in batch.column(2).to_pylist()], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["rid", "id", "fp"])

    return scratch.materialize(rows.mapInArrow(run, "rid long, id long, fp long"), "simhash")


def fingerprint_groups(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``classes`` (``fp`` distinct, ``cls`` and other columns) with ``group``, the same for all that links within ``radius`` connect."""
    spark = classes.sparkSession
    masks = []
    for a, b in combinations(range(len(BLOCKS)), 2):
        mask = sum(((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in (BLOCKS[a], BLOCKS[b]))
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    filed = classes.select("fp", "cls", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "masked"))
    filed = filed.repartition("t", "masked").sortWithinPartitions("t", "masked", "fp").select("t", "masked", "fp", "cls")
    with scratch.short_rows(spark, 1 << 16):  # four longs a row
        edges = scratch.materialize(filed.mapInArrow(_linker(radius), "u long, v long"), "simhash-links")
    members = connected_components(edges)
    return classes.join(members.withColumnRenamed("node", "cls"), "cls", "left").withColumn("group", F.coalesce("component", "cls")).drop("component")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id, rid`` for every row.

    Rows with equal fingerprints are one class before any comparison, so copies cost nothing.
    ``component_id`` is the smallest id that can be reached over links; ``rid`` tells rows apart.

    Null and word-less texts have fingerprint zero and are linked like any other.  A null id never
    becomes a component id unless no row of the component has one.  Repeated rows are in one
    component.  Texts of any length are read whole.  Other columns are ignored.  An empty table gives an empty result.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"radius must lie between 0 and {RADIUS}")
    spark = docs.sparkSession
    fps = fingerprints(docs, id_col, text_col, width)
    classes = scratch.materialize(fps.groupBy("fp").agg(F.min("rid").alias("cls"), F.min("id").alias("least_id")), "simhash-classes")
    labelled = fingerprint_groups(classes, radius)
    least = labelled.groupBy("group").agg(F.min("least_id").alias("component_id"))
    by_fp = labelled.join(least, "group").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "rid")


#: Min-wise files for pairs beyond the fingerprint radius: bands, and minima joined in one band's key.
BANDS, ROWS = 20, 5
#: Shingles of one chunk of a min-wise file; a worker holds two chunks.
CHUNK_SHINGLES = 2_000_000
#: What a text counts for beside its shingles.
_TEXT_COST = 16
#: Rows of sets that a worker gathers before it checks the whole blocks among them.
_BLOCK_ROWS = 256


def _sketcher(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        rng = np.random.default_rng(_SEED)
        mul, add = rng.integers(1, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
        mul |= np.uint64(1)
        mix = np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            keys, fps = [], []
            for text in batch.column(1).to_pylist():
                h = shingle_hashes(text, width)
                fps.append(simhash(h))
                least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
                for k in range(0, len(h), 2048):
                    x = h[k : k + 2048, None] * mul + add
                    np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=0), out=least)
                key = np.arange(BANDS, dtype=np.uint64)
                for column in least.reshape(BANDS, ROWS).T:
                    key = (key ^ column) * mix
                    key ^= key >> np.uint64(29)
                keys.append(key.view(np.int64))
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            offsets = np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)
            fp = np.array(fps, dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array(fp)], names=["node", "keys", "fp"])

    return run


def _runs(batches: Iterator[pa.RecordBatch], width: int, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of about ``most`` rows at a time, cut only where the first ``width`` columns change."""
    held: list[tuple[np.ndarray, ...]] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
        rows += batch.num_rows
        if rows > most:
            whole = tuple(np.concatenate(c) for c in zip(*held))
            # The last run may go on in the next batch, so it is held back.
            cut = rows - int(np.logical_and.reduce([c == c[-1] for c in whole[:width]]).sum())
            if cut:
                yield tuple(c[:cut] for c in whole)
            held, rows = [tuple(c[cut:] for c in whole)], rows - cut
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``file, node`` of every file of several nodes, from rows sorted by band, key and node.

    A file is named by a hash of its nodes, so that files of the same nodes become one.
    """
    import pyarrow as pa

    mix = np.uint64(0x9E3779B97F4A7C15)
    for t, masked, node in _runs(batches, 2, _FILED_ROWS):
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (masked[1:] != masked[:-1])])
        fresh = new | np.concatenate([[True], node[1:] != node[:-1]])
        run, node = (np.cumsum(new) - 1)[fresh], node[fresh]
        count = np.bincount(run)
        x = (node.view("<u8") ^ (node.view("<u8") >> np.uint64(31))) * mix
        name = np.add.reduceat(x ^ (x >> np.uint64(29)), np.concatenate([[0], np.cumsum(count)[:-1]]))
        several = count[run] > 1
        yield pa.RecordBatch.from_arrays([pa.array(name.view("<i8")[run[several]]), pa.array(node[several])], names=["file", "node"])


def similar_links(sets: list[np.ndarray], group: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of ``similarity`` or more that join everything which such pairs (and equal groups) connect.

    Every pair is decided: it is compared, or its sets already hang together, or their sizes exclude it.
    """
    links: list[tuple[int, int]] = []
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets, group = [sets[k] for k in order], np.unique(group[order], return_inverse=True)[1]
    size = np.array([len(s) for s in sets], dtype=np.int64)
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.concatenate([[0], np.cumsum(size)])
    members = np.split(np.argsort(group, kind="stable"), np.cumsum(np.bincount(group))[:-1])
    mark = np.zeros(len(values), dtype=bool)
    # The sets not reached so far, smallest first, and their shingles.
    rest, left = np.arange(len(sets)), flat

    def take(groups) -> list[int]:
        nonlocal rest, left
        gone = np.isin(group[rest], groups)
        left, rest = left[np.repeat(~gone, size[rest])], rest[~gone]
        return [int(k) for g in groups for k in members[g]]

    while len(rest):
        queue = take([group[rest[0]]])
        while queue and len(rest):
            i = queue.pop()
            sizes = size[rest]
            a, b = int(np.searchsorted(sizes, int(similarity * size[i]))), int(np.searchsorted(sizes, int(size[i] / similarity) + 1, side="right"))
            if a == b:
                continue
            at = np.concatenate([[0], np.cumsum(sizes)])
            mark[flat[ends[i] : ends[i + 1]]] = True
            found = np.concatenate([[0], np.cumsum(mark[left[at[a] : at[b]]])])
            mark[flat[ends[i] : ends[i + 1]]] = False
            other, bounds = rest[a:b], at[a : b + 1] - at[a]
            common = found[bounds[1:]] - found[bounds[:-1]]
            good = common >= similarity * (size[i] + size[other] - common)
            if good.any():
                groups, first = np.unique(group[other[good]], return_index=True)
                links += [(int(order[i]), int(order[j])) for j in other[good][first]]
                queue += take(groups)
    return links


def _checker(similarity: float):
    """Links of every block from rows ``block, node, group, set`` sorted by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for block, node, group, sets in _runs(batches, 1, _BLOCK_ROWS):
            links: list[tuple[int, int]] = []
            cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if b - a > 1:
                    links += [(node[a + i], node[a + j]) for i, j in similar_links(list(sets[a:b]), group[a:b], similarity)]
            found = np.array(links, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])

    return run


def identity(id_: Column, text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of id and text that tell rows apart."""
    return F.xxhash64(id_, text), F.xxhash64(F.lit(1), id_, text)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``k1, k2, id, component, node`` of every row that is linked to another; ``k1, k2`` are its :func:`identity`.

    Texts are linked when the Jaccard similarity of their sets of ``width``-word shingles is at least
    ``similarity``.  Candidates are the texts that links of SimHash fingerprints (:data:`RADIUS` bits or fewer) connect, and, beyond that radius,
    those that share one of :data:`BANDS` min-wise keys (two texts at 0.8 do so with probability 0.9996).  Every pair of a file is decided exactly on the sets unless checked pairs
    already join its texts; no fingerprint distance drops one.  A file beyond
    :data:`CHUNK_SHINGLES` is first checked by chunks, each with the same one text of the file; then the
    chunks that hold different groups are checked against each other.

    Null counts as empty; word-less texts are equal to each other and form one group.  Rows that
    repeat id and text are one node.  Texts of any length are read whole.  Other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch.prepare(spark)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    id_ = docs[id_col].cast("long")
    k1, k2 = identity(id_, text)
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), id_.alias("id"), text.alias("text"))
    sketches = scratch.materialize(rows.select("k1", "text").mapInArrow(_sketcher(width), "node long, keys array<long>, fp long"), "near-sketches")
    classes = scratch.materialize(sketches.groupBy("fp").agg(F.min("node").alias("cls")), "near-classes")
    groups = scratch.materialize(fingerprint_groups(classes).select("fp", "group"), "near-groups-of-fingerprints")
    # Groups of fingerprints are files like those of the min-wise keys; the first hold what SimHash finds, the others what lies beyond its radius.
    filed = sketches.join(groups, "fp").select("node", F.lit(BANDS).alias("t"), F.col("group").alias("masked"))
    filed = filed.unionAll(sketches.select("node", F.posexplode("keys").alias("t", "masked")))
    filed = filed.repartition("t", "masked").sortWithinPartitions("t", "masked", "node").select("t", "masked", "node")
    with scratch.short_rows(spark, 1 << 16):  # three longs a row
        files = scratch.materialize(filed.mapInArrow(_files, "file long, node long").distinct(), "near-files")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            hashes = [np.unique(shingle_hashes(t, width)).view("<i8") for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(hashes, pa.list_(pa.int64()))], names=["k1", "k2", "id", "set"])

    # Files name texts by one hash; texts that share it all take part, so a collision only adds candidates.
    wanted = scratch.materialize(files.select(F.col("node").alias("k1")).distinct(), "near-wanted")
    involved = rows.join(scratch.few_or_merged(wanted), "k1", "left_semi").dropDuplicates(["k1", "k2"]).select("k1", "k2", "id", "text")
    involved = involved.mapInArrow(sets, "k1 long, k2 long, id long, set array<long>")
    involved = scratch.materialize(involved.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "id", "set"), "near-sets")
    files = files.select("file", F.col("node").alias("k1")).join(involved.select("k1", "node"), "k1").select("file", "node")

    def check(blocks: DataFrame) -> DataFrame:
        held = blocks.join(involved.select("node", "set"), "node").select("block", "node", "group", "set")
        return held.repartition("block").sortWithinPartitions("block").mapInArrow(_checker(similarity), "u long, v long")

    sized = files.join(involved.select("node", (F.size("set") + _TEXT_COST).alias("cost")), "node")
    cut = lambda *by: F.floor((F.sum("cost").over(W.partitionBy("file").orderBy(*by, "cost", "node").rowsBetween(W.unboundedPreceding, 0)) - F.col("cost")) / CHUNK_SHINGLES)
    whole = sized.groupBy("file").agg(F.sum("cost").alias("all"), F.min("node").alias("pivot"))
    large = scratch.materialize(whole.where(F.col("all") > CHUNK_SHINGLES), "near-large")
    small = sized.join(large, "file", "left_anti").select(F.col("file").alias("block"), "node", F.col("node").alias("group"))
    links = scratch.materialize(check(small), "near-links")
    if not large.isEmpty():
        chunked = sized.join(large, "file").withColumn("chunk", cut())
        named = lambda *by: F.xxhash64("file", *by)
        pivots = chunked.select("file", "chunk", F.col("pivot").alias("node")).distinct()
        blocks = chunked.select("file", "chunk", "node").unionAll(pivots).distinct().select(named("chunk").alias("block"), "node", F.col("node").alias("group"))
        links = scratch.materialize(links.unionAll(check(blocks)), "near-links")
        members = connected_components(links).withColumnRenamed("component", "group")
        grouped = sized.join(large, "file", "left_semi").join(members, "node", "left").withColumn("group", F.coalesce("group", "node"))
        grouped = scratch.materialize(grouped.withColumn("chunk", cut("group")), "near-chunks")
        chunks = grouped.groupBy("file", "chunk").agg(F.min("group").alias("low"), F.max("group").alias("high"))
        other = chunks.select("file", F.col("chunk").alias("after"), F.col("low").alias("low_"), F.col("high").alias("high_"))
        undecided = chunks.join(other, "file").where((F.col("chunk") <= F.col("after")) & (F.least("low", "low_") < F.greatest("high", "high_")))
        undecided = undecided.select("file", named("chunk", "after").alias("block"), F.explode(F.array_distinct(F.array("chunk", "after"))).alias("chunk"))
        links = scratch.materialize(links.unionAll(check(grouped.join(undecided, ["file", "chunk"]).select("block", "node", "group"))), "near-links")
    members = connected_components(links)
    members = members.unionAll(members.select(F.col("component").alias("node"), "component").distinct())
    return members.join(involved.select("node", "k1", "k2", "id"), "node").select("k1", "k2", "id", "component", "node")
