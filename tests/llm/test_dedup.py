import collections
import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup as E
from corpusloom.llm import repeats as R
from corpusloom.llm import simhash as S
from corpusloom.llm.components import connected_components
from tests.llm.cases import collect, documents, frame

_DROP = str.maketrans("", "", E.IGNORED)


# --- exact -----------------------------------------------------------------------------------


@pytest.mark.parametrize("key_bits, bucket_bytes", [(64, 4 << 20), (3, 500)])
def test_exact_groups_match_brute_force(spark, key_bits, bucket_bytes):
    rows = documents()
    got = collect(E.exact_dedup(frame(spark, rows), key_bits=key_bits, bucket_bytes=bucket_bytes))
    assert len(got) == len(rows)
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[(t or "").translate(_DROP)].append((-len(t or ""), i is None, i))
    expected = collections.Counter()
    for norm, members in groups.items():
        best = min(members)[2]
        for _, _, i in members:
            expected[i, best, len(members), hashlib.sha256(norm.encode()).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == expected
    kept = collections.Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_empty_table(spark):
    assert collect(E.exact_dedup(frame(spark, []))) == []


def test_directory_doubles_only_where_needed():
    depth, directory, buckets = E.build_directory({0: 10, 1: 10, 200: 1}, 8, 12)
    assert depth == 8 and directory[0] != directory[1] and len(directory) == 256
    assert len(set(directory.tolist())) == len(buckets) < 20
    assert E.build_directory({5: 1000}, 4, 10)[0] == 4  # one address cannot be split further
    assert E.build_directory({}, 4, 10)[0] == 0


def test_addresses_go_on_splitting_below_the_directory():
    histogram = {0: 10, 1: 11, 2: 41, 3: 0}
    depth, directory, _ = E.build_directory(histogram, 2, 10)
    further = E.further_depths(histogram, 2, 10)
    assert depth == 2 and further.tolist() == [0, 1, 3, 0]
    key = lambda address, below: (address << 62 | below << 59) - (1 << 64 if address > 1 else 0)
    places = {a: [E.bucket_of(key(a, b), depth, directory, further) for b in range(8)] for a in range(4)}
    assert [len(set(places[a])) for a in range(4)] == [1, 2, 8, 1]
    assert len({p for a in range(4) for p in places[a]}) == 12
    assert places[1] == sorted(places[1]) and places[2] == sorted(places[2])


def test_exact_groups_with_few_address_bits(spark, monkeypatch):
    rows = [(i, f"text {i % 60} " + "y" * (i % 7 == 0), "en", "s") for i in range(240)]
    docs = frame(spark, rows)
    whole = sorted(map(str, collect(E.exact_dedup(docs))))
    monkeypatch.setattr(E, "ADDRESS_BITS", 2)
    assert sorted(map(str, collect(E.exact_dedup(docs, bucket_bytes=200)))) == whole


def test_mapper_sends_a_text_at_once_and_holds_no_text():
    import pyarrow as pa

    types = [pa.int64()] * 5 + [pa.binary(), pa.binary()]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=list("abcdefg"))
    row = lambda i, word: (i, i, 9 + i, 0, word, str(word).encode(), b"x" * 1000 + str(word).encode())
    depth, directory, _ = E.build_directory({}, 2, 10)
    sent = E._mapper(depth, directory, E.further_depths({}, 2, 10))(iter([batch([row(0, 5), row(1, 6)]), batch([row(2, 5), row(3, 5)])]))
    first = next(sent).to_pylist()
    assert [(r["rid"], r["norm"][-1:]) for r in first if r["kind"] == E._TEXT] == [(0, b"5"), (1, b"6")]
    later = [r for b in sent for r in b.to_pylist()]
    assert [(r["rid"], r["n"], r["members"], r["norm"]) for r in later if r["kind"] == E._TEXT] == [(3, 12, 2, None)]
    assert [r["rid"] for r in first + later if r["kind"] == E._MEMBER] == [0, 1, 2, 3]


def test_row_groups_of_written_tables_are_bounded(spark):
    import glob

    import pyarrow.parquet as pq

    E.scratch.prepare(spark)
    table = E.scratch.materialize(spark.range(0, 2_000_000, 1, 1).select(F.sha2(F.col("id").cast("string"), 256).alias("h")), "groups")
    (path,) = glob.glob(table.inputFiles()[0].removeprefix("file://"))
    meta = pq.ParquetFile(path).metadata
    assert max(meta.row_group(k).total_byte_size for k in range(meta.num_row_groups)) < 2 * E.scratch.GROUP_BYTES and meta.num_rows == 2_000_000
    assert spark.conf.get("parquet.hadoop.vectored.io.enabled") == "false"


# --- simhash -----------------------------------------------------------------------------------


def _fingerprint(text, width=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    width = min(width, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[k : k + width]).encode(), 42) for k in range(len(words) - width + 1)] if words else []
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def _groups(items, linked):
    parent = list(range(len(items)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(items)):
        for b in range(a):
            if linked(items[a], items[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(items))]


def test_simhash_components_match_brute_force(spark):
    rows = [r for r in documents() if r[0] != 20]
    got = collect(S.simhash_components(frame(spark, rows)))
    prints = [_fingerprint(t) for _, t, *_ in rows]
    group = _groups(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (i, *_), g in zip(rows, group):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    expected = collections.Counter((i, f"{p:016x}", least[g]) for (i, *_), p, g in zip(rows, prints, group))
    assert collections.Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == expected


def test_simhash_empty_table(spark):
    assert collect(S.simhash_components(frame(spark, []))) == []


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 7, 20])
def test_bit_sliced_links_match_popcount(radius):
    rng = np.random.default_rng(radius)
    for n in (1, 2, 63, 64, 65, 200):
        values = rng.integers(0, 1 << 63, 6, dtype=np.uint64)[rng.integers(0, 6, n)]
        for k in range(n):
            for _ in range(rng.integers(0, radius + 4)):
                values[k] ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
        run = np.sort(rng.integers(0, 4, n))
        parent, links = S.link_runs(run, values, radius)
        near = lambda a, b: a[0] == b[0] and (a[1] ^ b[1]).bit_count() <= radius
        assert parent.tolist() == _groups(list(zip(run.tolist(), values.tolist())), near)
        assert all(near((run[a], int(values[a])), (run[b], int(values[b]))) for a, b in links)
        assert len(links) == n - len(set(parent.tolist()))


def test_files_split_over_batches_are_joined(spark, monkeypatch):
    """A file of fingerprints that spans Arrow batches is compared as a whole."""
    import pyarrow as pa

    monkeypatch.setattr(S, "_FILED_ROWS", 8)
    rng = np.random.default_rng(0)
    table = np.repeat(np.arange(5, dtype=np.int32), 9)
    masked = np.zeros(45, dtype=np.int64)
    fp = np.repeat(rng.integers(0, 1 << 62, 5), 9) ^ (1 << (np.arange(45) % 9))
    batches = [pa.RecordBatch.from_arrays([pa.array(c[k : k + 4]) for c in (table, masked, fp, np.arange(45))], names=list("abcd")) for k in range(0, 45, 4)]
    links = [(a, b) for out in S._linker(3)(iter(batches)) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
    assert len(links) == 5 * 8 and all(a // 9 == b // 9 for a, b in links)


def test_near_duplicates_at_the_threshold(spark):
    words = [f"w{k}" for k in range(204)]  # 200 shingles of five words
    some = words.copy()
    some[100:104] = ["a", "b", "c", "d"]  # breaks 8: 192 / 208 > 0.8
    many = words.copy()
    many[20:180:9] = ["z"] * len(many[20:180:9])  # breaks far more than 0.2
    rows = [(1, " ".join(words), "", ""), (2, " ".join(some), "", ""), (3, " ".join(many), "", ""), (4, " ".join(words).upper(), "", ""), (5, None, "", ""), (6, " ", "", "")]
    got = collect(S.near_duplicates(frame(spark, rows)))
    groups = collections.defaultdict(set)
    for r in got:
        groups[r["component"]].add(r["id"])
    assert sorted(map(sorted, groups.values())) == [[1, 2, 4], [5, 6]]


def test_near_duplicates_recall_is_that_of_brute_force(spark):
    import random

    rng = random.Random(3)
    rows, texts = [], []
    for k in range(40):
        words = [f"v{rng.randrange(5000)}" for _ in range(150)]
        texts.append(words)
        for share in (0, 1, 2, 3):  # single words changed: 5 shingles each
            copy = words.copy()
            for at in rng.sample(range(5, 145), share):
                copy[at] = f"n{rng.randrange(10**6)}"
            rows.append((4 * k + share, " ".join(copy), "", ""))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t, *_ in rows}
    ids = sorted(sets)
    group = _groups(ids, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    sizes = collections.Counter(group)
    expected = {i: ids[g] for i, g in zip(ids, group) if sizes[g] > 1}
    got = collections.defaultdict(list)
    for r in collect(S.near_duplicates(frame(spark, rows))):
        got[r["component"]].append(r["id"])
    found = {i: min(members) for members in got.values() for i in members}
    assert found == expected


def _true_groups(texts, width=5):
    sets = [{tuple(t[k : k + width]) for k in range(len(t) - width + 1)} for t in texts]
    return _groups(list(range(len(sets))), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))


def _near_groups(spark, texts):
    """The smallest index of each text's group, as found."""
    found = list(range(len(texts)))
    members = collections.defaultdict(list)
    for r in collect(S.near_duplicates(frame(spark, [(i, " ".join(t), "", "") for i, t in enumerate(texts)]))):
        members[r["component"]].append(r["id"])
    for ids in members.values():
        for i in ids:
            found[i] = min(ids)
    return found


def _template(pairs, singles):
    """Texts of 100 shingles that share 85 or so: planted pairs above 0.8, all others below."""
    import random

    rng = random.Random(pairs)
    shared = [f"s{k}" for k in range(89)]
    own = lambda: [f"o{rng.randrange(10**9)}" for _ in range(15)]
    out = []
    for _ in range(pairs):
        tail = own()
        out += [shared + tail, shared + tail[:5] + own()[:10]]
    out += [shared + own() for _ in range(singles)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("pairs, singles", [(20, 10), (150, 50)])
def test_near_duplicates_of_a_template_match_brute_force(spark, pairs, singles):
    """Most pairs of a file fail the exact check; none may keep another from being checked."""
    texts = _template(pairs, singles)
    expected = _true_groups(texts)
    assert len(set(expected)) == pairs + singles
    assert _near_groups(spark, texts) == expected


def test_near_duplicates_that_repeat_a_passage(spark):
    """Equal sets of shingles are linked however often a text repeats a passage."""
    texts = []
    for k in range(20):
        words, passage = [f"a{k}_{j}" for j in range(200)], [f"p{k}_{j}" for j in range(5)]
        texts += [words + passage * 2, words + passage * 1000]
    assert _near_groups(spark, texts) == _true_groups(texts) == [k - k % 2 for k in range(40)]


def test_near_duplicates_in_chunks_match_brute_force(spark, monkeypatch):
    """A file beyond one chunk is decided as a whole, also between its chunks."""
    texts = _template(30, 10) + [[f"c{k}" for k in range(100)] + [f"x{j}"] for j in range(40)]
    monkeypatch.setattr(S, "CHUNK_SHINGLES", 1000)
    assert _near_groups(spark, texts) == _true_groups(texts)


def test_similar_links_connect_what_brute_force_connects():
    rng = np.random.default_rng(1)
    for n in (2, 3, 40):
        sets = [np.unique(rng.integers(0, 30, rng.integers(0, 30))) for _ in range(n)]
        group = rng.integers(0, n, n)
        near = lambda i, j: len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j]))
        links = S.similar_links(sets, group, 0.5)
        assert all(near(i, j) for i, j in links)
        linked = {(min(p), max(p)) for p in links}
        whole = _groups(list(range(n)), lambda i, j: near(i, j) or group[i] == group[j])
        assert _groups(list(range(n)), lambda i, j: (min(i, j), max(i, j)) in linked or group[i] == group[j]) == whole


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(0, 50)] + [(1000, 1000 + k) for k in range(1, 60)] + [(5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(1, 51)} | {1000 + k: 1000 for k in range(1, 60)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


# --- repeats -----------------------------------------------------------------------------------


def _repeats(rows, length, keep_first):
    data = sorted(((i is None, i or 0, k, (t or "").encode()) for k, (i, t, *_) in enumerate(rows)), key=lambda r: (r[0], r[1]))
    seen = collections.Counter(b[p : p + length] for *_, b in data for p in range(len(b) - length + 1))
    earlier, out = set(), collections.Counter()
    whole = {}
    for last, i, _, b in data:
        mask = bytearray(len(b))
        if keep_first:
            first = whole.setdefault(b, (last, i)) == (last, i)
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if (s in earlier and not (keep_first and first and whole[b] != (last, i))) if keep_first else seen[s] > 1:
                mask[p : p + length] = b"\1" * length
            earlier.add(s) if keep_first else None
        kept = bytes(x for x, m in zip(b, mask) if not m)
        spans = sum(1 for p in range(len(b)) if mask[p] and (not p or not mask[p - 1]))
        out[None if last else i, len(b), sum(mask), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("owner_bytes", [R.OWNER_BYTES, 400, 0])
def test_repeats_match_brute_force(spark, owner_bytes):
    rows = [r for r in documents() if r[0] not in (20,)]
    got = collect(R.remove_repeats(frame(spark, rows), length=60, keep_first=False, owner_bytes=owner_bytes))
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == _repeats(rows, 60, False)


@pytest.mark.parametrize("owner_bytes", [R.OWNER_BYTES, 400, 0])
def test_repeats_keep_the_first(spark, owner_bytes):
    rows = [r for r in documents() if r[0] not in (14, 20, 21)]
    got = collect(R.remove_repeats(frame(spark, rows), length=60, keep_first=True, owner_bytes=owner_bytes))
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == _repeats(rows, 60, True)


def test_repeats_very_long_and_empty(spark):
    rows = [r for r in documents() if r[0] in (20, 1, 21)]
    got = collect(R.remove_repeats(frame(spark, rows), keep_first=False))
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == _repeats(rows, 200, False)
    assert collect(R.remove_repeats(frame(spark, []))) == []


def test_repeats_of_a_passage_that_very_many_texts_share(spark):
    """One anchor with more than 20,000 places and as many distinct pieces, split by longer grams."""
    rng = np.random.default_rng(5)
    passage = "".join(chr(c) for c in rng.integers(97, 123, 230))
    around = lambda: "".join(chr(c) for c in rng.integers(97, 123, 30))
    rows = [(k, around() + passage + around(), "en", "a") for k in range(20_500)]
    got = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    got = R.remove_repeats(got, keep_first=False, owner_bytes=1 << 18)
    expected = _repeats(rows, 200, False)
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in collect(got)) == expected


def _shared(a, b, most):
    return next((k for k in range(most) if a[k] != b[k]), most)


@pytest.mark.parametrize("length", [40, 60, 200])
def test_suffix_arrays_and_factors_match_brute_force(length):
    rng = np.random.default_rng(length)
    pieces = [bytes(rng.integers(97, 99, rng.integers(length, length + 60), dtype=np.uint8)) for _ in range(12)]
    pieces = list(dict.fromkeys([*pieces, pieces[0][3:] + b"x" * 3, pieces[1][:length], pieces[2][-length:]]))
    suffixes = [p[k : k + length] for p in pieces for k in range(len(p) - length + 1)]
    order, shared = R.suffix_array(pieces, length)
    expected = sorted(range(len(suffixes)), key=lambda k: (suffixes[k], k))
    assert order.tolist() == expected
    assert shared.tolist() == [_shared(suffixes[a], suffixes[b], length) for a, b in zip(expected, expected[1:])]
    factors = R.longest_previous_factors(order.tolist(), shared.tolist())
    assert all(factors[i] == max((_shared(suffixes[i], suffixes[j], length) for j in range(i)), default=0) for i in range(len(suffixes)))
    for keep_first in (False, True):
        flags = np.concatenate(R.repeated_starts(pieces, length, keep_first)).tolist()
        assert flags == [(s in suffixes[:k]) if keep_first else suffixes.count(s) > 1 for k, s in enumerate(suffixes)]


@pytest.mark.parametrize("gram", [32, 117, 200])
def test_gram_hashes_depend_on_the_gram_only(gram):
    data = bytes(np.random.default_rng(gram).integers(97, 99, 400, dtype=np.uint8)) * 2
    hashes = R._gram_hashes(np.frombuffer(data, np.uint8), gram).tolist()
    assert len(hashes) == len(data) - gram + 1
    assert len(set(zip(hashes, (data[k : k + gram] for k in range(len(hashes)))))) == len(set(hashes)) < len(hashes)


def test_anchors_cover_every_start_and_depend_on_content_only(monkeypatch):
    rng = np.random.default_rng(0)
    data = bytes(rng.integers(97, 101, 3000, dtype=np.uint8))
    whole = R.anchors(data, 100)
    assert whole[1][0] == 0 and whole[2][-1] == len(data) - 100 and (whole[1][1:] == whole[2][:-1] + 1).all()
    by_start = lambda found: [int(h) for h, a, b in zip(*found) for _ in range(a, b + 1)]
    monkeypatch.setattr(R, "_STRETCH", 256)
    assert by_start(R.anchors(data, 100)) == by_start(whole)
    assert by_start(R.anchors(b"xyz" + data[500:900], 100))[3:] == by_start(whole)[500:801]


def test_near_duplicates_come_from_fingerprints_too(spark, monkeypatch):
    """With min-wise keys that no two texts share, near copies are found by their SimHash fingerprints, and checked exactly."""
    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in rng.integers(0, 10**6, 4000)]
    texts = [base, [*base[:-1], "other"], ["first", *base[1:]], [f"w{k}" for k in rng.integers(0, 10**6, 4000)]]
    rows = frame(spark, [(i, " ".join(t), "", "") for i, t in enumerate(texts)])
    posexplode = F.posexplode
    monkeypatch.setattr(S.F, "posexplode", lambda c: posexplode(F.array(F.xxhash64("node"))) if isinstance(c, str) else posexplode(c))
    assert sorted(r["id"] for r in collect(S.near_duplicates(rows))) == [0, 1, 2]
