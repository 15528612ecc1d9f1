"""The trie of rebuilt conversations against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest

from corpusloom.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, k1 long, depth long, length long, part long"


def brute(rows):
    """(conv_id, turn, role, text) -> the rows of the query."""
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32], role, text))
    for turns in own.values():
        turns.sort(key=lambda x: x[:3])
    nodes = {}
    for c in own:
        h = (zlib.crc32(str(c).encode()) & 0xFFFFFFFF) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        path = tuple(x[3:] for x in own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            node = nodes.setdefault(path[:d], {"members": [], "ends": []})
            node["members"].append(c)
            if d == len(path):
                node["ends"].append(c)
    out = []
    for path, node in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        childless = [p for p in below if not any(len(q) == len(p) + 1 and q[:-1] == p for q in below)]
        out.append((
            min(node["members"]), len(path), min(nodes[path[:-1]]["members"]) if path else None, len(node["members"]),
            sum(len(q) == len(path) + 1 for q in below), len(childless),
            sum((len(nodes[p]["members"]) - 1) * len(p[-1][1].encode()) for p in below if p),
            hashlib.sha256(",".join(map(str, sorted(node["ends"]))).encode()).hexdigest(),
        ))
    return sorted(out)


def run(spark, rows, tmp_path):
    path = f"{tmp_path}/t{random.random()}"
    wide = [(*r, 1, 2, 3, 4) for r in rows]
    spark.createDataFrame(wide, SCHEMA).repartition(3).write.parquet(f"{path}/conversations.parquet")
    got = queries.op13_prefix_trie(spark, path)
    assert got.columns == ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got.collect())


def awkward(seed=2):
    """Copies, shared heads, null ids, turns, roles and texts, ties, repeated rows, one long conversation, negative ids."""
    rng = random.Random(seed)
    texts = ["yes", "no", "é" * 30, "", None, "x" * 20_000]
    rows = []
    for c in [*range(0, 40), -7, -3, -5, 101, 103, 10**12 + 1]:
        if c % 7 == 0 and c:
            continue
        rows += [(c, t if rng.random() < 0.9 else None, "user" if t % 2 == 0 else rng.choice(["assistant", None]), rng.choice(texts)) for t in range(rng.randrange(0, 12))]
    rows += [(c, t, "user", f"common {t}") for c in range(200, 260) for t in range(3)]
    rows += [(300, t, "user", "same") for t in range(400)]
    rows += [(301, 0, "user", "tie a"), (301, 0, "user", "tie b"), (301, 0, "user", "tie b"), (301, 1, "user", "b"), (301, 1, "user", "b")]
    rows += [(None, 0, "user", "lost"), (None, None, None, None), (401, None, None, None)]
    return rows


def test_awkward_conversations(spark, tmp_path):
    rows = awkward()
    assert run(spark, rows, tmp_path) == brute(rows)


def test_merging_in_many_rounds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(prefix_trie, "FAN", 2)
    monkeypatch.setattr(prefix_trie, "RUN", 3)
    rows = [r for r in awkward(3) if r[0] != 300]
    assert run(spark, rows, tmp_path) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")], [(1, 0, "user", "only")], [(4, 0, "user", "a"), (4, 1, "user", "b")]])
def test_few_conversations(spark, tmp_path, rows):
    assert run(spark, rows, tmp_path) == brute(rows)


def test_turnless_conversations_end_at_the_root(spark, tmp_path):
    # Conversations without a base whose own turns are fewer than those taken from it.
    rows = [(c, 0, "user", "gone") for c in range(1, 60) if c % 5]
    got = run(spark, rows, tmp_path)
    assert got == brute(rows) and got[0][1] == 0 and got[0][7] != hashlib.sha256(b"").hexdigest()
