"""A trie of conversations by their turns, built from partial tries.

A node is a sequence of turns.  Its key is its depth and a sum of hashes of (place, turn), so the keys of all prefixes of a
conversation are running sums, scanned range by range (:mod:`corpusloom.operators.segments`); turns go
by a digest, and texts are read once and left behind.

* Partial tries: each task sums up the members of the nodes it sees, and tables of neighbouring tasks are merged by
  key in rounds of :data:`FAN`, until one table is left.  The ids that end at a node are merged as sorted runs.
* Rollup from the bottom: a node belongs to its smallest member, whose nodes are the lower end of its path, a chain.
  Sums run up each chain from its deepest node; what a chain sums up to is then added to every node above it on
  its member's path.  That takes the same few steps at any depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from corpusloom.llm import scratch
from corpusloom.operators import segments

#: Partial tables merged into one in a round.
FAN = 512
#: Ids in one run of a node's end list.
RUN = 1 << 15
_BITS = (1 << 62) - 1
KEY = ["k1", "k2", "depth"]


def turn_digest(role: Column, text: Column) -> Column:
    """128 bits of the SHA-256 of a turn's role, preceded by its length, and text."""
    return F.unhex(F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))


def numbered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, pos, digest, bytes`` for each turn: its place from 0 in the order of ``turn``, nulls first.

    Turns of one number are ordered by their digest.  Null role or text becomes empty.  Turns without a conversation id
    are of none and left out.  A conversation of any length is spread over tasks.
    """
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = conversations.select(conversations[conv_col].cast("long").alias("conv_id"), conversations[turn_col].alias("turn"), turn_digest(role, text).alias("digest"), F.octet_length(text).cast("long").alias("bytes"), F.lit(1).alias("one")).where("conv_id is not null")
    counted = segments.scan(turns, ["conv_id"], ["turn", "digest"], segments.sums({"upto": "one"}), keep=lambda t: scratch.materialize(t, "turns"))
    return counted.select("conv_id", (F.col("upto") - 1).alias("pos"), "digest", "bytes")


def shared_heads(turns: DataFrame, base: Column, taken: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns come from another.

    Conversation ``conv_id`` consists of the first ``taken`` turns (at most ``most``; all if there are fewer, none if there is no such
    conversation) of the conversation ``base``, both expressions of ``conv_id``, and its own turns after its first ``taken``.
    Returns ``conv_id, length`` of each conversation, and their turns.
    """
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"base": base, "taken": taken})
    lengths = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    head = F.least("taken", F.coalesce("base_n", F.lit(0)))
    plan = counts.join(lengths, "base", "left").select("conv_id", "base", "taken", head.alias("head"), (head + F.greatest(F.col("n") - F.col("taken"), F.lit(0))).alias("length"))
    plan = scratch.materialize(plan, "rebuilt")
    own = turns.join(plan, "conv_id").where("pos >= taken").select("conv_id", (F.col("head") + F.col("pos") - F.col("taken")).alias("pos"), "digest", "bytes")
    heads = turns.where(F.col("pos") < most).withColumnRenamed("conv_id", "base")
    copied = plan.where("head > 0").join(heads, "base").where("pos < head").select("conv_id", "pos", "digest", "bytes")
    return plan.select("conv_id", "length"), own.unionAll(copied)


def _wrapped_sums(columns: dict[str, str]) -> segments.Scan:
    """Running sums of hashes modulo 2^62."""
    plain = segments.sums(columns)

    def local(batch: pa.RecordBatch, starts: np.ndarray, before: list[pa.Array] | None) -> list[pa.Array]:
        import pyarrow as pa

        return [pa.array(x.to_numpy() & _BITS) for x in plain.local(batch, starts, before)]

    def join(a: Sequence[Any], b: Sequence[Any]) -> Sequence[Any]:
        return [(x + y) & _BITS for x, y in zip(a, b)]

    return segments.Scan({c: ST.LongType() for c in columns}, local, join, lambda a, b: [(x + y).bitwiseAND(F.lit(_BITS)) for x, y in zip(a, b)])


def paths(lengths: DataFrame, turns: DataFrame) -> DataFrame:
    """``conv_id, depth, k1, k2, p1, p2, bytes, ends``: a row for each conversation and node on its path, the root too.

    ``k1, k2`` and the depth are the node's key, ``p1, p2`` its parent's; ``ends`` marks the last node.
    """
    root = lengths.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes"))
    part = lambda salt: F.when(F.col("pos") < 0, F.lit(0)).otherwise(F.xxhash64(F.lit(salt), "pos", "digest").bitwiseAND(F.lit(_BITS)))
    rows = turns.select("conv_id", "pos", "digest", "bytes").unionAll(root).join(lengths, "conv_id")
    rows = rows.select("conv_id", (F.col("pos") + 1).alias("depth"), part(1).alias("e1"), part(2).alias("e2"), "bytes", (F.col("pos") + 1 == F.col("length")).alias("ends"))
    summed = segments.scan(rows, ["conv_id"], ["depth"], _wrapped_sums({"k1": "e1", "k2": "e2"}), keep=lambda t: scratch.materialize(t, "paths"))
    parent = lambda k, e: (F.col(k) - F.col(e)).bitwiseAND(F.lit(_BITS))
    return summed.select("conv_id", "depth", "k1", "k2", parent("k1", "e1").alias("p1"), parent("k2", "e2").alias("p2"), "bytes", "ends")


def merged_nodes(rows: DataFrame) -> DataFrame:
    """``k1, k2, depth, p1, p2, bytes, conv_id, n_convs``: one row a node, with its smallest member and their number.

    Each task's partial trie is a table of the nodes it met.  Tables are merged by key, :data:`FAN` neighbours at a time.
    """
    what = [F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("bytes").alias("bytes"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs")]
    tables = rows.rdd.getNumPartitions()
    merged = rows.withColumns({"n_convs": F.lit(1).cast("long"), "part": F.spark_partition_id()})
    while tables > 1:
        tables = -(-tables // FAN)
        merged = merged.groupBy(*KEY, F.floor(F.col("part") / FAN).alias("part")).agg(*what)
    return merged.groupBy(*KEY).agg(*what) if rows.rdd.getNumPartitions() <= 1 else merged.drop("part")


def end_runs(rows: DataFrame) -> DataFrame:
    """``k1, k2, depth, first, ids``: the conversations that end at each node, in sorted runs of at most :data:`RUN`.

    A node's runs follow each other by ``first``; a node at which many end has many runs, from many tasks.
    """
    ends = rows.where("ends").select(*KEY, "conv_id")
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ends.repartitionByRange(count, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        node, ids = None, []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in (*node, ids[0])], pa.array([ids], pa.list_(pa.int64()))], names=[*KEY, "first", "ids"])

        for batch in batches:
            for *now, c in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                if ids and (now != node or len(ids) >= RUN):
                    yield done()
                    ids = []
                node = now
                ids.append(c)
        if ids:
            yield done()

    return dealt.mapInArrow(run, "k1 long, k2 long, depth long, first long, ids array<long>")


def end_digests(runs: DataFrame) -> DataFrame:
    """``k1, k2, depth, ends_sha256``: SHA-256 of a node's ids in decimal, ascending, joined by commas.

    The hash of a list is a chain from its first byte to its last, so a node's runs stream through one task,
    which holds one run at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        node, state = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in node], pa.array([state.hexdigest()])], names=[*KEY, "ends_sha256"])

        for batch in batches:
            for k in range(batch.num_rows):
                now = [batch.column(c)[k].as_py() for c in range(3)]
                text = ",".join(map(str, batch.column(4)[k].as_py()))
                if now == node:
                    state.update(f",{text}".encode())
                    continue
                if node is not None:
                    yield done()
                node, state = now, hashlib.sha256(text.encode())
        if node is not None:
            yield done()

    return runs.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(run, "k1 long, k2 long, depth long, ends_sha256 string")


def rolled_up(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``parent_conv_id, n_children, n_leaves, saved_tokens``, the last two over each node's subtree."""
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    known = nodes.join(children, KEY, "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "up": -F.col("depth")})
    known = known.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes")})
    # From the deepest node of each chain to its top.
    chained = segments.scan(known, ["conv_id"], ["up"], segments.sums({"own_leaves": "leaf", "own_saved": "saved"}), keep=lambda t: scratch.materialize(t, "chains"))
    tops = chained.groupBy("conv_id").agg(F.max("own_leaves").alias("leaves"), F.max("own_saved").alias("tokens"), F.min("depth").alias("top"))
    above = rows.join(tops.where("leaves > 0 or tokens > 0"), "conv_id").where("depth < top").groupBy(*KEY).agg(F.sum("leaves").alias("leaves"), F.sum("tokens").alias("tokens"))
    # A chain's top hangs on a node of another member; all others on the node above in the chain.
    heads = chained.join(tops.select("conv_id", F.col("top").alias("depth")), ["conv_id", "depth"])
    first = nodes.where("depth = 0").select("conv_id").first()  # the root's
    hung = heads.where("depth > 1").select(*KEY, "p1", "p2").join(
        nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("hung_on")), ["p1", "p2", "depth"]
    ).select(*KEY, "hung_on")
    parent = F.when(F.col("depth") == 1, F.lit(first.conv_id if first else None).cast("long")).when(F.col("depth") > 1, F.coalesce("hung_on", "conv_id"))
    joined = chained.join(hung, KEY, "left").join(above, KEY, "left")
    return joined.select(
        *KEY, "conv_id", parent.alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("own_leaves") + F.coalesce("leaves", F.lit(0))).alias("n_leaves"), (F.col("own_saved") + F.coalesce("tokens", F.lit(0))).alias("saved_tokens"),
    )


def prefix_trie(lengths: DataFrame, turns: DataFrame) -> DataFrame:
    """All nodes of the trie of conversations (``conv_id, length``) with the given turns (``conv_id, pos, digest, bytes``).

    Returns ``k1, k2, depth, conv_id`` (smallest member)``, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.
    Conversations without turns are members of the root, and end there.  Conversations that repeat each other share all
    nodes.  Without conversations there are no nodes, not even the root.  Texts of any length go by their digest.
    """
    scratch.prepare(lengths.sparkSession)
    with scratch.short_rows(lengths.sparkSession, 1 << 13):
        rows = paths(lengths, turns)
        nodes = scratch.materialize(merged_nodes(rows), "nodes")
        rolled = rolled_up(rows, nodes)
        ends = scratch.materialize(end_digests(end_runs(rows)), "ends")
    empty = hashlib.sha256(b"").hexdigest()
    return rolled.join(ends, KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty)))
