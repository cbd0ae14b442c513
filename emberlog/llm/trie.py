"""The trie of conversation prefixes: which turns conversations share from their start."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import stored
from emberlog.llm.forward import SHARD_NODES, subtree_totals
from emberlog.operators.numbering import numbered

# A prefix is identified by a polynomial of its turns' digests over a prime field: prefixes of
# parts of a conversation, sorted in different tasks, combine by one multiplication.
_PRIME, _BASE = (1 << 127) - 1, 0x5DEECE66D1E35A7F3C6EF372FE94F82B
_ROOT = bytes(16)
_CHUNK_CHARS, _OUT_ROWS = 1 << 16, 20_000
_CHAIN = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("id", pa.binary()), ("parent", pa.binary()), ("bytes", pa.int64()), ("_part", pa.int64())])


def _whole_numbers(column: str):
    return F.col(column).cast("bigint")


def rebuilt(conversations: DataFrame, group: int = 5, shares: int = 9) -> DataFrame:
    """(conv_id, turn, role, text): every conversation c with its first h turns replaced by those of
    conversation c - c % group, h = crc32 of c's decimal digits modulo `shares`; turns count from 0.

    All of the other conversation's turns are taken if they are fewer, none if it is absent; c's own
    turns after its first h follow. A conversation may be left without turns and is then absent.
    Turns are ordered by number (null first), role and text; null roles and texts become empty; rows
    without conv_id belong to no conversation. A conversation's turns are numbered by ranges, so one
    may be larger than a task holds.
    """
    rows = conversations.where("conv_id IS NOT NULL").select(
        _whole_numbers("conv_id").alias("conv_id"),
        _whole_numbers("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = stored(numbered(rows, "conv_id", F.asc_nulls_first("turn"), "role", "text", column="n").drop("turn"), "turns")
    heads = rows.groupBy("conv_id").agg(F.min("n").alias("first"), F.count("*").alias("turns"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % shares
    heads = heads.select("conv_id", "first", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    bases = heads.select(F.col("conv_id").alias("base"), F.col("turns").alias("base_turns"))
    heads = stored(heads.join(bases, "base", "left").withColumn("taken", F.coalesce(F.least("h", "base_turns"), F.lit(0))), "heads")
    placed = rows.join(heads.select("conv_id", "first", "h", "taken"), "conv_id").withColumn("k", F.col("n") - F.col("first"))
    own = placed.where("k >= h").select("conv_id", (F.col("taken") + F.col("k") - F.col("h")).alias("turn"), "role", "text")
    openings = placed.where(F.col("k") < shares).select(F.col("conv_id").alias("base"), F.col("k").alias("turn"), "role", "text")
    taken = heads.where("taken > 0").select("conv_id", "base", "taken").join(openings, "base").where("turn < taken")
    return own.unionAll(taken.select("conv_id", "turn", "role", "text"))


def _number(value: bytes) -> int:
    return int.from_bytes(value, "big")


def _chained(batches):
    """Sorted turns: depth and prefix within this partition's part of a conversation."""
    at, depth, value = None, 0, 0
    for batch in batches:
        out = []
        for conv, part, mark, size in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "_part", "mark", "bytes"))):
            if conv != at:
                at, depth, value = conv, 0, 0
            before, value, depth = value, (value * _BASE + _number(mark) + 1) % _PRIME, depth + 1
            out.append((conv, depth, value.to_bytes(16, "big"), before.to_bytes(16, "big"), size, part))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _CHAIN)], schema=_CHAIN)


def _continued(batches, carried: dict):
    """Adds what earlier partitions hold of the conversation that a partition starts with."""
    for batch in batches:
        rows = batch.to_pylist()
        for row in rows:
            conv, depth, value = carried.get(row["_part"], (None, 0, 0))
            if row["conv_id"] == conv:
                raised = pow(_BASE, row["depth"] - 1, _PRIME) * value % _PRIME
                row["parent"] = ((raised + _number(row["parent"])) % _PRIME).to_bytes(16, "big")
                row["id"] = ((raised * _BASE + _number(row["id"])) % _PRIME).to_bytes(16, "big")
                row["depth"] += depth
        yield pa.RecordBatch.from_pylist(rows, _CHAIN)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, id, parent, bytes) per turn: the prefix that it ends, and its text's size.

    Turns are range-sorted by conversation and order, so a long conversation spreads over tasks; what
    the driver sees is one row per partition. Equal prefixes have equal ids (127 bits).
    """
    mark = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    rows = turns.select("conv_id", "turn", "role", "text", mark.alias("mark"), F.octet_length("text").cast("bigint").alias("bytes"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id().cast("bigint"))
    kind = "conv_id bigint, depth bigint, id binary, parent binary, bytes bigint, _part bigint"
    chains = stored(rows.select("conv_id", "_part", "mark", "bytes").mapInArrow(_chained, kind), "chains")
    last = F.max(F.struct("conv_id", "depth", "id")).alias("last")
    carried, conv, depth, value = {}, None, 0, 0
    for row in chains.groupBy("_part").agg(F.min("conv_id").alias("first"), last).orderBy("_part").collect():
        here = row["last"]
        if row["first"] == conv:
            carried[row["_part"]] = (conv, depth, value)
        if here["conv_id"] == conv:
            value = (value * pow(_BASE, here["depth"], _PRIME) + _number(here["id"])) % _PRIME
            depth += here["depth"]
        else:
            conv, depth, value = here["conv_id"], here["depth"], _number(here["id"])
    if carried:
        chains = stored(chains.mapInArrow(lambda batches: _continued(batches, carried), kind), "chains")
    return chains.drop("_part")


def _joined(batches):
    """Sorted (id, conv_id): the ids of a node's conversations, comma-joined, in pieces."""
    at, first, parts, size, out = None, None, [], 0, []
    schema = pa.schema([("id", pa.binary()), ("first", pa.int64()), ("part", pa.string())])

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    for batch in batches:
        for node, conv in zip(batch.column("id").to_pylist(), batch.column("conv_id").to_pylist()):
            if node != at or size > _CHUNK_CHARS:
                if parts:
                    out.append((at, first, ",".join(parts)))
                at, first, parts, size = node, conv, [], 0
            parts.append(str(conv))
            size += len(parts[-1]) + 1
            if len(out) >= _OUT_ROWS // 10:
                yield rows()
                out = []
    if parts:
        out.append((at, first, ",".join(parts)))
    if out:
        yield rows()


def _hashed(batches):
    """Sorted pieces: the SHA-256 of a node's whole list, which never stands in memory."""
    at, state, out = None, None, []
    schema = pa.schema([("id", pa.binary()), ("ends_sha256", pa.string())])

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    for batch in batches:
        for node, part in zip(batch.column("id").to_pylist(), batch.column("part").to_pylist()):
            if node != at:
                if state is not None:
                    out.append((at, state.hexdigest()))
                at, state = node, hashlib.sha256(part.encode())
            else:
                state.update(b"," + part.encode())
            if len(out) >= _OUT_ROWS:
                yield rows()
                out = []
    if state is not None:
        out.append((at, state.hexdigest()))
    if out:
        yield rows()


def ending_hashes(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256) per node of `ends` (id, conv_id): SHA-256 of its conversations' decimal
    ids, ascending, comma-joined. A node with many is cut into ranges first."""
    parts = ends.repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id").mapInArrow(_joined, "id binary, first bigint, part string")
    return parts.repartition("id").sortWithinPartitions("id", "first").select("id", "part").mapInArrow(_hashed, "id binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """One row per distinct prefix of conversations, from the empty one.

    `turns` (conv_id, turn, role, text) are ordered by turn (null first), role and text within their
    conversation; `conversations` (conv_id) lists all of them, also those without turns. Result: id
    and parent (binary prefix ids), depth, conv_id (smallest member: a conversation that starts with
    the prefix), parent_conv_id, n_convs (members), n_children, n_leaves (childless prefixes in the
    subtree), saved_tokens (over the subtree: members but one, times the bytes of the last text),
    ends_sha256 (of the members that end here).

    Subtree totals are passed upward by time-forward processing (see `forward`). Null roles and texts
    are empty, null conv_ids left out, repeated turns are turns of their own; without conversations
    the result is empty. Other columns are not read.
    """
    empty = F.lit("")
    turns = turns.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")
    )
    chains = prefixes(turns)
    everyone = conversations.where("conv_id IS NOT NULL").select(_whole_numbers("conv_id").alias("conv_id")).distinct()
    roots = everyone.select(
        "conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(_ROOT).alias("id"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("bigint").alias("bytes")
    )
    members = stored(chains.unionAll(roots), "members")
    nodes = members.groupBy("depth", "id").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("parent").alias("parent"), F.min("bytes").alias("bytes")
    )
    nodes = stored(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")).drop("bytes"), "nodes")
    totals = subtree_totals(nodes.select("id", "parent", "depth", "saved", "conv_id"), "conv_id", shard_nodes=shard_nodes)
    ends = members.groupBy("conv_id").agg(F.max(F.struct("depth", "id"))["id"].alias("id"))
    above = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.drop("saved").join(totals.withColumnRenamed("saved", "saved_tokens"), "id").join(ending_hashes(ends), "id", "left")
    found = found.join(above, "parent", "left")
    none = hashlib.sha256(b"").hexdigest()
    return found.select(
        "id", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
