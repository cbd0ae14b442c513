"""Time-forward processing of trees: totals travel from nodes to their parents through a queue."""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import stored
from emberlog.operators.numbering import numbered

#: Nodes of a shard, and messages that a task's queue holds in memory before it spills.
SHARD_NODES, QUEUE_ROWS = 250_000, 400_000
_SPILL_ROWS, _OUT_ROWS = 10_000, 20_000
_OUT = pa.schema([("id", pa.binary()), ("met", pa.bool_()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64())])


class SpillingQueue:
    """A priority queue of comparable tuples. Beyond `limit` of them it writes what it holds to a
    file as a sorted run; the smallest is taken from memory or from the head of a run."""

    def __init__(self, limit: int = QUEUE_ROWS):
        self.limit, self._heap, self._runs, self._count = limit, [], [], 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self._heap, item)
        if len(self._heap) > self.limit:
            self._heap.sort()
            file = tempfile.TemporaryFile()
            for first in range(0, len(self._heap), _SPILL_ROWS):
                pickle.dump(self._heap[first : first + _SPILL_ROWS], file, pickle.HIGHEST_PROTOCOL)
            file.seek(0)
            self._heap = []
            self._next(self._read(file))

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    return

    def _next(self, run: Iterator[tuple]) -> None:
        head = next(run, None)
        if head is not None:
            self._count += 1
            heapq.heappush(self._runs, (head, self._count, run))

    def peek(self) -> tuple | None:
        if self._runs and (not self._heap or self._runs[0][0] < self._heap[0]):
            return self._runs[0][0]
        return self._heap[0] if self._heap else None

    def pop(self) -> tuple:
        if self._runs and (not self._heap or self._runs[0][0] < self._heap[0]):
            head, _, run = heapq.heappop(self._runs)
            self._next(run)
            return head
        return heapq.heappop(self._heap)


def _passed(batches, limit: int, nodes: bool):
    """Nodes sorted by (shard, depth from the deepest, id): each takes what its children and other
    shards sent, and sends its totals to its parent's place. Messages that no node of the shard
    takes are results, addressed to other shards."""
    queue, out = SpillingQueue(limit), []

    def drained():
        nonlocal out
        found, out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _OUT)], schema=_OUT), []
        return found

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("shard", "depth", "id", "parent", "saved", "in_children", "in_leaves", "in_saved")]
        for shard, depth, node, parent, saved, children, leaves, passed in zip(*columns):
            place = (shard, -depth, node)
            children, leaves, saved = children or 0, leaves or 0, saved + (passed or 0)
            while (head := queue.peek()) is not None and head[:3] <= place:
                message = queue.pop()
                if message[:3] == place:
                    children, leaves, saved = children + message[3], leaves + message[4], saved + message[5]
                else:
                    out.append((message[2], False, *message[3:]))
            leaves = leaves if children else 1
            if nodes:
                out.append((node, True, children, leaves, saved))
            if parent is not None:
                queue.push((shard, 1 - depth, parent, 1, leaves, saved))
            if len(out) >= _OUT_ROWS:
                yield drained()
    while queue.peek() is not None:
        message = queue.pop()
        out.append((message[2], False, *message[3:]))
        if len(out) >= _OUT_ROWS:
            yield drained()
    if out:
        yield drained()


def subtree_totals(nodes: DataFrame, *order: str, shard_nodes: int = SHARD_NODES, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """(id, n_children, n_leaves, saved) per row of `nodes` (id: binary, parent: binary or null,
    depth: bigint, saved: bigint, and the columns of `order`): children, childless nodes of the
    subtree, sum of `saved` over it; each node counts to its own subtree.

    Nodes are cut into shards of equal size along `order`, whatever the tree looks like. A shard's
    nodes pass through one task, deepest level first, with a queue that spills; its memory does not
    grow with the shard. Shards exchange summed messages, one row per receiving node, until no sum
    changes: as many rounds as a path to the root enters shards, and one more. Columns in `order`
    that put children behind their parents keep these few. An empty frame gives an empty result.
    """
    spark = nodes.sparkSession
    shard = F.floor(F.col("_n") / shard_nodes).cast("bigint")
    placed = numbered(nodes, *order, "depth", "id", column="_n").withColumn("shard", shard)
    placed = stored(placed.select("shard", "depth", "id", "parent", "saved"), "shards")
    sums = [F.sum(c).alias(f"in_{s}") for c, s in (("n_children", "children"), ("n_leaves", "leaves"), ("saved", "saved"))]
    nothing = spark.createDataFrame([], "id binary, in_children bigint, in_leaves bigint, in_saved bigint")

    def through(messages: DataFrame, keep_nodes: bool) -> DataFrame:
        rows = placed.join(messages, "id", "left").repartition("shard").sortWithinPartitions("shard", F.desc("depth"), "id")
        rows = rows.select("shard", "depth", "id", "parent", "saved", "in_children", "in_leaves", "in_saved")
        kind = "id binary, met boolean, n_children bigint, n_leaves bigint, saved bigint"
        return rows.mapInArrow(lambda batches: _passed(batches, queue_rows, keep_nodes), kind)

    def state(messages: DataFrame) -> tuple:
        whole = F.sum(F.xxhash64(*messages.columns).cast("decimal(38,0)"))
        return tuple(messages.agg(F.count("*"), whole).first())

    messages, before = nothing, (0, None)
    while True:
        sent = stored(through(messages, False).groupBy("id").agg(*sums), "messages")
        if (now := state(sent)) == before:
            break
        messages, before = sent, now
    return through(messages, True).where("met").drop("met")
