"""Nearest neighbours through a hierarchical k-means tree, best bin first."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from emberlog.llm.common import Shared, sampled, stored

#: Vectors that the tree is fitted on, about; all are indexed.
SAMPLE = 20_000
BRANCHES, LEAF_SAMPLE, ROUNDS = 8, 24, 8
#: Queries whose true neighbours set the number of leaves to visit, and the recall they must reach.
CALIBRATION, RECALL = 100, 0.97
#: Vectors, and queries, of one task's unit of work; queries of one routing task.
BLOCK, CHUNK, ROUTED = 8192, 256, 64
FIRST_VISITS, WIDEN = 4, 1.25


@dataclass
class Tree:
    """Nodes in breadth-first order: children of node i are first[i] to first[i] + BRANCHES at most;
    leaves have none and a number."""

    centres: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector: the nearest child, level by level."""
        at = np.zeros(len(vectors), np.int64)
        todo = np.arange(len(vectors))
        while len(todo):
            moved = []
            for node in np.unique(at[todo]):
                rows = todo[at[todo] == node]
                below = self.children[node]
                if len(below):
                    at[rows] = below[_squared(vectors[rows], self.centres[below]).argmin(axis=1)]
                    moved.append(rows)
            todo = np.concatenate(moved) if moved else np.empty(0, np.int64)
        return self.leaf[at]

    def visits(self, query: np.ndarray, enough) -> list[int]:
        """Leaves by best bin first: a queue holds every node met, nearest centre first; the nearest
        is taken, a leaf is visited, any other gives its children. Ends when `enough(leaves)`."""
        queue, found = [(0.0, 0)], []
        while queue:
            _, node = heapq.heappop(queue)
            below = self.children[node]
            if len(below):
                far = ((self.centres[below] - query) ** 2).sum(axis=1)
                for d, child in zip(far.tolist(), below.tolist()):
                    heapq.heappush(queue, (d, child))
            else:
                found.append(int(self.leaf[node]))
                if enough(found):
                    break
        return found


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)


def _kmeans(vectors: np.ndarray, k: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """Centres and labels; the first centres are drawn far apart (k-means++)."""
    centres = [vectors[rng.integers(len(vectors))]]
    far = ((vectors - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k and far.sum() > 0:
        centres.append(vectors[rng.choice(len(vectors), p=far / far.sum())])
        far = np.minimum(far, ((vectors - centres[-1]) ** 2).sum(axis=1))
    centres = np.array(centres)
    for _ in range(ROUNDS):
        labels = _squared(vectors, centres).argmin(axis=1)
        for c in np.unique(labels):
            centres[c] = vectors[labels == c].mean(axis=0)
    return centres, _squared(vectors, centres).argmin(axis=1)


def fit_tree(sample: np.ndarray, seed: int = 11) -> Tree:
    """Splits the sample by k-means until a node has at most LEAF_SAMPLE vectors or all are equal."""
    rng = np.random.default_rng(seed)
    centres, children, leaf = [sample.mean(axis=0)], [], []
    pending, leaves = [sample], 0
    at = 0
    while at < len(pending):
        rows, pending[at] = pending[at], None
        below = np.empty(0, np.int64)
        if len(rows) > LEAF_SAMPLE:
            found, labels = _kmeans(rows, BRANCHES, rng)
            used = np.unique(labels)
            if len(used) > 1:
                below = np.arange(len(pending), len(pending) + len(used))
                centres += list(found[used])
                pending += [rows[labels == c] for c in used]
        children.append(below)
        leaf.append(-1 if len(below) else leaves)
        leaves += not len(below)
        at += 1
    return Tree(np.array(centres), children, np.array(leaf))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _indexer(tree):
    def run(batches):
        own = tree.load()
        for batch in batches:
            leaf = own.assign(_matrix(batch.column("vector"))) if len(batch) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int64())], [*batch.schema.names, "leaf"])

    return run


def _best(distances: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest, ties to the smaller id."""
    return np.lexsort((ids, distances))[:k]


_FOUND = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("leaf", pa.int64())])
SCHEMA = "query bigint, vec_id bigint, score double, leaf bigint"


def _nearest(queries, query_ids, query_rows, vectors, ids, leaves, k, visited=None) -> pa.Table:
    """The k nearest of the rows to each query, or of those whose leaf is among its `visited` ones.

    Products of matrices leave the rows that can be among them; their distances are then taken
    from the differences.
    """
    out: list[list] = [[], [], [], []]
    lengths = (vectors * vectors).sum(axis=1)
    rough = _squared(queries, vectors)
    slack = 1e-9 * (lengths.max(initial=0) + (queries * queries).sum(axis=1).max(initial=0))
    seen = np.zeros(int(leaves.max(initial=0)) + 1, bool)
    for n, (q, own, row) in enumerate(zip(queries, query_ids, query_rows)):
        other = ids != own
        if visited is not None:
            mine = visited[n][visited[n] < len(seen)]
            seen[mine] = True
            other &= seen[leaves]
            seen[mine] = False
        other = np.flatnonzero(other)
        if len(other) > k:
            near = rough[n, other]
            other = other[near <= np.partition(near, k - 1)[k - 1] + slack]
        d = np.sqrt(((vectors[other] - q) ** 2).sum(axis=1))
        best = _best(d, ids[other], k)
        out[0].append(np.full(len(best), row))
        out[1].append(ids[other][best])
        out[2].append(d[best])
        out[3].append(leaves[other][best])
    return pa.table([pa.array(np.concatenate(c) if c else [], f.type) for c, f in zip(out, _FOUND)], schema=_FOUND)


def _scan(known, k):
    """The k nearest rows of each batch to each of a few queries."""

    def run(batches):
        rows, ids, vectors = known.load()
        for batch in batches:
            if len(batch):
                found = _nearest(vectors, ids, rows, _matrix(batch.column("vector")), batch.column("vec_id").to_numpy(), batch.column("leaf").to_numpy(), k)
                yield from found.to_batches()

    return run


def _router(tree, sizes, units, visits, k):
    """(query, vec_id, vector, unit, leaves) for the leaves each query visits, by the unit they are
    in: `visits` of them, and more until they hold k rows besides its own."""
    schema = pa.schema(
        [("query", pa.int64()), ("vec_id", pa.int64()), ("vector", pa.list_(pa.float64())), ("unit", pa.int64()), ("leaves", pa.list_(pa.int64()))]
    )

    def run(batches):
        held, unit_of, own = sizes.load(), units.load(), tree.load()
        for batch in batches:
            found = []
            for row, vector in zip(batch.to_pylist(), _matrix(batch.column("vector")) if len(batch) else []):
                count = [0]

                def enough(leaves, count=count):
                    count[0] += held.get(leaves[-1], 0)
                    return len(leaves) >= visits and count[0] > k

                by_unit: dict[int, list[int]] = {}
                for leaf in own.visits(vector, enough):
                    if leaf in unit_of:
                        by_unit.setdefault(unit_of[leaf], []).append(leaf)
                found += [row | {"unit": unit, "leaves": leaves} for unit, leaves in by_unit.items()]
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    return run


def _units(sizes: dict[int, int]) -> tuple[dict[int, int], dict[int, int]]:
    """Leaves in units of about BLOCK rows, neighbours in the tree together: unit of each leaf, rows
    of each unit. A leaf beyond that is a unit of its own."""
    unit_of: dict[int, int] = {}
    rows: dict[int, int] = {}
    unit = 0
    for leaf in sorted(sizes):
        if rows.get(unit, 0) and rows[unit] + sizes[leaf] > BLOCK:
            unit += 1
        unit_of[leaf] = unit
        rows[unit] = rows.get(unit, 0) + sizes[leaf]
    return unit_of, rows


def _compare(k):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(queries) or not len(rows):
            return _FOUND.empty_table()
        return _nearest(
            _matrix(queries.column("vector")), queries.column("vec_id").to_numpy(), queries.column("query").to_numpy(),
            _matrix(rows.column("vector")), rows.column("vec_id").to_numpy(), rows.column("leaf").to_numpy(), k,
            [np.array(leaves, np.int64) for leaves in queries.column("leaves").to_pylist()],
        )

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def usable(vector: Column) -> Column:
    """Not null, no null, NaN or infinite component, not all zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10, recall: float = RECALL, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that `is_query` holds for, its k nearest other rows by
    Euclidean distance in double precision, nearest first, ties to the smaller id.

    The tree is fitted on about SAMPLE vectors; every row is indexed under a leaf. Each query
    visits leaves best bin first. How many is calibrated: CALIBRATION queries are compared with
    all rows, and visits widen until the leaves visited hold the `recall` share of their true
    neighbours (at the end, all leaves). Leaves are compared in units of about BLOCK rows,
    a larger leaf in blocks, and the queries of a unit in chunks, so that a leaf with a third of
    all rows is many tasks; each gives at most k rows per query.

    Vectors that are null, empty, zero, of another length than most, or hold null or non-finite
    components take no part, nor do null ids. A query finds no row with its own id; rows that
    repeat an id may each be found; equal query rows are one query. With fewer than k other rows
    all are found. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    whole = vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    whole = whole.where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    size = whole.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if size is None:
        return empty
    whole = whole.where(F.size("vector") == size["size"])
    sample = sampled(whole, SAMPLE, "vec_id", "vector").orderBy("vec_id").select("vector").toArrow()
    tree = fit_tree(_matrix(sample.column("vector")))
    sent = Shared(spark.sparkContext, tree)
    index = stored(whole.mapInArrow(_indexer(sent), "vec_id bigint, vector array<double>, asked boolean, leaf bigint"), "vector-index")

    asked = index.where("asked").select("vec_id", "vector").distinct()
    asked = stored(asked.withColumn("query", F.monotonically_increasing_id()), "vector-queries")
    sizes = {r["leaf"]: r["n"] for r in index.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    visits = _calibrated(index, asked, tree, k, recall)

    unit_of, unit_rows = _units(sizes)
    context = spark.sparkContext
    route = _router(sent, Shared(context, sizes), Shared(context, unit_of), visits, k)
    tasks = -(-max(asked.count(), 1) // ROUTED)
    routed = asked.repartition(tasks, "query").select("query", "vec_id", "vector").mapInArrow(
        route, "query bigint, vec_id bigint, vector array<double>, unit bigint, leaves array<bigint>"
    )
    routed = stored(routed, "visits")
    per_unit = {r["unit"]: r["n"] for r in routed.groupBy("unit").agg(F.count("*").alias("n")).collect()}
    # One row per leaf, whose number the sample bounds.
    shape = [(leaf, unit, -(-unit_rows[unit] // BLOCK), -(-per_unit.get(unit, 0) // CHUNK)) for leaf, unit in unit_of.items()]
    shape = spark.createDataFrame(shape, "leaf bigint, unit bigint, blocks int, chunks int")
    left = routed.join(F.broadcast(shape.drop("leaf").distinct()), "unit").select(
        "query", "vec_id", "vector", "unit", "leaves",
        F.pmod(F.xxhash64("query"), F.col("chunks")).cast("int").alias("chunk"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"),
    )
    right = index.join(F.broadcast(shape), "leaf").where("chunks > 0").select(
        "vec_id", "vector", "unit", "leaf",
        F.pmod(F.xxhash64("vec_id", "vector"), F.col("blocks")).cast("int").alias("block"), F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"),
    )
    keys = ("unit", "block", "chunk")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_compare(k), SCHEMA)
    names = asked.select("query", F.col("vec_id").alias("query_id"))
    return _ranked(found, k).join(names, "query").select("query_id", "rank", "vec_id", "score")


def _calibrated(index: DataFrame, asked: DataFrame, tree: Tree, k: int, recall: float) -> int:
    """The least number of visits, of the widening steps, that reaches the recall on some queries."""
    spark = index.sparkSession
    some = sampled(asked, CALIBRATION, "vec_id", "vector").select("query", "vec_id", "vector").toArrow()
    if not len(some):
        return FIRST_VISITS
    vectors = _matrix(some.column("vector"))
    rows = some.column("query").to_numpy()
    known = Shared(spark.sparkContext, (rows, some.column("vec_id").to_numpy(), vectors))
    scanned = index.select("vec_id", "vector", "leaf").mapInArrow(_scan(known, k), SCHEMA)
    truth: dict[int, list[int]] = {}
    for row in _ranked(scanned, k).select("query", "leaf").collect():
        truth.setdefault(row["query"], []).append(row["leaf"])
    places = []
    for row, vector in zip(rows.tolist(), vectors):
        order = {leaf: n for n, leaf in enumerate(tree.visits(vector, lambda found: False))}
        places += [order[leaf] for leaf in truth.get(row, [])]
    places, visits, leaves = np.array(places), FIRST_VISITS, tree.leaves
    while visits < leaves and len(places) and (places < visits).mean() < recall:
        visits = int(np.ceil(visits * WIDEN))
    return min(visits, leaves)
