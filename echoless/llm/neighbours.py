"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample; every row goes down to a leaf. A query
visits leaves best bin first: a priority queue holds the branches not taken,
by distance to their centres. How many leaves it visits is widened until the
recall on some queries, whose true neighbours are found by brute force, is
high enough.

A leaf is searched in chunks of rows and of queries, so neither a large leaf
nor one that all queries visit is one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echoless.llm.sampling import at_most
from echoless.llm.storage import stored

#: Rows, and queries, of a chunk of a leaf.
ROWS, QUERIES = 2048, 512


@dataclass
class Tree:
    """centres[i]: the children's centres of node i, children[i]: their nodes; a leaf has neither and leaf[i] >= 0."""

    centres: list
    children: list
    leaf: list
    n_leaves: int = 0

    def add(self, x: np.ndarray, leaf_rows: int, branches: int, rng: np.random.Generator) -> int:
        node = len(self.leaf)
        self.centres.append(None)
        self.children.append(())
        self.leaf.append(-1)
        distinct = np.unique(x, axis=0) if len(x) <= 4 * branches else x
        if len(x) <= leaf_rows or len(distinct) < 2 or (x == x[0]).all():
            self.leaf[node] = self.n_leaves
            self.n_leaves += 1
            return node
        centres, own = _kmeans(x, min(branches, -(-len(x) // leaf_rows)), rng)
        if len(centres) < 2:
            self.leaf[node] = self.n_leaves
            self.n_leaves += 1
            return node
        self.centres[node] = centres
        self.children[node] = tuple(self.add(x[own == k], leaf_rows, branches, rng) for k in range(len(centres)))
        return node

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: down the nearest centres."""
        out = np.zeros(len(x), dtype=np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
            elif len(rows):
                near = _distances(x[rows], self.centres[node]).argmin(axis=1)
                todo += [(child, rows[near == k]) for k, child in enumerate(self.children[node])]
        return out

    def best_bins(self, q: np.ndarray, most: int, held: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """The first `most` leaves of a query, best bin first, and more until they hold `least` of the rows held has for each leaf."""
        queue, found, rows = [(0.0, 0)], [], 0
        while queue and (len(found) < most or rows < least):
            _, node = heapq.heappop(queue)
            while self.leaf[node] < 0:
                d = _distances(q[None], self.centres[node])[0]
                near = int(d.argmin())
                for k, child in enumerate(self.children[node]):
                    if k != near:
                        heapq.heappush(queue, (float(d[k]), child))
                node = self.children[node][near]
            found.append(self.leaf[node])
            rows += held.get(found[-1], 0) if held else 0
        return found


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1), 0)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, turns: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = np.unique(x[rng.choice(len(x), size=k, replace=False)], axis=0)
    if len(centres) < 2:  # drawn equal; two rows that differ begin
        centres = np.stack([x[0], x[(x != x[0]).any(axis=1)][0]])
    for _ in range(turns):
        own = _distances(x, centres).argmin(axis=1)
        centres = np.stack([x[own == c].mean(axis=0) for c in np.unique(own)])
    own = _distances(x, centres).argmin(axis=1)
    used = np.unique(own)
    return centres[used], np.searchsorted(used, own)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _top(ids: np.ndarray, x: np.ndarray, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest rows of x but the query's own, and their distances; smaller ids first among equals."""
    d = x - q
    score = np.sqrt(np.einsum("ij,ij->i", d, d))
    at = np.flatnonzero(ids != query_id)
    if len(at) > k:
        at = at[score[at] <= np.partition(score[at], k - 1)[k - 1]]
    at = at[np.lexsort((ids[at], score[at]))][:k]
    return ids[at], score[at]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part: no null, zero or non-finite vector, none without vec_id,
    and of several lengths the commonest (the longer of equals). Rows that repeat are one."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(fine, F.lit(False)))
    sizes = rows.groupBy(F.size(x).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.filter(F.size(x) == (sizes["size"] if sizes else 0)).distinct()


def fit_tree(rows: DataFrame, n_rows: int, sample: int, leaf_rows: int, branches: int, seed: int) -> Tree:
    """A tree fitted on at most `sample` rows, chosen by hash. Leaves are made to hold about leaf_rows of all rows,
    but at least ten of the sample."""
    picked = at_most(rows, ["vec_id"], sample, n_rows, seed).select("embedding").toArrow()
    x = _matrix(picked.column("embedding").combine_chunks()) if picked.num_rows else np.zeros((1, 1))
    tree = Tree([], [], [])
    tree.add(x, max(10, round(leaf_rows * len(x) / max(n_rows, 1))), branches, np.random.default_rng(seed))
    return tree


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def calibrated_visits(placed: DataFrame, queries: DataFrame, tree: Tree, k: int, recall: float, most: int) -> int:
    """The fewest leaves to visit for the wanted recall on at most `most` of the queries, against brute force."""
    spark = placed.sparkSession
    some = at_most(queries, ["vec_id"], most, queries.count()).toArrow()
    if not some.num_rows:
        return 1
    q = _matrix(some.column("embedding").combine_chunks())
    ids = some.column("vec_id").to_numpy()
    sent = spark.sparkContext.broadcast((ids, q))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, x = batch.column("vec_id").to_numpy(), _matrix(batch.column("embedding"))
            leaf = dict(zip(own.tolist(), batch.column("leaf").to_pylist()))
            for i, v in zip(*sent.value):
                near, score = _top(own, x, i, v, k)
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(near), pa.int64()), pa.array(near), pa.array(score), pa.array([leaf[n] for n in near.tolist()], pa.int32())], names=["query_id", "vec_id", "score", "leaf"])

    true = _ranked(placed.mapInArrow(nearest, "query_id long, vec_id long, score double, leaf int"), k).select("query_id", "leaf").collect()
    place = {int(i): {leaf: n for n, leaf in enumerate(tree.best_bins(v, tree.n_leaves))} for i, v in zip(ids, q)}
    needed = np.sort([place[r.query_id][r.leaf] + 1 for r in true])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else 1


def search(
    vectors: DataFrame,
    every: int = 100,
    k: int = 10,
    recall: float = 0.97,
    sample: int = 20_000,
    leaf_rows: int = 512,
    branches: int = 8,
    calibration: int = 64,
    seed: int = 11,
) -> DataFrame:
    """For each row whose vec_id is divisible by `every` its k nearest other rows: query_id, rank, vec_id, score.

    Rows that usable() leaves out neither ask nor answer. Rows with the query's
    vec_id are its own and no answer; fewer than k candidates are all given.
    Rows that repeat count once. Other columns are left alone.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors))
    n_rows = rows.count()
    tree = fit_tree(rows, n_rows, sample, leaf_rows, branches, seed)
    sent = spark.sparkContext.broadcast((tree.centres, tree.children, tree.leaf, tree.n_leaves))  # plain values: executors need not have this module
    kind = vectors.schema["embedding"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tree(*sent.value)
        for batch in batches:
            leaves = own.leaves_of(_matrix(batch.column("embedding")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.int32())], names=["vec_id", "embedding", "leaf"])

    placed = stored(rows.withColumn("vec_id", F.col("vec_id").cast("long")).mapInArrow(place, f"vec_id long, embedding {kind}, leaf int"))
    queries = placed.filter(F.col("vec_id") % every == 0).select("vec_id", "embedding")
    visits = calibrated_visits(placed, queries, tree, k, recall, calibration)
    if n_rows <= k * tree.n_leaves:
        visits = tree.n_leaves  # so few rows that a leaf may hold less than k
    # A row for each leaf; the tree bounds their number.
    held = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}
    queries = queries.join(queries.groupBy("vec_id").agg(F.count("*").alias("n_own")), "vec_id")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tree(*sent.value)
        for batch in batches:
            n_own = batch.column("n_own").to_pylist()
            found = [own.best_bins(v, visits, held, k + n) for v, n in zip(_matrix(batch.column("embedding")), n_own)]
            of = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([*(c.take(of) for c in batch.columns[:2]), pa.array([leaf for f in found for leaf in f], pa.int32())], names=["query_id", "query", "leaf"])

    probes = stored(queries.mapInArrow(probe, f"query_id long, query {kind}, leaf int"))
    # A row for each leaf; the tree bounds their number.
    chunks = placed.groupBy("leaf").agg(F.ceil(F.count("*") / ROWS).alias("n_row_chunks"))
    chunks = chunks.join(probes.groupBy("leaf").agg(F.ceil(F.count("*") / QUERIES).alias("n_query_chunks")), "leaf")
    some = F.broadcast(chunks)
    left = placed.join(some, "leaf").withColumn("r", F.pmod(F.xxhash64("vec_id"), "n_row_chunks"))
    left = left.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("n_query_chunks") - 1))).select("leaf", "r", "c", "vec_id", "embedding")
    right = probes.join(some, "leaf").withColumn("c", F.pmod(F.xxhash64("query_id"), "n_query_chunks"))
    right = right.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("n_row_chunks") - 1))).select("leaf", "r", "c", "query_id", "query")

    def compare(key: tuple, rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if rows.num_rows and asked.num_rows:
            ids, x = rows.column("vec_id").to_numpy(), _matrix(rows.column("embedding").combine_chunks())
            for i, v in zip(asked.column("query_id").to_pylist(), _matrix(asked.column("query").combine_chunks())):
                near, score = _top(ids, x, i, v, k)
                out[0] += [i] * len(near)
                out[1] += near.tolist()
                out[2] += score.tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    met = left.groupBy("leaf", "r", "c").cogroup(right.groupBy("leaf", "r", "c"))
    found = met.applyInArrow(compare, "query_id long, vec_id long, score double")
    return _ranked(found.distinct(), k).select("query_id", "rank", "vec_id", "score")
