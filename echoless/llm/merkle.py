"""A Merkle manifest of a dataset that stores few of its nodes.

Leaves are put in order per group by ranges, and every FAN consecutive nodes
become the digest of their digests, level by level, until one node of the group
remains. The groups' last nodes, in group order, make a tree of the same kind.

Only every `every`-th level is stored. An aligned subtree, FAN^every nodes of a
stored level, is small and complete: a task works out its inner nodes from the
stored ones, gives its topmost node when the tree is built and the siblings on
each path when proofs are asked for, and forgets the inner nodes again. No group
is ever one task, however many rows it holds.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from echoless.llm.storage import stored

FAN = 8
#: Levels of which one is stored; a subtree has FAN^EVERY leaves.
EVERY = 3
#: One step of a proof: the own digest's place among the run's siblings, whose digests stand one after the other.
STEP = "struct<at: int, siblings: string>"


def part_of(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(part_of, values)).cast("binary"), 256)


def _digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _levels(nodes: list[str], steps: int, fan: int) -> list[list[str]]:
    """The nodes of a subtree and of the `steps` levels above."""
    levels = [nodes]
    for _ in range(steps):
        below = levels[-1]
        levels.append([_digest(below[i : i + fan]) for i in range(0, len(below), fan)])
    return levels


def _steps(n: int, fan: int) -> int:
    """How often n nodes become fewer until one remains."""
    steps = 0
    while n > 1:
        n, steps = -(-n // fan), steps + 1
    return steps


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with `n`, the place of each (from 0) among the rows of its `tree` in `order`, and `size`, the tree's rows.

    Tasks number the trees of their range of (tree, order); what lies before a range is added from one row for each tree and range.
    """
    by = [F.col("tree").asc_nulls_first(), *order]
    schema = T.StructType([*rows.schema.fields, T.StructField("_range", T.LongType()), T.StructField("_n", T.LongType())])
    arrow = to_arrow_schema(schema)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree, n = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            places = []
            for value in batch.column("tree").to_pylist():
                if value != tree:
                    tree, n = value, 0
                places.append(n)
                n += 1
            columns = [*batch.columns, pa.array([part] * len(places), pa.int64()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    ranged = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(number, schema))
    counts = ranged.groupBy("tree", "_range").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("tree").orderBy("_range")
    counts = counts.select(
        F.col("tree").alias("_tree"), F.col("_range").alias("_of"), (F.sum("_rows").over(before) - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("size"),
    )
    met = ranged.join(counts, (F.col("_range") == F.col("_of")) & F.col("tree").eqNullSafe(F.col("_tree")))
    return met.withColumn("n", F.col("_n") + F.col("_before")).drop("_n", "_range", "_tree", "_of", "_before")


class Forest:
    """Trees over nodes (tree, n, size, digest): level 0 and every `every`-th level above are stored."""

    def __init__(self, nodes: DataFrame, fan: int = FAN, every: int = EVERY):
        self.fan, self.every = fan, every
        self.kind = nodes.schema["tree"].dataType
        self.levels = [stored(nodes.select("tree", "n", "size", "digest"))]
        while True:
            # Beyond the level on which its last node stands a tree has no more nodes.
            rising = self.levels[-1].filter("size > 1")
            if rising.isEmpty():
                break
            self.levels.append(stored(self._above(rising)))

    def _subtree(self, nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("subtree", F.floor(F.col("n") / self.fan**self.every))

    def _above(self, nodes: DataFrame) -> DataFrame:
        """The next stored level: the topmost node of each subtree."""
        fan, every = self.fan, self.every
        schema = T.StructType([T.StructField("tree", self.kind), *(T.StructField(c, T.LongType()) for c in ("n", "size")), T.StructField("digest", T.StringType())])
        arrow = to_arrow_schema(schema)

        def top(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("n")
            size = rows.column("size")[0].as_py()
            steps = min(every, _steps(size, fan))
            for _ in range(steps):
                size = -(-size // fan)
            (last,) = _levels(rows.column("digest").to_pylist(), steps, fan)[-1]
            return pa.Table.from_arrays([rows.column("tree").slice(0, 1), rows.column("subtree").slice(0, 1), pa.array([size]), pa.array([last])], schema=arrow)

        return self._subtree(nodes).groupBy("tree", "subtree").applyInArrow(top, schema)

    def tops(self) -> DataFrame:
        """tree and digest of its last node."""
        return reduce(DataFrame.unionByName, [level.filter("size = 1") for level in self.levels]).select("tree", "digest")

    def proofs(self, rows: DataFrame, above: DataFrame) -> DataFrame:
        """rows (tree, n, size and any others; each names a leaf) with `top` and `proof`: the steps from the leaf to the last node
        of its tree and then those of `above` (tree, top, steps), from which top comes too.

        Works from the topmost stored level down. Rows of a subtree meet the steps above it, one row.
        """
        over = None
        for level in self.levels[:0:-1]:
            paths = self._paths(level, self._over(level, over, above))
            over = stored(paths.select("tree", F.col("n").alias("subtree"), "top", F.col("proof").alias("steps")))
        return self._paths(rows, self._over(self.levels[0], over, above))

    def _over(self, level: DataFrame, over: DataFrame | None, above: DataFrame) -> DataFrame:
        """What lies over each subtree of a level; over the last node of a tree there is only what lies above the tree."""
        ended = level.filter("size = 1").select(F.col("tree").alias("_tree"))
        ends = above.join(ended, F.col("tree").eqNullSafe(F.col("_tree"))).select("tree", F.lit(0).cast("long").alias("subtree"), "top", "steps")
        return ends if over is None else over.unionByName(ends)

    def _paths(self, rows: DataFrame, over: DataFrame) -> DataFrame:
        """rows with the steps inside their subtree and those `over` it."""
        fan, every = self.fan, self.every
        schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string(f"top string, proof array<{STEP}>").fields])
        arrow = to_arrow_schema(schema)
        n_columns = len(rows.columns)

        def paths(nodes: pa.Table, beyond: pa.Table) -> pa.Table:
            nodes = nodes.sort_by("n")
            if not nodes.num_rows:
                return pa.Table.from_arrays([pa.array([], f.type) for f in arrow], schema=arrow)
            steps = min(every, _steps(nodes.column("size")[0].as_py(), fan))
            levels = _levels(nodes.column("digest").to_pylist(), steps, fan)
            inside: list[list[dict]] = beyond.column("steps").to_pylist()  # from the top of the subtree, one node, down
            for level in levels[-2::-1]:
                runs = [level[i : i + fan] for i in range(0, len(level), fan)]
                inside = [
                    [{"at": at, "siblings": "".join(run[:at] + run[at + 1 :])}, *onwards] for run, onwards in zip(runs, inside) for at in range(len(run))
                ]
            top = pa.array(beyond.column("top").to_pylist() * nodes.num_rows, pa.string())
            return pa.Table.from_arrays([*nodes.columns[:n_columns], top, pa.array(inside, arrow.field("proof").type)], schema=arrow)

        left = self._subtree(rows).groupBy("tree", "subtree")
        return left.cogroup(over.groupBy("tree", "subtree")).applyInArrow(paths, schema)


def folded(digest: Column, proof: str = "proof") -> Column:
    """The root that a leaf and its proof give."""
    width = 64

    def up(own: Column, step: Column) -> Column:
        cut = step["at"] * width
        run = F.concat(F.substring(step["siblings"], F.lit(1), cut), own, F.substring(step["siblings"], cut + 1, F.lit(2**31 - 1)))
        return F.sha2(run.cast("binary"), 256)

    return F.aggregate(proof, digest, up)


def manifest(rows: DataFrame, fan: int = FAN, every: int = EVERY) -> DataFrame:
    """rows (tree, key, digest and any others) with subroot, root and proof.

    Leaves of a tree ascend by key (a null one comes first), then by digest;
    equal rows are neighbours and have a leaf each. Trees ascend too, null first.
    proof is an array of STEP from the leaf by its subroot to the root; a run of
    one has no siblings. Without rows there is no root and no row.
    """
    names = rows.columns
    leaves = stored(numbered(rows, [F.col("key").asc_nulls_first(), F.col("digest").asc()]))
    forest = Forest(leaves, fan, every)
    tops = stored(forest.tops())
    ranked = tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("key"), "digest")
    ranked = stored(numbered(ranked, [F.col("key").asc_nulls_first()]))
    upper = Forest(ranked, fan, every)
    root = upper.tops().withColumn("steps", F.expr(f"cast(array() as array<{STEP}>)")).withColumnRenamed("digest", "top")  # one row
    crown = upper.proofs(ranked, root)
    above = stored(crown.select(F.col("key").alias("tree"), F.col("digest").alias("top"), F.col("proof").alias("steps")))
    proven = forest.proofs(leaves, above).withColumnRenamed("top", "subroot")
    return proven.select(*names, "subroot", root.select("top").scalar().alias("root"), "proof")


def document_manifest(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """A manifest of docs (doc_id, source, lang, n_chars, text) with a tree for each lang: doc_id, leaf, changed_leaf, subroot, root, proof.

    changed_leaf is the leaf of the row with lower-cased A-Z. Nulls are told
    apart from empty values. Rows that repeat are leaves of their own. Other
    columns are left alone.
    """
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    rows = docs.select(
        F.col("lang").alias("tree"), F.col("doc_id").alias("key"), leaf_digest(*fields, F.col("text")).alias("digest"),
        leaf_digest(*fields, lower).alias("changed"),
    )
    found = manifest(stored(rows), FAN, every)
    return found.select(F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), F.col("changed").alias("changed_leaf"), "subroot", "root", "proof")


def tampered(doc_id: str = "doc_id") -> Column:
    """Rows whose doc_id's checksum is divisible by three."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 0, F.lit(False))
