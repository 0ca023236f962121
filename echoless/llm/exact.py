"""Exact dedup by sorting contents.

Sampled splitters cut the order of the normalised texts into ranges, every task
sorts its range with Spark's external sort, so equal texts stand side by side,
and each text is compared in full with the one before it. The first of a run of
equal texts has the smallest doc_id and stays.

Texts are put in order by their first HEAD bytes; texts that agree there by
their digest, which keeps the splitters small however much texts share, then by
the whole text, doc_id and row. As ids are part of the order, splitters cut
through a run of equal texts too, so no number of copies makes a task large. A
run that reaches over the border of ranges is put together from one row for
each border; the two texts at a border are compared in full as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from echoless.llm.storage import stored

SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Bytes by which texts are put in order before their digest is looked at.
HEAD = 64


def normalised(text: str = "text") -> Column:
    """The text with one space for each run of white space; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE_RUN, " ")


def _runs(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Cut sorted rows into runs of equal texts: doc_id and digest of each row, its place in its run, the run's number in
    the range, first doc_id and rows in it. The first and the last row of a range keep their text.

    Only the ids of the run that is not yet at its end are held, and the text before.
    """
    part = TaskContext.get().partitionId()
    n_runs, lowest, before = 0, None, None
    ids: list[pa.Array] = []
    digest = None

    def rows(chunks: list[pa.Array], lengths: np.ndarray, digests: list[str], first_run: int, last: bool) -> pa.RecordBatch:
        own = pa.concat_arrays(chunks)
        begin = np.cumsum(lengths) - lengths
        of = np.repeat(np.arange(len(lengths)), lengths)
        edge = {0: lowest} if first_run == 0 else {}
        if last:
            edge[len(own) - 1] = before
        columns = [
            own, pa.array(digests).take(pa.array(of)), pa.array(np.arange(len(own)) - begin[of]), pa.array(np.full(len(own), part)), pa.array(first_run + of),
            own.take(pa.array(begin[of])), pa.array(lengths[of]), pa.array([edge.get(i) for i in range(len(own))] if edge else pa.nulls(len(own)), pa.binary()),
        ]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        text, doc_id = batch.column("_text"), batch.column("doc_id")
        same = np.zeros(n, dtype=bool)
        same[1:] = pc.equal(text.slice(1), text.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        same[0] = before is not None and text[0].as_py() == before
        if before is None:
            lowest = text[0].as_py()
        begins = np.flatnonzero(~same)
        if begins.size:
            low, high = int(begins[0]), int(begins[-1])
            digests = batch.column("text_sha256").take(pa.array(begins)).to_pylist()
            lengths = np.diff(begins)
            if ids:
                held = sum(map(len, ids)) + low
                yield rows([*ids, doc_id.slice(0, high)], np.append(held, lengths), [digest, *digests[:-1]], n_runs, False)
                n_runs += 1 + len(lengths)
            elif high:
                yield rows([doc_id.slice(0, high)], lengths, digests[:-1], n_runs, False)
                n_runs += len(lengths)
            ids, digest = [doc_id.slice(high)], digests[-1]
        else:
            ids.append(doc_id)
        before = text[n - 1].as_py()
    if ids:
        yield rows(ids, np.array([sum(map(len, ids))]), [digest], n_runs, True)


def _borders(found: DataFrame) -> DataFrame:
    """For the first and last run of each range: doc_id of the first row of the whole run, rows in it, and rows before the range.

    A few values for each range; texts meet only the one text across their border.
    """
    edge = found.filter(F.col("_edge").isNotNull())
    # One row for each range: its outer texts, its first and last run.
    first = F.struct("_place", "_first", "_rows", "_edge")
    ends = edge.groupBy("_part").agg(
        F.min("_run").alias("low"), F.max("_run").alias("high"),
        F.min_by(first, F.struct("_run", "_place")).alias("f"), F.max_by(first, F.struct("_run", "_place")).alias("l"),
    )
    by_part = Window.orderBy("_part")
    ranges = ends.select("_part").withColumn("no", F.row_number().over(by_part))  # a number for each range
    ends = ends.join(ranges, "_part")
    lower = ends.select((F.col("no") + 1).alias("no"), F.col("l._edge").alias("text"))
    linked = ends.join(lower, "no", "left").select("_part", "no", "low", "high", "f", "l", F.coalesce(F.col("text") == F.col("f._edge"), F.lit(False)).alias("joins"))
    # Ranges that a run reaches over: a new stretch begins where a border joins nothing, or where the run before began inside its range.
    linked = linked.select("_part", "no", "low", "high", "joins", F.col("f._first").alias("f_id"), F.col("f._rows").alias("f_rows"), F.col("l._first").alias("l_id"), F.col("l._rows").alias("l_rows"))
    one = F.col("low") == F.col("high")
    runs = linked.select("_part", "no", F.inline(F.array(
        F.struct(F.col("low").alias("_run"), F.col("f_id").alias("id"), F.col("f_rows").alias("n"), F.col("joins").alias("joins"), F.lit(0).alias("side")),
        F.when(~one, F.struct(F.col("high").alias("_run"), F.col("l_id").alias("id"), F.col("l_rows").alias("n"), F.lit(False).alias("joins"), F.lit(1).alias("side"))),
    )))
    runs = runs.filter(F.col("_run").isNotNull())
    order = Window.orderBy("no", "side")
    runs = runs.withColumn("stretch", F.sum((~F.col("joins")).cast("long")).over(order))
    whole = Window.partitionBy("stretch").orderBy("no", "side")
    every = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return runs.select(
        "_part", "_run", F.first("id").over(every).alias("whole_id"), F.sum("n").over(every).alias("whole_rows"),
        (F.row_number().over(whole) > 1).alias("continues"),
    )


def exact_duplicates(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after normalised(). keep_id is the smallest
    doc_id of a text's group and group_size its rows. Exactly one row of a group
    is kept: one with keep_id, and of repeated rows with that id any. A null
    doc_id comes after all others; keep_id is null if a group has no other. Other
    columns are left alone. doc_id may have any type that can be put in order.
    """
    kind = docs.schema["doc_id"].dataType
    text = docs.select("doc_id", normalised().cast("binary").alias("_text"), F.monotonically_increasing_id().alias("_row"))
    text = text.select("doc_id", "_text", "_row", F.sha2("_text", 256).alias("text_sha256"), F.substring("_text", 1, HEAD).alias("_head"))
    order = [F.col("_head").asc(), F.col("text_sha256").asc(), F.col("doc_id").asc_nulls_last(), F.col("_row").asc()]
    ranged = text.repartitionByRange(partitions, *order) if partitions else text.repartitionByRange(*order)
    in_order = ranged.sortWithinPartitions(*order[:2], "_text", *order[2:]).select("doc_id", "text_sha256", "_text")
    made = T.StructType([
        T.StructField("doc_id", kind), T.StructField("text_sha256", T.StringType()), T.StructField("_place", T.LongType()),
        T.StructField("_part", T.LongType()), T.StructField("_run", T.LongType()), T.StructField("_first", kind),
        T.StructField("_rows", T.LongType()), T.StructField("_edge", T.BinaryType()),
    ])
    arrow = to_arrow_schema(made)
    found = stored(in_order.mapInArrow(lambda batches: _runs(batches, arrow), made))
    borders = stored(_borders(found)).alias("b")
    rows = found.drop("_edge").alias("f").join(F.broadcast(borders), ["_part", "_run"], "left")  # two rows for each range at most
    inside = F.col("whole_rows").isNull()
    return rows.select(
        "doc_id", F.when(inside, F.col("_first")).otherwise(F.col("whole_id")).alias("keep_id"),
        F.coalesce("whole_rows", "_rows").alias("group_size"),
        ((F.col("_place") == 0) & ~F.coalesce("continues", F.lit(False))).alias("kept"), "text_sha256",
    )
