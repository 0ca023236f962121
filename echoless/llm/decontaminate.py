"""Benchmark decontamination by winnowing.

Of each run of consecutive k-gram hashes the smallest is kept as fingerprint.
A span of k + window - 1 words that a document shares with a benchmark item
holds one whole run, so both keep the same fingerprint in it: no such span is
missed. Fingerprints are joined, and every hit is extended word by word within
the words that travel with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echoless.llm.storage import stored
from echoless.llm.words import ALPHANUMERIC, Slice, byte_powers, gram_hashes, mix, slices, word_powers

#: Words of a shared span.
SPAN = 10
#: Words of a k-gram; SPAN - K + 1 k-grams make a run.
K = 5
#: Bits of the filter that tells which fingerprints the benchmark has: 1 MB, whatever the benchmark's size.
FILTER_BITS = 23


def _windowed_min(values: np.ndarray, width: int) -> np.ndarray:
    """Where the smallest of each width consecutive values is, the last one of equals."""
    n = len(values) - width + 1
    at = np.arange(n)
    for j in range(1, width):
        at = np.where(values[j : j + n] <= values[at], np.arange(j, j + n), at)
    return at


def winnowed(part: Slice, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First words (in the slice) and hashes of the fingerprints of all texts of at least span words."""
    grams = gram_hashes(part.hashes(byte_powers()), k, word_powers())
    width = span - k + 1
    if len(grams) < width:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    at = _windowed_min(grams, width)
    whole = part.doc[: len(at)] == part.doc[span - 1 : span - 1 + len(at)]
    at = np.unique(at[whole])
    return at, grams[at]


def short_grams(part: Slice, lengths: list[int]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """All m-grams of all texts, for the lengths m of items that are shorter than a span."""
    found, hashes = [], part.hashes(byte_powers()) if lengths else None
    for m in lengths:
        grams = gram_hashes(hashes, m, word_powers())
        at = np.flatnonzero(part.doc[: len(grams)] == part.doc[m - 1 : m - 1 + len(grams)])
        found.append((at, mix(grams[at], m), m))
    return found


def _around(part: Slice, at: int, row: int, before: int, after: int) -> tuple[int, bytes]:
    """How many words stand before word at in what is given, and the words around it."""
    low = max(at - before, part.first[row])
    high = min(at + after, part.first[row + 1])
    return at - low, b" ".join(part.word(i) for i in range(low, high))


_FOUND = {"kind": "tinyint", "row_id": "long", "n_words": "long", "h": "long", "at": "long", "m": "int", "lead": "int", "words": "string"}
_ARROW = {"tinyint": pa.int8(), "long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _document_rows(bits, lengths: list[int], span: int, k: int):
    """For each document a row of kind 0, and one of kind 1 for each fingerprint that the benchmark may have."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(bits.value, dtype=np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            ids = batch.column("row_id")
            schema = pa.schema([(n, _ARROW[t]) for n, t in _FOUND.items()]).append(batch.schema.field("doc_id"))
            for part in slices(batch.column("text"), ALPHANUMERIC, lower=True):
                n = len(part.counts)
                own = ids.slice(part.row, n)
                blank = [pa.nulls(n, t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.string())]
                of_doc = [pa.array(np.zeros(n, np.int8)), own, pa.array(part.counts.astype(np.int64)), own, *blank]
                yield pa.RecordBatch.from_arrays([*of_doc, batch.column("doc_id").slice(part.row, n)], schema=schema)
                found = [(*winnowed(part, span, k), 0), *short_grams(part, lengths)]
                ids_np = own.to_numpy(zero_copy_only=False)
                for at, h, m in found:
                    keep = known[h >> np.uint64(64 - FILTER_BITS)]
                    at, h = at[keep], h[keep]
                    if not len(at):
                        continue
                    doc = part.doc[at]
                    around = [_around(part, a, d, 0 if m else span - k, m or span) for a, d in zip(at.tolist(), doc.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.ones(len(at), np.int8)), pa.array(ids_np[doc]), pa.nulls(len(at), pa.int64()),
                            pa.array(h.view(np.int64)), pa.array((at - part.first[doc]).astype(np.int64)), pa.array(np.full(len(at), m, np.int32)),
                            pa.array([x[0] for x in around], pa.int32()), pa.array([x[1].decode() for x in around]),
                            pa.nulls(len(at), schema.field("doc_id").type),
                        ],
                        schema=schema,
                    )

    return rows


def _item_rows(span: int, k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text"), ALPHANUMERIC, lower=True):
                at, h = winnowed(part, span, k)
                short = [(part.first[d], m) for d, m in enumerate(part.counts.tolist()) if 0 < m < span]
                whole = {m: dict(zip(a.tolist(), g.tolist())) for a, g, m in short_grams(part, sorted({m for _, m in short}))}
                found = [(a, g, 0) for a, g in zip(at.tolist(), h.tolist())] + [(a, whole[m][a], m) for a, m in short]
                around = [_around(part, a, part.doc[a], 0 if m else span - k, m or span) for a, _, m in found]
                rows = [part.row + part.doc[a] for a, _, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("item_id").take(pa.array(rows, pa.int64())).cast(pa.string()),
                        pa.array(np.array([g for _, g, _ in found], dtype=np.uint64).view(np.int64)),
                        pa.array([m for _, _, m in found], pa.int32()),
                        pa.array([x[0] for x in around], pa.int32()), pa.array([x[1].decode() for x in around], pa.string()),
                    ],
                    names=["item_id", "h", "m", "item_lead", "item_words"],
                )

    return rows


def _extend(span: int, k: int):
    """Matches of a document's words with an item's: from which word on, and how many."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begins, counts = [], []
            for at, m, lead, words, item_lead, item_words in zip(*(batch.column(c).to_pylist() for c in ("at", "m", "lead", "words", "item_lead", "item_words"))):
                mine, theirs = words.split(" "), item_words.split(" ")
                left = 0
                while left < min(lead, item_lead) and mine[lead - left - 1] == theirs[item_lead - left - 1]:
                    left += 1
                right = 0
                while right < min(len(mine) - lead, len(theirs) - item_lead) and mine[lead + right] == theirs[item_lead + right]:
                    right += 1
                begins.append(at - left)
                counts.append(left + right if right >= (m or k) and left + right >= (m or span) else 0)
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("item_id"), pa.array(begins, pa.int64()), pa.array(counts, pa.int64())], names=["row_id", "item_id", "begin", "n"])

    return rows


def _known_bits(items: DataFrame) -> bytes:
    """The filter as bytes: bit h >> (64 - FILTER_BITS) for each hash. At most 2^(FILTER_BITS - 6) rows are collected."""
    bit = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    words = items.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - FILTER_BITS}) & 63 as int))")).alias("b"))
    table = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    for w, b in words.collect():
        table[w] = b & ((1 << 64) - 1)
    return table.tobytes()


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K) -> tuple[DataFrame, DataFrame]:
    """Where documents (doc_id, text) repeat benchmark items (item_id, text).

    Gives counts (row_id, doc_id, n_words) with a row for every row of docs,
    and hits (row_id, item_id, begin, n): the n words from word begin on are
    words of the item, in its order. Items of fewer than span words hit where
    they occur as a whole. Null and empty texts have no words; rows that repeat
    are judged each on its own, and a repeated item counts once. item_id comes
    as a string, null for items without one. Other columns are left alone.
    """
    items = benchmark.select("item_id", "text")
    items = stored(items.mapInArrow(_item_rows(span, k), "item_id string, h long, m int, item_lead int, item_words string").distinct())
    lengths = sorted(r[0] for r in items.filter("m > 0").select("m").distinct().collect())  # all below span
    bits = docs.sparkSession.sparkContext.broadcast(_known_bits(items))
    ddl = ", ".join(f"{n} {t}" for n, t in _FOUND.items()) + f", doc_id {docs.schema['doc_id'].dataType.simpleString()}"
    found = docs.select("doc_id", "text").withColumn("row_id", F.monotonically_increasing_id())
    found = stored(found.mapInArrow(_document_rows(bits, lengths, span, k), ddl))  # row_id is fixed from here on
    counts = found.filter("kind = 0").select("row_id", "doc_id", "n_words")
    met = found.filter("kind = 1").join(items, ["h", "m"])
    met = met.select("row_id", "item_id", "at", "m", "lead", "words", "item_lead", "item_words")
    hits = met.mapInArrow(_extend(span, k), "row_id long, item_id string, begin long, n long").filter("n > 0")
    return counts, hits.groupBy("row_id", "item_id", "begin").agg(F.max("n").alias("n"))


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """One row for each row of docs: row_id, doc_id, n_words, n_hit, n_items, items (sorted), unnamed, spans.

    n_items and items tell of items with an item_id, unnamed whether any without
    one is hit. spans has the hit stretches as (begin, end) in words, end exclusive, apart
    from each other and in order. See benchmark_hits for what counts as a hit.
    """
    counts, hits = benchmark_hits(docs, benchmark, span, k)
    hits = stored(hits)
    # The longest hit from each word on: no document has more of these than words.
    longest = hits.groupBy("row_id", "begin").agg(F.max(F.col("begin") + F.col("n")).alias("end"))
    so_far = Window.partitionBy("row_id").orderBy("begin")
    reached = F.max("end").over(so_far.rowsBetween(Window.unboundedPreceding, -1))
    stretch = longest.withColumn("_new", (F.coalesce(reached, F.lit(-1)) < F.col("begin")).cast("int"))
    stretch = stretch.withColumn("_no", F.sum("_new").over(so_far)).groupBy("row_id", "_no").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    spans = stretch.groupBy("row_id").agg(F.sum(F.col("end") - F.col("begin")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    items = hits.select("row_id", "item_id").distinct()
    items = items.groupBy("row_id").agg(F.array_sort(F.collect_list("item_id")).alias("items"), F.max(F.col("item_id").isNull()).alias("unnamed"))
    joined = counts.join(spans, "row_id", "left").join(items, "row_id", "left")
    none = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "row_id", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(none).cast("long").alias("n_items"), none.alias("items"), F.coalesce("unnamed", F.lit(False)).alias("unnamed"), "spans",
    )
