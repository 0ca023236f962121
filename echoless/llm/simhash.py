"""SimHash near-dedup.

Bit i of a text's fingerprint is set if more than half of the hashes of its
word shingles have it. Texts whose fingerprints differ in few bits belong
together. A fingerprint is cut into blocks; of two fingerprints that differ in
at most `distance` bits, all but `distance` blocks are equal. So fingerprints
are joined on each choice of that many blocks, and the distance is checked.

Equal fingerprints are one from the start. A choice of blocks that very many
fingerprints share is dealt to tasks by pairs of chunks, and tasks return
links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoless.llm.storage import stored
from echoless.llm.words import SPACES, Slice, slices

SEED = 42
BITS = 64
#: Fingerprints with equal blocks that are compared at once.
CHUNK = 512
#: Groups up to this size are compared side by side, larger ones each on its own.
SMALL = 16


def shingle_hashes(part: Slice, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of every text, and how many each text has."""
    lengths = part.ends - part.starts
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    joined = np.full(begin[-1], 0x20, dtype=np.uint8)
    shift = np.repeat(begin[:-1] - part.starts, lengths)
    source = np.arange(len(shift)) + np.repeat(part.starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) if len(lengths) else shift
    joined[source + shift] = part.data[source]
    # Word by which a shingle starts, and the one after its last.
    n = np.where(part.counts >= size, part.counts - size + 1, np.minimum(part.counts, 1))
    first = np.repeat(part.first[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    last = np.minimum(first + size, np.repeat(part.first[1:], n))
    text, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = [digest(text[a:b], SEED) for a, b in zip(begin[first].tolist(), (begin[last] - 1).tolist())]
    return np.array(hashes, dtype=np.uint64), n


def fingerprints_of(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A fingerprint for each text from the hashes of its n shingles; zero if it has none."""
    out = np.zeros(len(n), dtype=np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])[some]
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
        set_ = np.packbits(2 * ones > n[some, None], axis=1, bitorder="little")
        out[some] = np.ascontiguousarray(set_).view(np.uint64).ravel()
    return out


def _fingerprint(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprints_of(*shingle_hashes(part, size)) for part in slices(batch.column("text"), SPACES, lower=True)]
            fp = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in batch.schema.names if n != "text"), pa.array(fp)], names=[*(n for n in batch.schema.names if n != "text"), "fp"])

    return rows


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs (doc_id, text) to doc_id, fp: one row each, fp as a signed long. Null and empty texts have fp 0."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_fingerprint(shingle), f"doc_id {kind}, fp long")


def _masks(distance: int) -> list[int]:
    """The bits of each choice of blocks, as signed longs: of 2 * distance blocks, distance are chosen."""
    n = max(2 * distance, 1)
    edges = [BITS * i // n for i in range(n + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(blocks, n - distance)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= distance


def _roots(fps: np.ndarray, distance: int) -> np.ndarray:
    """For each fingerprint the first one that it is linked with, over others too."""
    near = _near(fps[:, None], fps[None, :], distance)
    root = np.arange(len(fps))
    while True:
        new = np.where(near, root[None, :], len(fps)).min(axis=1)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _links(distance: int):
    """Links within groups; rows come in order of group, and a group may lie across batches."""

    def within(group: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        size = np.diff(np.append(begin, len(group)))
        own = np.repeat(size, size)
        left, right = [], []
        for step in range(1, SMALL):
            same = (group[step:] == group[:-step]) & (own[step:] <= SMALL)
            at = np.flatnonzero(same)
            at = at[_near(fp[at], fp[at + step], distance)]
            left.append(fp[at + step])
            right.append(fp[at])
        for b, n in zip(begin[size > SMALL].tolist(), size[size > SMALL].tolist()):
            part = fp[b : b + n]
            root = _roots(part, distance)
            moved = root != np.arange(n)
            left.append(part[moved])
            right.append(part[root[moved]])
        return np.concatenate(left), np.concatenate(right)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, fp = np.zeros((0, 4), np.int64), np.zeros(0, np.uint64)

        def links(g: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            number = np.cumsum(np.append(True, (g[1:] != g[:-1]).any(axis=1))) if len(g) else np.zeros(0, np.int64)
            a, b = within(number, f) if len(f) else (f, f)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"])

        for batch in batches:
            new = np.stack([batch.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in ("choice", "bits", "i", "j")], axis=1)
            group = np.concatenate([group, new])
            fp = np.concatenate([fp, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            other = np.flatnonzero((group != group[-1]).any(axis=1)) if len(group) else []
            cut = other[-1] + 1 if len(other) else 0
            if cut:
                yield links(group[:cut], fp[:cut])
                group, fp = group[cut:], fp[cut:]
        yield links(group, fp)

    return rows


def links(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """(u, v): links among distinct fingerprints (fp). Fingerprints at most distance bits apart are linked, directly or over others."""
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(_masks(distance))])
    keyed = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.choice", "k.bits")
    shared = keyed.groupBy("choice", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = keyed.hint("merge").join(shared, ["choice", "bits"])
    n_chunks = F.ceil(F.col("n") / CHUNK)
    keyed = keyed.withColumn("own", F.pmod(F.xxhash64("fp"), n_chunks)).withColumn("other", F.explode(F.sequence(F.lit(0), n_chunks - 1)))
    chunked = keyed.select("choice", "bits", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    order = ["choice", "bits", "i", "j"]
    dealt = chunked.repartition(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(_links(distance), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) to (u, root): the smallest vertex that each vertex is connected with, for all but the roots.

    Stars in turn: every vertex sends its larger neighbours to its smallest one,
    then its smaller neighbours. No task sees more of a vertex than its smallest
    neighbour, so one with very many neighbours does no harm.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    edges, before = stored(edges), None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before or state[0] == 0:
            return edges.withColumnRenamed("v", "root")
        before = state
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stored(edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = stored(small.union(least).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, fp, component_id.

    component_id is the smallest doc_id that can be reached over fingerprints
    at most distance bits apart; null if all that is reached has no doc_id.
    Texts without words have fingerprint zero and are linked like others. Other
    columns are left alone.
    """
    docs = stored(fingerprints(docs, shingle))
    distinct = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp"), distance)).withColumnRenamed("u", "fp")
    rooted = stored(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(least, "root").select("fp", "component_id")
    return docs.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
