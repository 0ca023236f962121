"""Near copies by similarity, with SimHash as the filter.

The fingerprint of a text is long: WORDS independent SimHashes of its distinct
shingles. It is cut into blocks, and texts that share a block are compared by
the Hamming distance of their first two SimHashes. What is close is checked
against the shingles themselves: texts are linked if the Jaccard similarity of
their sets of shingles is at least the threshold. Two sets of similarity s
differ in a bit with probability p = acos(2s / (1 + s)) / pi; with 64 blocks of
16 bits at least one is equal in 99.2% of pairs at s = 0.8, 99.9% at 0.85.

Links are found twice. First each text is checked against one other, the
smallest near one with which it shares one of the first blocks; that joins most
of any group of copies without looking at its pairs. Then all pairs are looked
at that are not yet in one group. A block that very many texts share is dealt
to tasks by pairs of chunks: its most frequent group against the rest, and the
rest against itself. Texts of a block that are close, directly or over others,
are a cluster. Where its close pairs are no more than its texts, they are checked
one by one. Others are dense: for each text only the cluster's least one is
noted. Dense clusters of all blocks with a text in common become one, unless
that is more to check than they are apart, and its texts' shingles go to a task
for each pair of parts once, not once for each block. The task checks all pairs
and returns what links each text to its group, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echoless.llm.simhash import CHUNK, SMALL, components, fingerprints_of
from echoless.llm.storage import stored
from echoless.llm.words import SPACES, Slice, byte_powers, gram_hashes, mix, slices, word_powers

#: SimHashes of 64 bits in a fingerprint, and bits in a block.
WORDS, WIDTH = 16, 16
#: Blocks that the first search for links uses.
FIRST = 16
#: Of 128 bits, texts of similarity 0.8 differ in 19 on average (deviation 4), others in 64 (deviation 6).
DISTANCE = 34
#: Texts and shingles of a part; a task checks two parts of a cluster against each other, COLUMNS shingles at a time.
PART, VOLUME, COLUMNS = 512, 1 << 22, 4096


def distinct_shingles(part: Slice, size: int, powers: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of every text as hashes, sorted, and how many each text has. Fewer words than size make one."""
    hashes, rows = part.hashes(powers[0]), len(part.counts)
    full = gram_hashes(hashes, size, powers[1])
    inside = part.doc[size - 1 :][: len(full)] == part.doc[: len(full)]
    doc, found = [part.doc[: len(full)][inside]], [full[inside]]
    for n in range(1, size):
        short = np.flatnonzero(part.counts == n)
        if len(short):
            doc.append(short)
            found.append(gram_hashes(hashes, n, powers[1])[part.first[short]])
    doc, found = np.concatenate(doc), np.concatenate(found)
    order = np.lexsort((found, doc))
    doc, found = doc[order], found[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (found[1:] != found[:-1]))[: len(doc)]
    return found[new], np.bincount(doc[new], minlength=rows)


def _content(shingles: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64 bits for each set of shingles."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shingles, 3), dtype=np.uint64)])
    ends = np.cumsum(n)
    return mix(sums[ends] - sums[ends - n] + n.astype(np.uint64), 5)


def _signatures(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = byte_powers(), word_powers()
        for batch in batches:
            contents, fps = [np.zeros(0, np.uint64)], [np.zeros((0, WORDS), np.uint64)]
            for part in slices(batch.column("text"), SPACES, lower=True):
                shingles, n = distinct_shingles(part, size, powers)
                contents.append(_content(shingles, n))
                fps.append(np.stack([fingerprints_of(mix(shingles, 100 + i), n) for i in range(WORDS)], axis=1))
            fps = np.concatenate(fps)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1) * WORDS, pa.int32()), pa.array(fps.ravel().view(np.int64)))
            kept = [n for n in batch.schema.names if n != "text"]
            cid = pa.array(np.concatenate(contents).view(np.int64))
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), cid, lists], names=[*kept, "cid", "fps"])

    return rows


def _shingle_sets(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = byte_powers(), word_powers()
        for batch in batches:
            for part in slices(batch.column("text"), SPACES, lower=True):
                shingles, n = distinct_shingles(part, size, powers)
                ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(shingles.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(_content(shingles, n).view(np.int64)), lists], names=["cid", "shingles"])

    return rows


def _keyed(rows: DataFrame, blocks: int) -> DataFrame:
    """rows once for each of the first blocks: key is the block's number and bits."""
    per = 64 // WIDTH
    bits = lambda i: f"shiftrightunsigned(fps[{i // per}], {WIDTH * (i % per)}) & {(1 << WIDTH) - 1}L"
    keys = F.array(*[F.expr(f"{i << WIDTH}L + ({bits(i)})") for i in range(blocks)])
    return rows.withColumn("key", F.explode(keys)).withColumns({"f": F.col("fps")[0], "g": F.col("fps")[1]}).drop("fps")


def _close(other: str) -> Column:
    return F.bit_count(F.col("f").bitwiseXOR(F.col(f"{other}.f"))) + F.bit_count(F.col("g").bitwiseXOR(F.col(f"{other}.g"))) <= DISTANCE


def _first_pairs(distinct: DataFrame) -> DataFrame:
    keyed = _keyed(distinct.select("cid", "fps"), FIRST)
    least = keyed.groupBy("key").agg(F.min(F.struct("cid", "f", "g")).alias("c"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return keyed.join(least, "key").filter((F.col("cid") > F.col("c.cid")) & _close("c")).groupBy(F.col("cid").alias("u")).agg(F.min("c.cid").alias("v"))


def _clusters(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts the first one that it is connected with by the pairs (a, b)."""
    first = np.arange(n)
    while True:
        new, low = first.copy(), np.minimum(first[a], first[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == first).all():
            return first
        first = new


def _close_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Close pairs of different groups among rows of equal (key, i, j), which come in order and may lie across batches.

    Gives pairs (u, v), or, where a cluster has more of them than texts, its texts u with the least of them, v.
    """

    def close(t: np.ndarray) -> pa.RecordBatch:
        number = np.cumsum(np.append(True, (t[1:, :3] != t[:-1, :3]).any(axis=1))) if len(t) else np.zeros(0, np.int64)
        begin = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(t) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(t)))
        own = np.repeat(size, size)
        cid, root, f, g = t[:, 3], t[:, 4], t[:, 5].view(np.uint64), t[:, 6].view(np.uint64)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return (np.bitwise_count(f[a] ^ f[b]).astype(np.int16) + np.bitwise_count(g[a] ^ g[b]) <= DISTANCE) & (root[a] != root[b])

        for step in range(1, SMALL):
            at = np.flatnonzero((number[step:] == number[:-step]) & (own[step:] <= SMALL))
            at = at[near(at, at + step)]
            left.append(at)
            right.append(at + step)
        for b, n in zip(begin[size > SMALL].tolist(), size[size > SMALL].tolist()):
            x, y = np.nonzero(np.triu(np.bitwise_count(f[b : b + n, None] ^ f[None, b : b + n]) <= DISTANCE, 1))
            at = near(b + x, b + y)
            left.append(b + x[at])
            right.append(b + y[at])
        a, b = np.concatenate(left), np.concatenate(right)
        texts, cluster = np.unique(np.concatenate([a, b])), _clusters(a, b, len(t))
        many = np.bincount(cluster[a], minlength=len(t)) > np.bincount(cluster[texts], minlength=len(t))
        few, texts = ~many[cluster[a]], texts[many[cluster[texts]]]
        least = np.full(len(t), np.iinfo(np.int64).max)
        np.minimum.at(least, cluster[texts], cid[texts])
        a, b = cid[a[few]], cid[b[few]]
        columns = [np.append(np.maximum(a, b), cid[texts]), np.append(np.minimum(a, b), least[cluster[texts]])]
        dense = np.arange(len(a) + len(texts)) >= len(a)
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(dense)], names=["u", "v", "dense"])

    yield from _by_cell(batches, ("key", "i", "j"), ("cid", "root", "f", "g"), close)


def _by_cell(batches, cell: tuple, columns: tuple, work) -> Iterator[pa.RecordBatch]:
    """work on the rows of whole cells, as a table of longs."""
    held = np.zeros((0, len(cell) + len(columns)), np.int64)
    for batch in batches:
        new = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (*cell, *columns)], axis=1)
        held = np.concatenate([held, new])
        other = np.flatnonzero((held[:, : len(cell)] != held[-1, : len(cell)]).any(axis=1)) if len(held) else []
        cut = other[-1] + 1 if len(other) else 0
        if cut:
            yield work(held[:cut])
            held = held[cut:]
    yield work(held)


def _linked(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set of shingles the first one that it is linked with, over others too; sets with none are alone."""
    size, n = np.array([len(s) for s in sets]), len(sets)
    tokens, column = np.unique(np.concatenate(sets), return_inverse=True)
    common, row = np.zeros((n, n)), np.repeat(np.arange(n), size)
    shared = np.bincount(column, minlength=len(tokens)) > 1
    at = shared[column]
    column, row = (np.cumsum(shared) - 1)[column[at]], row[at]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    for low in range(0, int(shared.sum()), COLUMNS):
        begin, end = np.searchsorted(column, [low, low + COLUMNS])
        holds = np.zeros((n, COLUMNS), np.float32)
        holds[row[begin:end], column[begin:end] - low] = 1
        common += holds @ holds.T
    near = common / np.maximum(size[:, None] + size[None, :] - common, 1) >= similarity
    near = (near & (size > 0)) | np.eye(n, dtype=bool)
    root = np.arange(n)
    while True:
        new = np.where(near, root[None, :], n).min(axis=1)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _dense_links(similarity: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(cids: list, sets: list) -> pa.RecordBatch:
            cid = np.array(cids, np.int64)
            root = _linked(sets, similarity) if sets else np.zeros(0, np.int64)
            moved = root != np.arange(len(cid))
            u, v = cid[moved], cid[root[moved]]
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

        cell, cids, sets = None, [], []
        for batch in batches:
            names = zip(*[batch.column(c).to_pylist() for c in ("cell", "i", "j")])
            found = batch.column("shingles")
            ends, values = found.offsets.to_numpy(), found.values.to_numpy(zero_copy_only=False)
            for k, (name, cid) in enumerate(zip(names, batch.column("u").to_pylist())):
                if name != cell:
                    if cids:
                        yield links(cids, sets)
                    cell, cids, sets = name, [], []
                cids.append(cid)
                sets.append(values[ends[k] : ends[k + 1]].copy())
        yield links(cids, sets)

    return rows


def _others(rooted: DataFrame) -> DataFrame:
    """All close pairs of rooted (cid, root, fps) with a block in common and different roots, as `_close_texts` gives them."""
    keyed = _keyed(rooted, 64 // WIDTH * WORDS)
    many = stored(keyed.groupBy("key").count().filter(F.col("count") > CHUNK).select("key"))
    of_root = keyed.join(many, "key").groupBy("key", "root").count()
    hot = of_root.groupBy("key").agg(F.max(F.struct("count", "root")).alias("most"), F.sum("count").alias("all"))
    chunks = lambda n: F.ceil(n / CHUNK)
    hot = stored(hot.select("key", F.col("most.root").alias("main"), chunks(F.col("most.count")).alias("n_main"), chunks(F.col("all") - F.col("most.count")).alias("n_rest")))
    dealt = keyed.join(hot, "key", "left").filter(F.coalesce(F.col("n_rest"), F.lit(1)) > 0)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    at = lambda i, j: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"))
    mine = lambda n: F.pmod(F.xxhash64("cid"), F.col(n))
    # i is 0 for blocks that few texts share, positive for the main group against the rest, negative within the rest.
    main = F.transform(upto("n_rest"), lambda j: at(mine("n_main") + 1, j))
    rest = F.concat(
        F.transform(upto("n_main"), lambda i: at(i + 1, mine("n_rest"))),
        F.transform(upto("n_rest"), lambda j: at(-1 - F.least(j, mine("n_rest")), F.greatest(j, mine("n_rest")))),
    )
    zero = F.lit(0)
    places = F.when(F.col("main").isNull(), F.array(at(zero, zero))).when(F.col("root") == F.col("main"), main).otherwise(rest)
    order = ["key", "i", "j"]
    dealt = dealt.withColumn("at", F.explode(places)).select("key", "at.i", "at.j", "cid", "root", "f", "g")
    dealt = dealt.repartition(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(_close_texts, "u long, v long, dense boolean")


def _cells(stars: DataFrame) -> DataFrame:
    """(u, v), texts with the least ones of their clusters, to (u, cell): texts of a cluster have a cell in common.

    All clusters that hang together are one cell, or each least text has its own if that sends fewer rows.
    """
    stars = stored(stars.withColumn("first", F.min("v").over(Window.partitionBy("u"))))
    roots = components(stars.select(F.col("v").alias("u"), F.col("first").alias("v"))).withColumnRenamed("u", "v")
    sent = lambda n: n * F.greatest(F.ceil(n / PART) - 1, F.lit(1))
    own = stars.groupBy("v").agg(F.count("*").alias("n"), F.count_if(F.col("v") == F.col("first")).alias("firsts"))
    own = stored(own.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v")))
    whole = own.groupBy("root").agg((sent(F.sum("firsts")) <= F.sum(sent(F.col("n")))).alias("whole"))
    own = own.join(whole, "root").select("v", "root", "whole")
    return stars.join(own, "v").filter(~F.col("whole") | (F.col("v") == F.col("first"))).select("u", F.when(F.col("whole"), F.col("root")).otherwise(F.col("v")).alias("cell"))


def _parts(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """The texts of cells (u, cell) once for each pair (i, j) of parts that a task checks."""
    sized = cells.join(sets.select(F.col("cid").alias("u"), F.size("shingles").cast("long").alias("n")), "u")
    parts = F.greatest(F.ceil(F.count("*") / PART), F.ceil(F.sum("n") / VOLUME), F.lit(1))
    dealt = cells.join(sized.groupBy("cell").agg(parts.alias("parts")), "cell").withColumn("part", F.pmod(F.xxhash64("u", F.lit(2)), "parts"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).filter("parts = 1 or part <> other")
    return dealt.select("u", "cell", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))


def _sets(asked: DataFrame, rows: DataFrame, distinct: DataFrame, size: int) -> DataFrame:
    """The sets of shingles of the texts asked for (cid)."""
    one_row = distinct.join(asked.distinct(), "cid").select("row.rid", "row.tid")
    return stored(rows.join(one_row, ["rid", "tid"]).select("text").mapInArrow(_shingle_sets(size), "cid long, shingles array<long>").dropDuplicates(["cid"]))


def _other_links(rooted: DataFrame, rows: DataFrame, distinct: DataFrame, size: int, similarity: float) -> DataFrame:
    """Links that join the groups of rooted (cid, root, fps) as far as their texts are similar."""
    found = stored(_others(rooted).distinct())
    pairs, cells = found.filter(~F.col("dense")).select("u", "v"), stored(_cells(found.filter("dense").select("u", "v")))
    sets = _sets(pairs.select(F.explode(F.array("u", "v")).alias("cid")).union(cells.select("u")), rows, distinct, size)
    order = ["cell", "i", "j"]
    dealt = _parts(cells, sets).join(sets.withColumnRenamed("cid", "u"), "u").repartition(*order).sortWithinPartitions(*order)
    return _similar(pairs, sets, similarity).union(dealt.mapInArrow(_dense_links(similarity), "u long, v long"))


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets of shingles are as similar as asked for."""
    of = lambda end, name: sets.select(F.col("cid").alias(end), F.col("shingles").alias(name))
    both = pairs.join(of("u", "a"), "u").filter(F.size("a") > 0).join(of("v", "b"), "v").withColumn("common", F.size(F.array_intersect("a", "b")))
    return both.filter(F.col("common") / (F.size("a") + F.size("b") - F.col("common")) >= similarity).select("u", "v")


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, component_id.

    Texts (words between ASCII white space, A-Z lower-cased) are linked if the
    Jaccard similarity of their sets of word shingles is at least similarity;
    component_id is the smallest doc_id reachable, null if none reached has one.
    Texts with fewer words than a shingle have one of all their words. Null and
    empty texts and those of white space are copies of each other and of no
    other. Other columns are left alone. Sets of shingles are told apart by 64
    bits of hash.
    """
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), F.xxhash64("text", F.lit(1)).alias("tid"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = stored(rows.mapInArrow(_signatures(shingle), f"doc_id {kind}, rid long, tid long, cid long, fps array<long>"))
    distinct = signed.groupBy("cid").agg(F.min("doc_id").alias("least"), F.min(F.struct("rid", "tid")).alias("row"), F.min("fps").alias("fps"))
    distinct = stored(distinct)
    first = stored(_first_pairs(distinct))
    sets = _sets(first.select(F.explode(F.array("u", "v")).alias("cid")), rows, distinct, shingle)
    links = stored(_similar(first, sets, similarity))
    roots = components(links).withColumnRenamed("u", "cid")
    rooted = stored(distinct.select("cid", "fps").join(roots, "cid", "left").select("cid", F.coalesce("root", "cid").alias("root"), "fps"))
    links = links.union(_other_links(rooted, rows, distinct, shingle, similarity))
    roots = components(links).withColumnRenamed("u", "cid")
    rooted = stored(distinct.select("cid", "least").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return signed.select("doc_id", "cid").join(rooted.join(least, "root").select("cid", "component_id"), "cid").select("doc_id", "component_id")
