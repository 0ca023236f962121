import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from echoless.llm import mixing
from text_tables import DOCS, hard_docs, hard_rows, same


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    full, rest = set(), share * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        left = rest - sum(most * sizes[s] for s in full)
        deal = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = {s for s in open_ if deal[s] > most * sizes[s]}
        if not above:
            return {s: deal.get(s, most * sizes[s]) for s in order}
        full |= above


def check(found, rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    expected = targets(sizes)
    for r in found:
        assert r.taken <= 2 * r["size"] and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(expected[r.source])
        taken[r.source] += r.taken
    for s, t in expected.items():
        assert t - 65 <= taken[s] <= t + 1e-6
    same([(r.doc_id, r["size"]) for r in found], [(r[0], size(r[1])) for r in rows])


def test_sizes_targets_and_taken_words(spark):
    check(mixing.taken_words(hard_docs(spark)).collect(), hard_rows())


def test_reruns_agree(spark):
    runs = [mixing.taken_words(hard_docs(spark)).select("doc_id", "size", "taken").collect() for _ in range(2)]
    same(runs[0], [tuple(r) for r in runs[1]])


def test_reruns_agree_however_the_rows_are_split(spark):
    rows = hard_rows() + hard_rows()[:9] * 3
    docs = hard_docs(spark, rows)
    splits = [docs.coalesce(1), docs.repartition(5), docs.repartition(20, "text"), docs.orderBy(F.rand(3))]
    runs = [mixing.taken_words(s).select("doc_id", "size", "source", "taken").collect() for s in splits]
    for run in runs[1:]:
        same(run, [tuple(r) for r in runs[0]])


def test_permutations_of_many_blocks(spark):
    slots = spark.range(100_000).withColumn("slot", F.col("id") * 10_000_000)
    for n in (2**40, 10**12 + 39):
        blocks = slots.select(mixing._permuted(F.col("slot"), F.lit(n), F.lit(5), 17).alias("b"))
        r = blocks.agg(F.count_distinct("b").alias("d"), F.min("b").alias("a"), F.max("b").alias("z"), F.avg("b").alias("m")).first()
        assert r.d == 100_000 and 0 <= r.a and r.z < n and abs(r.m / n - 0.5) < 0.01
    for n in (1, 2, 4095, 4096, 4097, 10_000, 65_536):
        for source in (0, 3):
            b = spark.range(n).select(mixing._permuted(F.col("id"), F.lit(n).cast("long"), F.lit(source), 17).alias("b"))
            assert sorted(r.b for r in b.collect()) == list(range(n))


def test_slots_of_a_source_visit_every_block_once_a_round(spark):
    t = spark.createDataFrame([(0, "a", 1000, 1730.0), (1, "b", 10, 15.0), (2, None, 0, 0.0), (3, "c", 64, 128.0)], "source_id long, source string, source_size long, target double")
    drawn = mixing.slots(t, 64, 8, 1).collect()
    for source, n, words in ((0, 16, 1730), (1, 1, 15), (3, 1, 128)):
        own = [r for r in drawn if r.source_id == source]
        for round_ in {r["round"] for r in own}:
            blocks = [r.block for r in own if r["round"] == round_]
            assert len(set(blocks)) == len(blocks) and max(blocks) < n
        assert len([r for r in own if r["round"] == 0]) == n
        assert sum(r.n_words for r in own) >= words
    assert not [r for r in drawn if r.source_id == 2]
    assert len({r.shard for r in drawn}) > 1


def test_mixture_has_the_words_it_says(spark):
    rows, mixture = mixing.mix_sources(hard_docs(spark))
    size = {r.row_id: r["size"] for r in rows.collect()}
    for r in mixture.collect():
        assert 0 <= r.from_word and r.from_word + r.n_words <= size[r.row_id]


def test_no_rows_and_no_words(spark):
    assert mixing.taken_words(spark.createDataFrame([], DOCS)).count() == 0
    assert [r.taken for r in mixing.taken_words(spark.createDataFrame([(1, None, "x", None, 0), (2, " ", "x", "a", 0)], DOCS)).collect()] == [0, 0]
