"""Mixing sources to target weights.

Every source is a stream of words, packed into blocks of a fixed number of
words. Output shards draw how many blocks of each source they take; the draws
of a source are its slots. A pseudorandom permutation of the block numbers of
its source maps each slot to a block, and slots meet blocks in a join on
(source, block number).

Only DataFrame functions are used. Nothing is collected but a few sums over
all sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echoless.llm.storage import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Primes above SMALL, so each is coprime to any number of blocks below it. Fixed values.
PRIMES = (2305843009213693951, 2305843009213693921, 2305843009213693907, 2305843009213693723)
#: Fewer blocks than this are permuted by one multiplication, more by Feistel rounds.
SMALL = 4096
#: Steps of a permutation that leads out of the blocks; at SMALL blocks a slot needs as many with odds of 10^-48.
WALK = 32
#: Slots, or groups of rows, that one task numbers or expands at a time.
RUN = 4096
#: Rows of a group whose words one task puts in order.
GROUP = 256


def _numbered(keys: DataFrame, order: str) -> DataFrame:
    """keys with their rank (from 0, null last), by ranges that each task ranks alone."""
    by = F.col(order).asc_nulls_last()
    ranged = stored(keys.repartitionByRange(by).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").count()  # a row for each task of a shuffle, however many keys
    starts = starts.select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy("_range").orderBy(by)) - 1
    ranked = ranged.withColumn("rank", local).join(starts, "_range")
    return ranked.withColumn("rank", F.col("rank") + F.col("_start")).drop("_range", "_start")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size) to source_id, source, source_size, target.

    share of all words is dealt by weight; a target stops at most times the
    size of its source, and what is above is dealt again among the others.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = stored(_numbered(sizes, "source").withColumn("_w", weight).withColumn("_cap", F.col("source_size") * most))
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    level, before = 0.0, None
    while level != before:  # each turn fixes one source at least; a few turns are usual
        before = level
        full = F.col("_cap") <= F.col("_w") * level
        capped, open_weight = ranked.agg(
            F.coalesce(F.sum(F.when(full, F.col("_cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("_w"))), F.lit(0)),
        ).first()
        level = (total - capped) / open_weight if open_weight else before
    target = F.least(F.col("_cap").cast("double"), F.col("_w") * F.lit(float(level)))
    return ranked.select(F.col("rank").alias("source_id"), "source", "source_size", target.alias("target"))


def _offsets(docs: DataFrame) -> DataFrame:
    """Where each row's words start in the stream of its source.

    A source may hold a third of all rows: rows are dealt to groups of about
    GROUP rows by hash, groups are summed first, and only sums are put in order.
    """
    n_groups = docs.count() // GROUP + 1
    group = F.pmod(F.xxhash64("h", "place"), F.lit(n_groups))
    docs = docs.withColumn("_group", group)
    sums = docs.groupBy("source_id", "_group").agg(F.sum("size").alias("_size"))
    # Groups of a source are ordered in two steps too: RUN groups make a block of groups.
    sums = sums.withColumn("_block", F.floor(F.col("_group") / RUN))
    blocks = sums.groupBy("source_id", "_block").agg(F.sum("_size").alias("_size"))
    up = Window.partitionBy("source_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("source_id", "_block", F.coalesce(F.sum("_size").over(up), F.lit(0)).alias("_at"))
    up = Window.partitionBy("source_id", "_block").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_in", F.coalesce(F.sum("_size").over(up), F.lit(0))).join(blocks, ["source_id", "_block"])
    sums = sums.select("source_id", "_group", (F.col("_in") + F.col("_at")).alias("_at"))
    order = ("h", "h2", "place")  # of equal rows it does not matter which has which place
    up = Window.partitionBy("source_id", "_group").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = docs.withColumn("_in", F.coalesce(F.sum("size").over(up), F.lit(0)))
    rows = rows.join(sums, ["source_id", "_group"])
    return rows.withColumn("start", F.col("_in") + F.col("_at")).drop("_in", "_at", "_group")


def _blocks(docs: DataFrame, block: int) -> DataFrame:
    """A row for each part of a row's words that lies in one block."""
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    numbers = F.sequence(F.floor(F.col("start") / block), last)
    rows = docs.filter("size > 0").withColumn("block", F.explode(numbers))
    begin = F.greatest(F.col("start"), F.col("block") * block)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return rows.select(
        "row_id", "source_id", "block", (begin - F.col("start")).alias("from_word"),
        (begin - F.col("block") * block).alias("in_block"), (end - begin).alias("n_words"),
    )


def _permuted(slot: Column, n: Column, source: Column, seed: int) -> Column:
    """The block of a slot: a bijection of 0 to n - 1 that the source and the seed choose.

    Few blocks: x -> (p x + b) mod n, where p is coprime to n. Many: four Feistel
    rounds on the square grid that just holds n points, again from where they
    lead to as long as that lies beyond the last block. No step multiplies
    numbers beyond the root of n.
    """
    prime = F.element_at(F.array(*map(F.lit, PRIMES)), (F.pmod(F.xxhash64(source, F.lit(seed)), F.lit(len(PRIMES))) + 1).cast("int"))
    shift = F.pmod(F.xxhash64(source, F.lit(seed + 1)), n)
    # A root worked out in floats may be one short.
    side = F.ceil(F.sqrt(n.cast("double"))) + 1

    def rounds(x: Column) -> Column:
        right = F.pmod(x, side)
        left = F.floor((x - right) / side)
        for i in range(2):
            left = F.pmod(left + F.pmod(F.xxhash64(right, source, F.lit(seed + 10 + 2 * i)), side), side)
            right = F.pmod(right + F.pmod(F.xxhash64(left, source, F.lit(seed + 11 + 2 * i)), side), side)
        return left * side + right

    steps = F.array(*[F.lit(i) for i in range(WALK)])
    walked = F.aggregate(steps, slot, lambda x, i: F.when((x < n) & (i > 0), x).otherwise(rounds(x)))
    walked = F.when(walked < n, walked).otherwise(F.raise_error(F.lit("a permutation leads out of its blocks")).cast("long"))
    # Nearly all slots stay inside at once; that path is compiled.
    return F.when(n < SMALL, ((prime % n) * slot + shift) % n).when(rounds(slot) < n, rounds(slot)).otherwise(walked)


def _placed(plain: DataFrame) -> DataFrame:
    """plain with the place of each row among the rows with its hashes (h, h2), numbered by ranges: one row may repeat very often."""
    ranged = stored(plain.repartitionByRange("h", "h2", "row_id").withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("h", "h2", "_range").agg(F.count("*").alias("_rows"))
    # Only rows on both sides of a border between ranges have something before their range.
    many = counts.groupBy("h", "h2").agg(F.count("*").alias("_ranges")).filter("_ranges > 1")
    earlier = Window.partitionBy("h", "h2").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.join(many, ["h", "h2"], "left_semi").select("h", "h2", "_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_range", "h", "h2").orderBy("row_id")) - 1
    numbered = ranged.withColumn("place", local).join(before, ["h", "h2", "_range"], "left")
    return numbered.withColumn("place", F.col("place") + F.coalesce("_before", F.lit(0))).drop("_range", "_before")


def slots(targets: DataFrame, block: int, shard_slots: int, seed: int) -> DataFrame:
    """The slots of every output shard: shard, source_id, slot, round, block, n_words.

    A source fills target / block slots, and each of them falls into a shard by
    an independent hash: the numbers of its slots in the shards are a
    multinomial draw, while its total is met exactly. After as many slots as
    there are blocks, the next round takes them again. The last slot takes only
    as many words as are missing.
    """
    n = F.ceil(F.col("source_size") / block)
    shares = targets.filter("source_size > 0").withColumn("_n", n)
    # A round takes the whole stream; in the last, unfinished one, every slot takes a full block.
    shares = shares.withColumn("_rounds", F.floor(F.col("target") / F.col("source_size")))
    shares = shares.withColumn("_rest", F.floor(F.col("target") - F.col("_rounds") * F.col("source_size")))
    shares = shares.withColumn("_slots", F.col("_rounds") * F.col("_n") + F.ceil(F.col("_rest") / block))
    n_slots = shares.agg(F.coalesce(F.sum("_slots"), F.lit(0))).first()[0]
    n_shards = n_slots // shard_slots + 1
    runs = shares.filter("_slots > 0").withColumn("_run", F.explode(F.sequence(F.lit(0), F.floor((F.col("_slots") - 1) / RUN))))
    # As many tasks as there are slots for; the few rows that stand for runs would all be given to one.
    runs = runs.repartition(int(n_slots // (RUN * 16)) + 1, F.col("source_id"), F.col("_run"))
    top = F.least(F.col("_slots"), (F.col("_run") + 1) * RUN) - 1
    drawn = runs.withColumn("slot", F.explode(F.sequence(F.col("_run") * RUN, top)))
    round_ = F.floor(F.col("slot") / F.col("_n"))
    in_round = F.col("slot") - round_ * F.col("_n")
    missing = F.when(round_ < F.col("_rounds"), F.lit(block)).otherwise(F.least(F.lit(block), F.col("_rest") - in_round * block))
    return drawn.select(
        F.pmod(F.xxhash64("source_id", "slot", F.lit(seed + 2)), F.lit(n_shards)).alias("shard"),
        "source_id", "slot", round_.alias("round"),
        _permuted(in_round, F.col("_n"), F.col("source_id"), seed).alias("block"), missing.alias("n_words"),
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    block: int = 64,
    shard_slots: int = 4096,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """Deal the words of docs (doc_id, text, source) out to shards by source weight.

    Gives two tables. rows: row_id, doc_id, source, size, source_size, target
    for every row of docs. mixture: shard, source_id, slot, row_id, from_word,
    n_words - the words of each slot, as parts of rows.

    Sources rank by code point, null last, and weights repeat along the ranks.
    A null text has size 0, and rows of size 0 or of an empty source take no
    part in the mixture. Rows that repeat count as often as they stand there.
    Columns beside the three are left alone. most must be a whole number for
    no row to be taken more often than that.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    hashes = F.xxhash64("doc_id", "source", "text").alias("h"), F.xxhash64("text", "source", "doc_id", F.lit(1)).alias("h2")
    plain = docs.select("doc_id", "source", size.alias("size"), *hashes)
    # row_id, which hangs on how the input is split, only tells equal rows apart.
    plain = stored(_placed(stored(plain.withColumn("row_id", F.monotonically_increasing_id()))))
    per_source = plain.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(per_source, weights, share, most))
    sourced = plain.alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
    rows = sourced.select("row_id", "doc_id", "p.source", "size", "source_id", "source_size", "target", "h", "h2", "place")
    parts = _blocks(_offsets(rows.select("row_id", "source_id", "size", "h", "h2", "place")), block)
    drawn = slots(targets, block, shard_slots, seed)
    # Spark takes what explode() makes for as small as its input and would broadcast it.
    met = parts.alias("b").hint("merge").join(drawn.alias("s"), ["source_id", "block"])
    taken = F.least(F.col("b.n_words"), F.col("s.n_words") - F.col("in_block"))
    mixture = met.select("shard", "source_id", "slot", "row_id", "from_word", taken.alias("n_words")).filter("n_words > 0")
    return rows.drop("source_id", "h", "h2", "place"), mixture


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of docs: row_id, doc_id, source, size, source_size, target, and taken."""
    rows, mixture = mix_sources(docs, **options)
    taken = mixture.groupBy("row_id").agg(F.sum("n_words").alias("taken"))
    return rows.join(taken, "row_id", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
