"""Service rules: from replies, through cooldowns, to lifetimes and matches."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rule_key, unpack_rule_key
from ..schema import COOLDOWN_US, EPOCH_US, FAILURE_COOLDOWN_US, RULE_TTL_US
from .flows import match_replies
from .nets import assign_internal, nets_of, with_membership
from .spans import CHUNK_US, fold_spans

KEY = ["ip", "port", "proto"]
_MATCH_BUCKET_US = 60_000_000
#: Binary logarithm of the registers of a sketch; with 16,384 an estimate is off by 0.8% (one deviation).
SKETCH_BITS = 14


def services_of(replies: DataFrame, subnets: DataFrame) -> DataFrame:
    """Rules from matched replies: the asking side if internal, else the other."""
    flagged = with_membership(replies, nets_of(subnets, "internal"), _src="src_ip")
    return flagged.select(
        F.col("reply_ts").alias("ts_us"),
        F.when(F.col("_src"), F.col("src_ip")).otherwise(F.col("dst_ip")).alias("ip"),
        F.when(F.col("_src"), F.col("src_port")).otherwise(F.col("dst_port")).alias("port"),
        "proto",
    )


def replied_services(p: DataFrame, subnets: DataFrame, **limits) -> DataFrame:
    return services_of(match_replies(p, **limits), subnets)


def _cooldown(rules, cooldown_us, chunk_us, starts_only):
    """A cooldown is a span that nothing answers."""
    zero = F.lit(0).cast("bigint")
    rows = rules.select(
        rule_key(*KEY).alias("key"), "ts_us", zero.alias("_id"), zero.alias("_side")
    )
    return fold_spans(
        rows, ["key"], "ts_us", "_id", "_side", cooldown_us, cooldown_us, starts_only, chunk_us
    )


def cooldown_dedup(
    rules: DataFrame, cooldown_us: int = COOLDOWN_US, chunk_us: int = CHUNK_US
) -> DataFrame:
    """Keep a rule only when the last kept one of its key is a cooldown old.

    Suppressed rules do not extend the cooldown.
    """
    return _cooldown(rules, cooldown_us, chunk_us, True).select("ts_us", *unpack_rule_key("key"))


def reply_counts(
    rules: DataFrame, cooldown_us: int = COOLDOWN_US, chunk_us: int = CHUNK_US
) -> DataFrame:
    """Replies seen and rules queued after the cooldown."""
    return _cooldown(rules, cooldown_us, chunk_us, False).agg(
        F.count("*").alias("replies"), F.count_if(F.col("role") == 0).alias("queued")
    )


def service_hits(p: DataFrame, subnets: DataFrame) -> DataFrame:
    """Packets as hits on the service key of their internal end."""
    return assign_internal(p, subnets).select(
        "ts_us",
        F.col("internal_ip").alias("ip"),
        F.col("internal_port").alias("port"),
        "proto",
    )


def failure_cooldown(
    keys: DataFrame, failures: DataFrame, cooldown_us: int = FAILURE_COOLDOWN_US
) -> DataFrame:
    """Drop arrivals of a key within the cooldown after a failed install.

    The time bucket in the join key keeps a busy key from meeting all its
    failures, and spreads it over tasks.
    """
    failed = failures.select(
        F.col("key").alias("_key"),
        F.col("fail_us").alias("_fail"),
        F.explode(F.array(F.lit(0), F.lit(1))).alias("_step"),
    ).select(
        "_key", "_fail", F.expr(f"_fail div {cooldown_us} + _step").alias("_slot")
    )
    on = (
        (F.col("key") == F.col("_key"))
        & (F.expr(f"ts_us div {cooldown_us}") == F.col("_slot"))
        & (F.col("ts_us") >= F.col("_fail"))
        & (F.col("ts_us") < F.col("_fail") + cooldown_us)
    )
    return keys.join(failed, on, "left_anti")


def pending_candidates(
    keys: DataFrame,
    installed: DataFrame,
    failures: DataFrame,
    cooldown_us: int = FAILURE_COOLDOWN_US,
) -> DataFrame:
    """Keys to install, once each, with their first admissible arrival."""
    return (
        failure_cooldown(keys, failures, cooldown_us)
        .groupBy("key")
        .agg(F.min("ts_us").alias("ts_us"))
        .join(installed.select("key"), "key", "left_anti")
    )


def rule_intervals(rules: DataFrame, hits: DataFrame, ttl_us: int = RULE_TTL_US) -> DataFrame:
    """Lifetimes of installed rules: from the first rule to last use + TTL.

    Everything of one key within one TTL-long slot belongs to one lifetime, so
    slots are summed up first (busy keys shrink to a row per slot) and only the
    slots of a key are put in order.
    """
    slot = F.expr(f"ts_us div {ttl_us}").alias("_slot")
    ruled = rules.groupBy(*KEY, slot).agg(
        F.min("ts_us").alias("_first_rule"), F.max("ts_us").alias("_last_rule")
    )
    # A hit learns its slot's first rule; slots are then summed up where the hits are.
    used = (
        hits.select("ts_us", *KEY, slot)
        .join(ruled.drop("_last_rule"), [*KEY, "_slot"], "left")
        .groupBy(*KEY, "_slot")
        .agg(
            F.min("ts_us").alias("_first_hit"),
            F.max("ts_us").alias("_last_hit"),
            F.count("*").alias("_hits"),
            F.count_if(F.col("ts_us") >= F.col("_first_rule")).alias("_hits_after"),
        )
    )
    slots = ruled.join(used, [*KEY, "_slot"], "full").select(
        *KEY,
        "_slot",
        "_first_rule",
        F.least("_first_rule", "_first_hit").alias("_from"),
        F.greatest("_last_rule", "_last_hit").alias("_to"),
        F.coalesce("_hits", F.lit(0)).alias("_hits"),
        F.coalesce("_hits_after", F.lit(0)).alias("_hits_after"),
    )
    ordered = W.partitionBy(*KEY).orderBy("_slot")
    running = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    breaks = F.coalesce(F.col("_from") - F.lag("_to").over(ordered) > ttl_us, F.lit(True))
    lives = slots.withColumn("_new", breaks.cast("int")).withColumn(
        "_life", F.sum("_new").over(running)
    )
    so_far = W.partitionBy(*KEY, "_life").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    earlier = F.min("_first_rule").over(so_far)
    used = F.when(earlier.isNotNull(), F.col("_hits")).otherwise(F.col("_hits_after"))
    return (
        lives.withColumn("_used", used)
        .groupBy(*KEY, "_life")
        .agg(
            F.min("_first_rule").alias("start_us"),
            (F.max("_to") + ttl_us).alias("end_us"),
            F.sum("_used").alias("n_hits"),
        )
        .filter(F.col("start_us").isNotNull())
        .select(*KEY, "start_us", "end_us", "n_hits")
    )


def mark_active_hosts(p: DataFrame, intervals: DataFrame, subnets: DataFrame) -> DataFrame:
    """Add `suppressed`: the packet's service has a rule live at packet time.

    Lifetimes are cut into time buckets; packets meet those of their bucket, so
    a busy service spreads over its buckets. Packets without an internal end
    drop out.
    """
    width = _MATCH_BUCKET_US
    live = (
        intervals.select(
            F.col("ip").alias("internal_ip"),
            F.col("port").alias("internal_port"),
            "proto",
            F.struct("start_us", "end_us").alias("_span"),
            F.explode(
                F.sequence(F.expr(f"start_us div {width}"), F.expr(f"(end_us - 1) div {width}"))
            ).alias("_bucket"),
        )
        .groupBy("internal_ip", "internal_port", "proto", "_bucket")
        .agg(F.collect_list("_span").alias("_spans"))
    )
    inside = F.exists(
        "_spans",
        lambda s: (F.col("ts_us") >= s["start_us"]) & (F.col("ts_us") < s["end_us"]),
    )
    return (
        assign_internal(p, subnets)
        .withColumn("_bucket", F.expr(f"ts_us div {width}"))
        .join(live, ["internal_ip", "internal_port", "proto", "_bucket"], "left")
        .withColumn("suppressed", F.coalesce(inside, F.lit(False)))
        .drop("_bucket", "_spans")
    )


def active_host_filter(
    p: DataFrame, intervals: DataFrame, subnets: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(suppressed, mirrored) packets under the rules live at packet time."""
    marked = mark_active_hosts(p, intervals, subnets)
    return (
        marked.filter("suppressed").drop("suppressed"),
        marked.filter("not suppressed").drop("suppressed"),
    )


def install_requests(
    rules: DataFrame,
    intervals: DataFrame,
    failures: DataFrame,
    cooldown_us: int = FAILURE_COOLDOWN_US,
) -> DataFrame:
    """When each lifetime's rule was first asked for outside a failure's cooldown.

    While a rule lives its key is not asked for again, so it is one request for
    each lifetime. Both sides meet in time buckets, so a busy key spreads.
    """
    width = _MATCH_BUCKET_US
    arrivals = failure_cooldown(
        rules.select("ts_us", rule_key(*KEY).alias("key")), failures, cooldown_us
    ).withColumn("_bucket", F.expr(f"ts_us div {width}"))
    lives = intervals.select(
        rule_key(*KEY).alias("key"),
        "start_us",
        "end_us",
        F.explode(
            F.sequence(F.expr(f"start_us div {width}"), F.expr(f"(end_us - 1) div {width}"))
        ).alias("_bucket"),
    )
    inside = (F.col("ts_us") >= F.col("start_us")) & (F.col("ts_us") < F.col("end_us"))
    return (
        arrivals.join(lives, ["key", "_bucket"])
        .filter(inside)
        .groupBy("key", "start_us")
        .agg(F.min("ts_us").alias("ts_us"))
        .select("key", "ts_us")
    )


def sketch_key() -> Column:
    """What sketches count: 64 bits for each key."""
    return F.xxhash64(*KEY)


def hot_rules(rules: DataFrame, epoch_us: int = EPOCH_US, n: int = 2) -> DataFrame:
    """Keys seen in every one of the last n epochs, per epoch."""
    seen = rules.select(F.expr(f"ts_us div {epoch_us}").alias("epoch"), *KEY).distinct()
    before = F.lag("epoch", n - 1).over(W.partitionBy(*KEY).orderBy("epoch"))
    return (
        seen.withColumn("_before", before)
        .filter(F.col("_before") == F.col("epoch") - (n - 1))
        .select("epoch", *KEY)
    )


def epoch_sketches(rules: DataFrame, *by: str, epoch_us: int = EPOCH_US, bits: int = SKETCH_BITS) -> DataFrame:
    """Rules and a sketch of their keys per epoch and `by` (an interface, a run).

    Sketches are stored and merged later (`merged_occupancy`), however the rules
    were split up.
    """
    return rules.groupBy(F.expr(f"ts_us div {epoch_us}").alias("epoch"), *by).agg(
        F.count("*").alias("n_rules"), F.hll_sketch_agg(sketch_key(), bits).alias("keys")
    )


def merged_occupancy(sketches: DataFrame, *by: str) -> DataFrame:
    """Rules and estimated distinct keys per epoch and `by`, over all else that `epoch_sketches` told apart."""
    return sketches.groupBy("epoch", *by).agg(
        F.sum("n_rules").alias("n_rules"),
        F.hll_sketch_estimate(F.hll_union_agg("keys")).alias("approx_keys"),
    )


def epoch_occupancy(rules: DataFrame, epoch_us: int = EPOCH_US) -> DataFrame:
    """Rules per epoch: all, distinct keys, and their number as a sketch estimates it."""
    per_key = rules.groupBy(F.expr(f"ts_us div {epoch_us}").alias("epoch"), *KEY).agg(
        F.count("*").alias("_n")
    )
    return per_key.groupBy("epoch").agg(
        F.sum("_n").alias("n_rules"),
        F.count("*").alias("n_keys"),
        F.hll_sketch_estimate(F.hll_sketch_agg(sketch_key(), SKETCH_BITS)).alias("approx_keys"),
    )
