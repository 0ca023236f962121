"""The batch operators on streams of packets and rules.

Inputs carry `ts` (see `with_event_time`); outputs are append-only. State grows with
the open flows: start the streams within `ordered.rocksdb_state`.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import flow_key, flow_side
from ..operators.flows import packet_addresses
from ..operators.rules import KEY, SKETCH_BITS, sketch_key
from ..schema import (
    CLOCK_ORIGIN_US,
    COOLDOWN_US,
    EPOCH_US,
    LINGER_US,
    REPLY_TIMEOUT_US,
    RULE_TTL_US,
)
from .ordered import CooldownFold, FlowFold, SessionFold, fold_stream


def track_flows_stream(
    p: DataFrame,
    watermark: str = "1 second",
    reply_timeout_us: int = REPLY_TIMEOUT_US,
    linger_us: int = LINGER_US,
) -> DataFrame:
    """Replied flows when the reply is certain, unanswered ones once the
    watermark is a reply timeout past their first packet."""
    keyed = p.select("ts", *flow_key(), "ts_us", "pkt_id", flow_side().alias("side"))
    schema = (
        "proto int, ep_lo bigint, ep_hi bigint, status string, side int, t0 bigint,"
        " first_pkt_id bigint, reply_ts bigint"
    )
    flows = fold_stream(keyed, FlowFold((reply_timeout_us, linger_us)), schema, watermark)
    return flows.select("status", "proto", *packet_addresses(), "t0", "first_pkt_id", "reply_ts")


def cooldown_stream(
    rules: DataFrame, watermark: str = "1 second", cooldown_us: int = COOLDOWN_US
) -> DataFrame:
    keyed = rules.select(
        "ts", *KEY, "ts_us", F.lit(0).cast("bigint").alias("pkt_id"), F.lit(0).alias("side")
    )
    schema = "ip bigint, port int, proto int, ts_us bigint"
    return fold_stream(keyed, CooldownFold((cooldown_us,)), schema, watermark).select("ts_us", *KEY)


def rule_sessions_stream(
    activity: DataFrame, watermark: str = "1 second", ttl_us: int = RULE_TTL_US
) -> DataFrame:
    """Lifetimes of rules from one stream of rules and hits (`is_rule`).

    As in the batch, lifetimes without a rule are left out and hits count from
    the first rule on; earlier ones only prolong.
    """
    hit = (~F.col("is_rule")).cast("int")  # of equal times the rule comes first
    keyed = activity.select("ts", *KEY, "ts_us", hit.cast("bigint").alias("pkt_id"), hit.alias("side"))
    schema = "ip bigint, port int, proto int, start_us bigint, end_us bigint, n_hits bigint"
    return fold_stream(keyed, SessionFold((ttl_us,)), schema, watermark)


def epoch_windows_stream(
    rules: DataFrame, watermark: str = "1 second", epoch_us: int = EPOCH_US
) -> DataFrame:
    window = F.window("ts", f"{epoch_us} microseconds")
    start = F.unix_micros(F.col("window.start")) - CLOCK_ORIGIN_US
    return (
        rules.withWatermark("ts", watermark)
        .groupBy(window)
        .agg(
            F.count("*").alias("n_rules"),
            F.hll_sketch_estimate(F.hll_sketch_agg(sketch_key(), SKETCH_BITS)).alias("approx_keys"),
        )
        .select((start / epoch_us).cast("bigint").alias("epoch"), "n_rules", "approx_keys")
    )
