"""Flow tracking: which packets start a flow, answer it, or go unanswered."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import flow_key, flow_side
from ..schema import LINGER_US, REPLY_TIMEOUT_US
from .spans import CHUNK_US, ROLE_NAMES, latest, placed_fold

_KEY = ["proto", "ep_lo", "ep_hi"]


def _keyed(p: DataFrame, by) -> DataFrame:
    """The fewest columns that still hold a whole packet; the rest is derivable.

    Lower endpoint and protocol share one number, so that sorting mostly
    compares one machine word.
    """
    keyed = p.select(*by, *flow_key(), flow_side().alias("side"), "ts_us", "pkt_id")
    low = (F.shiftleft("ep_lo", 8).bitwiseOR(F.col("proto"))).alias("_low")
    return keyed.select(*by, low, "ep_hi", "side", "ts_us", "pkt_id")


def _fold(p, reply_timeout_us, linger_us, by, starts_only, chunk_us) -> tuple[DataFrame, DataFrame]:
    folded, placed = placed_fold(
        _keyed(p, by), [*by, "_low", "ep_hi"], "ts_us", "pkt_id", "side",
        reply_timeout_us, linger_us, starts_only, chunk_us,
    )
    named = folded.withColumns(
        {
            "proto": F.col("_low").bitwiseAND(255).cast("int"),
            "ep_lo": F.shiftright("_low", 8),
        }
    )
    return named, placed


def packet_addresses() -> list:
    """Source and destination of a packet, back from its key and side."""
    src = F.when(F.col("side") == 0, F.col("ep_lo")).otherwise(F.col("ep_hi"))
    dst = F.when(F.col("side") == 0, F.col("ep_hi")).otherwise(F.col("ep_lo"))
    return [
        F.shiftright(src, 16).alias("src_ip"),
        F.shiftright(dst, 16).alias("dst_ip"),
        src.bitwiseAND(65535).cast("int").alias("src_port"),
        dst.bitwiseAND(65535).cast("int").alias("dst_port"),
    ]


def _status(placed: DataFrame, reply_ts, t0, timeout_us) -> Column:
    """Flow status. The clock is global: any tracked packet lets time pass."""
    now = latest(placed)
    return (
        F.when(reply_ts.isNotNull(), "replied")
        .when(now - t0 >= timeout_us, "unanswered")
        .otherwise("open")
    )


def track_flows(
    p: DataFrame,
    reply_timeout_us: int = REPLY_TIMEOUT_US,
    linger_us: int = LINGER_US,
    by=(),
    chunk_us: int = CHUNK_US,
) -> DataFrame:
    """One row per flow instance. `end_ts` is when the flow is forgotten."""
    role = F.col("role")
    folded, placed = _fold(p, reply_timeout_us, linger_us, by, False, chunk_us)
    flows = (
        folded.groupBy(*by, *_KEY, F.col("flow_t0").alias("t0"), F.col("flow_id").alias("first_pkt_id"))
        .agg(
            F.max(F.when(role == 0, F.col("side"))).alias("side"),
            F.max("reply_ts").alias("reply_ts"),
            F.max("ts_us").alias("last_ts"),
            F.count_if(role == 1).alias("n_dup"),
            F.count_if(role == 3).alias("n_linger"),
        )
    )
    status = _status(placed, F.col("reply_ts"), F.col("t0"), reply_timeout_us)
    ends = (
        F.when(F.col("status") == "replied", F.col("last_ts") + linger_us)
        .when(F.col("status") == "unanswered", F.col("t0") + reply_timeout_us)
    )
    return flows.withColumn("status", status).select(
        *by, *_KEY, *packet_addresses(), "t0", "first_pkt_id", "status", "reply_ts",
        ends.alias("end_ts"), "n_dup", "n_linger",
    )


def packet_events(
    p: DataFrame,
    reply_timeout_us: int = REPLY_TIMEOUT_US,
    linger_us: int = LINGER_US,
    by=(),
    chunk_us: int = CHUNK_US,
) -> DataFrame:
    """What each packet did: created, dup_request, replied or linger."""
    names = F.array(*[F.lit(name) for name in ROLE_NAMES])
    return _fold(p, reply_timeout_us, linger_us, by, False, chunk_us)[0].select(
        *by, "pkt_id", "ts_us", "proto", "ep_lo", "ep_hi",
        F.get(names, F.col("role")).alias("event"),
        F.col("flow_t0").alias("t0"), F.col("flow_id").alias("first_pkt_id"),
    )


def flow_starts(
    p: DataFrame,
    reply_timeout_us: int = REPLY_TIMEOUT_US,
    linger_us: int = LINGER_US,
    by=(),
    chunk_us: int = CHUNK_US,
) -> DataFrame:
    """First packet of each flow with the flow's status and reply time.

    Leaves out the per-flow packet counts and so the shuffle by flow that
    `track_flows` needs.
    """
    starts, placed = _fold(p, reply_timeout_us, linger_us, by, True, chunk_us)
    return starts.select(
        *by, "pkt_id", "ts_us", "proto", *packet_addresses(),
        _status(placed, F.col("reply_ts"), F.col("ts_us"), reply_timeout_us).alias("status"),
        "reply_ts",
    )


def unanswered(p: DataFrame, **limits) -> DataFrame:
    """First packet of every flow that got no reply in time."""
    return (
        flow_starts(p, **limits).filter(F.col("status") == "unanswered").drop("status", "reply_ts")
    )


def match_replies(p: DataFrame, **limits) -> DataFrame:
    """Each answered request with its reply time and delay."""
    return (
        flow_starts(p, **limits)
        .filter(F.col("status") == "replied")
        .withColumn("delay_us", F.col("reply_ts") - F.col("ts_us"))
        .drop("status")
    )
