"""Stateless packet filters and projections."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import (
    BROADCAST_ADDRESS,
    ETHERNET_BYTES,
    NULL_ADDRESS,
    SNAP_BYTES,
    TRACKED_PROTOS,
)
from .nets import nets_of, with_membership


def capture_filter(p: DataFrame) -> DataFrame:
    """IPv4 only, and neither end is the null or the broadcast address."""
    useless = [NULL_ADDRESS, BROADCAST_ADDRESS]
    kept = p.filter(~F.col("src_ip").isin(useless) & ~F.col("dst_ip").isin(useless))
    return kept.filter(F.col("ip_version") == 4) if "ip_version" in p.columns else kept


def first_fragment(p: DataFrame) -> DataFrame:
    return p.filter(F.col("frag_offset").bitwiseAND(0x1FFF) == 0)


def l4_filter(p: DataFrame) -> DataFrame:
    return p.filter(F.col("proto").isin(*TRACKED_PROTOS))


def snap_truncate(p: DataFrame, n: int = SNAP_BYTES) -> DataFrame:
    """Kept length of each frame; payload beyond it is cut where frames exist."""
    kept = F.least(F.col("ip_len") + ETHERNET_BYTES, F.lit(n)).cast("int")
    out = p.withColumn("snap_len", kept)
    if "frame" in p.columns:
        out = out.withColumn("frame", F.substring("frame", F.lit(1), F.col("snap_len")))
    return out


def head_packets(p: DataFrame, n: int) -> DataFrame:
    """First n packets in capture order."""
    return p.orderBy("ts_us", "pkt_id").limit(n)


def anonymize_internal(p: DataFrame, subnets: DataFrame, salt: str) -> DataFrame:
    """Internal addresses become salted hashes, external ones stay readable."""
    flagged = with_membership(p, nets_of(subnets, "internal"), _src="src_ip", _dst="dst_ip")

    def hidden(flag, column):
        text = F.col(column).cast("string")
        return F.when(F.col(flag), F.sha2(F.concat(F.lit(salt), text), 256)).otherwise(text)

    return flagged.withColumns(
        {"src_ip": hidden("_src", "src_ip"), "dst_ip": hidden("_dst", "dst_ip")}
    ).drop("_src", "_dst")
