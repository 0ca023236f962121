"""Flow keys, directions, rule keys and header flags as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ICMP, TCP, UDP
from .address import _col


def endpoint(ip, port, proto="proto") -> Column:
    """ip*65536+port as one BIGINT; ICMP has no ports."""
    usable = F.when(_col(proto) == ICMP, F.lit(0)).otherwise(_col(port)).cast("bigint")
    return _col(ip) * 65536 + usable


def flow_key() -> list[Column]:
    """Unordered endpoint pair of a packet: proto, ep_lo, ep_hi."""
    src, dst = endpoint("src_ip", "src_port"), endpoint("dst_ip", "dst_port")
    return [
        F.col("proto"),
        F.least(src, dst).alias("ep_lo"),
        F.greatest(src, dst).alias("ep_hi"),
    ]


def flow_side() -> Column:
    """0 when the packet leaves the lower endpoint (or both are equal), else 1."""
    src, dst = endpoint("src_ip", "src_port"), endpoint("dst_ip", "dst_port")
    return F.when(src <= dst, 0).otherwise(1).cast("int")


def flow_direction(src, dst, first_src, first_dst) -> Column:
    """+1 like the first packet, -1 its reverse, 0 neither; +1 wins a tie."""
    src, dst, a, b = map(_col, (src, dst, first_src, first_dst))
    return (
        F.when((src == a) & (dst == b), 1).when((src == b) & (dst == a), -1).otherwise(0)
    ).cast("int")


def rule_key(ip, port, proto) -> Column:
    """ip<<24 | port<<8 | proto; 56 bits fit a signed BIGINT."""
    ip, port, proto = (_col(c).cast("bigint") for c in (ip, port, proto))
    return (
        F.shiftleft(ip.bitwiseAND(0xFFFFFFFF), 24)
        .bitwiseOR(F.shiftleft(port.bitwiseAND(0xFFFF), 8))
        .bitwiseOR(proto.bitwiseAND(0xFF))
    )


def unpack_rule_key(key) -> list[Column]:
    key = _col(key)
    return [
        F.shiftright(key, 24).bitwiseAND(0xFFFFFFFF).alias("ip"),
        F.shiftright(key, 8).bitwiseAND(0xFFFF).cast("int").alias("port"),
        key.bitwiseAND(0xFF).cast("int").alias("proto"),
    ]


def elapsed_us(start, end) -> Column:
    """Microseconds from start to end, never negative."""
    return F.greatest(_col(end) - _col(start), F.lit(0).cast("bigint"))


def proto_name(c) -> Column:
    c = _col(c)
    return F.when(c == ICMP, "icmp").when(c == TCP, "tcp").when(c == UDP, "udp")


# TCP flag bits.
TCP_FLAG_BITS = {
    "fin": 0x01, "syn": 0x02, "rst": 0x04, "psh": 0x08,
    "ack": 0x10, "urg": 0x20, "flag6": 0x40, "flag7": 0x80,
}


def tcp_flag_columns(c="tcp_flags") -> list[Column]:
    return [(_col(c).bitwiseAND(bit) != 0).alias(name) for name, bit in TCP_FLAG_BITS.items()]
