from .address import host_offset, int_to_ip, ip_to_int, mac_bytes, mac_text, mask_of
from .flowkey import (
    elapsed_us,
    endpoint,
    flow_direction,
    flow_key,
    flow_side,
    proto_name,
    rule_key,
    tcp_flag_columns,
    unpack_rule_key,
)
from .text import compact_count, group_digits

__all__ = [
    "compact_count", "elapsed_us", "endpoint", "flow_direction",
    "flow_key", "flow_side", "group_digits", "host_offset",
    "int_to_ip", "ip_to_int", "mac_bytes", "mac_text", "mask_of", "proto_name",
    "rule_key", "tcp_flag_columns", "unpack_rule_key",
]
