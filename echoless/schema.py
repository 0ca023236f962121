"""Column layouts and fixed protocol values shared by all modules."""

from pyspark.sql import types as T

# IP protocol numbers that flow tracking handles.
ICMP, TCP, UDP = 1, 6, 17
IPIP = 4
TRACKED_PROTOS = (ICMP, TCP, UDP)

# Addresses that never take part in a conversation.
NULL_ADDRESS = 0
BROADCAST_ADDRESS = 4294967295

# Default time limits, in microseconds.
REPLY_TIMEOUT_US = 1_000_000
LINGER_US = 200_000
COOLDOWN_US = 1_000_000
FAILURE_COOLDOWN_US = 200_000
RULE_TTL_US = 5_000_000
ACTIVE_HOST_US = 60_000_000
EPOCH_US = 2_000_000
SAMPLE_US = 1_000_000
FLUSH_US = 10_000

# Sizes.
SNAP_BYTES = 64
ETHERNET_BYTES = 14
RULES_PER_MESSAGE = 4000
TABLE_CAPACITY = 20_000

# Rule message header (big-endian) and record sizes in bytes.
WIRE_MAGIC, WIRE_VERSION, WIRE_OP_INSTALL = 0x5034, 1, 1
WIRE_HEADER_BYTES = WIRE_RULE_BYTES = 8

# 2024-01-01 00:00:00 UTC; packet clocks count microseconds from here.
CLOCK_ORIGIN_US = 1_704_067_200_000_000

PACKETS = T.StructType([
    T.StructField("pkt_id", T.LongType()),
    T.StructField("ts_us", T.LongType()),
    T.StructField("proto", T.IntegerType()),
    T.StructField("src_ip", T.LongType()),
    T.StructField("dst_ip", T.LongType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
])

SUBNETS = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("net", T.LongType()),
    T.StructField("mask", T.LongType()),
])

RULES = T.StructType([
    T.StructField("ts_us", T.LongType()),
    T.StructField("ip", T.LongType()),
    T.StructField("port", T.IntegerType()),
    T.StructField("proto", T.IntegerType()),
])

# Counter names in file order; all are whole numbers but one.
STAT_FIELDS = (
    "pkt_count",
    "pkt_buf_count",
    "flow_hash_count",
    "lazy_flow_hash_count",
    "pkt_list_count_tot",
    "pkt_list_count_use",
    "flow_hash_list_count_tot",
    "flow_hash_list_count_use",
    "installed_entry_count_tot",
    "install_buf_size",
    "controller_rule_install_count",
    "install_rule_batch_count",
    "expired_pkt_count_tot",
    "bloom_rule_sending_count_tot",
    "bloom_rule_sending_error_count",
    "entry_install_error_count",
    "entry_install_dedup_count",
    "flow_hash_total_lookups",
    "flow_hash_collision_lookups",
    "flow_hash_missed_lookups",
    "flow_hash_total_probes",
    "flow_hash_max_depth",
    "flow_hash_avg_probes",
    "flow_hash_p99_depth",
)
STAT_DOUBLES = ("flow_hash_avg_probes",)

# Per-interface status line columns, in order.
STATUS_FIELDS = (
    "iface",
    "pkt_pps",
    "nic_pps",
    "pkt",
    "buf",
    "flow",
    "exp",
    "bloom_rsp",
    "pcap_rx",
    "pcap_drp",
    "pcap_ifdr",
    "pcap_pend",
    "nic_drx",
    "nic_oob_d",
    "ruleq",
)

# Controller report columns, in order.
CONTROLLER_FIELDS = (
    "timestamp",
    "interval_cycle",
    "epoch",
    "group0",
    "group1",
    "switched",
    "in_s",
    "pend_add_s",
    "inst_s",
    "add_fail_s",
    "pending",
    "fail_cd",
    "hot_rules",
    "local",
    "usage",
    "active_hosts",
    "pkts_ok",
    "pkts_bad",
    "pkts_trunc",
    "batch_ok",
    "batch_fail",
    "sock_drop",
    "rx_pkts_s",
    "tx_pkts_s",
    "ring_depth",
    "ring_pushes",
    "ring_pops",
    "ring_dropped",
)

# Install trial file columns, in order.
TRIAL_FILE = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("batch_size", T.IntegerType()),
    T.StructField("round", T.IntegerType()),
    T.StructField("target_rules", T.LongType()),
    T.StructField("installed_rules", T.LongType()),
    T.StructField("dropped_rules", T.LongType()),
    T.StructField("elapsed_sec", T.DoubleType()),
    T.StructField("throughput_rules_per_sec", T.DoubleType()),
    T.StructField("batch_fail_count", T.IntegerType()),
])
