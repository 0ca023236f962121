"""Packets and side inputs that Spark derives from the given tables.

`events` has no addresses, so each event becomes one to four packets by integer
arithmetic: a request, a repeated request, a reply, a further client packet.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mask_of, ip_to_int
from ..schema import SUBNETS

INTERNAL_BASE = 2193620992  # 130.192.0.0
EXTERNAL_BASE = 268435456  # 16.0.0.0

_LEGS = """
explode(filter(array(
  named_struct('leg', 0, 'at', t0, 'has', true),
  named_struct('leg', 1, 'at', t0 + 300000, 'has', event_type = 'error' or v % 4 = 0),
  named_struct('leg', 2, 'at', t0 + v * 200, 'has', event_type <> 'error'),
  named_struct('leg', 3, 'at', t0 + v * 200 + 150000, 'has', event_type = 'purchase')
), x -> x.has)) as x
"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


def packets_of(events: DataFrame) -> DataFrame:
    talk = events.selectExpr(
        "event_id", "user_id", "event_type", "cast(round(value * 100) as bigint) as v"
    ).selectExpr(
        "event_id",
        "event_type",
        "v",
        "event_id * 1000 as t0",
        f"{EXTERNAL_BASE} + user_id % 251 as ext_ip",
        f"{INTERNAL_BASE} + (user_id * 7919) % 1021 as int_ip",
        "case when v % 8 = 7 then 1 when v % 2 = 0 then 6 else 17 end as proto",
        "event_id % 5 = 0 as outbound",
        "cast(1024 + (event_id div 4) % 4 as int) as cport",
        "case when v % 3 = 0 then 80 when v % 3 = 1 then 53 else 443 end as sport",
    )
    legs = talk.selectExpr("*", _LEGS).selectExpr(
        "*", "x.leg <> 2 as asks", "(x.leg <> 2) = outbound as from_inside"
    )
    return legs.selectExpr(
        "event_id * 4 + x.leg as pkt_id",
        "x.at as ts_us",
        "proto",
        "case when from_inside then int_ip else ext_ip end as src_ip",
        "case when from_inside then ext_ip else int_ip end as dst_ip",
        "case when proto = 1 then 0 when asks then cport else sport end as src_port",
        "case when proto = 1 then 0 when asks then sport else cport end as dst_port",
    )


def subnets(spark: SparkSession) -> DataFrame:
    rows = [("internal", "130.192.0.0", "16"), ("responder", "130.192.3.0", "24")]
    text = spark.createDataFrame(rows, "kind string, addr string, bits string")
    return text.select(
        "kind", ip_to_int("addr").alias("net"), mask_of("bits").alias("mask")
    ).to(SUBNETS)


def with_iface(p: DataFrame) -> DataFrame:
    """Both directions of a conversation share one of eight interfaces."""
    number = (10 + (F.col("src_ip") + F.col("dst_ip")) % 8).cast("string")
    return p.withColumn("iface", F.concat(F.lit("enp"), number, F.lit("s0")))


def packets_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets with header fields, fragments, other protocols and odd addresses."""
    return with_iface(packets(spark, sf_dir)).selectExpr(
        "pkt_id",
        "ts_us",
        "iface",
        "case when pkt_id % 53 = 0 then 6 else 4 end as ip_version",
        "case when pkt_id % 29 = 0 then 47 else proto end as proto",
        "case when pkt_id % 101 = 0 then 0 else src_ip end as src_ip",
        "case when pkt_id % 103 = 0 then 4294967295 else dst_ip end as dst_ip",
        "src_port",
        "dst_port",
        "case when pkt_id % 17 = 0 then 185 else 0 end as frag_offset",
        "cast(40 + pkt_id % 1400 as int) as ip_len",
        "cast(64 - pkt_id % 5 as int) as ttl",
        "element_at(array(2, 16, 18, 24), cast(pkt_id % 4 as int) + 1) as tcp_flags",
        "case when src_ip > dst_ip then 8 else 0 end as icmp_type",
        "cast(pkt_id % 3 as int) as icmp_code",
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ethernet frames of packets_ext, cut to 64 bytes.

    Every fifth header is 24 bytes long, every seventh packet is tunnelled, and
    every 59th frame is not IP at all.
    """
    p = packets_ext(spark, sf_dir).selectExpr(
        "*", "pkt_id % 5 = 0 as long_head", "pkt_id % 7 = 0 as tunnel", "pkt_id % 59 = 0 as arp"
    )

    def h(expr, digits):
        return f"lpad(hex(cast({expr} as bigint)), {digits}, '0')"

    def ip_header(head, length, proto, src, dst, frag, ttl):
        return (
            f"concat({head}, '00', {h(length, 4)}, '0000', {h(frag, 4)}, {h(ttl, 2)},"
            f" {h(proto, 2)}, '0000', {h(src, 8)}, {h(dst, 8)})"
        )

    inner = ip_header(
        "case when long_head then concat(hex(ip_version), '6') else concat(hex(ip_version), '5') end",
        "ip_len", "proto", "src_ip", "dst_ip", "frag_offset", "ttl",
    )
    outer = ip_header("'45'", "ip_len + 20", "4", "167772161", "167772162", "0", "9")
    options = "case when long_head then '01010101' else '' end"
    l4 = (
        f"case proto when 1 then concat({h('icmp_type', 2)}, {h('icmp_code', 2)}, repeat('0', 12))"
        f" else concat({h('src_port', 4)}, {h('dst_port', 4)}, repeat('0', 18),"
        f" {h('tcp_flags', 2)}, repeat('0', 12)) end"
    )
    text = (
        "concat(repeat('0', 24), case when arp then '0806' else '0800' end,"
        f" case when tunnel then {outer} else '' end, {inner}, {options}, {l4}, repeat('F', 64))"
    )
    return p.selectExpr("pkt_id", "ts_us", f"substring(unhex({text}), 1, 64) as frame")


def match_rules(spark: SparkSession) -> DataFrame:
    """Overlapping entries; the first two share a priority."""
    rows = [
        (0, INTERNAL_BASE, 4294901760, 0, 0, 10, "source"),
        (1, 0, 0, INTERNAL_BASE, 4294901760, 10, "target"),
        (2, INTERNAL_BASE + 256, 4294967040, 0, 0, 5, "watched"),
    ]
    return spark.createDataFrame(
        rows,
        "pos int, src_val bigint, src_mask bigint, dst_val bigint, dst_mask bigint,"
        " priority int, action string",
    )


def sessions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(64, 12), (65, 13)], "ingress_port int, session int")


def failures(rules: DataFrame) -> DataFrame:
    """About every 13th rule fails to install 50 ms after it was sent."""
    return rules.filter(F.expr("(ts_us div 1000) % 13 = 0")).selectExpr(
        "ts_us + 50000 as fail_us", "ip * 16777216 + port * 256 + proto as key"
    )


def datagrams(batches: DataFrame) -> DataFrame:
    """Encoded batches; some with a foreign header, cut short, empty or truncated."""
    return batches.withColumn("k", F.expr("recv_us div 10000 * 3 + message")).selectExpr(
        "recv_us",
        "message",
        "k % 17 = 0 as truncated",
        "case when k % 7 = 0 then unhex(concat('0000', substring(hex(payload), 5)))"
        " when k % 11 = 0 then substring(payload, 1, octet_length(payload) - 1)"
        " when k % 13 = 0 then unhex('5034010100000000') else payload end as payload",
    )


def receive_samples(samples: DataFrame) -> DataFrame:
    """Capture and socket counters next to the packet totals of a sample."""
    return samples.selectExpr(
        "*",
        "case when substring(iface, 5, 1) in ('0', '4') then 0 else pkt + 2 end as capture_rx",
        "pkt % 50 as sock_rx_delta",
        "pkt div 100 as capture_drop",
        "pkt % 3 as sock_drop_delta",
    )


def stat_lines(rows: DataFrame) -> DataFrame:
    """`iface, ts_us, line` counters -> counter file lines with their path."""
    return rows.selectExpr(
        "concat('run/', iface, '_pid77_HashSize1000000_GCSize10_GCPeriod10_GCTimeout200000.csv')"
        " as path",
        "concat(ts_us div 1000000, '.', lpad(ts_us % 1000000, 6, '0'), ',STATS,main.c,7,', line)"
        " as value",
    )


def status_lines(samples: DataFrame) -> DataFrame:
    """Status lines of samples; two interfaces write the older 14 columns."""
    return samples.selectExpr(
        "iface",
        "ts_us",
        "case when substring(iface, 4, 2) in ('11', '13') then '' else concat(pkt % 777, ' ') end as n",
        "case when (ts_us div 1000000) % 2 = 1 then cast(pkt % 3 as string) else '-' end as oob",
        "pkt",
    ).selectExpr(
        "iface",
        "ts_us",
        "concat(rpad(iface, 10, ' '), lpad(pkt % 1000, 9, ' '), '  ', n, concat_ws('   ', pkt,"
        " pkt % 50, pkt % 90, pkt % 30, pkt % 40, pkt + 3, pkt % 5, 0, 3 - pkt % 7, pkt % 888,"
        " oob, pkt % 7)) as value",
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "concat('enp', 10 + user_id % 8, 's0') as iface",
        "event_id as line_no",
        "case when event_id % 7 = 0 then"
        " concat('WARN pkt buffer overflow: drop packet (count=', event_id, ')')"
        " when event_id % 5 = 0 then ' ' else concat('tick ', event_id) end as value",
    )


def net_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net file lines, two per supplier, in each of the accepted forms."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr(
        "s_suppkey as i", "concat('10.', s_suppkey div 256 % 256, '.', s_suppkey % 256, '.7') as a"
    )
    pairs = rows.selectExpr(
        "i",
        "posexplode(case i % 4 when 0 then array(concat(a, '/24'), '# note')"
        " when 1 then array(concat('  ', a, '/255.255.0.0'), '')"
        " when 2 then array(concat(a, ' # two lines'), '255.255.255.0')"
        " else array('', '0.0.0.0/8') end) as (step, value)",
    )
    return pairs.selectExpr(
        "'internal' as kind", "concat('f', i % 3) as file", "i * 2 + step as line_no", "value"
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.selectExpr(
        "user_id", "event_id", "cast(round(value * 100) as bigint) as v"
    ).selectExpr(
        "64 * cast(pow(2, user_id % 6) as int) as batch_size",
        "cast(user_id % 6 as int) as pos",
        "cast(event_id % 3 as int) as round",
        "50000 as target_rules",
        "50000 - v % 100 as installed_rules",
        "v % 100 as dropped_rules",
        "1.5D as elapsed_sec",
        "cast(v % 4096 as double) as throughput",
        "case when v % 10 = 0 then 1 else 0 end as batch_fail",
    )
