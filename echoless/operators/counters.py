"""Counters, rates, gauges and the per-second reports built on them.

Everything is summed per sample first; running totals then work on one row per
sample, not on packets. What several counters are derived from, flows, rules or
samples, is worked out once and stored.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import proto_name
from ..plans.storage import stored
from ..schema import (
    ACTIVE_HOST_US,
    EPOCH_US,
    SAMPLE_US,
    TABLE_CAPACITY,
    TRACKED_PROTOS,
)
from .flows import flow_starts, track_flows
from .nets import nets_of, with_membership
from .rules import cooldown_dedup, epoch_occupancy, hot_rules, install_requests, services_of


#: Samples of a block: one task expands or puts in order as many.
BLOCK = 4096
_ENDS = ("src_ip", "dst_ip", "src_port", "dst_port")


def _flag_tracked(p: DataFrame, subnets: DataFrame) -> DataFrame:
    flagged = with_membership(p, nets_of(subnets, "responder"), _src="src_ip", _dst="dst_ip")
    tracked = ~F.col("_src") & ~F.col("_dst") & F.col("proto").isin(*TRACKED_PROTOS)
    if "frag_offset" in p.columns:
        tracked = tracked & (F.col("frag_offset").bitwiseAND(0x1FFF) == 0)
    return flagged.withColumn("_tracked", tracked).drop("_src", "_dst")


def packet_counts(p: DataFrame, subnets: DataFrame) -> DataFrame:
    """All captured packets, and the tracked ones by protocol."""
    by_proto = [
        F.count_if(F.col("_tracked") & (F.col("proto") == number)).alias(f"{name}_count")
        for name, number in (("tcp", 6), ("udp", 17), ("icmp", 1))
    ]
    return _flag_tracked(p, subnets).agg(F.count("*").alias("pkt_count"), *by_proto)


def unanswered_counts(p: DataFrame, **limits) -> DataFrame:
    """Unanswered packets in total and by protocol."""
    return (
        flow_starts(p, **limits)
        .filter(F.col("status") == "unanswered")
        .select(proto_name("proto").alias("proto"))
        .rollup("proto")
        .agg(F.count("*").alias("n"))
        .select(F.coalesce("proto", F.lit("total")).alias("proto"), "n")
    )


def _sample(column: str, width: int):
    return F.expr(f"{column} div {width}")


def _grid(ends: DataFrame) -> DataFrame:
    """Every `sample` from column a to column b of one row.

    The row becomes a row per block of samples, and tasks expand their blocks,
    so one stray time makes more blocks but no long array and no long task.
    """
    blocks = ends.select(
        "a", "b", F.explode(F.sequence(F.expr(f"a div {BLOCK}"), F.expr(f"b div {BLOCK}"))).alias("_k")
    ).repartition("_k")
    first, last = F.greatest("a", F.col("_k") * BLOCK), F.least("b", (F.col("_k") + 1) * BLOCK - 1)
    return blocks.select(F.explode(F.sequence(first, last)).alias("sample"))


def _all_samples(p: DataFrame, sample_us: int) -> DataFrame:
    first, last = F.min("ts_us"), F.max("ts_us")
    ends = p.agg(first.alias("a"), last.alias("b")).filter("a is not null")
    return _grid(ends.select(_sample("a", sample_us).alias("a"), _sample("b", sample_us).alias("b")))


def _with_totals(df: DataFrame, totals: dict[str, str], by: str = "sample") -> DataFrame:
    """Add running totals of columns (new name -> column; NULL counts as 0) in the order of `by`.

    Blocks are summed first; only their sums are put in one order, and each
    block's rows among themselves.
    """
    block = F.expr(f"{by} div {BLOCK}").alias("_k")
    zeroed = {name: F.coalesce(column, F.lit(0)) for name, column in totals.items()}
    sums = df.groupBy(block).agg(*[F.sum(c).alias(f"_{n}") for n, c in zeroed.items()])
    before = W.orderBy("_k").rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select("_k", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in totals])
    inside = W.partitionBy("_k").orderBy(by).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = df.select("*", block).join(carried, "_k")
    return rows.withColumns({n: F.sum(c).over(inside) + F.col(f"_{n}") for n, c in zeroed.items()}).drop(
        "_k", *[f"_{n}" for n in totals]
    )


def _transitions(p: DataFrame, flows: DataFrame) -> DataFrame:
    """Every change of a flow's state up to the last packet, as +1/-1 rows."""
    clock = p.agg(F.max("ts_us")).scalar()

    def step(at, buffered, flow, lingering, happens):
        return F.struct(
            at.alias("at"), F.lit(buffered).alias("buffered"), F.lit(flow).alias("flows"),
            F.lit(lingering).alias("lingering"), happens.alias("happens"),
        )

    replied, expired = F.col("status") == "replied", F.col("status") == "unanswered"
    steps = F.array(
        step(F.col("t0"), 1, 1, 0, F.lit(True)),
        step(F.col("reply_ts"), -1, 0, 1, replied),
        step(F.col("end_ts"), -1, -1, 0, expired),
        step(F.col("end_ts"), 0, -1, -1, replied & (F.col("end_ts") <= clock)),
    )
    return flows.select(F.explode(steps).alias("s")).filter("s.happens").select("s.*").drop("happens")


def state_gauges(p: DataFrame, sample_us: int = SAMPLE_US, **limits) -> DataFrame:
    """Buffered packets, live and lingering flows at the end of each sample."""
    gauges = ("buffered", "flows", "lingering")
    changes = (
        _transitions(p, track_flows(p, **limits))
        .groupBy(_sample("at", sample_us).alias("sample"))
        .agg(*[F.sum(g).alias(g) for g in gauges])
    )
    rows = stored(_all_samples(p, sample_us).join(changes, "sample", "left"))
    return _with_totals(rows, {g: g for g in gauges}).select(
        ((F.col("sample") + 1) * sample_us).alias("ts_us"), *gauges
    )


def stats_snapshots(
    p: DataFrame, subnets: DataFrame, sample_us: int = SAMPLE_US, **limits
) -> DataFrame:
    """Counter snapshot at the end of each sample; the last one closes the run.

    Lookups are counted per sample, everything else since the start.
    """
    flagged = _flag_tracked(p, subnets)
    tracked = flagged.filter("_tracked").drop("_tracked")
    flows = track_flows(tracked, **limits)
    flows = stored(flows.select("status", "proto", *_ENDS, "t0", "reply_ts", "end_ts"))
    packets = flagged.groupBy(_sample("ts_us", sample_us).alias("sample")).agg(
        F.count("*").alias("pkts"), F.count_if("_tracked").alias("lookups")
    )
    changes = (
        _transitions(tracked, flows)
        .groupBy(_sample("at", sample_us).alias("sample"))
        .agg(
            F.sum("buffered").alias("buffered"),
            F.sum("flows").alias("flows"),
            F.sum("lingering").alias("lingering"),
            F.count_if((F.col("buffered") == 1)).alias("created"),
            F.count_if(F.col("lingering") == 1).alias("replies"),
            F.count_if((F.col("buffered") == -1) & (F.col("flows") == -1)).alias("expired"),
        )
    )
    queued = (
        cooldown_dedup(services_of(flows.filter(F.col("status") == "replied"), subnets))
        .groupBy(_sample("ts_us", sample_us).alias("sample"))
        .agg(F.count("*").alias("queued"))
    )
    totals = {
        "pkt_count": "pkts",
        "pkt_buf_count": "buffered",
        "flow_hash_count": "flows",
        "lazy_flow_hash_count": "lingering",
        "controller_rule_install_count": "queued",
        "expired_pkt_count_tot": "expired",
        "bloom_rule_sending_count_tot": "replies",
    }
    rows = stored(
        _all_samples(p, sample_us)
        .join(packets, "sample", "left")
        .join(changes, "sample", "left")
        .join(queued, "sample", "left")
    )
    return _with_totals(rows, totals).select(
        ((F.col("sample") + 1) * sample_us).alias("ts_us"),
        *totals,
        F.coalesce("lookups", F.lit(0)).alias("flow_hash_total_lookups"),
        F.coalesce("created", F.lit(0)).alias("flow_hash_missed_lookups"),
    )


def interface_samples(p: DataFrame, sample_us: int = SAMPLE_US) -> DataFrame:
    """Packet totals per interface at the end of each sample that saw packets."""
    counts = p.groupBy("iface", _sample("ts_us", sample_us).alias("_s")).agg(
        F.count("*").alias("_n")
    )
    running = W.partitionBy("iface").orderBy("_s").rowsBetween(W.unboundedPreceding, W.currentRow)
    return counts.select(
        "iface",
        ((F.col("_s") + 1) * sample_us).alias("ts_us"),
        F.sum("_n").over(running).alias("pkt"),
    )


def packet_rates(samples: DataFrame, column: str = "pkt", by: str = "iface") -> DataFrame:
    """Packets per second between samples; 0 for the first and for resets."""
    w = W.partitionBy(by).orderBy("ts_us")
    dt = (F.col("ts_us") - F.lag("ts_us").over(w)) / 1e6
    grown = F.col(column) - F.lag(column).over(w)
    rate = F.when((dt >= 1e-3) & (grown >= 0), F.floor(grown / dt + 0.5)).otherwise(0)
    return samples.withColumn(f"{column}_pps", rate.cast("bigint"))


def counter_deltas(samples: DataFrame, columns: list[str], by: str = "iface") -> DataFrame:
    """Difference of each counter to the sample before; the first counts from 0."""
    w = W.partitionBy(by).orderBy("ts_us")
    return samples.select(
        "*",
        *[
            (F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))).alias(f"{c}_s") for c in columns
        ],
    )


def receive_backlog(samples: DataFrame, by: str = "iface") -> DataFrame:
    """Received, dropped and not yet processed packets per sample.

    The capture library and the socket may disagree; the larger total counts.
    """
    running = W.partitionBy(by).orderBy("ts_us").rowsBetween(W.unboundedPreceding, W.currentRow)
    received = F.greatest("capture_rx", F.sum("sock_rx_delta").over(running))
    dropped = F.greatest("capture_drop", F.sum("sock_drop_delta").over(running))
    return (
        samples.withColumn("received", received)
        .withColumn("dropped", dropped)
        .select(by, "ts_us", "received", "dropped", (F.col("received") - F.col("pkt")).alias("backlog"))
    )


def _span_changes(spans: DataFrame, start: str, end: str) -> DataFrame:
    """+1 where a span starts and -1 where it ends: columns `at`, `d`."""
    ends = F.array(
        F.struct(F.col(start).alias("at"), F.lit(1).alias("d")),
        F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")),
    )
    return spans.select(F.explode(ends).alias("e")).select("e.*")


def table_usage(
    intervals: DataFrame, sample_us: int = SAMPLE_US, capacity: int = TABLE_CAPACITY
) -> DataFrame:
    """Live rules at the end of each sample, from the first rule's to the last one's end."""
    changes = (
        _span_changes(intervals, "start_us", "end_us")
        .groupBy(_sample("at", sample_us).alias("sample"))
        .agg(F.sum("d").alias("_d"))
    )
    ends = changes.agg(F.min("sample").alias("a"), F.max("sample").alias("b")).filter("a is not null")
    rows = _with_totals(_grid(ends).join(changes, "sample", "left"), {"usage": "_d"})
    return rows.select(
        ((F.col("sample") + 1) * sample_us).alias("ts_us"), "usage",
        (F.col("usage") / capacity).alias("share"),
    )


def active_host_counts(
    rules: DataFrame, intervals: DataFrame, active_us: int = ACTIVE_HOST_US
) -> DataFrame:
    """+1/-1 changes of the number of active hosts: columns `at`, `d`.

    Spans of one host that begin in one slot overlap, so they merge to one row
    per slot before the host's slots are put in order.
    """
    slot = min(active_us, 5_000_000)
    spans = rules.select("ip", F.col("ts_us").alias("a"), (F.col("ts_us") + active_us).alias("b"))
    spans = spans.unionByName(
        intervals.select("ip", F.col("start_us").alias("a"), F.col("end_us").alias("b"))
    )
    slots = spans.groupBy("ip", F.expr(f"a div {slot}").alias("_slot")).agg(
        F.min("a").alias("a"), F.max("b").alias("b")
    )
    w = W.partitionBy("ip").orderBy("_slot")
    reach = F.max("b").over(w.rowsBetween(W.unboundedPreceding, -1))
    joined = (
        slots.withColumn("_new", F.coalesce(F.col("a") > reach, F.lit(True)).cast("int"))
        .withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .groupBy("ip", "_run")
        .agg(F.min("a").alias("a"), F.max("b").alias("b"))
    )
    return _span_changes(joined, "a", "b")


def controller_report(
    rules: DataFrame,
    intervals: DataFrame,
    failures: DataFrame,
    ports: DataFrame,
    epoch_us: int = EPOCH_US,
    active_us: int = ACTIVE_HOST_US,
) -> DataFrame:
    """One row per second from the first to the last rule.

    `ports` has the changes that port_counters gives, per second, of the ports
    to report. group0 and group1 are the rules and the distinct keys of the
    epoch before. What no input here tells is not among the columns.
    """
    second = SAMPLE_US
    rules, intervals, failures = stored(rules), stored(intervals), stored(failures)

    def per_second(df, column, name):
        return df.groupBy(_sample(column, second).alias("sec")).agg(F.count("*").alias(name))

    asked = install_requests(rules, intervals, failures)
    traffic = ports.groupBy((_sample("ts_us", second) - 1).alias("sec")).agg(
        F.sum("rx_s").alias("rx_pkts_s"), F.sum("tx_s").alias("tx_pkts_s")
    )

    def changes(df, name):
        return df.groupBy(_sample("at", second).alias("sec")).agg(F.sum("d").alias(name))

    used = changes(_span_changes(intervals, "start_us", "end_us"), "d_usage")
    hosts = changes(active_host_counts(rules, intervals, active_us), "d_hosts")
    per_epoch = epoch_occupancy(rules, epoch_us).select("epoch", "n_rules", "n_keys")
    hot = hot_rules(rules, epoch_us).groupBy("epoch").agg(F.count("*").alias("hot_rules"))
    seconds = _all_samples(rules, second).withColumnRenamed("sample", "sec")
    parts = [
        per_second(rules, "ts_us", "in_s"),
        per_second(asked, "ts_us", "pend_add_s"),
        per_second(intervals, "start_us", "inst_s"),
        per_second(failures, "fail_us", "add_fail_s"),
        traffic,
    ]
    # Changes before the first reported second still count, hence the full join.
    out = seconds.withColumn("_in", F.lit(True))
    out = out.join(used, "sec", "full").join(hosts, "sec", "full")
    for part in parts:
        out = out.join(part, "sec", "left")
    out = stored(out)
    epoch = F.expr(f"sec * {second} div {epoch_us}")
    out = (
        _with_totals(out, {"usage": "d_usage", "active_hosts": "d_hosts"}, "sec")
        .filter("_in")
        .withColumn("_closed", epoch - 1)
        .join(per_epoch.withColumnRenamed("epoch", "_closed"), "_closed", "left")
        .join(hot.withColumnRenamed("epoch", "_closed"), "_closed", "left")
    )
    count = [
        F.coalesce(c, F.lit(0)).alias(c)
        for c in ("in_s", "pend_add_s", "inst_s", "add_fail_s", "hot_rules")
    ]
    return out.select(
        "sec",
        (epoch % 2).cast("int").alias("epoch"),
        F.coalesce("n_rules", F.lit(0)).alias("group0"),
        F.coalesce("n_keys", F.lit(0)).alias("group1"),
        (F.col("sec") * second % epoch_us == 0).cast("int").alias("switched"),
        *count,
        F.col("usage").alias("local"),
        "usage",
        "active_hosts",
        F.coalesce("rx_pkts_s", F.lit(0)).alias("rx_pkts_s"),
        F.coalesce("tx_pkts_s", F.lit(0)).alias("tx_pkts_s"),
    )


def port_counters(samples: DataFrame) -> DataFrame:
    """Receive and transmit totals per port and their change per sample."""
    w = W.partitionBy("port").orderBy("ts_us")
    change = [
        (F.col(c) - F.coalesce(F.lag(c).over(w), F.col(c))).alias(f"{c}_s") for c in ("rx", "tx")
    ]
    return samples.select("port", "ts_us", "rx", "tx", *change)


def port_samples(p: DataFrame, subnets: DataFrame, sample_us: int = SAMPLE_US) -> DataFrame:
    """Running receive (into the internal net) and transmit totals per port."""
    flagged = with_membership(p, nets_of(subnets, "internal"), _dst="dst_ip")
    counts = flagged.groupBy("port", _sample("ts_us", sample_us).alias("_s")).agg(
        F.count_if("_dst").alias("_rx"), F.count_if(~F.col("_dst")).alias("_tx")
    )
    running = W.partitionBy("port").orderBy("_s").rowsBetween(W.unboundedPreceding, W.currentRow)
    return counts.select(
        "port",
        ((F.col("_s") + 1) * sample_us).alias("ts_us"),
        F.sum("_rx").over(running).alias("rx"),
        F.sum("_tx").over(running).alias("tx"),
    )


def throughput_summary(trials: DataFrame) -> DataFrame:
    """Mean install rate per batch size; the best one is the first among equals.

    `pos` is the place of the batch size in the order in which sizes were tried.
    """
    per_size = trials.groupBy("batch_size").agg(
        F.min("pos").alias("pos"),
        F.count("*").alias("rounds"),
        F.avg("throughput").alias("avg_throughput"),
        (F.sum("installed_rules") / F.sum("target_rules")).alias("ok_ratio"),
        F.sum("batch_fail").alias("batch_fail"),
    )
    best = per_size.agg(
        F.max_by("batch_size", F.struct(F.col("avg_throughput"), -F.col("pos")))
    ).scalar()
    return per_size.withColumn("is_best", F.col("batch_size") == best)
