"""Every operator as a query over the given tables, with SQL to compare with."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as X
from ..operators import counters, filters, flows, hosts, nets, rules, sessions, status, wire
from ..schema import CONTROLLER_FIELDS, STAT_DOUBLES, STAT_FIELDS
from ..sources import frames, packets, sinks, statfiles
from ..sources import nets as net_files
from ..streaming import jobs
from ..streaming.ordered import LateRows, rocksdb_state
from . import fixtures as fx
from . import reports
from .oracle import build
from .storage import run_in_steps, shared_dir, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None, tracked: str = "all"):
    def register(fn):
        name = fn.__name__.rstrip("_")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = build(sql, tracked)
        return fn

    return register


def _rules(spark, d) -> DataFrame:
    return rules.replied_services(fx.packets(spark, d), fx.subnets(spark))


def _hits(spark, d) -> DataFrame:
    return rules.service_hits(fx.packets(spark, d), fx.subnets(spark))


def _intervals(spark, d) -> DataFrame:
    return rules.rule_intervals(_rules(spark, d), _hits(spark, d))


def _samples(spark, d) -> DataFrame:
    return counters.interface_samples(fx.with_iface(fx.packets(spark, d)))


def _now(spark, d):
    return fx.packets(spark, d).agg(F.max("ts_us")).scalar()


_INTERNAL_HOST = "between 2193620992 and 2193686527"
_NOW = "(select max(ts_us) from packets)"


# Sources and sinks


@_query("select iface, pkt_id, ts_us, proto, src_ip, dst_ip, src_port, dst_port from keyed")
def read_packets(spark, d):
    root = shared_dir(spark)
    fx.with_iface(fx.packets(spark, d)).write.partitionBy("iface").parquet(root)
    names = [row.iface for row in spark.read.parquet(root).select("iface").distinct().collect()]
    return packets.read_packets(spark, {name: f"{root}/iface={name}" for name in names})


@_query("""
select pkt_id, ts_us, ip_version, proto, src_ip, dst_ip,
  case when frag_offset = 0 and proto in (6, 17) then src_port else 0 end as src_port,
  case when frag_offset = 0 and proto in (6, 17) then dst_port else 0 end as dst_port,
  frag_offset, ip_len, ttl,
  case when frag_offset = 0 and proto = 6 and l4 + 14 <= 64 then tcp_flags end as tcp_flags,
  case when frag_offset = 0 and proto = 1 then icmp_type end as icmp_type,
  case when frag_offset = 0 and proto = 1 then icmp_code end as icmp_code,
  ip_len - head as payload_len
from (select *, case when pkt_id % 5 = 0 then 24 else 20 end as head,
  14 + case when pkt_id % 7 = 0 then 20 else 0 end + case when pkt_id % 5 = 0 then 24 else 20 end as l4
  from ext) where pkt_id % 59 <> 0 and ip_version = 4""")
def decode_frames(spark, d):
    return frames.decode_frames(fx.frames(spark, d))


@_query("""
select pkt_id, src_ip, dst_ip from ext where pkt_id % 59 <> 0 and ip_version = 4 and pkt_id % 7 = 0""")
def unwrap_ipip(spark, d):
    tunnelled = fx.frames(spark, d).filter("pkt_id % 7 = 0")
    return frames.decode_frames(tunnelled).select("pkt_id", "src_ip", "dst_ip")


@_query("""
select 'internal' as kind, cast(net as bigint) as net, cast(mask as bigint) as mask from (
select case i % 4 when 1 then 167772160 + (i // 256 % 256) * 65536
  when 3 then 0 else 167772160 + (i // 256 % 256) * 65536 + (i % 256) * 256 end as net,
  case i % 4 when 1 then 4294901760 when 3 then 0 else 4294967040 end as mask
from (select s_suppkey as i from supplier))""")
def read_subnets(spark, d):
    return net_files.parse_subnets(fx.net_lines(spark, d))[0]


def _snapshots(spark, d) -> DataFrame:
    made = counters.stats_snapshots(fx.packets(spark, d), fx.subnets(spark))
    return made.withColumn("iface", F.lit("enp10s0"))


_GRID = """(select unnest(range((select min(ts_us) // 1000000 from packets),
  (select max(ts_us) // 1000000 from packets) + 1)) as s)"""
_CLOCK = "(select max(ts_us) from ordered)"
_SNAPSHOT_SQL = f"""
select (g.s + 1) * 1000000 as ts_us,
  (select count(*) from keyed where ts_us // 1000000 <= g.s) as pkt_count,
  (select count(*) from flows where t0 // 1000000 <= g.s)
  - (select count(*) from flows where status = 'replied' and reply_ts // 1000000 <= g.s)
  - (select count(*) from flows where status = 'unanswered' and end_ts // 1000000 <= g.s) as pkt_buf_count,
  (select count(*) from flows where t0 // 1000000 <= g.s)
  - (select count(*) from flows where end_ts <= {_CLOCK} and end_ts // 1000000 <= g.s) as flow_hash_count,
  (select count(*) from flows where status = 'replied' and reply_ts // 1000000 <= g.s)
  - (select count(*) from flows where status = 'replied' and end_ts <= {_CLOCK} and end_ts // 1000000 <= g.s)
  as lazy_flow_hash_count,
  (select count(*) from kept where ts_us // 1000000 <= g.s) as controller_rule_install_count,
  (select count(*) from flows where status = 'unanswered' and end_ts // 1000000 <= g.s) as expired_pkt_count_tot,
  (select count(*) from flows where status = 'replied' and reply_ts // 1000000 <= g.s) as bloom_rule_sending_count_tot,
  (select count(*) from ordered where ts_us // 1000000 = g.s) as flow_hash_total_lookups,
  (select count(*) from flows where t0 // 1000000 = g.s) as flow_hash_missed_lookups
from {_GRID} g"""
_SNAPSHOT_FIELDS = (
    "pkt_count", "pkt_buf_count", "flow_hash_count", "lazy_flow_hash_count", "controller_rule_install_count",
    "expired_pkt_count_tot", "bloom_rule_sending_count_tot", "flow_hash_total_lookups", "flow_hash_missed_lookups",
)
_STAT_CELLS = [f"cast({n} as varchar)" if n in _SNAPSHOT_FIELDS else "''" for n in STAT_FIELDS]
_STAT_COLUMNS = ", ".join(
    n if n in _SNAPSHOT_FIELDS else f"cast(null as {'double' if n in STAT_DOUBLES else 'bigint'}) as {n}" for n in STAT_FIELDS
)


@_query(f"""
select 'enp10s0' as iface, 77 as pid, 1000000 as hash_size, 10 as gc_size, 10 as gc_period, 200000 as gc_timeout,
  ts_us, 'STATS' as level, {_STAT_COLUMNS} from ({_SNAPSHOT_SQL})""", tracked="no_bypass")
def read_stats_csv(spark, d):
    root = shared_dir(spark)
    lines = fx.stat_lines(statfiles.format_stats(_snapshots(spark, d), "csv"))
    name = "enp10s0_pid77_HashSize1000000_GCSize10_GCPeriod10_GCTimeout200000.csv"
    lines.select("value").write.text(f"{root}/{name}")
    return statfiles.read_stats_csv(spark, root)


@_query(f"""
select 'enp10s0' as iface, ts_us, concat_ws(',', {", ".join(_STAT_CELLS)}) as line from ({_SNAPSHOT_SQL})""",
        tracked="no_bypass")
def format_stats(spark, d):
    return statfiles.format_stats(_snapshots(spark, d), "csv")


@_query(f"""
select 'enp10s0' as iface, ts_us, pos, line from (select ts_us, unnest(range(24)) as pos,
  unnest([{", ".join(f"'{n}=' || {c}" for n, c in zip(STAT_FIELDS, _STAT_CELLS))}]) as line from ({_SNAPSHOT_SQL}))""",
        tracked="no_bypass")
def format_stats_kv(spark, d):
    return statfiles.format_stats(_snapshots(spark, d), "kv")


_STATUS_COLUMNS = """pkt_pps, nic_pps, pkt, buf, flow, exp, bloom_rsp, pcap_rx, pcap_drp, pcap_ifdr,
  pcap_pend, nic_drx, nic_oob_d, ruleq"""


@_query(f"select iface, ts_us, {_STATUS_COLUMNS} from status_rows")
def read_status(spark, d):
    return status.parse_status(fx.status_lines(_samples(spark, d)))


@_query("select iface, app_drop, last_line from drop_log")
def read_drop_log(spark, d):
    return status.parse_drop_log(fx.log_lines(spark, d))


@_query("""
select batch_size, round, target_rules, installed_rules, dropped_rules, elapsed_sec, throughput, batch_fail
from trials""")
def read_trials(spark, d):
    lines = fx.trials(spark, d).selectExpr(
        "concat_ws(',', '2024-01-01 00:00:00', batch_size, round, target_rules, installed_rules,"
        " dropped_rules, format_string('%.6f', elapsed_sec), format_string('%.2f', throughput),"
        " batch_fail) as value"
    )
    return statfiles.parse_trials(lines)


@_query("""
select recv_us, port, ip, proto from (
  select recv_us, message, k, verdict, truncated, cnt from datagrams) g
join (select (flush + 1) * 10000 as recv_us, place // 3 as message, ip, port, proto from wire_rules)
using (recv_us, message)
where verdict = 'ok' and not truncated and cnt > 0""")
def decode_rule_batches(spark, d):
    messages = fx.datagrams(wire.encode_rule_batches(_rules(spark, d), max_rules=3))
    return wire.decode_rule_batches(messages)[0].withColumnRenamed("ts_us", "recv_us")


@_query("select recv_us, message, truncated, verdict, case when verdict = 'ok' then cnt end as rule_count from datagrams")
def message_verdicts(spark, d):
    messages = fx.datagrams(wire.encode_rule_batches(_rules(spark, d), max_rules=3))
    return wire.decode_rule_batches(messages)[1].drop("payload")


@_query("select recv_us, message, n_rules, upper(hex) as payload from wire_batches")
def encode_rule_batches(spark, d):
    batches = wire.encode_rule_batches(_rules(spark, d), max_rules=3)
    return batches.withColumn("payload", F.hex("payload"))


@_query("""
select *, cast(make_timestamp(1704067200000000 + ts_us) as date) as day from (select * from unanswered
  union all select pkt_id, ts_us, proto, src_ip, dst_ip, src_port, dst_port from keyed where bypass)""", tracked="no_bypass")
def write_unanswered(spark, d):
    path = shared_dir(spark)
    bypass, tracked = nets.split_bypass(fx.packets(spark, d), fx.subnets(spark))
    kept = flows.unanswered(tracked).unionByName(bypass)
    for _ in range(2):  # a second run replaces the first
        sinks.write_unanswered(kept, path)
    return spark.read.parquet(path)


@_query("select ts_us, ip, port, proto from kept")
def write_rules(spark, d):
    path = shared_dir(spark)
    kept = rules.cooldown_dedup(_rules(spark, d))
    for _ in range(2):  # the second run replaces the first
        sinks.write_rules(kept, path, run="first")
    return spark.read.parquet(path).drop("run")


# Projections and filters


@_query("""
select pkt_id, ts_us, proto, src_ip, dst_ip from ext
where ip_version = 4 and src_ip not in (0, 4294967295) and dst_ip not in (0, 4294967295)""")
def capture_filter(spark, d):
    kept = filters.capture_filter(fx.packets_ext(spark, d))
    return kept.select("pkt_id", "ts_us", "proto", "src_ip", "dst_ip")


@_query("select pkt_id, frag_offset from ext where frag_offset = 0")
def first_fragment(spark, d):
    return filters.first_fragment(fx.packets_ext(spark, d)).select("pkt_id", "frag_offset")


@_query("select pkt_id, proto from ext where proto in (1, 6, 17)")
def l4_filter(spark, d):
    return filters.l4_filter(fx.packets_ext(spark, d)).select("pkt_id", "proto")


@_query("select pkt_id, case when bypass then 'bypass' else 'tracked' end as path from keyed")
def split_bypass(spark, d):
    bypass, tracked = nets.split_bypass(fx.packets(spark, d), fx.subnets(spark))
    return bypass.select("pkt_id", F.lit("bypass").alias("path")).unionByName(
        tracked.select("pkt_id", F.lit("tracked").alias("path"))
    )


@_query("""
select pkt_id, case when src_in then src_ip else dst_ip end as internal_ip,
  case when src_in then src_port else dst_port end as internal_port from keyed where src_in or dst_in""")
def assign_internal(spark, d):
    out = nets.assign_internal(fx.packets(spark, d), fx.subnets(spark))
    return out.select("pkt_id", "internal_ip", "internal_port")


@_query("""
select pkt_id, case when src_in then 'in' else 'out' end || '->' || case when dst_in then 'in' else 'out' end
  as direction from keyed""")
def ip_direction(spark, d):
    out = nets.ip_direction(fx.packets(spark, d), fx.subnets(spark))
    return out.select("pkt_id", "direction")


@_query("select pkt_id, ip_len, least(ip_len + 14, 64) as snap_len from ext")
def snap_truncate(spark, d):
    out = filters.snap_truncate(fx.packets_ext(spark, d))
    return out.select("pkt_id", "ip_len", "snap_len")


@_query("select pkt_id, ts_us from packets order by ts_us, pkt_id limit 500")
def head_packets(spark, d):
    return filters.head_packets(fx.packets(spark, d), 500).select("pkt_id", "ts_us")


@_query(f"""
select pkt_id, case when src_in then sha256('pepper' || src_ip) else cast(src_ip as varchar) end as src_ip,
  case when dst_in then sha256('pepper' || dst_ip) else cast(dst_ip as varchar) end as dst_ip from keyed""")
def anonymize_internal(spark, d):
    out = filters.anonymize_internal(fx.packets(spark, d), fx.subnets(spark), "pepper")
    return out.select("pkt_id", "src_ip", "dst_ip")


# Joins


@_query("select pkt_id, src_ip, src_in as member from keyed")
def subnet_member(spark, d):
    out = nets.subnet_member(fx.packets(spark, d), "src_ip", fx.subnets(spark))
    return out.select("pkt_id", "src_ip", "member")


@_query("""
select pkt_id, case when src_ip between 2193621248 and 2193621503 then 'watched'
  when src_in then 'source' when dst_in then 'target' else 'none' end as action from keyed""")
def ternary_match(spark, d):
    out = nets.ternary_match(fx.packets(spark, d), fx.match_rules(spark), "none")
    return out.select("pkt_id", "action")


_SUPPRESSED = """exists (select 1 from intervals i where i.ip = h.ip and i.port = h.port
  and i.proto = h.proto and h.ts_us >= i.start_us and h.ts_us < i.end_us)"""


@_query(f"""
select pkt_id, {_SUPPRESSED} as suppressed from (select pkt_id, ts_us, proto,
  case when src_in then src_ip else dst_ip end as ip,
  case when src_in then src_port else dst_port end as port from keyed where src_in or dst_in) h""")
def active_host_filter(spark, d):
    marked = rules.mark_active_hosts(
        fx.packets(spark, d), _intervals(spark, d), fx.subnets(spark)
    )
    return marked.select("pkt_id", "suppressed")


@_query("""
select first_pkt_id as pkt_id, t0 as ts_us, proto, src_ip, dst_ip, src_port, dst_port, reply_ts,
  reply_ts - t0 as delay_us from flows where status = 'replied'""")
def match_replies(spark, d):
    return flows.match_replies(fx.packets(spark, d))


_KEYS_SQL = "select ts_us, ip*16777216 + port*256 + proto as key from rules"
_INSTALLED_SQL = "select distinct ip*16777216 + port*256 + proto as key from rules where ip % 5 = 0"
_NOT_FAILED = """not exists (select 1 from failures f where f.key = k.key
  and k.ts_us >= f.fail_us and k.ts_us < f.fail_us + 200000)"""


def _keys(spark, d):
    sent = _rules(spark, d)
    return sent.select("ts_us", X.rule_key("ip", "port", "proto").alias("key"), "ip")


@_query(f"""
select key, min(ts_us) as ts_us from ({_KEYS_SQL}) k where {_NOT_FAILED}
  and key not in ({_INSTALLED_SQL}) group by key""")
def pending_candidates(spark, d):
    keys = _keys(spark, d)
    installed = keys.filter("ip % 5 = 0").select("key").distinct()
    return rules.pending_candidates(keys.drop("ip"), installed, fx.failures(_rules(spark, d)))


@_query(f"select key, ts_us from ({_KEYS_SQL}) k where {_NOT_FAILED}")
def failure_cooldown(spark, d):
    return rules.failure_cooldown(_keys(spark, d).drop("ip"), fx.failures(_rules(spark, d)))


@_query("""
select pkt_id, ingress_port, ingress_port - 52 as session from (
  select pkt_id, 64 + pkt_id % 3 as ingress_port from packets) where ingress_port < 66""")
def mirror_session(spark, d):
    p = fx.packets(spark, d).selectExpr("pkt_id", "cast(64 + pkt_id % 3 as int) as ingress_port")
    return nets.mirror_session(p, fx.sessions(spark))


@_query("""
select iface, case when age > 3 then 'STALE(' || age || 's)' when age is not null then 'OK'
  when pid is not null then 'NO_STATUS' else 'CRASHED' end as state, coalesce(app_drop, 0) as app_drop,
  case when age is null and pid is null then last_line end as last_line from (
  select i.iface, g.app_drop, g.last_line, p.pid,
  (select max(ts_us) // 1000000 from samples) + 2 - u.updated_s as age
  from (select distinct iface from samples) i
  left join (select iface, max(ts_us) // 1000000 - cast(substr(iface, 5, 1) as int) as updated_s from samples
    where substr(iface, 5, 1) not in ('6', '7') group by iface) u using (iface)
  left join drop_log g using (iface)
  left join (select iface, min(line_no) as pid from log_lines where substr(iface, 5, 1) <> '7' group by iface) p
  using (iface))""")
def iface_state(spark, d):
    samples, log = _samples(spark, d), fx.log_lines(spark, d)
    digit = "substring(iface, 5, 1)"
    updated = samples.filter(f"{digit} not in ('6', '7')").groupBy("iface").agg(
        F.expr(f"max(ts_us) div 1000000 - cast({digit} as int)").alias("updated_s")
    )
    pids = log.filter(f"{digit} <> '7'").groupBy("iface").agg(F.min("line_no").alias("pid"))
    now = samples.agg(F.expr("max(ts_us) div 1000000 + 2")).scalar()
    return status.iface_state(
        samples.select("iface").distinct(), updated, status.parse_drop_log(log), pids, now
    )


# Flow tracking


@_query("""
select proto, ep_lo, ep_hi, src_ip, dst_ip, src_port, dst_port, t0, first_pkt_id, status, reply_ts, end_ts,
  n_dup, n_linger from flows""")
def track_flows(spark, d):
    return flows.track_flows(fx.packets(spark, d))


@_query("select pkt_id, ts_us, proto, ep_lo, ep_hi, event, t0, first_pkt_id from ev")
def packet_events(spark, d):
    return flows.packet_events(fx.packets(spark, d))


@_query("select * from unanswered")
def unanswered(spark, d):
    return flows.unanswered(fx.packets(spark, d))


@_query("select k.iface, u.* from unanswered u join keyed k using (pkt_id)")
def unanswered_by_iface(spark, d):
    return flows.unanswered(fx.with_iface(fx.packets(spark, d)), by=("iface",))


@_query("select ts_us, ip, port, proto from rules")
def replied_services(spark, d):
    return _rules(spark, d)


@_query("select pkt_id, proto, ep_lo, ep_hi from keyed")
def flow_key(spark, d):
    return fx.packets(spark, d).select("pkt_id", *X.flow_key())


@_query("""
select k.pkt_id, case when k.src_ep = s.src_ep and k.dst_ep = s.dst_ep then 1
  when k.src_ep = s.dst_ep and k.dst_ep = s.src_ep then -1 else 0 end as direction
from ev join keyed k using (pkt_id) join keyed s on s.pkt_id = ev.first_pkt_id""")
def flow_direction(spark, d):
    p = fx.packets(spark, d)
    events = flows.packet_events(p).select("pkt_id", "first_pkt_id")
    ends = p.select(
        "pkt_id", X.endpoint("src_ip", "src_port").alias("src"), X.endpoint("dst_ip", "dst_port").alias("dst")
    )
    first = ends.select(
        F.col("pkt_id").alias("first_pkt_id"), F.col("src").alias("src0"), F.col("dst").alias("dst0")
    )
    return events.join(ends, "pkt_id").join(first, "first_pkt_id").select(
        "pkt_id", X.flow_direction("src", "dst", "src0", "dst0").alias("direction")
    )


@_query("""
select pkt_id, cast(sum(brk) over (partition by proto, ep_lo, ep_hi order by ts_us, pkt_id rows unbounded preceding) as bigint)
  as session from (select *, case when ts_us - lag(ts_us) over (partition by proto, ep_lo, ep_hi order by ts_us, pkt_id)
  >= 1000000 then 1 else 0 end as brk from keyed)""")
def split_sessions(spark, d):
    return sessions.split_sessions(fx.packets(spark, d)).select("pkt_id", "session")


# Rules and hosts


@_query("select ts_us, ip, port, proto from kept")
def cooldown_dedup(spark, d):
    return rules.cooldown_dedup(_rules(spark, d))


@_query("select ip, port, proto, start_us, end_us, n_hits from intervals")
def rule_intervals(spark, d):
    return _intervals(spark, d)


@_query(f"""
select ip, flow_count, last_rule_us from (
select ip, cast(sum(n) as bigint) as flow_count, max(ts) as last_rule_us from (
  select ip, 0 as n, ts_us as ts from rules where ts_us <= {_NOW}
  union all select ip, 1, null from intervals where start_us <= {_NOW} and end_us > {_NOW}) group by ip)
where flow_count > 0 or {_NOW} - last_rule_us < 60000000""")
def active_hosts(spark, d):
    return hosts.active_hosts(_rules(spark, d), _intervals(spark, d), _now(spark, d))


@_query(f"""
select r.i as "offset", case when l.ip is null then 0 else 1 end as active
from (select unnest(range(65536)) as i) r left join (select distinct ip from intervals
  where start_us <= {_NOW} and end_us > {_NOW}) l on l.ip = 2193620992 + r.i""")
def active_host_bitmap(spark, d):
    return hosts.active_host_bitmap(
        spark, _intervals(spark, d), fx.INTERNAL_BASE, _now(spark, d)
    )


@_query("""
select k.pkt_id, (k.dst_ip, k.ts_us // 1000000) in (
  select (src_ip, ts_us // 1000000) from keyed where src_in
  union select (ip, unnest(range(start_us // 1000000, (end_us - 1) // 1000000 + 1))) from intervals) as host_alive
from keyed k where not src_in and dst_in""")
def host_liveness(spark, d):
    out = hosts.host_liveness(fx.packets(spark, d), _intervals(spark, d), fx.subnets(spark))
    return out.select("pkt_id", "host_alive")


def _near(exact: str):
    """approx_keys is within 3% of the exact number."""
    return (F.abs(F.col("approx_keys") - F.col(exact)) <= 0.03 * F.col(exact)).alias("near")


@_query("select epoch, ip, port, proto from hot")
def hot_rules(spark, d):
    return rules.hot_rules(_rules(spark, d))


@_query("""
select ts_us // 2000000 as epoch, count(*) as n_rules, count(distinct (ip, port, proto)) as n_keys, true as near
from rules group by epoch""")
def epoch_occupancy(spark, d):
    return rules.epoch_occupancy(_rules(spark, d)).select("epoch", "n_rules", "n_keys", _near("n_keys"))


@_query("""
select ts_us // 2000000 as epoch, count(*) as n_rules, count(distinct (ip, port, proto)) as n_keys, true as near
from rules group by epoch""")
def merged_occupancy(spark, d):
    """Sketches of two halves of the hosts, stored, then merged; beside the exact counts."""
    made = _rules(spark, d)
    sketches = stored(rules.epoch_sketches(made.withColumn("half", F.col("ip") % 2), "half"))
    exact = rules.epoch_occupancy(made).select("epoch", "n_keys")
    return rules.merged_occupancy(sketches).join(exact, "epoch").select("epoch", "n_rules", "n_keys", _near("n_keys"))


# Aggregations


@_query("""
select count(*) as pkt_count,
  count(case when not bypass and frag_offset = 0 and proto = 6 then 1 end) as tcp_count,
  count(case when not bypass and frag_offset = 0 and proto = 17 then 1 end) as udp_count,
  count(case when not bypass and frag_offset = 0 and proto = 1 then 1 end) as icmp_count from captured""")
def packet_counts(spark, d):
    captured = filters.capture_filter(fx.packets_ext(spark, d))
    return counters.packet_counts(captured, fx.subnets(spark))


@_query("""
select coalesce(p, 'total') as proto, count(*) as n from (
  select case proto when 1 then 'icmp' when 6 then 'tcp' when 17 then 'udp' end as p from unanswered)
group by rollup (p)""")
def unanswered_counts(spark, d):
    return counters.unanswered_counts(fx.packets(spark, d))


@_query("select (select count(*) from rules) as replies, (select count(*) from kept) as queued")
def reply_counts(spark, d):
    return rules.reply_counts(_rules(spark, d))


@_query(f"""
select (g.s + 1) * 1000000 as ts_us,
  (select count(*) from flows where t0 // 1000000 <= g.s)
  - (select count(*) from flows where status = 'replied' and reply_ts // 1000000 <= g.s)
  - (select count(*) from flows where status = 'unanswered' and end_ts // 1000000 <= g.s) as buffered,
  (select count(*) from flows where t0 // 1000000 <= g.s)
  - (select count(*) from flows where end_ts <= {_CLOCK} and end_ts // 1000000 <= g.s) as flows,
  (select count(*) from flows where status = 'replied' and reply_ts // 1000000 <= g.s)
  - (select count(*) from flows where status = 'replied' and end_ts <= {_CLOCK} and end_ts // 1000000 <= g.s)
  as lingering from {_GRID} g""")
def state_gauges(spark, d):
    return counters.state_gauges(fx.packets(spark, d))


@_query(_SNAPSHOT_SQL, tracked="no_bypass")
def stats_snapshots(spark, d):
    return counters.stats_snapshots(fx.packets(spark, d), fx.subnets(spark))


@_query("""
select iface, ts_us, pkt, coalesce(case when dt >= 1e-3 and grown >= 0 then cast(floor(grown / dt + 0.5) as bigint) end, 0)
  as pkt_pps from (select *, (ts_us - lag(ts_us) over w) / 1e6 as dt, pkt - lag(pkt) over w as grown
  from samples window w as (partition by iface order by ts_us))""")
def packet_rates(spark, d):
    return counters.packet_rates(_samples(spark, d))


@_query("""
select iface, ts_us, pkt, pkt - coalesce(lag(pkt) over (partition by iface order by ts_us), 0) as pkt_s from samples""")
def counter_deltas(spark, d):
    return counters.counter_deltas(_samples(spark, d), ["pkt"])


@_query("""
select iface, ts_us, received, dropped, received - pkt as backlog from (select iface, ts_us, pkt,
  greatest(case when substr(iface, 5, 1) in ('0', '4') then 0 else pkt + 2 end, cast(sum(pkt % 50) over w as bigint)) as received,
  greatest(pkt // 100, cast(sum(pkt % 3) over w as bigint)) as dropped
  from samples window w as (partition by iface order by ts_us rows unbounded preceding))""")
def receive_backlog(spark, d):
    return counters.receive_backlog(fx.receive_samples(_samples(spark, d)))


@_query("""
select count(case when not truncated and verdict = 'ok' then 1 end) as pkts_ok, count(case when not truncated and verdict = 'bad' then 1 end) as pkts_bad,
  count(case when truncated or verdict = 'trunc' then 1 end) as pkts_trunc,
  count(case when not truncated and (verdict <> 'ok' or cnt = 0) then 1 end) as sock_drop,
  cast(coalesce(sum(case when not truncated and verdict = 'ok' then cnt end), 0) as bigint) as rules_in from datagrams""")
def datagram_quality(spark, d):
    return wire.datagram_quality(
        fx.datagrams(wire.encode_rule_batches(_rules(spark, d), max_rules=3))
    )


_CHANGES = """(select moment // 1000000 as s, sum(d) as d from (
  select start_us as moment, 1 as d from intervals union all select end_us, -1 from intervals) group by s)"""


@_query(f"""
select (s + 1) * 1000000 as ts_us, cast(u as bigint) as usage, u / 20000 as share
from (select s, sum(coalesce(d, 0)) over (order by s rows unbounded preceding) as u
from (select unnest(range((select min(s) from {_CHANGES}), (select max(s) from {_CHANGES}) + 1)) as s) left join {_CHANGES} using (s))""")
def table_usage(spark, d):
    return counters.table_usage(_intervals(spark, d))


_TOTAL_SQL = ", ".join(
    "null as nic_oob_d" if c.strip() == "nic_oob_d" else f"cast(sum({c.strip()}) as bigint) as {c.strip()}"
    for c in _STATUS_COLUMNS.split(",")
)


@_query(f"""
select iface, {_STATUS_COLUMNS}, app_drop from latest_status join drop_log using (iface)
union all select 'TOTAL', {_TOTAL_SQL}, cast(sum(app_drop) as bigint) from latest_status join drop_log using (iface)""")
def status_total(spark, d):
    return status.status_total(_latest_status(spark, d), status.parse_drop_log(fx.log_lines(spark, d)))


def _latest_status(spark, d):
    lines = fx.status_lines(_samples(spark, d))
    latest = lines.groupBy("iface").agg(F.max_by("value", "ts_us").alias("value"))
    return status.parse_status(latest)


def _short(x: str) -> str:
    return f"""case when abs({x}) >= 1000000000 then printf('%.1f', {x} / 1e9) || 'g' when abs({x}) >= 1000000 then printf('%.1f', {x} / 1e6) || 'm'
  when abs({x}) >= 1000 then printf('%.1f', {x} / 1e3) || 'k' else cast({x} as varchar) end"""


_ROLLUP_CELLS = ["'-'" if c == "nic_oob_d" else _short(f"coalesce({c}, 0)") for c in (*status.NUMBERS, "app_drop")]


@_query(f"""
select printf('%-10s {" ".join(f"%{w}s" for w in (8, 8, 10, 8, 8, 9, 8, 10, 8, 8, 10, 10, 10, 5, 10, 12))}', 'TOTAL',
  {", ".join(_ROLLUP_CELLS)}, 'SUM') as value
from (select {_TOTAL_SQL}, cast(sum(app_drop) as bigint) as app_drop from latest_status join drop_log using (iface))""")
def write_rollup(spark, d):
    totals = status.status_total(
        _latest_status(spark, d), status.parse_drop_log(fx.log_lines(spark, d))
    )
    path = shared_dir(spark)
    sinks.write_rollup(totals, path)
    return sinks.latest_rollup(spark, path)


_HOST_RUNS = """(select ip, min(a) as a, max(b) as b from (
  select *, sum(brk) over (partition by ip order by a, b rows unbounded preceding) as run from (
  select *, case when a > max(b) over (partition by ip order by a, b rows between unbounded preceding and 1 preceding)
    then 1 else 0 end as brk from (
  select ip, ts_us as a, ts_us + 60000000 as b from rules union all select ip, start_us, end_us from intervals)))
  group by ip, run)"""
_PORT_SQL = """(select *, rx - coalesce(lag(rx) over w, rx) as rx_s, tx - coalesce(lag(tx) over w, tx) as tx_s
  from port_rows window w as (partition by port order by ts_us))"""
_REPORT_SQL = f"""
select s as sec, cast((s * 1000000 // 2000000) % 2 as int) as epoch,
  (select count(*) from rules where ts_us // 2000000 = s * 1000000 // 2000000 - 1) as group0,
  (select count(distinct (ip, port, proto)) from rules where ts_us // 2000000 = s * 1000000 // 2000000 - 1) as group1,
  case when s * 1000000 % 2000000 = 0 then 1 else 0 end as switched,
  (select count(*) from rules where ts_us // 1000000 = s) as in_s,
  (select count(*) from (select min(k.ts_us) as ts_us from ({_KEYS_SQL}) k join intervals i on k.key = i.ip*16777216 + i.port*256 + i.proto
    and k.ts_us >= i.start_us and k.ts_us < i.end_us where {_NOT_FAILED} group by k.key, i.start_us)
    where ts_us // 1000000 = s) as pend_add_s,
  (select count(*) from intervals where start_us // 1000000 = s) as inst_s,
  (select count(*) from failures where fail_us // 1000000 = s) as add_fail_s,
  (select count(*) from hot where epoch = s * 1000000 // 2000000 - 1) as hot_rules,
  (select count(*) from intervals where start_us // 1000000 <= s and end_us // 1000000 > s) as local,
  (select count(*) from intervals where start_us // 1000000 <= s and end_us // 1000000 > s) as usage,
  (select count(*) from {_HOST_RUNS} where a // 1000000 <= s and b // 1000000 > s) as active_hosts,
  (select cast(coalesce(sum(rx_s), 0) as bigint) from {_PORT_SQL} where ts_us // 1000000 - 1 = s) as rx_pkts_s,
  (select cast(coalesce(sum(tx_s), 0) as bigint) from {_PORT_SQL} where ts_us // 1000000 - 1 = s) as tx_pkts_s
from (select unnest(range((select min(ts_us) // 1000000 from rules), (select max(ts_us) // 1000000 from rules) + 1)) as s)"""


def _ports(spark, d):
    p = fx.packets(spark, d).withColumn("port", F.expr("64 + (src_ip + dst_ip) % 2"))
    return counters.port_counters(counters.port_samples(p, fx.subnets(spark)))


def _report(spark, d):
    sent = stored(_rules(spark, d))
    lives = rules.rule_intervals(sent, _hits(spark, d))
    return counters.controller_report(sent, lives, fx.failures(sent), _ports(spark, d))


@_query(_REPORT_SQL)
def controller_report(spark, d):
    return _report(spark, d)


_REPORT_FIELDS = (
    "epoch", "group0", "group1", "switched", "in_s", "pend_add_s", "inst_s", "add_fail_s", "hot_rules", "local", "usage",
    "active_hosts", "rx_pkts_s", "tx_pkts_s",
)
_REPORT_COLUMNS = ", ".join(
    f"cast({n} as bigint) as {n}" if n in _REPORT_FIELDS else f"cast(null as bigint) as {n}" for n in CONTROLLER_FIELDS[2:]
)


@_query(f"""
select strftime(make_timestamp(1704067200000000 + sec * 1000000), '%Y-%m-%d %H:%M:%S') as "timestamp",
  cast(2.0 as double) as interval_cycle, {_REPORT_COLUMNS} from ({_REPORT_SQL})""")
def read_controller_csv(spark, d):
    root = shared_dir(spark)
    statfiles.format_controller_csv(_report(spark, d)).write.text(root)
    return statfiles.read_controller_csv(spark, root)


@_query("""
select *, batch_size = (select arg_max(batch_size, avg_throughput - pos * 1e-9) from per_size) as is_best from per_size""")
def throughput_summary(spark, d):
    return counters.throughput_summary(fx.trials(spark, d))


@_query(f"select ip, count(*) as n_rules from intervals where start_us <= {_NOW} and end_us > {_NOW} group by ip")
def installed_per_host(spark, d):
    return hosts.installed_per_host(_intervals(spark, d), _now(spark, d))


@_query("""
select port, ts_us, rx, tx, rx - coalesce(lag(rx) over w, rx) as rx_s, tx - coalesce(lag(tx) over w, tx) as tx_s
from port_rows window w as (partition by port order by ts_us)""")
def port_counters(spark, d):
    return _ports(spark, d)


# Reports


@_query(f"""
select ts_us - ts_us % 10000000 as window_us, case when src_ip {_INTERNAL_HOST} then 'internal' else 'external' end as initiator,
  case proto when 1 then 'icmp' when 6 then 'tcp' else 'udp' end as proto, count(*) as n from unanswered group by all""")
def radiation_split(spark, d):
    return reports.radiation_split(
        flows.unanswered(fx.packets(spark, d)), fx.subnets(spark), 10_000_000
    )


@_query("""
select dst_ip, dst_port, proto, count(case when status = 'unanswered' then 1 end) as requests,
  count(distinct case when status = 'unanswered' then src_ip end) as clients from flows
group by dst_ip, dst_port, proto having count(case when status = 'replied' then 1 end) = 0 and count(case when status = 'unanswered' then 1 end) > 0""")
def dead_services(spark, d):
    return reports.dead_services(flows.flow_starts(fx.packets(spark, d)))


@_query("""
select src_ip, count(distinct (dst_ip, dst_port)) as targets, count(*) as packets from unanswered group by src_ip
having count(distinct (dst_ip, dst_port)) >= 3 order by targets desc, src_ip limit 100""")
def scanners(spark, d):
    return reports.scanners(flows.unanswered(fx.packets(spark, d)), 3, 100)


@_query(f"""
select src_ip, dst_ip, dst_port, proto, count(distinct ts_us // 2000000) as windows, count(*) as packets
from unanswered where src_ip {_INTERNAL_HOST} group by src_ip, dst_ip, dst_port, proto having windows >= 2""")
def misconfigured_hosts(spark, d):
    return reports.misconfigured_hosts(
        flows.unanswered(fx.packets(spark, d)), fx.subnets(spark), 2, 2_000_000
    )


@_query(f"""
select t0 - t0 % 10000000 as window_us, dst_ip, dst_port, proto, count(case when status = 'replied' then 1 end) as replied,
  count(case when status = 'unanswered' then 1 end) as unanswered, count(case when status = 'replied' then 1 end) / count(*) as ratio
from flows where status <> 'open' and dst_ip {_INTERNAL_HOST} group by all""")
def answer_ratio(spark, d):
    return reports.answer_ratio(
        flows.flow_starts(fx.packets(spark, d)), fx.subnets(spark), 10_000_000
    )


# Scalars, each over a whole column


@_query("""
select pkt_id, src_ip, (src_ip >> 24) || '.' || ((src_ip >> 16) & 255) || '.' || ((src_ip >> 8) & 255) || '.' || (src_ip & 255)
  as dotted, src_ip as back from packets""")
def ip_to_int(spark, d):
    p = fx.packets(spark, d).select("pkt_id", "src_ip", X.int_to_ip("src_ip").alias("dotted"))
    return p.withColumn("back", X.ip_to_int("dotted"))


@_query("""
select pkt_id, bits, cast(4294967296 - (1::bigint << (32 - bits)) as bigint) as mask, 4294967040 + pkt_id % 256 as dotted
from (select pkt_id, cast(pkt_id % 33 as int) as bits from packets)""")
def mask_of(spark, d):
    p = fx.packets(spark, d).selectExpr(
        "pkt_id", "cast(pkt_id % 33 as int) as bits", "concat('255.255.255.', pkt_id % 256) as text"
    )
    return p.select(
        "pkt_id", "bits", X.mask_of(F.col("bits").cast("string")).alias("mask"),
        X.mask_of("text").alias("dotted"),
    )


@_query("""
select pkt_id, src_ip*16777216 + src_port*256 + proto as key, src_ip as ip, src_port as port, proto from packets""")
def rule_key(spark, d):
    keyed = fx.packets(spark, d).select(
        "pkt_id", X.rule_key("src_ip", "src_port", "proto").alias("key")
    )
    return keyed.select("pkt_id", "key", *X.unpack_rule_key("key"))


@_query("""
select pkt_id, greatest(ts_us - 3000000, 0) as since, greatest(3000000 - ts_us, 0) as until from packets""")
def elapsed_us(spark, d):
    mark = F.lit(3_000_000).cast("bigint")
    return fx.packets(spark, d).select(
        "pkt_id", X.elapsed_us(mark, F.col("ts_us")).alias("since"),
        X.elapsed_us(F.col("ts_us"), mark).alias("until"),
    )


@_query("""
select pkt_id, case proto when 1 then 'icmp' when 6 then 'tcp' when 17 then 'udp' end as name from ext""")
def proto_name(spark, d):
    return fx.packets_ext(spark, d).select("pkt_id", X.proto_name("proto").alias("name"))


_SHORT = """case when abs(x) >= 1000000000 then sg || printf('%.1f', abs(x) / 1e9) || 'g'
  when abs(x) >= 1000000 then sg || printf('%.1f', abs(x) / 1e6) || 'm'
  when abs(x) >= 1000 then sg || printf('%.1f', abs(x) / 1e3) || 'k' else cast(x as varchar) end"""


@_query(f"""
select pkt_id, {_SHORT} as short from (select *, case when x < 0 then '-' else '' end as sg from (
  select pkt_id, (pkt_id * 7919 % 40 - 10) * (pkt_id * pkt_id % 1000003) * 125 as x from packets))""")
def compact_count(spark, d):
    p = fx.packets(spark, d).selectExpr(
        "pkt_id", "(pkt_id * 7919 % 40 - 10) * (pkt_id * pkt_id % 1000003) * 125 as x"
    )
    return p.select("pkt_id", X.compact_count("x").alias("short"))


@_query("select pkt_id, format('{:,}', ts_us) as grouped from packets")
def group_digits(spark, d):
    return fx.packets(spark, d).select("pkt_id", X.group_digits("ts_us").alias("grouped"))


@_query("""
select pkt_id, lower(lpad(to_hex(src_ip), 8, '0') || lpad(to_hex(src_port), 4, '0')) as bytes, 
  regexp_replace(lower(lpad(to_hex(src_ip), 8, '0') || lpad(to_hex(src_port), 4, '0')), '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6')
  as mac from packets""")
def mac_bytes(spark, d):
    raw = F.unhex(F.concat(F.lpad(F.hex("src_ip"), 8, "0"), F.lpad(F.hex(F.col("src_port").cast("bigint")), 4, "0")))
    p = fx.packets(spark, d).select("pkt_id", X.mac_text(raw).alias("mac"))
    return p.select("pkt_id", F.lower(F.hex(X.mac_bytes("mac"))).alias("bytes"), "mac")


@_query("""
select pkt_id, tcp_flags & 1 <> 0 as fin, tcp_flags & 2 <> 0 as syn, tcp_flags & 4 <> 0 as rst, tcp_flags & 8 <> 0 as psh,
  tcp_flags & 16 <> 0 as ack, tcp_flags & 32 <> 0 as urg, tcp_flags & 64 <> 0 as flag6, tcp_flags & 128 <> 0 as flag7
from (select pkt_id, pkt_id % 256 as tcp_flags from packets)""")
def tcp_flags(spark, d):
    p = fx.packets(spark, d).selectExpr("pkt_id", "cast(pkt_id % 256 as int) as tcp_flags")
    return p.select("pkt_id", *X.tcp_flag_columns())


@_query("""
select pkt_id, case when src_in then src_ip - 2193620992 end as src_offset,
  case when dst_in then dst_ip - 2193620992 end as dst_offset from keyed""")
def host_offset(spark, d):
    return fx.packets(spark, d).select(
        "pkt_id", X.host_offset("src_ip", fx.INTERNAL_BASE).alias("src_offset"),
        X.host_offset("dst_ip", fx.INTERNAL_BASE).alias("dst_offset"),
    )


# Streams: the whole input in steps and a closing marker, compared with the
# batch rules. The marker lets time pass, so no flow stays open.


@_query("""
select case when reply_ts is null then 'unanswered' else 'replied' end as status, proto, src_ip, dst_ip,
  src_port, dst_port, t0, first_pkt_id, reply_ts from flows""")
def track_flows_stream(spark, d):
    return run_in_steps(
        fx.packets(spark, d), lambda p: jobs.track_flows_stream(packets.with_event_time(p))
    )


@_query("select ts_us, ip, port, proto from kept")
def cooldown_stream(spark, d):
    return run_in_steps(
        _rules(spark, d), lambda r: jobs.cooldown_stream(packets.with_event_time(r))
    )


@_query("select ip, port, proto, start_us, end_us, n_hits from intervals")
def rule_sessions_stream(spark, d):
    activity = _rules(spark, d).withColumn("is_rule", F.lit(True)).unionByName(
        _hits(spark, d).withColumn("is_rule", F.lit(False))
    )
    return run_in_steps(
        activity, lambda a: jobs.rule_sessions_stream(packets.with_event_time(a))
    )


@_query("""
select ts_us // 2000000 as epoch, count(*) as n_rules, true as near from rules group by epoch""")
def epoch_windows_stream(spark, d):
    made = _rules(spark, d)
    windows = run_in_steps(made, lambda r: jobs.epoch_windows_stream(packets.with_event_time(r)))
    exact = rules.epoch_occupancy(made).select("epoch", "n_keys")
    return windows.join(exact, "epoch").select("epoch", "n_rules", _near("n_keys"))


@_query("select count(*) as late from packets where ts_us < (select max(ts_us) // 2 from packets) and pkt_id % 97 = 0")
def late_packets(spark, d):
    """Packets that come after everything else and long after their time."""
    p, root = fx.packets(spark, d), shared_dir(spark)
    slow = (F.col("ts_us") < p.agg(F.expr("max(ts_us) div 2")).scalar()) & (F.col("pkt_id") % 97 == 0)
    late = LateRows()
    spark.streams.addListener(late)
    for part in (p.filter(~slow), p.filter(slow)):
        part.write.mode("append").parquet(f"{root}/in")
        stream = packets.with_event_time(packets.read_packets(spark, f"{root}/in", streaming=True))
        with rocksdb_state(spark):
            query = (
                jobs.track_flows_stream(stream).writeStream.format("parquet")
                .option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
                .trigger(availableNow=True).start()
            )
        n = late.of(query)
    spark.streams.removeListener(late)
    return spark.range(1).select(F.lit(n).cast("bigint").alias("late"))
