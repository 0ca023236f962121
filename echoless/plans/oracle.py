"""Common table expressions from which the comparison SQL is put together.

Each entry is plain SQL over the driver's tables or over entries above it.
"""

_GONE = """(case when f.last_ts is null then o.ts_us - f.t0 >= 1000000
       else o.ts_us - f.last_ts >= 200000 end)"""

CTES = {
    "e": """select event_id, user_id, event_type, cast(round(value*100) as bigint) v from events""",
    "b": """select event_id, event_type, v, event_id*1000 as t0,
  268435456 + user_id % 251 as ext_ip, 2193620992 + (user_id*7919) % 1021 as int_ip,
  case when v%8=7 then 1 when v%2=0 then 6 else 17 end as proto,
  event_id%5=0 as outbound, 1024+(event_id//4)%4 as cport,
  case when v%3=0 then 80 when v%3=1 then 53 else 443 end as sport from e""",
    "legs": """select event_id*4 as pkt_id, t0 as ts_us, 0 as leg, proto, outbound, cport, sport, int_ip, ext_ip from b
  union all select event_id*4+1, t0+300000, 1, proto, outbound, cport, sport, int_ip, ext_ip from b where event_type='error' or v%4=0
  union all select event_id*4+2, t0+v*200, 2, proto, outbound, cport, sport, int_ip, ext_ip from b where event_type<>'error'
  union all select event_id*4+3, t0+v*200+150000, 3, proto, outbound, cport, sport, int_ip, ext_ip from b where event_type='purchase'""",
    "packets": """select pkt_id, ts_us, proto,
  case when (leg<>2)=outbound then int_ip else ext_ip end as src_ip,
  case when (leg<>2)=outbound then ext_ip else int_ip end as dst_ip,
  case when proto=1 then 0 when leg<>2 then cport else sport end as src_port,
  case when proto=1 then 0 when leg<>2 then sport else cport end as dst_port from legs""",
    "keyed": """select *, src_ip*65536+src_port as src_ep, dst_ip*65536+dst_port as dst_ep,
  least(src_ip*65536+src_port, dst_ip*65536+dst_port) as ep_lo,
  greatest(src_ip*65536+src_port, dst_ip*65536+dst_port) as ep_hi,
  case when src_ip*65536+src_port <= dst_ip*65536+dst_port then 0 else 1 end as side,
  src_ip between 2193620992 and 2193686527 as src_in,
  dst_ip between 2193620992 and 2193686527 as dst_in,
  (src_ip between 2193621760 and 2193622015) or (dst_ip between 2193621760 and 2193622015) as bypass,
  'enp' || (10 + (src_ip + dst_ip) % 8) || 's0' as iface from packets""",
    "ordered": """select *, row_number() over (partition by proto, ep_lo, ep_hi order by ts_us, pkt_id) rn from {tracked}""",
    "ev": f"""select proto, ep_lo, ep_hi, rn, pkt_id, ts_us, side, 'created' as event, ts_us as t0,
  pkt_id as first_pkt_id, side as side0, cast(null as bigint) as last_ts from ordered where rn = 1
  union all
  select o.proto, o.ep_lo, o.ep_hi, o.rn, o.pkt_id, o.ts_us, o.side,
  case when {_GONE} then 'created' when f.last_ts is not null then 'linger'
       when o.side = f.side0 then 'dup_request' else 'replied' end,
  case when {_GONE} then o.ts_us else f.t0 end,
  case when {_GONE} then o.pkt_id else f.first_pkt_id end,
  case when {_GONE} then o.side else f.side0 end,
  case when {_GONE} then null when f.last_ts is not null or o.side <> f.side0 then o.ts_us end
  from ev f join ordered o on o.proto = f.proto and o.ep_lo = f.ep_lo and o.ep_hi = f.ep_hi and o.rn = f.rn + 1""",
    "flow_rows": """select proto, ep_lo, ep_hi, t0, first_pkt_id, max(side0) as side0,
  max(case when event = 'replied' then ts_us end) as reply_ts, max(ts_us) as last_ts,
  count(case when event = 'dup_request' then 1 end) as n_dup, count(case when event = 'linger' then 1 end) as n_linger
  from ev group by proto, ep_lo, ep_hi, t0, first_pkt_id""",
    "flows": """select *,
  (case when side0 = 0 then ep_lo else ep_hi end) // 65536 as src_ip,
  (case when side0 = 0 then ep_hi else ep_lo end) // 65536 as dst_ip,
  (case when side0 = 0 then ep_lo else ep_hi end) % 65536 as src_port,
  (case when side0 = 0 then ep_hi else ep_lo end) % 65536 as dst_port,
  case when reply_ts is not null then 'replied'
       when (select max(ts_us) from ordered) - t0 >= 1000000 then 'unanswered' else 'open' end as status,
  case when reply_ts is not null then last_ts + 200000
       when (select max(ts_us) from ordered) - t0 >= 1000000 then t0 + 1000000 end as end_ts
  from flow_rows""",
    "unanswered": """select first_pkt_id as pkt_id, t0 as ts_us, proto, src_ip, dst_ip, src_port, dst_port
  from flows where status = 'unanswered'""",
    "rules": """select reply_ts as ts_us,
  case when src_ip between 2193620992 and 2193686527 then src_ip else dst_ip end as ip,
  case when src_ip between 2193620992 and 2193686527 then src_port else dst_port end as port,
  proto from flows where status = 'replied'""",
    "rules_ordered": """select *, row_number() over (partition by ip, port, proto order by ts_us) rn from rules""",
    "rules_walk": """select ip, port, proto, rn, ts_us, ts_us as sent, true as kept from rules_ordered where rn = 1
  union all
  select o.ip, o.port, o.proto, o.rn, o.ts_us,
  case when o.ts_us - w.sent >= 1000000 then o.ts_us else w.sent end, o.ts_us - w.sent >= 1000000
  from rules_walk w join rules_ordered o
  on o.ip = w.ip and o.port = w.port and o.proto = w.proto and o.rn = w.rn + 1""",
    "kept": """select ts_us, ip, port, proto from rules_walk where kept""",
    "hits": """select ts_us, case when src_in then src_ip else dst_ip end as ip,
  case when src_in then src_port else dst_port end as port, proto from keyed where src_in or dst_in""",
    "activity": """select ts_us, ip, port, proto, true as is_rule from rules
  union all select ts_us, ip, port, proto, false from hits""",
    "lives": """select *, sum(brk) over (partition by ip, port, proto order by ts_us, is_rule rows unbounded preceding) life
  from (select *, case when ts_us - lag(ts_us) over (partition by ip, port, proto order by ts_us, is_rule) > 5000000
  then 1 else 0 end as brk from activity)""",
    "intervals": """select ip, port, proto, start_us, end_us,
  count(case when not is_rule and ts_us >= start_us then 1 end) as n_hits from (
  select *, min(case when is_rule then ts_us end) over (partition by ip, port, proto, life) as start_us,
  max(ts_us) over (partition by ip, port, proto, life) + 5000000 as end_us from lives)
  where start_us is not null group by ip, port, proto, start_us, end_us""",
    "failures": """select ts_us + 50000 as fail_us, ip*16777216 + port*256 + proto as key
  from rules where (ts_us // 1000) % 13 = 0""",
    "hot": """select epoch, ip, port, proto from (
  select *, lag(epoch) over (partition by ip, port, proto order by epoch) as before from (
  select distinct ts_us // 2000000 as epoch, ip, port, proto from rules)) where before = epoch - 1""",
    "iface_counts": """select iface, ts_us // 1000000 as s, count(*) as n from keyed group by iface, s""",
    "samples": """select iface, (s + 1) * 1000000 as ts_us,
  cast(sum(n) over (partition by iface order by s rows unbounded preceding) as bigint) as pkt from iface_counts""",
    "status_rows": """select iface, ts_us, pkt % 1000 as pkt_pps,
  case when substr(iface, 4, 2) in ('11', '13') then pkt % 888 else pkt % 777 end as nic_pps,
  pkt, pkt % 50 as buf, pkt % 90 as flow, pkt % 30 as exp, pkt % 40 as bloom_rsp, pkt + 3 as pcap_rx,
  pkt % 5 as pcap_drp, 0 as pcap_ifdr, 3 - pkt % 7 as pcap_pend, pkt % 888 as nic_drx,
  case when (ts_us // 1000000) % 2 = 1 then pkt % 3 end as nic_oob_d, pkt % 7 as ruleq from samples""",
    "latest_status": """select * from status_rows where (iface, ts_us) in (select (iface, max(ts_us)) from status_rows group by iface)""",
    "log_lines": """select 'enp' || (10 + user_id % 8) || 's0' as iface, event_id as line_no,
  case when event_id % 7 = 0 then 'WARN pkt buffer overflow: drop packet (count=' || event_id || ')'
       when event_id % 5 = 0 then ' ' else 'tick ' || event_id end as value, event_id from events""",
    "drop_log": """select iface, coalesce(max(case when event_id % 7 = 0 then event_id end), 0) as app_drop,
  arg_max(value, event_id) filter (where trim(value) <> '') as last_line from log_lines group by iface""",
    "ext": """select pkt_id, ts_us, iface, case when pkt_id % 53 = 0 then 6 else 4 end as ip_version,
  case when pkt_id % 29 = 0 then 47 else proto end as proto,
  case when pkt_id % 101 = 0 then 0 else src_ip end as src_ip,
  case when pkt_id % 103 = 0 then 4294967295 else dst_ip end as dst_ip,
  src_port, dst_port, case when pkt_id % 17 = 0 then 185 else 0 end as frag_offset,
  cast(40 + pkt_id % 1400 as int) as ip_len, cast(64 - pkt_id % 5 as int) as ttl,
  case when pkt_id % 4 = 0 then 2 when pkt_id % 4 = 1 then 16 when pkt_id % 4 = 2 then 18 else 24 end as tcp_flags,
  case when src_ip > dst_ip then 8 else 0 end as icmp_type, cast(pkt_id % 3 as int) as icmp_code from keyed""",
    "captured": """select *, (src_ip between 2193621760 and 2193622015) or (dst_ip between 2193621760 and 2193622015) as bypass
  from ext where ip_version = 4 and src_ip not in (0, 4294967295) and dst_ip not in (0, 4294967295)""",
    "wire_rules": """select *, ts_us // 10000 as flush,
  row_number() over (partition by ts_us // 10000 order by ts_us, ip, port, proto) - 1 as place from rules""",
    "wire_batches": """select (flush + 1) * 10000 as recv_us, place // 3 as message, count(*) as n_rules,
  '50340101' || lpad(to_hex(count(*)), 4, '0') || '0000' ||
  string_agg(lpad(to_hex(proto), 2, '0') || '00' || lpad(to_hex(port), 4, '0') || lpad(to_hex(ip), 8, '0'), '' order by place)
  as hex from wire_rules group by flush, message""",
    "numbered": """select *, recv_us // 10000 * 3 + message as k from wire_batches""",
    "datagrams": """select recv_us, n_rules, k, k % 17 = 0 as truncated,
  case when k % 7 = 0 then 'bad' when k % 11 = 0 then 'trunc' else 'ok' end as verdict,
  case when k % 13 = 0 and k % 7 <> 0 and k % 11 <> 0 then 0 else n_rules end as cnt, message from numbered""",
    "trials": """select 64 * cast(pow(2, user_id % 6) as int) as batch_size, cast(user_id % 6 as int) as pos,
  cast(event_id % 3 as int) as round, 50000 as target_rules, 50000 - v % 100 as installed_rules,
  v % 100 as dropped_rules, cast(1.5 as double) as elapsed_sec, cast(v % 4096 as double) as throughput,
  case when v % 10 = 0 then 1 else 0 end as batch_fail from e""",
    "per_size": """select batch_size, min(pos) as pos, count(*) as rounds, avg(throughput) as avg_throughput,
  sum(installed_rules) / sum(target_rules) as ok_ratio, cast(sum(batch_fail) as bigint) as batch_fail
  from trials group by batch_size""",
    "ports": """select 64 + (src_ip + dst_ip) % 2 as port, ts_us // 1000000 as s,
  count(case when dst_in then 1 end) as rx, count(case when not dst_in then 1 end) as tx from keyed group by all""",
    "port_rows": """select port, (s + 1) * 1000000 as ts_us,
  cast(sum(rx) over (partition by port order by s rows unbounded preceding) as bigint) as rx,
  cast(sum(tx) over (partition by port order by s rows unbounded preceding) as bigint) as tx from ports""",
}

_TRACKED = {"all": "keyed", "no_bypass": "(select * from keyed where not bypass)"}


def build(select: str, tracked: str = "all") -> str:
    """`select` with exactly the entries it needs in front of it."""
    import re

    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b\w+\b", text):
            if name in CTES and name not in needed:
                needed.append(name)
                visit(CTES[name].replace("{tracked}", _TRACKED[tracked]))

    visit(select)
    parts = [
        f"{name} as ({text.replace('{tracked}', _TRACKED[tracked])})"
        for name, text in CTES.items()
        if name in needed
    ]
    return f"with recursive {', '.join(parts)} {select}" if parts else select
