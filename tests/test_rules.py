"""Rules, nets and messages where data is skewed, long or at a border."""

import random

from pyspark.sql import functions as F

from brute import fold
from echoless.operators import hosts
from echoless.operators import counters, nets, rules, wire
from echoless.schema import PACKETS, RULES

RNG = random.Random(6)


def test_cooldown_is_greedy(spark):
    times = sorted(RNG.randrange(0, 9_000_000) for _ in range(300))
    rows = [(t, 5, 80, 6) for t in times] + [(t, 7, 80, 6) for t in (0, 999_999, 1_000_000, 1_999_999)]
    df = spark.createDataFrame(rows, RULES)
    expected = sorted(
        (rows[rid][0], rows[rid][1])
        for rid, v in fold([(r[1], r[0], i, 0) for i, r in enumerate(rows)], 1_000_000, 1_000_000).items()
        if v[0] == "created"
    )
    for chunk_us in (1_000_000, 30_000_000):
        kept = rules.cooldown_dedup(df, chunk_us=chunk_us)
        assert sorted((r.ts_us, r.ip) for r in kept.collect()) == expected


def brute_intervals(sent, hits, ttl):
    events = sorted([(t, 0) for t in sent] + [(t, 1) for t in hits])
    lives, current = [], None
    for t, kind in events:
        if current and t - current[1] > ttl:
            lives.append(current)
            current = None
        if current is None and kind == 0:
            current = [t, t, 0]
        elif current:
            current[1] = t
            current[2] += kind
    return sorted((a, b + ttl, n) for a, b, n in lives + ([current] if current else []))


def test_rule_intervals_follow_the_events(spark):
    for seed in range(3):
        rng = random.Random(seed)
        sent = sorted(rng.sample(range(0, 400), 8))
        hits = sorted(rng.sample(range(0, 400), 25))
        hits = [h for h in hits if h not in sent]
        got = rules.rule_intervals(
            spark.createDataFrame([(t, 1, 2, 6) for t in sent], RULES),
            spark.createDataFrame([(t, 1, 2, 6) for t in hits], RULES),
            ttl_us=10,
        ).collect()
        assert sorted((r.start_us, r.end_us, r.n_hits) for r in got) == brute_intervals(sent, hits, 10)


def test_sketches_merge_over_interfaces(spark):
    made = spark.createDataFrame([(i * 1000, i % 3001, i % 7, 6, f"if{i % 2}") for i in range(60_000)], "ts_us long, ip long, port int, proto int, iface string")
    parts = rules.epoch_sketches(made, "iface", epoch_us=60_000_000)
    assert parts.count() == 2
    (merged,) = rules.merged_occupancy(parts).collect()
    exact = made.select("ip", "port", "proto").distinct().count()
    assert merged.n_rules == 60_000 and abs(merged.approx_keys - exact) <= 0.03 * exact
    of_one = {r.iface: r.approx_keys for r in rules.merged_occupancy(parts, "iface").collect()}
    assert set(of_one) == {"if0", "if1"}


def packets(spark, n=200):
    rows = [(i, i, 6, RNG.randrange(1 << 32), RNG.randrange(1 << 32), 1, 2) for i in range(n)]
    return spark.createDataFrame(rows, PACKETS)


def test_hundred_thousand_nets_of_all_masks_take_one_join(spark):
    sizes = [0xFFFFFFFF & ~((1 << (32 - n)) - 1) for n in range(33)]
    rng = random.Random(12)
    listed = [(rng.randrange(1 << 32) & sizes[n], sizes[n]) for n in rng.choices(range(12, 33), k=100_000)]
    listed += [(m & (0xC0000000 | rng.randrange(1 << 30)), m) for m in sizes[2:12]]
    listed += [(0x0A0A0000 + 2 * i, sizes[32]) for i in range(32_768)]  # as many ranges as fit in a bucket
    by_mask = {}
    for net, mask in listed:
        by_mask.setdefault(mask, set()).add(net)
    at = [0, (1 << 32) - 1, *(0x0A0A0000 + i for i in range(200)), *(rng.randrange(1 << 32) for _ in range(500))]
    at += [net + d for net, _ in listed[:300] for d in (-1, 0, 1) if 0 <= net + d < 1 << 32] + [None]
    p = spark.createDataFrame([(a,) for a in at], "src_ip long")
    out = nets.with_membership(p, spark.createDataFrame(listed, "net long, mask long"), member="src_ip")
    expected = sorted((-1 if a is None else a, a is not None and any(a & m in found for m, found in by_mask.items())) for a in at)
    assert sorted((-1 if r.src_ip is None else r.src_ip, r.member) for r in out.collect()) == expected
    assert str(out._jdf.queryExecution().optimizedPlan().toString()).count("Join") == 1


def test_nets_with_a_mask_that_is_no_prefix(spark, monkeypatch):
    listed = [(0x0A000001, 0xFF0000FF), (0x0B000000, 0xFF000000), (0x0C000001, 0xFF000000)]
    p = spark.createDataFrame([(0x0A123401,), (0x0A123402,), (0x0B000009,), (0x0C000001,), (None,)], "src_ip long")
    table = spark.createDataFrame(listed, "net long, mask long")
    inline = nets.with_membership(p, table, member="src_ip").collect()
    monkeypatch.setattr(nets, "MAX_INLINE", 1)
    key = lambda r: (r.src_ip is None, r.src_ip or 0, r.member)
    assert sorted(nets.with_membership(p, table, member="src_ip").collect(), key=key) == sorted(inline, key=key)


def test_long_net_lists_use_joins_and_agree(spark, monkeypatch):
    masks = [4278190080, 4294901760, 4026531840]
    listed = [("internal", RNG.randrange(1 << 32) & m, m) for m in masks for _ in range(6)]
    subnets = spark.createDataFrame(listed, "kind string, net bigint, mask bigint")
    p = packets(spark)
    inline = nets.subnet_member(p, "src_ip", subnets).select("pkt_id", "member").collect()
    monkeypatch.setattr(nets, "MAX_INLINE", 3)
    joined = nets.subnet_member(p, "src_ip", subnets).select("pkt_id", "member").collect()
    assert sorted(inline) == sorted(joined)
    expected = {r.pkt_id: any(r.src_ip & m == n for _, n, m in listed) for r in p.collect()}
    assert dict(inline) == expected


def test_packets_without_an_address_are_in_no_net_on_either_path(spark, monkeypatch):
    subnets = spark.createDataFrame(
        [("responder", B, 4294967295), ("responder", 7 << 24, 255 << 24)], "kind string, net bigint, mask bigint"
    )
    p = spark.createDataFrame([(0, 0, 6, None, 9, 1, 2), (1, 0, 6, None, B, 1, 2), (2, 0, 6, B, None, 1, 2)], PACKETS)
    for limit in (200, 1):
        monkeypatch.setattr(nets, "MAX_INLINE", limit)
        bypass, tracked = nets.split_bypass(p, subnets)
        assert sorted(r.pkt_id for r in bypass.collect()) == [1, 2]
        assert [r.pkt_id for r in tracked.collect()] == [0]


def test_long_match_tables_use_joins_and_agree(spark, monkeypatch):
    table = spark.createDataFrame(
        [(0, 0, 0, 0, 0x80000000, 7, "low"), (1, 0x80000000, 0x80000000, 0, 0, 7, "high"),
         (2, 0, 0x40000000, 0, 0, 3, "first"), (3, 0, 0x40000000, 0, 0, 3, "never")],
        "pos int, src_val bigint, src_mask bigint, dst_val bigint, dst_mask bigint,"
        " priority int, action string",
    )
    p = packets(spark)
    inline = nets.ternary_match(p, table, "none").select("pkt_id", "action").collect()
    monkeypatch.setattr(nets, "MAX_INLINE", 1)
    joined = nets.ternary_match(p, table, "none").select("pkt_id", "action").collect()
    assert sorted(inline) == sorted(joined)
    assert {r.action for r in inline} == {"low", "high", "first", "none"}


def test_a_rule_for_everything_agrees_on_both_paths(spark, monkeypatch):
    table = spark.createDataFrame(
        [(0, 0, 0, 0, 0, 9, "any"), (1, 5, 0, 0, 0, 1, "never"), (2, 0x80000000, 0x80000000, 0, 0, 7, "high")],
        "pos int, src_val bigint, src_mask bigint, dst_val bigint, dst_mask bigint, priority int, action string",
    )
    p = packets(spark).unionByName(spark.createDataFrame([(999, 0, 6, None, 1, 1, 2)], PACKETS))
    inline = nets.ternary_match(p, table, "none").select("pkt_id", "action").collect()
    monkeypatch.setattr(nets, "MAX_INLINE", 1)
    assert sorted(inline) == sorted(nets.ternary_match(p, table, "none").select("pkt_id", "action").collect())
    assert {r.action for r in inline} == {"any", "high", "none"}


def test_messages_round_trip_when_one_flush_holds_most(spark):
    rows = [(RNG.randrange(0, 10_000), RNG.randrange(1 << 32), RNG.randrange(65536), 17) for _ in range(900)]
    rows += [(5_000, i, i % 65536, 6) for i in range(900)] + [(70_000, 1, 2, 6)]
    sent = spark.createDataFrame(rows, RULES)
    batches = wire.encode_rule_batches(sent, max_rules=400)
    sizes = sorted(r.n_rules for r in batches.collect())
    assert sizes == [1, 200, 400, 400, 400, 400]
    received, verdicts = wire.decode_rule_batches(batches)
    assert verdicts.filter(F.col("verdict") != "ok").count() == 0
    back = sorted((r.ip, r.port, r.proto) for r in received.collect())
    assert back == sorted(r[1:] for r in rows)


def test_packets_meet_rules_across_time_buckets(spark):
    width = 60_000_000
    spans = spark.createDataFrame(
        [(B, 80, 6, width - 5, width + 5), (B, 80, 6, 3 * width, 5 * width)],
        "ip bigint, port int, proto int, start_us bigint, end_us bigint",
    )
    times = [width - 6, width - 5, width + 4, width + 5, 3 * width, 5 * width - 1, 5 * width]
    p = spark.createDataFrame([(i, t, 6, B, 9, 80, 1) for i, t in enumerate(times)], PACKETS)
    inside = spark.createDataFrame([("internal", B, 4294967295)], "kind string, net bigint, mask bigint")
    suppressed, mirrored = rules.active_host_filter(p, spans, inside)
    assert sorted(r.pkt_id for r in suppressed.collect()) == [1, 2, 4, 5]
    assert sorted(r.pkt_id for r in mirrored.collect()) == [0, 3, 6]


B = 2193620993


def test_a_stray_time_makes_blocks_and_running_totals_carry_over_them(spark):
    df = spark.createDataFrame([(1, 0), (5, 2), (9000 * 4096, 3)], "at bigint, d bigint")
    grid = counters._grid(spark.createDataFrame([(3, 2 * counters.BLOCK + 5)], "a bigint, b bigint"))
    assert sorted(r.sample for r in grid.collect()) == list(range(3, 2 * counters.BLOCK + 6))
    totals = counters._with_totals(df.withColumnRenamed("at", "sample"), {"t": "d"}).collect()
    assert {r.sample: r.t for r in totals} == {1: 0, 5: 2, 9000 * 4096: 5}


def test_long_lifetimes_stay_ranges(spark):
    day = 86_400_000_000
    nets = spark.createDataFrame([("internal", 100 << 8, 0xFFFFFF00)], "kind string, net bigint, mask bigint")
    host, other = (100 << 8) + 1, (100 << 8) + 2
    lives = [(host, 5_000_000, day), (host, day - 3_000_000, day + 2_500_000), (host, 2 * day, 3 * day), (other, 0, 1)]
    lives = spark.createDataFrame(lives, "ip bigint, start_us bigint, end_us bigint")
    times = [0, 4_999_999, 5_000_000, day // 2, day, day + 2_400_000, day + 2_999_999, day + 3_000_000, 2 * day - 1, 2 * day, 3 * day - 1, 3 * day]
    packets = [(i, t, 7, host) for i, t in enumerate(times)] + [(50, 9_000_000, 7, other), (51, 9_100_000, other, 7)]
    packets = spark.createDataFrame(packets, "pkt_id bigint, ts_us bigint, src_ip bigint, dst_ip bigint")
    alive = {r.pkt_id for r in hosts.host_liveness(packets, lives, nets).collect() if r.host_alive}
    assert alive == {2, 3, 4, 5, 6, 9, 10, 50}
    ranges = hosts._live_ranges(lives.selectExpr("ip as dst_ip", "start_us div 1000000 as _a", "(end_us - 1) div 1000000 as _b"))
    assert ranges.count() < 300  # not a row for each of 172,799 seconds
