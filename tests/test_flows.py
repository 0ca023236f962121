"""The flow rules one by one, and properties that must always hold."""

import pytest
from pyspark.sql import functions as F

from echoless.operators.flows import flow_starts, packet_events, track_flows, unanswered
from echoless.plans import fixtures
from echoless.schema import PACKETS

A, B, C = 167772161, 167772162, 167772163


def packets(spark, rows):
    """rows: (ts_us, src, dst) or (ts_us, src, dst, sport, dport)."""
    full = [
        (i, r[0], 6, r[1], r[2], *(r[3:] or ((1000, 80) if r[1] == A else (80, 1000))))
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(full, PACKETS)


CASES = {
    "reply just in time": ([(0, A, B), (999_999, B, A)], ["created", "replied"]),
    "reply at the limit": ([(0, A, B), (1_000_000, B, A)], ["created", "created"]),
    "repeat does not refresh": (
        [(0, A, B), (600_000, A, B), (1_000_000, A, B)], ["created", "dup_request", "created"]
    ),
    "linger is refreshed": (
        [(0, A, B), (10, B, A), (200_009, A, B), (400_008, B, A)],
        ["created", "replied", "linger", "linger"],
    ),
    "linger ends at the limit": (
        [(0, A, B), (10, B, A), (200_010, B, A)], ["created", "replied", "created"]
    ),
    "equal times go by id": ([(5, A, B), (5, B, A)], ["created", "replied"]),
    "own address never replies": (
        [(0, A, A, 7, 7), (10, A, A, 7, 7)], ["created", "dup_request"]
    ),
    "other port is another flow": (
        [(0, A, B), (10, B, A, 81, 1000)], ["created", "created"]
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_packet_events(spark, name):
    rows, expected = CASES[name]
    events = packet_events(packets(spark, rows)).orderBy("pkt_id").collect()
    assert [e.event for e in events] == expected


def test_clock_is_global(spark):
    rows = [(0, A, B), (500_000, A, C), (1_000_000, C, A, 5, 6)]
    status = {r.pkt_id: r.status for r in flow_starts(packets(spark, rows)).collect()}
    assert status == {0: "unanswered", 1: "open", 2: "open"}


def test_icmp_ignores_ports(spark):
    rows = [(0, 0, 1, A, B, 8, 0), (1, 10, 1, B, A, 3, 3)]
    flows = track_flows(spark.createDataFrame(rows, PACKETS)).collect()
    assert [(f.status, f.reply_ts, f.end_ts) for f in flows] == [("replied", 10, 200_010)]


def test_interfaces_keep_their_own_state(spark):
    p = packets(spark, [(0, A, B), (10, B, A)]).withColumn(
        "iface", F.when(F.col("pkt_id") == 0, "x").otherwise("y")
    )
    assert track_flows(p).count() == 1
    assert track_flows(p, by=("iface",)).count() == 2


@pytest.mark.parametrize("chunk_us", [1_000_000, 7_000_001])
def test_counts_add_up_for_any_chunk_and_order(spark, sf_dir, chunk_us):
    p = fixtures.packets(spark, sf_dir).orderBy(F.rand(3)).repartition(5)
    flows = track_flows(p, chunk_us=chunk_us).groupBy("status").agg(
        F.count("*").alias("n"), F.sum("n_dup").alias("dup"), F.sum("n_linger").alias("linger")
    )
    by_status = {r.status: r for r in flows.collect()}
    assert {s: r.n for s, r in by_status.items()} == {"replied": 435, "unanswered": 385, "open": 3}
    dup = sum(r.dup for r in by_status.values())
    linger = sum(r.linger for r in by_status.values())
    assert (dup, linger) == (634, 498)
    assert 823 + dup + linger + 435 == p.count()
    assert unanswered(p, chunk_us=chunk_us).count() == 385
