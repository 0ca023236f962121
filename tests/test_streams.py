"""Streams give the batch results, whatever the order of arrival."""

import random

from pyspark.sql import functions as F

from brute import fold
from echoless.operators import rules
from echoless.plans.storage import run_in_steps, run_stream
from echoless.sources import packets, sinks
from echoless.streaming import jobs
from echoless.streaming.ordered import BUCKETS, LateRows


def write_files(spark, rows, path, size):
    """One parquet file per micro-batch, in arrival order."""
    for i in range(0, len(rows), size):
        part = spark.createDataFrame(rows[i:i + size], packets.PACKETS).coalesce(1)
        part.write.mode("append").parquet(path)


def stream_of(spark, path):
    reader = spark.readStream.schema(packets.PACKETS).option("maxFilesPerTrigger", 1)
    return packets.with_event_time(reader.parquet(path))


def test_disorder_within_the_watermark(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for i in range(240):
        a, b = (1, 2) if rng.random() < 0.7 else (2, 1)
        key = rng.randrange(6)
        ts = i * 40_000 + rng.randrange(40_000)
        rows.append((i, ts, 17, 100 * key + a, 100 * key + b, 5 if a == 1 else 6, 6 if a == 1 else 5))
    rows.append((999, 30_000_000, 17, 9001, 9002, 5, 6))  # moves the watermark on
    arrival = sorted(rows, key=lambda r: r[1] + rng.randrange(900_000))
    path = str(tmp_path / "in")
    write_files(spark, arrival, path, 60)
    out = run_stream(jobs.track_flows_stream(stream_of(spark, path), "1 second")).collect()
    got = {(r.first_pkt_id, r.status, r.t0, r.reply_ts) for r in out}
    expected_roles = fold(
        [((min(r[3:5]), max(r[3:5])), r[1], r[0], int(r[3] > r[4])) for r in rows],
        1_000_000, 200_000,
    )
    expected = {
        (rid, "replied" if reply is not None else "unanswered", t0, reply)
        for rid, (role, t0, _, reply) in expected_roles.items()
        if role == "created" and rid != 999
    }
    assert got == expected


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    # Spark judges a batch by the watermark that the batch before it began with.
    rows = [(0, 0, 6, 1, 2, 3, 4), (1, 60_000_000, 6, 1, 2, 3, 4), (4, 61_000_000, 6, 9, 10, 3, 4),
            (2, 1_000, 6, 7, 8, 3, 4), (3, 120_000_000, 6, 1, 2, 3, 4)]
    path = str(tmp_path / "in")
    for row in rows:
        write_files(spark, [row], path, 1)
    late = LateRows()
    spark.streams.addListener(late)
    query = (
        jobs.track_flows_stream(stream_of(spark, path), "1 second")
        .writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    assert late.of(query) == 1
    spark.streams.removeListener(late)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.first_pkt_id for r in out) == [0, 1, 4]


def test_lifetimes_are_those_of_the_batch_however_rows_come(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(400) * 10_000, rng.randrange(3), 80, 6, rng.random() < 0.15) for _ in range(300)]
    activity = spark.createDataFrame(rows, "ts_us long, ip long, port int, proto int, is_rule boolean")
    of = lambda rule: activity.filter(F.col("is_rule") == rule).drop("is_rule")
    expected = sorted(rules.rule_intervals(of(True), of(False), 60_000).collect())
    assert any(r.n_hits for r in expected) and any(not r.n_hits for r in expected)
    for steps in (2, 9):
        out = run_in_steps(activity, lambda a: jobs.rule_sessions_stream(packets.with_event_time(a), ttl_us=60_000), steps)
        assert sorted(out.collect()) == expected


def test_stream_sinks(spark, tmp_path):
    path = str(tmp_path / "in")
    write_files(spark, [(i, i, 6, 1, 2, 3, 4) for i in range(4)], path, 2)
    packets_in = stream_of(spark, path).drop("ts")
    sinks.write_unanswered(packets_in, str(tmp_path / "u"), str(tmp_path / "c1")).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "u"))
    assert stored.count() == 4
    assert {str(r.day) for r in stored.select("day").distinct().collect()} == {"2024-01-01"}
    rules = packets_in.select("ts_us", F.col("src_ip").alias("ip"))
    sinks.write_rules(rules, str(tmp_path / "r"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "r")).count() == 4


def test_many_keys_share_few_groups(spark, tmp_path):
    rng = random.Random(12)
    rows = []
    for i in range(6_000):
        a, b = rng.choice([(1, 2), (2, 1)])
        key = rng.randrange(2_500) if i % 4 else 0
        rows.append((i, rng.randrange(12_000_000), 6, 100 * key + a, 100 * key + b, 5 if a == 1 else 6, 6 if a == 1 else 5))
    rows.append((9_999, 60_000_000, 6, 900_001, 900_002, 5, 6))  # moves the watermark on
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_files(spark, sorted(rows, key=lambda r: r[1]), path, 2_000)
    query = (
        jobs.track_flows_stream(stream_of(spark, path)).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    groups = [s.numRowsTotal for p in query.recentProgress for s in p.stateOperators]
    assert max(groups) <= BUCKETS < 2_500
    got = {(r.first_pkt_id, r.status, r.t0, r.reply_ts) for r in spark.read.parquet(out).collect()}
    expected_roles = fold([((min(r[3:5]), max(r[3:5])), r[1], r[0], int(r[3] > r[4])) for r in rows], 1_000_000, 200_000)
    assert got == {
        (rid, "replied" if reply is not None else "unanswered", t0, reply)
        for rid, (role, t0, _, reply) in expected_roles.items() if role == "created" and rid != 9_999
    }


def test_cooldowns_are_those_of_the_batch_however_rows_come(spark):
    rng = random.Random(13)
    rows = [(rng.randrange(900) * 10_000, rng.randrange(40), 80, 6) for _ in range(900)]
    rows += [(rng.randrange(900) * 10_000, None, 80, 6) for _ in range(60)]
    made = spark.createDataFrame(rows, "ts_us long, ip long, port int, proto int")
    out = run_in_steps(made, lambda r: jobs.cooldown_stream(packets.with_event_time(r), cooldown_us=700_000), 3)
    expected, last = [], {}
    for ts, *key in sorted(rows, key=lambda r: r[0]):
        if ts >= last.get(tuple(key), -(10**9)) + 700_000:
            last[tuple(key)] = ts
            expected.append((ts, *key))
    assert sorted(out.collect(), key=str) == sorted(expected, key=str)
