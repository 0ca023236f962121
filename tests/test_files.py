"""Readers and sinks on real files."""

import os

import pytest
from pyspark.sql import functions as F

from echoless.functions import int_to_ip
from echoless.operators.status import iface_state, read_drop_log, read_status, status_total
from echoless.schema import CONTROLLER_FIELDS, STAT_FIELDS
from echoless.sources import nets, packets, sinks, statfiles


def test_net_file_forms(spark, tmp_path):
    path = tmp_path / "net.conf"
    path.write_text(
        "# internal\n\n10.1.2.3/24\n10.2.0.9/255.255.0.0\n10.3.3.3\n255.255.255.0\n"
        "1.2.3.4/0\n10.4.0.0/8 # note\n300.1.1.1/8\n10.0.0.0/33\n10.5.5.5\n255.255.255.255\n"
    )
    with pytest.raises(ValueError, match="300.1.1.1/8"):
        nets.read_subnets(spark, str(path), "internal")
    rows = nets.read_subnets(spark, str(path), "internal", strict=False).select(
        "kind", int_to_ip("net").alias("net"), int_to_ip("mask").alias("mask")
    ).collect()
    assert sorted((r.net, r.mask) for r in rows) == sorted([
        ("10.1.2.0", "255.255.255.0"), ("10.2.0.0", "255.255.0.0"),
        ("10.3.3.0", "255.255.255.0"), ("0.0.0.0", "0.0.0.0"), ("10.0.0.0", "255.0.0.0"),
        ("10.5.5.5", "255.255.255.255"),
    ])


def test_stats_files(spark, tmp_path):
    name = "enp1_pid42_HashSize1000_GCSize10_GCPeriod11_GCTimeout12.csv"
    numbers = ",".join("1.25" if f == "flow_hash_avg_probes" else "7" for f in STAT_FIELDS)
    (tmp_path / name).write_text(
        f"time,level,file,line,msg,{','.join(STAT_FIELDS)}\n12.000034,STATS,a.c,9,{numbers}\n"
    )
    (row,) = statfiles.read_stats_csv(spark, str(tmp_path)).collect()
    assert (row.iface, row.pid, row.hash_size, row.gc_timeout) == ("enp1", 42, 1000, 12)
    assert (row.ts_us, row.pkt_count, row.flow_hash_avg_probes) == (12_000_034, 7, 1.25)


def test_controller_and_trial_files(spark, tmp_path):
    report = tmp_path / "report.csv"
    cells = ["2024-01-01 00:00:00", "2.0"] + [str(i) for i in range(2, 28)]
    report.write_text(",".join(CONTROLLER_FIELDS) + "\n" + ",".join(cells) + "\n")
    (row,) = statfiles.read_controller_csv(spark, str(report)).collect()
    assert (row.group0, row.ring_dropped) == (3, 27)
    trials = tmp_path / "trials.csv"
    trials.write_text(
        "timestamp,batch_size,round,target_rules,installed_rules,dropped_rules,elapsed_sec,"
        "throughput_rules_per_sec,batch_fail_count\n2024-01-01 00:00:00,64,1,10,9,1,0.5,18.00,1\n"
    )
    (row,) = statfiles.read_trials(spark, str(trials)).collect()
    assert (row.batch_size, row.throughput, row.batch_fail) == (64, 18.0, 1)


def test_short_double_prints_like_c(spark):
    values = [0.0, 1.5, 100.0, 123456.7, 1234567.0, 0.00001, 2.0 / 3]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(statfiles.short_double(df.x)).collect()]
    assert got == ["%.6g" % v for v in values]


def test_status_of_a_run(spark, tmp_path):
    (tmp_path / "enp1.status").write_text("enp1  1 2 3 4 5 6 7 8 9 10 11 12 - 14\n")
    (tmp_path / "enp2.status").write_text("enp2  1 3000 4 5 6 7 8 9 10 11 12 13 14\n")
    (tmp_path / "total.status").write_text("TOTAL 1\n")
    over = "pkt buffer overflow: drop packet (count={})\n"
    (tmp_path / "enp1.log").write_text("start\n" + over.format(12) + over.format(9) + "end\n\n")
    (tmp_path / "enp3.log").write_text("died here\n")
    (tmp_path / "enp4.log").write_text("")
    status = read_status(spark, str(tmp_path))
    rows = {r.iface: r for r in status.collect()}
    assert (rows["enp1"].nic_pps, rows["enp1"].nic_oob_d, rows["enp1"].ruleq) == (2, None, 14)
    assert (rows["enp2"].nic_pps, rows["enp2"].nic_drx, rows["enp2"].pkt) == (12, 12, 3000)
    log = read_drop_log(spark, str(tmp_path))
    drops = {r.iface: (r.app_drop, r.last_line) for r in log.collect()}
    assert drops == {"enp1": (9, "end"), "enp3": (0, "died here")}
    totals = status_total(status, log)
    (total,) = totals.filter("iface = 'TOTAL'").collect()
    assert (total.pkt, total.nic_pps, total.nic_oob_d, total.app_drop) == (3003, 14, None, 9)

    ifaces = spark.createDataFrame([("enp1",), ("enp3",), ("enp4",)], "iface string")
    pids = spark.createDataFrame([("enp4", 7)], "iface string, pid bigint")
    now = rows["enp1"].updated_s + 4
    states = {r.iface: (r.state, r.last_line) for r in
              iface_state(ifaces, status, log, pids, now).collect()}
    assert states == {"enp1": ("STALE(4s)", None), "enp3": ("CRASHED", "died here"),
                      "enp4": ("NO_STATUS", None)}

    out = tmp_path / "out"
    for at in ("2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z", "2024-01-01T00:00:05Z"):
        sinks.write_rollup(totals, str(out), at)
    (line,) = sinks.latest_rollup(spark, str(out)).collect()
    cells = line.value.split()
    assert (cells[0], cells[3], cells[-1], len(cells)) == ("TOTAL", "3.0k", "SUM", 17)
    logged = [r.value for r in spark.read.text(f"{out}/total.log").select("value").sort("value").collect()]
    assert logged == [f"[{at}] {line.value}" for at in ("2024-01-01T00:00:00Z", "2024-01-01T00:00:05Z")]


def test_a_status_stays_readable_while_the_next_one_is_written(spark, tmp_path):
    row = spark.createDataFrame([("TOTAL", 1)], "iface string, n int")
    line = row.select("iface", F.concat(F.lit("T "), F.col("n").cast("string")).alias("value"))
    path = f"{tmp_path}/s"
    line.select("value", F.lit("2024-01-01T00:00:00Z").alias("at")).write.partitionBy("at").text(f"{path}/total.status")
    # What a writer has not committed yet stands in a folder that readers pass over.
    half = f"{path}/total.status/_temporary/0/task_1/at=2024-01-02T00%3A00%3A00Z"
    os.makedirs(half)
    with open(f"{half}/part-0.txt", "w") as f:
        f.write("T 2")
    assert [r.value for r in sinks.latest_rollup(spark, path).collect()] == ["T 1"]


def test_rules_written_twice_by_one_run_are_there_once(spark, tmp_path):
    path = str(tmp_path / "rules")
    rules = spark.createDataFrame([(1, 2, 3, 6), (5, 2, 3, 6)], "ts_us bigint, ip bigint, port int, proto int")
    for run in ("a", "a", "b"):
        sinks.write_rules(rules, path, run=run)
    assert sorted(tuple(r) for r in spark.read.parquet(path).groupBy("run").count().collect()) == [("a", 2), ("b", 2)]


def test_packets_of_many_interfaces(spark, tmp_path):
    df = spark.createDataFrame([(1, 5, 6, 1, 2, 3, 4)], packets.PACKETS)
    df.write.parquet(str(tmp_path / "a"))
    df.write.parquet(str(tmp_path / "b"))
    both = packets.read_packets(spark, {n: str(tmp_path / n) for n in "ab"})
    assert sorted(r.iface for r in both.collect()) == ["a", "b"]
    assert packets.read_packets(spark, str(tmp_path / "a"), streaming=True).isStreaming
