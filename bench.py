"""Headline queries on one machine; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from echoless.plans import fixtures
from echoless.plans.catalog import QUERIES
from echoless.plans.storage import shared_dir
from echoless.sources.frames import decode_frames

HEADLINE = (
    "unanswered",
    "track_flows",
    "packet_events",
    "replied_services",
    "cooldown_dedup",
    "rule_intervals",
    "active_host_filter",
    "stats_snapshots",
    "decode_frames",
    "encode_rule_batches",
    "scanners",
    "answer_ratio",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    # Frames are read from a table, so that their decoding is timed and not their making.
    frames = shared_dir(spark)
    fixtures.frames(spark, sf_dir).write.parquet(frames)
    queries = QUERIES | {"decode_frames": lambda s, _: decode_frames(s.read.parquet(frames))}
    for name in HEADLINE:
        for _ in range(2):  # the first run warms up the JVM and Python workers
            began = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.time() - began, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
