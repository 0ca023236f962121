"""Reports over unanswered traffic: radiation, dead services, scans, faults."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import proto_name
from ..operators.nets import nets_of, with_membership

_TARGET = ["dst_ip", "dst_port", "proto"]


def _window(width_us: int) -> Column:
    return F.expr(f"ts_us - pmod(ts_us, {width_us})").alias("window_us")


def radiation_split(u: DataFrame, subnets: DataFrame, window_us: int) -> DataFrame:
    """Unanswered packets by side of the sender, protocol and window."""
    flagged = with_membership(u, nets_of(subnets, "internal"), _src="src_ip")
    side = F.when(F.col("_src"), "internal").otherwise("external").alias("initiator")
    return flagged.groupBy(_window(window_us), side, proto_name("proto").alias("proto")).agg(
        F.count("*").alias("n")
    )


def dead_services(starts: DataFrame) -> DataFrame:
    """Services that were asked and never answered anyone."""
    per_client = starts.groupBy(*_TARGET, "src_ip").agg(
        F.count_if(F.col("status") == "unanswered").alias("_lost"),
        F.count_if(F.col("status") == "replied").alias("_answered"),
    )
    return (
        per_client.groupBy(*_TARGET)
        .agg(
            F.sum("_lost").alias("requests"),
            F.count_if(F.col("_lost") > 0).alias("clients"),
            F.sum("_answered").alias("_answered"),
        )
        .filter((F.col("_answered") == 0) & (F.col("requests") > 0))
        .drop("_answered")
    )


def scanners(u: DataFrame, min_targets: int, k: int) -> DataFrame:
    """Top k senders by distinct targets that never answered them.

    Distinct targets are formed first, so a sender's share of the second step
    is one count per task.
    """
    targets = u.groupBy("src_ip", "dst_ip", "dst_port").agg(F.count("*").alias("_n"))
    return (
        targets.groupBy("src_ip")
        .agg(F.count("*").alias("targets"), F.sum("_n").alias("packets"))
        .filter(F.col("targets") >= min_targets)
        .orderBy(F.desc("targets"), "src_ip")
        .limit(k)
    )


def misconfigured_hosts(
    u: DataFrame, subnets: DataFrame, min_windows: int, window_us: int
) -> DataFrame:
    """Internal senders that ask one silent target in many windows."""
    flagged = with_membership(u, nets_of(subnets, "internal"), _src="src_ip").filter("_src")
    per_window = flagged.groupBy("src_ip", *_TARGET, _window(window_us)).agg(
        F.count("*").alias("_n")
    )
    return (
        per_window.groupBy("src_ip", *_TARGET)
        .agg(F.count("*").alias("windows"), F.sum("_n").alias("packets"))
        .filter(F.col("windows") >= min_windows)
    )


def answer_ratio(starts: DataFrame, subnets: DataFrame, window_us: int) -> DataFrame:
    """Share of answered requests per internal service and window."""
    asked = with_membership(starts, nets_of(subnets, "internal"), _dst="dst_ip").filter("_dst")
    return (
        asked.filter(F.col("status") != "open")
        .groupBy(_window(window_us), *_TARGET)
        .agg(
            F.count_if(F.col("status") == "replied").alias("replied"),
            F.count_if(F.col("status") == "unanswered").alias("unanswered"),
        )
        .withColumn("ratio", F.col("replied") / (F.col("replied") + F.col("unanswered")))
    )
