"""Host activity derived from rules and traffic."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import ACTIVE_HOST_US, SAMPLE_US
from .nets import nets_of, with_membership

#: Periods of a bucket in which packets meet the live ranges of their host.
_LIVE_BUCKET = 1024


def _at(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _live(as_of_us) -> Column:
    return (F.col("start_us") <= _at(as_of_us)) & (F.col("end_us") > _at(as_of_us))


def active_hosts(
    rules: DataFrame, intervals: DataFrame, as_of_us, active_us: int = ACTIVE_HOST_US
) -> DataFrame:
    """Hosts with a live rule, or a rule seen less than `active_us` ago."""
    seen = rules.filter(F.col("ts_us") <= _at(as_of_us)).select(
        "ip", F.col("ts_us").alias("_ts"), F.lit(0).alias("_flow")
    )
    live = intervals.filter(_live(as_of_us)).select(
        "ip", F.lit(None).cast("bigint").alias("_ts"), F.lit(1).alias("_flow")
    )
    return (
        seen.unionByName(live)
        .groupBy("ip")
        .agg(F.sum("_flow").alias("flow_count"), F.max("_ts").alias("last_rule_us"))
        .filter(
            (F.col("flow_count") > 0) | (_at(as_of_us) - F.col("last_rule_us") < active_us)
        )
    )


def active_host_bitmap(
    spark, intervals: DataFrame, base: int, as_of_us, as_text: bool = False
) -> DataFrame:
    """One 0/1 flag for each of the 65,536 addresses from `base` on."""
    live = (
        intervals.filter(_live(as_of_us))
        .select((F.col("ip") - base).alias("offset"))
        .filter(F.col("offset").between(0, 65535))
        .distinct()
        .withColumn("_hit", F.lit(1))
    )
    rows = (
        spark.range(65536)
        .select(F.col("id").alias("offset"))
        .join(live, "offset", "left")
        .select("offset", F.coalesce("_hit", F.lit(0)).alias("active"))
    )
    if not as_text:
        return rows
    flags = F.transform(F.array_sort(F.collect_list(F.struct("offset", "active"))), lambda r: r["active"])
    return rows.agg(F.array_join(flags.cast("array<string>"), "").alias("bitmap"))


def host_liveness(
    p: DataFrame, intervals: DataFrame, subnets: DataFrame, period_us: int = SAMPLE_US
) -> DataFrame:
    """External-to-internal packets, flagged when the target host is alive.

    A host is alive in a period when it sends in it or a rule of it is live.
    Lifetimes stay ranges of periods, one row for each bucket they reach into;
    a packet tests the few disjoint ranges of its host and bucket.
    """
    flagged = with_membership(
        p, nets_of(subnets, "internal"), _src="src_ip", _dst="dst_ip"
    ).withColumn("period", F.expr(f"ts_us div {period_us}"))
    senders = flagged.filter("_src").select(F.col("src_ip").alias("dst_ip"), "period")
    ruled = intervals.select(
        F.col("ip").alias("dst_ip"),
        F.expr(f"start_us div {period_us}").alias("_a"), F.expr(f"(end_us - 1) div {period_us}").alias("_b"),
    )
    alive = senders.distinct().select("dst_ip", F.col("period").alias("_a"), F.col("period").alias("_b"))
    bucket = F.expr(f"period div {_LIVE_BUCKET}")
    inside = F.exists("_ranges", lambda r: F.col("period").between(r["a"], r["b"]))
    return (
        flagged.filter("not _src and _dst")
        .drop("_src", "_dst")
        .withColumn("_bucket", bucket)
        .join(_live_ranges(alive.unionByName(ruled)), ["dst_ip", "_bucket"], "left")
        .withColumn("host_alive", F.coalesce(inside, F.lit(False)))
        .drop("_ranges", "_bucket")
    )


def _live_ranges(ranges: DataFrame) -> DataFrame:
    """The disjoint ranges of periods (arrays of a, b) of each host and bucket, from any ranges _a to _b."""
    first, last = F.col("_bucket") * _LIVE_BUCKET, (F.col("_bucket") + 1) * _LIVE_BUCKET - 1
    cut = ranges.withColumn("_bucket", F.explode(F.sequence(F.expr(f"_a div {_LIVE_BUCKET}"), F.expr(f"_b div {_LIVE_BUCKET}"))))
    # One row for each period of a bucket at most is put in order.
    cut = cut.groupBy("dst_ip", "_bucket", F.greatest("_a", first).alias("a")).agg(F.max(F.least("_b", last)).alias("b"))
    before = W.partitionBy("dst_ip", "_bucket").orderBy("a")
    reach = F.max("b").over(before.rowsBetween(W.unboundedPreceding, -1))
    new = F.coalesce(F.col("a") > reach + 1, F.lit(True)).cast("int")
    runs = cut.withColumn("_new", new).withColumn("_run", F.sum("_new").over(before))
    runs = runs.groupBy("dst_ip", "_bucket", "_run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return runs.groupBy("dst_ip", "_bucket").agg(F.collect_list(F.struct("a", "b")).alias("_ranges"))


def installed_per_host(intervals: DataFrame, as_of_us) -> DataFrame:
    return intervals.filter(_live(as_of_us)).groupBy("ip").agg(F.count("*").alias("n_rules"))
