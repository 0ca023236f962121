"""Subnet membership, ternary matches and what follows from them per packet.

Subnet lists and match tables are configuration: a hundred rows at most in
practice. Up to MAX_INLINE rows become constants of the plan, so no packet is
shuffled or copied. Longer subnet lists become disjoint ranges and one join,
longer match tables equi-joins, one per distinct pair of masks.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MAX_INLINE = 200
#: All bits of an address, and the low ones that a bucket of ranges spans.
FULL, BUCKET_BITS = (1 << 32) - 1, 16


def _inline(table: DataFrame) -> list | None:
    """All rows of a small table, or None for a larger one."""
    rows = table.limit(MAX_INLINE + 1).collect()
    return rows if len(rows) <= MAX_INLINE else None


def nets_of(subnets: DataFrame, kind: str) -> DataFrame:
    return subnets.filter(F.col("kind") == kind).select("net", "mask").distinct()


def _is_prefix() -> Column:
    """The mask's zero bits are its lowest ones."""
    low = F.lit(FULL) - F.col("mask")
    return low.bitwiseAND(low + 1) == 0


def disjoint_ranges(nets: DataFrame) -> DataFrame:
    """(bucket, starts, ends): the addresses of all nets (prefix masks) as ascending ranges that do not touch.

    A row per bucket of 65,536 addresses. A net wider than a bucket is in each
    of its buckets, of which there are 65,536 at most whatever the list.
    """
    low, last = F.col("net"), F.col("net") + (F.lit(FULL) - F.col("mask"))
    number = lambda c: F.shiftright(c, BUCKET_BITS)
    parts = (
        nets.select(low.alias("_low"), last.alias("_last"), F.explode(F.sequence(number(low), number(last))).alias("bucket"))
        .select(
            "bucket",
            F.greatest("_low", F.shiftleft("bucket", BUCKET_BITS)).alias("start"),
            F.least("_last", F.shiftleft(F.col("bucket") + 1, BUCKET_BITS) - 1).alias("end"),
        )
        .groupBy("bucket", "start")
        .agg(F.max("end").alias("end"))
    )
    ordered = W.partitionBy("bucket").orderBy("start")
    reach = F.max("end").over(ordered.rowsBetween(W.unboundedPreceding, -1))
    apart = F.coalesce(F.col("start") > reach + 1, F.lit(True)).cast("int")
    return (
        parts.withColumn("_new", apart)
        .withColumn("_range", F.sum("_new").over(ordered))
        .groupBy("bucket", "_range")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy("bucket")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_ranges"))
        .select("bucket", F.col("_ranges.start").alias("starts"), F.col("_ranges.end").alias("ends"))
    )


def _in_ranges(df: DataFrame, ranges: DataFrame, flag: str, address: str) -> DataFrame:
    """One join on the bucket; the range is found by halving, as a bucket may hold 32,768."""
    side = ranges.select(F.col("bucket").alias("_bucket"), F.col("starts").alias("_starts"), F.col("ends").alias("_ends"))
    at = F.col(address)

    def halve(found: Column, step: Column) -> Column:
        more = found + step
        below = F.when(more <= F.size("_starts"), F.get("_starts", more - 1) <= at)
        return F.when(F.coalesce(below, F.lit(False)), more).otherwise(found)

    steps = F.array(*[F.lit(1 << i) for i in range(BUCKET_BITS - 1, -1, -1)])
    place = F.aggregate(steps, F.lit(0), halve)
    inside = F.coalesce(F.get("_ends", place - 1) >= at, F.lit(False))
    joined = df.join(side, F.shiftright(at, BUCKET_BITS) == F.col("_bucket"), "left")
    return joined.withColumn(flag, inside).drop("_bucket", "_starts", "_ends")


def with_membership(df: DataFrame, nets: DataFrame, **flags: str) -> DataFrame:
    """Add a boolean per `flag=address_column`: address in any of `nets`."""
    rows = _inline(nets)
    if rows is not None:
        by_mask: dict[int, list[int]] = {}
        for row in rows:
            by_mask.setdefault(row.mask, []).append(row.net)

        def inside(address: str) -> Column:
            hit = F.lit(False)
            for mask, values in sorted(by_mask.items()):
                hit = hit | F.col(address).bitwiseAND(mask).isin(values)
            return F.coalesce(hit, F.lit(False))  # no address is in no net

        return df.select("*", *[inside(address).alias(flag) for flag, address in flags.items()])
    listed = nets.filter(F.col("net").bitwiseAND(F.col("mask")) == F.col("net"))
    ranges = disjoint_ranges(listed.filter(_is_prefix()))
    masks = [r.mask for r in listed.filter(~_is_prefix()).select("mask").distinct().collect()]
    for flag, address in flags.items():
        df = _in_ranges(df, ranges, flag, address)
        for mask in masks:
            side = listed.filter(F.col("mask") == mask).select(F.col("net").alias("_net"), F.lit(True).alias("_hit"))
            df = df.join(side, F.col(address).bitwiseAND(mask) == F.col("_net"), "left")
            df = df.withColumn(flag, F.col(flag) | F.coalesce("_hit", F.lit(False))).drop("_net", "_hit")
    return df


def subnet_member(df: DataFrame, column: str, subnets: DataFrame, kind: str = "internal",
                  name: str = "member") -> DataFrame:
    return with_membership(df, nets_of(subnets, kind), **{name: column})


def split_bypass(p: DataFrame, subnets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bypass, tracked): traffic of responder nets skips flow tracking."""
    flagged = with_membership(p, nets_of(subnets, "responder"), _src="src_ip", _dst="dst_ip")
    bypass = F.col("_src") | F.col("_dst")
    return (
        flagged.filter(bypass).drop("_src", "_dst"),
        flagged.filter(~bypass).drop("_src", "_dst"),
    )


def assign_internal(p: DataFrame, subnets: DataFrame) -> DataFrame:
    """Internal end of each packet, source first; packets without one drop out."""
    flagged = with_membership(p, nets_of(subnets, "internal"), _src="src_ip", _dst="dst_ip")
    pick = F.when(F.col("_src"), F.col("src_ip")).otherwise(F.col("dst_ip"))
    port = F.when(F.col("_src"), F.col("src_port")).otherwise(F.col("dst_port"))
    return (
        flagged.filter(F.col("_src") | F.col("_dst"))
        .select("*", pick.alias("internal_ip"), port.alias("internal_port"))
        .drop("_src", "_dst")
    )


def ip_direction(p: DataFrame, subnets: DataFrame) -> DataFrame:
    flagged = with_membership(p, nets_of(subnets, "internal"), _src="src_ip", _dst="dst_ip")
    name = F.concat(
        F.when(F.col("_src"), "in").otherwise("out"),
        F.lit("->"),
        F.when(F.col("_dst"), "in").otherwise("out"),
    )
    return flagged.withColumn("direction", name).drop("_src", "_dst")


def ternary_match(p: DataFrame, match_rules: DataFrame, default: str) -> DataFrame:
    """Action of the best matching rule: lowest priority, then lowest pos."""
    src, dst = F.col("src_ip"), F.col("dst_ip")
    rows = _inline(match_rules)
    if rows is not None:
        action = None
        for r in sorted(rows, key=lambda r: (r.priority, r.pos)):
            hit = (src.bitwiseAND(r.src_mask) == r.src_val) & (
                dst.bitwiseAND(r.dst_mask) == r.dst_val
            )
            action = F.when(hit, r.action) if action is None else action.when(hit, r.action)
        action = F.lit(default) if action is None else action.otherwise(default)
        return p.withColumn("action", action)
    # Many rules, few mask pairs: keep the best rule per exact value, join per pair.
    pairs = match_rules.select("src_mask", "dst_mask").distinct().collect()
    order = F.struct("priority", "pos", "action")
    out, found = p, []
    for i, pair in enumerate(pairs):
        best = f"_best{i}"
        found.append(best)
        if pair.src_mask == 0 and pair.dst_mask == 0:
            # It asks for nothing: one rule for all packets with addresses, not one key for a join.
            anything = match_rules.filter("src_mask = 0 and dst_mask = 0 and src_val = 0 and dst_val = 0")
            rule = anything.agg(F.min(order).alias("r")).first().r
            if rule is None:
                found.pop()
                continue
            constant = F.struct(*[F.lit(rule[n]).cast(match_rules.schema[n].dataType).alias(n) for n in ("priority", "pos", "action")])
            out = out.withColumn(best, F.when(src.isNotNull() & dst.isNotNull(), constant))
            continue
        side = (
            match_rules.filter(
                (F.col("src_mask") == pair.src_mask) & (F.col("dst_mask") == pair.dst_mask)
            )
            .groupBy(F.col("src_val").alias("_sv"), F.col("dst_val").alias("_dv"))
            .agg(F.min(order).alias(best))
        )
        on = (src.bitwiseAND(pair.src_mask) == F.col("_sv")) & (
            dst.bitwiseAND(pair.dst_mask) == F.col("_dv")
        )
        out = out.join(side, on, "left").drop("_sv", "_dv")
    if not found:
        return out.withColumn("action", F.lit(default))
    winner = F.col(found[0]) if len(found) == 1 else F.least(*found)
    return out.withColumn("action", F.coalesce(winner["action"], F.lit(default))).drop(*found)


def mirror_session(p: DataFrame, sessions: DataFrame) -> DataFrame:
    """Mirror session by ingress port; ports without one mirror nothing."""
    return p.join(sessions, "ingress_port")
