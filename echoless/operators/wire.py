"""Rule messages: rules <-> binary batches, and the quality of received ones."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import (
    FLUSH_US,
    RULES_PER_MESSAGE,
    WIRE_HEADER_BYTES,
    WIRE_MAGIC,
    WIRE_OP_INSTALL,
    WIRE_RULE_BYTES,
    WIRE_VERSION,
)


def _hex(column: Column, digits: int) -> Column:
    return F.lpad(F.hex(column.cast("bigint")), digits, "0")


def _number(text: Column, byte, size: int) -> Column:
    """Big-endian unsigned number at a byte offset of a hex text."""
    at = byte * 2 + 1 if isinstance(byte, Column) else F.lit(byte * 2 + 1)
    return F.conv(F.substring(text, at, F.lit(size * 2)), 16, 10).cast("bigint")


def encode_rule_batches(
    rules: DataFrame, max_rules: int = RULES_PER_MESSAGE, flush_us: int = FLUSH_US
) -> DataFrame:
    """Messages of up to `max_rules` rules, flushed once per `flush_us`.

    A rule's place in its flush is its place within its microsecond plus the
    count of all earlier microseconds, so no task sorts a whole flush.
    """
    slot, at = "_flush", ["_flush", "ts_us"]
    stamped = rules.withColumn(slot, F.expr(f"ts_us div {flush_us}"))
    counts = stamped.groupBy(*at).agg(F.count("*").alias("_n"))
    earlier = W.partitionBy(slot).orderBy("ts_us").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*at, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy(*at).orderBy("ip", "port", "proto"))
    placed = (
        stamped.withColumn("_within", within)
        .join(offsets, at)
        .withColumn("_place", F.col("_before") + F.col("_within") - 1)
        .withColumn("message", F.expr(f"_place div {max_rules}"))
    )
    record = F.concat(
        _hex(F.col("proto"), 2), F.lit("00"), _hex(F.col("port"), 4), _hex(F.col("ip"), 8)
    )
    head = f"{WIRE_MAGIC:04X}{WIRE_VERSION:02X}{WIRE_OP_INSTALL:02X}"
    body = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col("_place"), record.alias("rec")))),
            lambda r: r["rec"],
        ),
        "",
    )
    return (
        placed.groupBy(slot, "message")
        .agg(F.count("*").alias("n_rules"), body.alias("_body"))
        .select(
            ((F.col(slot) + 1) * flush_us).alias("recv_us"),
            "message",
            "n_rules",
            F.unhex(
                F.concat(F.lit(head), _hex(F.col("n_rules"), 4), F.lit("0000"), F.col("_body"))
            ).alias("payload"),
        )
    )


def message_verdicts(datagrams: DataFrame) -> DataFrame:
    """Add `verdict` (ok, bad or trunc) and the announced `rule_count`."""
    text, size = F.hex("payload"), F.octet_length("payload")
    known = (
        (_number(text, 0, 2) == WIRE_MAGIC)
        & (_number(text, 2, 1) == WIRE_VERSION)
        & (_number(text, 3, 1) == WIRE_OP_INSTALL)
    )
    count = _number(text, 4, 2)
    verdict = (
        F.when(size < WIRE_HEADER_BYTES, "bad")
        .when(~known, "bad")
        .when(size != WIRE_HEADER_BYTES + WIRE_RULE_BYTES * count, "trunc")
        .otherwise("ok")
    )
    return datagrams.withColumn("verdict", verdict).withColumn(
        "rule_count", F.when(F.col("verdict") == "ok", count)
    )


def decode_rule_batches(datagrams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules, verdicts) of received messages; cut ones carry no rules."""
    verdicts = message_verdicts(datagrams)
    usable = (F.col("verdict") == "ok") & (F.col("rule_count") > 0)
    if "truncated" in datagrams.columns:
        usable = usable & ~F.col("truncated")
    text = F.hex("payload")
    start = WIRE_HEADER_BYTES + F.col("place") * WIRE_RULE_BYTES
    rules = (
        verdicts.filter(usable)
        .select(
            F.col("recv_us").alias("ts_us"),
            text.alias("_text"),
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rule_count") - 1)).alias("place"),
        )
        .select(
            "ts_us",
            _number(F.col("_text"), start + 4, 4).alias("ip"),
            _number(F.col("_text"), start + 2, 2).cast("int").alias("port"),
            _number(F.col("_text"), start, 1).cast("int").alias("proto"),
        )
    )
    return rules, verdicts


def datagram_quality(datagrams: DataFrame) -> DataFrame:
    """Message counts: a socket-cut one is trunc only; a message that yields no
    rule counts as dropped as well."""
    verdicts = message_verdicts(datagrams)
    cut = F.col("truncated")

    def verdict(name):
        return F.col("verdict") == name

    empty = F.coalesce(F.col("rule_count") == 0, F.lit(True))
    return verdicts.agg(
        F.count_if(~cut & verdict("ok")).alias("pkts_ok"),
        F.count_if(~cut & verdict("bad")).alias("pkts_bad"),
        F.count_if(cut | verdict("trunc")).alias("pkts_trunc"),
        F.count_if(~cut & empty).alias("sock_drop"),
        F.coalesce(F.sum(F.when(~cut, F.col("rule_count"))), F.lit(0)).alias("rules_in"),
    )
