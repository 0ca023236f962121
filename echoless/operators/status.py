"""Status lines and process logs of all interfaces, and their rollup."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import compact_count
from ..schema import STATUS_FIELDS

NUMBERS = STATUS_FIELDS[1:]
# Printed widths of the TOTAL line, in order.
_WIDTHS = (10, 8, 8, 10, 8, 8, 9, 8, 10, 8, 8, 10, 10, 10, 5, 10, 12)

_DROP_PATTERN = r"pkt buffer overflow: drop packet \(count=([0-9]+)\)"


def parse_status(lines: DataFrame) -> DataFrame:
    """`value` lines of 15 columns, or 14 without nic_pps, which then is nic_drx.

    Cells that are no integer (`-`) become NULL. Other columns are kept.
    """
    cells = F.col("_cells")
    full = F.size(cells) >= len(STATUS_FIELDS)
    nic_drx = STATUS_FIELDS.index("nic_drx")

    def cell(i: int) -> Column:
        if i < 2:
            return F.get(cells, F.lit(i))
        older = nic_drx - 1 if i == 2 else i - 1
        return F.when(full, F.get(cells, F.lit(i))).otherwise(F.get(cells, F.lit(older)))

    def number(i: int) -> Column:
        return F.when(cell(i).rlike("^-?[0-9]+$"), cell(i)).try_cast("bigint")

    others = [c for c in lines.columns if c not in ("value", *STATUS_FIELDS)]
    return lines.withColumn("_cells", F.split(F.trim("value"), r"\s+")).select(
        *others,
        cell(0).alias("iface"),
        *[number(i).alias(name) for i, name in enumerate(STATUS_FIELDS) if i],
    )


def read_status(spark: SparkSession, directory: str) -> DataFrame:
    """Latest status line per interface with the time its file was written."""
    files = spark.read.text(f"{directory}/*.status", wholetext=True)
    lines = files.select(
        F.translate("value", "\r\n", "").alias("value"),
        F.unix_seconds("_metadata.file_modification_time").alias("updated_s"),
        F.regexp_extract("_metadata.file_name", r"^(.*)\.status$", 1).alias("_file"),
    )
    return parse_status(lines.filter(F.col("_file") != "total").drop("_file"))


def parse_drop_log(lines: DataFrame) -> DataFrame:
    """Per interface: last reported overflow count (else 0) and last log line."""
    count = F.regexp_extract("value", _DROP_PATTERN, 1).try_cast("bigint")
    filled = F.when(F.trim("value") != "", F.col("line_no"))
    return lines.groupBy("iface").agg(
        F.coalesce(
            F.max_by(count, F.when(count.isNotNull(), F.col("line_no"))), F.lit(0)
        ).alias("app_drop"),
        F.max_by("value", filled).alias("last_line"),
    )


def read_drop_log(spark: SparkSession, directory: str) -> DataFrame:
    """Split by Spark; the byte offset of a line in its file gives the order.

    An interface without any log line is absent here and counts as 0 drops.
    """
    lines = spark.read.text(f"{directory}/*.log").select(
        F.regexp_extract(F.input_file_name(), r"([^/]+)\.log$", 1).alias("iface"),
        "value",
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias(
            "line_no"
        ),
    )
    return parse_drop_log(lines.filter(F.col("iface") != "total"))


def iface_state(
    ifaces: DataFrame,
    status: DataFrame,
    log: DataFrame,
    pids: DataFrame,
    now_s,
    interval: float = 1,
) -> DataFrame:
    """OK, STALE(age), NO_STATUS (a process but no status) or CRASHED."""
    limit = max(3, 3 * int(interval))
    now = now_s if isinstance(now_s, Column) else F.lit(now_s)
    age = now - F.col("updated_s")
    state = (
        F.when(age > limit, F.concat(F.lit("STALE("), age.cast("string"), F.lit("s)")))
        .when(age.isNotNull(), "OK")
        .when(F.col("pid").isNotNull(), "NO_STATUS")
        .otherwise("CRASHED")
    )
    return (
        ifaces.select("iface")
        .join(status.select("iface", "updated_s"), "iface", "left")
        .join(log.select("iface", "app_drop", "last_line"), "iface", "left")
        .join(pids.select("iface", "pid"), "iface", "left")
        .select(
            "iface",
            state.alias("state"),
            F.coalesce("app_drop", F.lit(0)).alias("app_drop"),
            F.when(state == "CRASHED", F.col("last_line")).alias("last_line"),
        )
    )


def status_total(status: DataFrame, drops: DataFrame) -> DataFrame:
    """Status rows of all interfaces and a TOTAL row; NULL cells add nothing.

    Out-of-band drops are not summed.
    """
    is_total = F.grouping("iface") == 1
    sums = []
    for c in (*NUMBERS, "app_drop"):
        total = F.coalesce(F.sum(c), F.lit(0)) if c != "nic_oob_d" else F.lit(None)
        sums.append(F.when(is_total, total).otherwise(F.sum(c)).cast("bigint").alias(c))
    return (
        status.join(drops.select("iface", "app_drop"), "iface", "left")
        .withColumn("app_drop", F.coalesce("app_drop", F.lit(0)))
        .rollup("iface")
        .agg(is_total.alias("_total"), *sums)
        .select(F.when(F.col("_total"), "TOTAL").otherwise(F.col("iface")).alias("iface"), *NUMBERS, "app_drop")
    )


def total_line(totals: DataFrame) -> DataFrame:
    """The TOTAL row as the monitor prints it, in one `value` column."""
    names = [*NUMBERS, "app_drop"]
    short = F.transform(F.array(*[F.col(c).cast("string") for c in names]), compact_count)
    cells = [F.coalesce(F.get("_short", F.lit(i)), F.lit("-")) for i in range(len(names))]
    pattern = " ".join(["%-10s"] + [f"%{width}s" for width in _WIDTHS[1:]])
    return (
        totals.filter(F.col("iface") == "TOTAL")
        .select(short.alias("_short"))
        .select(F.format_string(pattern, F.lit("TOTAL"), *cells, F.lit("SUM")).alias("value"))
    )
