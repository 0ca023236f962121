"""Counter, controller and trial files: CSV lines <-> typed rows."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CLOCK_ORIGIN_US, CONTROLLER_FIELDS, EPOCH_US, SAMPLE_US, STAT_DOUBLES, STAT_FIELDS, TRIAL_FILE

_LOG_PREFIX = ("time", "level", "file", "line", "msg")

STATS_LINE = T.StructType(
    [
        T.StructField("time", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("line", T.IntegerType()),
    ]
    + [
        T.StructField(name, T.DoubleType() if name in STAT_DOUBLES else T.LongType())
        for name in STAT_FIELDS
    ]
)
CONTROLLER_LINE = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("interval_cycle", T.DoubleType()),
    ]
    + [T.StructField(name, T.LongType()) for name in CONTROLLER_FIELDS[2:]]
)


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def parse_stats_csv(lines: DataFrame) -> DataFrame:
    """`path, value` lines of counter files -> one row per snapshot.

    A data line is `seconds.micros,level,file,line,` and the counters. Interface,
    process and sizing come from the file name.
    """
    name = F.regexp_extract("path", r"([^/]*_pid\d+_[^/]*)", 1)  # a file, or a folder of parts

    def sized(label: str) -> Column:
        return F.regexp_extract(name, rf"_{label}(\d+)", 1).try_cast("bigint")

    row = F.from_csv("value", _ddl(STATS_LINE))
    return (
        lines.filter(~F.col("value").startswith("time,") & (F.trim("value") != ""))
        .select(
            F.regexp_extract(name, r"^(.+)_pid\d+_", 1).alias("iface"),
            sized("pid").alias("pid"),
            sized("HashSize").alias("hash_size"),
            sized("GCSize").alias("gc_size"),
            sized("GCPeriod").alias("gc_period"),
            sized("GCTimeout").alias("gc_timeout"),
            row.alias("r"),
        )
        .select(
            "iface", "pid", "hash_size", "gc_size", "gc_period", "gc_timeout",
            (F.col("r.time").cast("decimal(20,6)") * 1000000).cast("bigint").alias("ts_us"),
            F.trim("r.level").alias("level"),
            *[F.col(f"r.{c}") for c in STAT_FIELDS],
        )
    )


def read_stats_csv(spark: SparkSession, run_dir: str) -> DataFrame:
    lines = spark.read.text(f"{run_dir}/*_pid*.csv")
    return parse_stats_csv(lines.select("value", F.input_file_name().alias("path")))


def parse_controller_csv(lines: DataFrame) -> DataFrame:
    row = F.from_csv("value", _ddl(CONTROLLER_LINE)).alias("r")
    return lines.filter(~F.col("value").startswith("timestamp,")).select(row).select("r.*")


def read_controller_csv(spark: SparkSession, path: str) -> DataFrame:
    """Report files, with or without their line of names."""
    return parse_controller_csv(spark.read.text(path))


def parse_trials(lines: DataFrame) -> DataFrame:
    row = F.from_csv("value", _ddl(TRIAL_FILE)).alias("r")
    return _named_trials(
        lines.filter(~F.col("value").startswith("timestamp,")).select(row).select("r.*")
    )


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    return _named_trials(spark.read.csv(path, schema=TRIAL_FILE, header=True))


def _named_trials(raw: DataFrame) -> DataFrame:
    return raw.select(
        "batch_size", "round", "target_rules", "installed_rules", "dropped_rules", "elapsed_sec",
        F.col("throughput_rules_per_sec").alias("throughput"),
        F.col("batch_fail_count").alias("batch_fail"),
    )


def short_double(c: Column) -> Column:
    """Six significant digits without trailing zeros, as C prints `%.6g`."""
    plain = F.format_string("%.6g", c)
    trimmed = F.regexp_replace(plain, r"(\.\d*?)0+(?=e|$)", "$1")
    return F.regexp_replace(trimmed, r"\.(?=e|$)", "")


def _printed(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit("")
    printed = short_double(F.col(name)) if name in STAT_DOUBLES else F.col(name).cast("string")
    return F.coalesce(printed, F.lit(""))


def format_stats(df: DataFrame, fmt: str = "kv") -> DataFrame:
    """Snapshots as `name=value` rows (kv) or one CSV line each (csv).

    Counters that the snapshot does not have are left empty, and so read back as NULL.
    """
    keep = [c for c in ("iface", "ts_us") if c in df.columns]
    values = [_printed(df, name) for name in STAT_FIELDS]
    if fmt == "csv":
        return df.select(*keep, F.concat_ws(",", *values).alias("line"))
    if fmt != "kv":
        raise ValueError(f"unknown format {fmt!r}")
    pairs = F.array(*[
        F.concat(F.lit(f"{name}="), value) for name, value in zip(STAT_FIELDS, values)
    ])
    return df.select(*keep, F.posexplode(pairs).alias("pos", "line"))


def format_controller_csv(report: DataFrame, epoch_us: int = EPOCH_US) -> DataFrame:
    """Report rows as 28-column lines; columns that the report does not have are empty.

    `sec` becomes a time in UTC; the cycle is the epoch's length in seconds.
    """
    at = F.timestamp_micros(F.col("sec") * SAMPLE_US + CLOCK_ORIGIN_US)
    known = {
        "timestamp": F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd HH:mm:ss"),
        "interval_cycle": F.lit(str(epoch_us / 1_000_000)),
    }
    cells = [
        known[name]
        if name in known
        else F.coalesce(F.col(name).cast("string") if name in report.columns else F.lit(None).cast("string"), F.lit(""))
        for name in CONTROLLER_FIELDS
    ]
    return report.select(F.concat_ws(",", *cells).alias("value"))
