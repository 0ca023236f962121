"""Sinks: what the collector, the rule installer and the monitor receive."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.status import total_line
from .packets import with_event_time


def _by_day(df: DataFrame) -> DataFrame:
    return with_event_time(df).withColumn("day", F.to_date("ts")).drop("ts")


def write_unanswered(df: DataFrame, path: str, checkpoint: str | None = None):
    """Write unanswered and bypass packets, a directory per day.

    A batch replaces the days that it has packets of, so it may run again. A
    stream appends and returns its query; give it a checkpoint location.
    """
    dated = _by_day(df)
    if not df.isStreaming:
        writer = dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        return writer.partitionBy("day").parquet(path)
    return (
        dated.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("day")
        .trigger(availableNow=True)
        .start()
    )


def write_rules(df: DataFrame, path: str, checkpoint: str | None = None, run: str = "batch"):
    """Write rules. A batch run owns the directory of its name and a stream's batch
    that of its number, so either replaces its own output when it runs again."""
    if not df.isStreaming:
        named = df.withColumn("run", F.lit(run))
        return named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        df.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def write_rollup(df: DataFrame, directory: str, at: str | None = None) -> None:
    """Write the TOTAL line as the status of the time `at`, and with its time to the log.

    Each status is a version of its own, which shows up when it is complete;
    latest_rollup reads the newest one, so there is always an old or a new one to
    read. Writing a time again replaces what it wrote. `at` is like
    2024-01-01T00:00:00Z; without it the time is now.
    """
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    one = total_line(df).coalesce(1).select("value", (F.lit(at) if at else now).alias("at"))
    dated = one.select(F.concat(F.lit("["), "at", F.lit("] "), "value").alias("value"), "at")
    for lines, name in ((dated, "total.log"), (one, "total.status")):
        writer = lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("at").text(f"{directory}/{name}")


def latest_rollup(spark: SparkSession, directory: str) -> DataFrame:
    """The newest status line that write_rollup has written."""
    lines = spark.read.schema("value string, at string").text(f"{directory}/total.status")
    return lines.select(F.max_by("value", "at").alias("value"))
