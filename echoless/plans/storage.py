"""Where jobs put tables that other tasks read back."""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..streaming.ordered import rocksdb_state


def shared_dir(spark: SparkSession) -> str:
    """A new directory in the cluster's shared folder.

    The cluster names it in spark.checkpoint.dir. A session without one uses a
    folder in its warehouse, which is shared as well; never a machine's own
    temporary folder, which other executors could not read.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    base = base or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return f"{base.rstrip('/')}/echoless-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, for tables that several parts of a plan read."""
    root = shared_dir(df.sparkSession)
    df.write.parquet(root)
    return df.sparkSession.read.schema(df.schema).parquet(root)


def run_stream(stream: DataFrame, root: str | None = None) -> DataFrame:
    """Run a stream over all there is and read back what it wrote.

    With the same root a stream that ran before goes on where it stopped.
    """
    root = root or shared_dir(stream.sparkSession)
    with rocksdb_state(stream.sparkSession):
        query = _start(stream, root)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")


def _start(stream: DataFrame, root: str) -> StreamingQuery:
    return (
        stream.writeStream.format("parquet")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def run_in_steps(
    rows: DataFrame, build: Callable[[DataFrame], DataFrame], steps: int = 2, close_us: int = 3_600_000_000
) -> DataFrame:
    """Hand a bounded table to a stream in steps of rising `ts_us`, stop it after each, and close it.

    The close is a marker row, a time of close_us after the last one with NULL
    or zero elsewhere. It moves the watermark past all rows and is never
    settled itself, so nothing is left waiting in state.
    """
    spark, root = rows.sparkSession, shared_dir(rows.sparkSession)
    first, last = rows.agg(F.min("ts_us"), F.max("ts_us")).first()
    if first is None:
        first = last = 0
    width = (last - first) // steps + 1
    parts = [rows.filter(F.expr(f"(ts_us - {first}) div {width}") == i) for i in range(steps)]
    zero = [F.lit(0).cast(f.dataType).alias(f.name) if f.name != "ts_us" else F.lit(last + close_us).alias("ts_us") for f in rows.schema]
    for part in [*parts, spark.range(1).select(*zero)]:
        part.write.mode("append").parquet(f"{root}/in")
        out = run_stream(build(spark.readStream.schema(rows.schema).parquet(f"{root}/in")), root)
    return out
