"""Packet tables and streams."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CLOCK_ORIGIN_US, PACKETS


def read_packets(
    spark: SparkSession, paths, streaming: bool = False, schema=PACKETS, **options
) -> DataFrame:
    """Packets of one or many interfaces.

    `paths` is a path, or a mapping from interface name to path, which adds an
    `iface` column. Streams read files as they arrive; `options` go to the
    reader, as maxFilesPerTrigger or maxBytesPerTrigger for a backlog.
    """

    def read(path: str) -> DataFrame:
        reader = spark.readStream if streaming else spark.read
        return reader.schema(schema).options(**options).parquet(path)

    if isinstance(paths, str):
        return read(paths)
    parts = [read(path).withColumn("iface", F.lit(name)) for name, path in paths.items()]
    return reduce(DataFrame.unionByName, parts)


def with_event_time(p: DataFrame) -> DataFrame:
    """Add `ts`, the packet clock as a TIMESTAMP for watermarks and windows."""
    return p.withColumn("ts", F.timestamp_micros(F.col("ts_us") + CLOCK_ORIGIN_US))
