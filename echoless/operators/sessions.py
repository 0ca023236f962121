"""Split the packets of a flow key at pauses that reset its state."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import flow_key
from ..schema import REPLY_TIMEOUT_US
from .spans import CHUNK_US


def split_sessions(
    p: DataFrame, gap_us: int = REPLY_TIMEOUT_US, chunk_us: int = CHUNK_US
) -> DataFrame:
    """Add the flow key and `session`, counted from 0 within the key.

    Pauses are found within (key, time chunk), so a busy key spreads over its
    chunks; what came before a chunk is added from one summary row per chunk.
    """
    key = ["proto", "ep_lo", "ep_hi"]
    group = [*key, "_chunk"]
    keyed = p.select("*", *flow_key()[1:]).withColumn(
        "_chunk", F.expr(f"(ts_us - pmod(ts_us, {chunk_us})) div {chunk_us}")
    )
    inner = W.partitionBy(*group).orderBy("ts_us", "pkt_id")
    pause = F.col("ts_us") - F.lag("ts_us").over(inner) >= gap_us
    local = keyed.withColumn("_break", F.coalesce(pause, F.lit(False)).cast("int")).withColumn(
        "_inner", F.sum("_break").over(inner.rowsBetween(W.unboundedPreceding, W.currentRow))
    )
    chunks = local.groupBy(*group).agg(
        F.min("ts_us").alias("_from"), F.max("ts_us").alias("_to"), F.sum("_break").alias("_breaks")
    )
    outer = W.partitionBy(*key).orderBy("_chunk")
    opens = F.coalesce(F.col("_from") - F.lag("_to").over(outer) >= gap_us, F.lit(False))
    before = F.coalesce(
        F.sum("_breaks").over(outer.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    starts = chunks.withColumn("_opens", opens.cast("int")).select(
        *group,
        (
            before + F.sum("_opens").over(outer.rowsBetween(W.unboundedPreceding, W.currentRow))
        ).alias("_before"),
    )
    return (
        local.join(starts, group)
        .withColumn("session", F.col("_before") + F.col("_inner"))
        .drop("_chunk", "_break", "_inner", "_before")
    )
