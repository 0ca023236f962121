"""Net files -> subnet rows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ip_to_int, mask_of
from ..schema import SUBNETS


def parse_subnets(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`kind, file, line_no, value` lines -> (subnets, rejected lines).

    A line holds `a.b.c.d/bits`, `a.b.c.d/dotted-mask`, or an address whose mask
    is the next line. `#` starts a comment; blank lines are skipped. Zero bits
    match every address. Rejected are lines without a valid address and mask.
    """
    text = F.trim(F.regexp_replace("value", "#.*", ""))
    w = W.partitionBy("kind", "file").orderBy("line_no")
    slash = F.col("text").contains("/")
    # Bare lines pair up: the 1st, 3rd, ... since the last slash is an address.
    since = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    used = (
        lines.withColumn("text", text)
        .filter(F.col("text") != "")
        .withColumn("_block", F.sum(slash.cast("int")).over(since))
        .withColumn("_next", F.lead("text").over(w))
        .withColumn(
            "_nth",
            F.sum((~slash).cast("int")).over(
                W.partitionBy("kind", "file", "_block").orderBy("line_no")
                .rowsBetween(W.unboundedPreceding, W.currentRow)
            ),
        )
        .filter(slash | (F.col("_nth") % 2 == 1))
    )
    address = ip_to_int(F.split_part("text", F.lit("/"), F.lit(1)))
    mask = F.when(slash, mask_of(F.split_part("text", F.lit("/"), F.lit(2)))).otherwise(
        ip_to_int("_next")
    )
    in_bits = slash & ~F.split_part("text", F.lit("/"), F.lit(2)).contains(".")
    mask = F.when(in_bits & (address == 0), F.lit(0)).otherwise(mask)
    read = used.withColumns({"address": address, "mask": mask})
    valid = F.col("address").isNotNull() & F.col("mask").isNotNull()
    subnets = read.filter(valid).select(
        "kind", F.col("address").bitwiseAND(F.col("mask")).alias("net"), "mask"
    )
    return subnets.to(SUBNETS), read.filter(~valid).select("kind", "file", "line_no", "value")


def read_subnets(spark: SparkSession, path: str, kind: str, strict: bool = True) -> DataFrame:
    """Net files are configuration of a few lines, hence one row per file here.

    A line that is no net would turn internal hosts into external ones for
    every later query, so it is an error unless `strict` is off.
    """
    files = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    lines = files.select(
        F.lit(kind).alias("kind"),
        "file",
        F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"),
    )
    subnets, rejected = parse_subnets(lines)
    if strict and (bad := rejected.orderBy("file", "line_no").limit(5).collect()):
        shown = ", ".join(f"{r.file}:{r.line_no + 1}: {r.value!r}" for r in bad)
        raise ValueError(f"no address and mask in {shown}")
    return subnets
