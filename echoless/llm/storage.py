"""Cutting the lineage of a table that is read more than once."""

from pyspark.sql import DataFrame

from echoless.plans.storage import shared_dir


def stored(df: DataFrame) -> DataFrame:
    """Write df to the cluster's shared folder and read it back.

    What is read back survives the loss of executors, and columns that are not
    needed are not read.
    """
    root = shared_dir(df.sparkSession)
    df.write.parquet(root)
    return df.sparkSession.read.schema(df.schema).parquet(root)
