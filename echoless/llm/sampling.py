"""Bounded samples of large tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def at_most(df: DataFrame, key: list[str], most: int, n_rows: int, seed: int = 0) -> DataFrame:
    """At most `most` of n_rows rows, the same ones each time: those with the smallest hashes of key.

    Rows are thinned first to about twice as many, so that however many tasks
    read df, few rows leave them to be put in order.
    """
    h = F.xxhash64(*key, F.lit(seed))
    share = min(1.0, 2 * most / max(n_rows, 1))
    return df.filter(F.pmod(h, F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy(h, *key).limit(most)
