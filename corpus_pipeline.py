"""A corpus pipeline: toxicity, near copies, benchmark passages, secrets, mixture.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written
as Parquet and read again as the docs of the next stage. All but the last give
the columns of docs. A stage judges all rows that its predecessor kept; rows
that repeat or have nulls are treated as the stage's operator says.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoless.llm import decontaminate, mixing, near_copies, secret_scan, toxicity
from echoless.llm.storage import stored

TOXIC_FROM = 0.7
_KEYS = ("__echoless_k", "__echoless_h")


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with two hashes that tell different rows (doc_id, text) apart."""
    return docs.withColumns({_KEYS[0]: F.xxhash64("doc_id", "text"), _KEYS[1]: F.xxhash64("text", "doc_id", F.lit(1))})


def _as_ids(keyed: DataFrame) -> DataFrame:
    """doc_id with both hashes in the place of doc_id, and text."""
    return keyed.select(F.struct("doc_id", *_KEYS).alias("doc_id"), "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below TOXIC_FROM; the model learns from the labels of the given documents."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = model.score(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"), "text"))
    return scored.filter(F.col("score") < TOXIC_FROM).select("kept.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id (a null one comes first).

    Near copies share 0.8 or more of their five-word shingles, directly or over others.
    """
    keyed = _keyed(docs)
    groups = near_copies.near_copies(_as_ids(keyed))
    first = groups.filter(F.col("doc_id") == F.col("component_id")).select("doc_id.*").select(*_KEYS).distinct()
    return keyed.join(first, list(_KEYS)).dropDuplicates(list(_KEYS)).select(docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    keyed = _keyed(docs)
    found = decontaminate.contamination(_as_ids(keyed), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.filter("n_hit > 0").select("doc_id.*").select(*_KEYS).distinct()
    return keyed.join(bad, list(_KEYS), "left_anti").select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with marks in the place of secrets and n_chars to match."""
    masked = secret_scan.mask_secrets(docs)
    return masked.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mixture takes."""
    return mixing.taken_words(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("secrets", mask_secrets),
    ("mixing", mix),
]
#: Trained models, fingerprints and winnowing are not SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
