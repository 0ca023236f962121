"""The queries of the text operators, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from echoless.llm import comparison, decontaminate, exact, html_text, licenses, merkle, mixing, negatives, neighbours, quality, repeats, secret_scan, simhash, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op2_mix_sources(spark, d):
    """Words that the mixture takes from every document."""
    taken = mixing.taken_words(_table(spark, d, "documents"))
    return taken.select("doc_id", "size", "source", "source_size", "target", "taken")


@_query
def op3_decontaminate(spark, d):
    """How much of every document stands in benchmark items too."""
    found = decontaminate.contamination(_table(spark, d, "documents"), _table(spark, d, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    n_items = F.col("n_items") + F.col("unnamed").cast("long")  # all items without an id are one, without a name
    return found.select("doc_id", "n_words", "n_hit", n_items.alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@_query
def op5_scan_secrets(spark, d):
    """Secrets of every document, and whether their values look live."""
    found = secret_scan.scan_secrets(_table(spark, d, "documents"))
    digest = F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", digest, F.col("lines").alias("spans"), "n_live", "n_example")


@_query
def op9_remove_repeats(spark, d):
    """What stays of every document when passages of earlier ones go."""
    found = repeats.remove_repeats(_table(spark, d, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@_query
def op1_near_duplicates(spark, d):
    """Fingerprint and group of near copies of every document."""
    found = simhash.near_duplicates(_table(spark, d, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


@_query
def op10_toxicity(spark, d):
    """Toxicity of every document."""
    return toxicity.score_toxicity(_table(spark, d, "documents"), _table(spark, d, "labels"))


@_query
def op7_extract_html(spark, d):
    """Main text of every page."""
    return html_text.extract(_table(spark, d, "pages"))


@_query
def op6_nearest_neighbours(spark, d):
    """The ten nearest rows of every hundredth row."""
    return neighbours.search(_table(spark, d, "embeddings"))


@_query
def op4_quality(spark, d):
    """Quality of every document."""
    return quality.score_quality(_table(spark, d, "documents"), _table(spark, d, "labels"))


@_query
def op8_scan_licenses(spark, d):
    """License texts and notices in every document."""
    found = licenses.scan_licenses(_table(spark, d, "documents"))
    return found.select(
        "doc_id", "n_words", F.size("found").cast("long").alias("n_found"), licenses.licenses_of().alias("licenses"),
        F.array_max(F.transform("found", lambda f: f.coverage)).alias("coverage"),
        F.array_join(F.transform("found", lambda f: F.concat_ws(":", f.license, f.begin, f.end)), ",").alias("spans"),
    )


@_query
def op11_hard_negatives(spark, d):
    """Rows of other labels that score nearly as high with an anchor as rows of its own."""
    vectors = _table(spark, d, "embeddings")
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", changed))


@_query
def op12_merkle_manifest(spark, d):
    """Leaf and proof of every document, and whether the document as received still gives the root."""
    found = merkle.document_manifest(_table(spark, d, "documents"))
    received = F.when(merkle.tampered(), F.col("changed_leaf")).otherwise(F.col("leaf"))
    siblings = F.sha2(F.array_join(F.transform("proof", lambda p: p.siblings), "").cast("binary"), 256)
    found = found.select("doc_id", "leaf", "subroot", "root", siblings.alias("proof_sha256"), merkle.folded(received).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


@_query
def op13_exact_duplicates(spark, d):
    """Which row of every group of equal texts stays."""
    return exact.exact_duplicates(_table(spark, d, "documents"))


@_query
def pipeline(spark, d):
    """The corpus after all stages of corpus_pipeline."""
    return corpus_pipeline.run(spark, d)


ORACLES["op3_decontaminate"] = comparison.BENCHMARK_PASSAGES
ORACLES["op9_remove_repeats"] = comparison.REPEATED_PASSAGES
ORACLES["op11_hard_negatives"] = comparison.HARD_NEGATIVES
ORACLES["op12_merkle_manifest"] = comparison.MERKLE_MANIFEST
ORACLES["op13_exact_duplicates"] = comparison.EQUAL_TEXTS
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
