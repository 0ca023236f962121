import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from echoless.llm import toxicity
from test_llm_mixing import check
from test_llm_near_copies import brute
from test_llm_passages import brute_hits
from test_llm_secrets import base_spans
from text_tables import DOCS, hard_rows, same

ITEMS = "item_id string, text string, n_words long"


def rows():
    secret = [(200, "the password=0123456789abcdef01 here " + "k " * 5, "en", "a", 1), (201, "you stupid idiot", "en", "a", 1)]
    return hard_rows() + secret


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows(), DOCS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([("1", " ".join(hard_rows()[0][1].split()[:12]), 1)], ITEMS).write.parquet(f"{root}/benchmark.parquet")
    labels = [(r[0], 1, int(r[0] % 2 == 0)) for r in hard_rows() if r[0] is not None and r[0] > 19]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def table(spark, some):
    return spark.createDataFrame(some, DOCS)


def test_toxic_documents_go(spark, folder):
    docs = table(spark, rows())
    scored = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet")).score(docs)
    kept = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert kept.columns == docs.columns
    same(kept.select("doc_id").collect(), [(r.doc_id,) for r in scored.filter("score < 0.7").collect()])


def test_one_of_each_group_stays(spark, folder):
    kept = corpus_pipeline.drop_near_copies(spark, table(spark, rows()), folder)
    assert kept.dtypes == table(spark, rows()).dtypes
    group_of = {}
    for r, (_, component) in zip(rows(), brute(rows())):
        group_of[r[0], r[1]] = component if component is not None else ("none", r[1])
    groups = [group_of[r.doc_id, r.text] for r in kept.collect()]
    assert sorted(map(str, groups)) == sorted(map(str, set(group_of.values())))


def test_benchmark_passages_go(spark, folder):
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    kept = corpus_pipeline.drop_benchmark_passages(spark, table(spark, rows()), folder)
    same(kept.select("doc_id", "text").collect(), [(r[0], r[1]) for r, h in zip(rows(), brute_hits(rows(), items)) if not h[2]])


def test_secrets_are_masked_and_nothing_goes(spark, folder):
    kept = corpus_pipeline.mask_secrets(spark, table(spark, rows()), folder).collect()
    assert len(kept) == len(rows()) and not any(base_spans(r.text) for r in kept)
    assert all(r.n_chars == len(r.text) for r in kept if r.text is not None)


def test_mixture(spark, folder):
    check(corpus_pipeline.mix(spark, table(spark, rows()), folder).collect(), rows())


def test_run_is_its_stages_one_after_the_other(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        if i < 4:
            docs = spark.createDataFrame(docs.collect(), DOCS)
    same(corpus_pipeline.run(spark, folder).select("doc_id", "source", "size").collect(), [tuple(r) for r in docs.select("doc_id", "source", "size").collect()])


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_no_rows_and_clashing_columns(spark, folder, name, stage):
    more = {n: F.lit(1) for n in ("row_id", "fp", "size", "score", "kept", "spans", "_row", "features", "h")}
    empty = table(spark, []).withColumns(more)
    assert stage(spark, empty, folder).count() == 0
    some = table(spark, rows()[:9]).withColumns(more)
    out = stage(spark, some, folder)
    assert out.count() <= 9 and (name == "mixing" or out.columns == some.columns)
