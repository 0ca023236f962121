import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from echoless.llm import quality, toxicity
from echoless.llm.words import Slice, slices
from text_tables import DOCS, hard_docs, hard_rows

LABELS = "doc_id long, quality int, toxic int, n_chars long"


def features(texts, lexicon=()):
    rows = []
    for part in slices(pa.array(texts, pa.string()), toxicity._LETTER, limit=64):
        lower = Slice(part.row, toxicity._LOWER[part.data], part.offsets, toxicity._LETTER)
        rows.append(toxicity.features_of(lower, part.data, *(toxicity.Beginnings(x, w) for x, w in ((lexicon, False), (toxicity.INSULTS, False), (toxicity.SECOND_PERSON, True)))))
    return [dict(zip(toxicity.FEATURES, r)) for r in np.concatenate(rows)]


def test_toxicity_features():
    plain, insult, far, capital, hidden, learned, empty, none = features(
        ["A calm day.", "you are an Idiot", "you " + "and " * 9 + "idiot", "STOP IT NOW!!", "1di0t and mo*ron", "lowerix words", "", None], ("loweri",)
    )
    assert plain["fixed_hits"] == plain["learned_hits"] == 0 and plain["words"] == pytest.approx(np.log(4))
    assert insult["fixed_rate"] == 0.25 and insult["near_second_person"] == 1 and far["near_second_person"] == 0 and far["fixed_hits"] > 0
    assert capital["capital_words"] == 1 and capital["exclamations"] == pytest.approx(2 / 13) and plain["capital_words"] == 0
    assert hidden["hidden_hits"] == pytest.approx(np.log(2)) and hidden["fixed_hits"] == 0 and hidden["obfuscated_rate"] > 0
    assert learned["learned_rate"] == 0.5 and learned["fixed_rate"] == 0
    assert all(v == 0 for f in (empty, none) for v in f.values())


def corpus(n=900, seed=9):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(20, 60))]
        toxic, good = int(i % 5 == 0), int(i % 4 != 0)
        if toxic:
            words[3:3] = [rng.choice(["idiot", "gromph" + rng.choice("abcdefg")])] * 2
        if not good:
            words = [w + rng.choice(["!!", "%%%", "$$$"]) for w in words]
        rows.append((i, " ".join(words), "en" if good else "xx", f"s{i % 3}", len(words)))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, good, toxic, 1))
    labels += [(None, 1, 1, 1), (3, None, None, 1), (0, 0, 1, 1), (1 << 40, 1, 1, 1), (7, 5, 9, 1)]
    return rows, labels


def test_toxicity_of_documents_not_learned_from(spark):
    rows, labels = corpus()
    found = toxicity.score_toxicity(hard_docs(spark, rows + hard_rows()), spark.createDataFrame(labels, LABELS)).collect()
    assert len(found) == len(rows) + len(hard_rows())
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    texts = {r[1] for r in hard_rows()}
    judged = [(r.predicted, int(r.doc_id % 5 == 0)) for r in found if r.held_out and r.doc_id >= 100]
    assert sum(a == b for a, b in judged) / len(judged) >= 0.97 and texts


def test_labels_of_one_kind_or_none(spark):
    docs = hard_docs(spark)
    for labels in ([], [(1, 1, 0, 1), (2, 1, 0, 1)]):
        table = spark.createDataFrame(labels, LABELS)
        assert {r.score for r in toxicity.score_toxicity(docs, table).collect()} == {0.0}
        assert len({r.score for r in quality.score_quality(docs, table).collect()}) == 1
    empty = spark.createDataFrame([], DOCS)
    assert toxicity.score_toxicity(empty, table).count() == 0 and quality.score_quality(empty, table).count() == 0


def test_quality_of_documents_not_learned_from(spark):
    rows, labels = corpus()
    found = quality.score_quality(hard_docs(spark, rows + hard_rows()), spark.createDataFrame(labels, LABELS)).collect()
    assert len(found) == len(rows) + len(hard_rows())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    judged = [(r.predicted, int(r.doc_id % 4 != 0)) for r in found if r.held_out and r.doc_id >= 100]
    assert sum(a == b for a, b in judged) / len(judged) >= 0.97


def test_every_document_without_a_label_is_in_the_pool(spark):
    rows, labels = corpus()
    all_rows, labelled = rows + hard_rows(), {r[0] for r in labels if r[0] is not None and r[1] in (0, 1)}
    pool = quality.unlabelled_views(hard_docs(spark, all_rows), spark.createDataFrame(labels, LABELS)).collect()
    views = quality.with_views(hard_docs(spark, [r for r in all_rows if r[0] not in labelled]).select("doc_id", "text", "lang", "source", "n_chars"))
    assert sorted(map(str, pool)) == sorted(map(str, views.select("_a", "_b").collect()))


def test_sources_stay_apart(spark):
    rows = [(i, "a", "en", f"host{i}/x", 1) for i in range(1000)]
    views = quality.with_views(hard_docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars"))
    assert len({str(r._b) for r in views.select("_b").collect()}) >= 980


def test_given_labels_that_are_held_out(spark, sf_dir):
    d = sf_dir.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    good = quality.score_quality(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in good) / len(good) >= 0.95
    toxic = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.toxic for r in toxic) / len(toxic) >= 0.9
