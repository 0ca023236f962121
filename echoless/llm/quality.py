"""Quality classifier by co-training.

Two views of a document, its text and its metadata, have a classifier each. In
every round each classifier labels the unlabelled documents that it is most
sure of, for the other one to learn from. At last both are calibrated on
labelled documents that neither has learned from, and their odds are combined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import FeatureHasher
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoless.llm.storage import stored
from echoless.llm.toxicity import held_out, labelled_sample
from echoless.llm.words import SPACES, byte_powers, mix, slices

TEXT_FEATURES = (
    "words", "word_bytes", "distinct", "repeated", "capitals", "digits", "marks", "exclamations", "pipes",
    "sentence_ends", "short_words", "lines",
)
_CLASSES = (range(0x41, 0x5B), range(0x30, 0x3A), map(ord, "#$%&*@^_~<>{}[]\\"), b"!", b"|")


def _table(values) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(values)] = True
    return table


_TABLES = [_table(c) for c in _CLASSES]


def _text_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.zeros((0, len(TEXT_FEATURES)))]
        for part in slices(batch.column("text"), SPACES):
            hashes = part.hashes(byte_powers())
            rows = len(part.counts)

            def share(flags: np.ndarray, bounds: np.ndarray, of: np.ndarray) -> np.ndarray:
                sums = np.concatenate([[0], np.cumsum(flags)])
                return (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(of, 1)

            each = np.unique(mix(hashes ^ mix(part.doc.astype(np.uint64), 7)), return_index=True)[1]
            distinct = np.bincount(part.doc[each], minlength=rows) / np.maximum(part.counts, 1)
            again = np.append(False, (hashes[1:] == hashes[:-1]) & (part.doc[1:] == part.doc[:-1]))[: len(hashes)]
            size, length = np.diff(part.offsets), part.ends - part.starts
            ends = np.isin(part.data[part.ends - 1], list(b".!?")) if len(length) else np.zeros(0, bool)
            found.append(np.stack([
                np.log1p(part.counts), share(length, part.first, part.counts), distinct, share(again, part.first, part.counts),
                *(share(t[part.data], part.offsets, size) for t in _TABLES),
                share(ends, part.first, part.counts), share(length <= 3, part.first, part.counts), share(part.data == 0x0A, part.offsets, part.counts),
            ], axis=1))
        values = np.concatenate(found)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * len(TEXT_FEATURES), pa.int32()), pa.array(values.ravel()))
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, names), lists], names=[*names, "_text"])


_HASHER = dict(inputCols=["_lang", "_source", "_length"], outputCol="_b", numFeatures=1 << 16)


def with_views(docs: DataFrame) -> DataFrame:
    """docs (with text, lang, source, n_chars) without these four, but with a vector of each view: _a (text), _b (metadata)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    meta = docs.withColumns({"_lang": text("lang"), "_source": text("source"), "_length": F.log1p(F.greatest(F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)), F.lit(0.0)))})
    meta = meta.drop("lang", "source", "n_chars")
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in meta.schema if f.name != "text")
    both = meta.mapInArrow(_text_features, f"{ddl}_text array<double>").withColumn("_a", array_to_vector("_text"))
    return FeatureHasher(**_HASHER).transform(both).drop("_text", *_HASHER["inputCols"])


def unlabelled_views(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Both views of every row of docs whose doc_id has no quality label. Texts are turned to vectors before the join."""
    views = with_views(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    return views.join(labels.filter("quality in (0, 1)").select("doc_id"), "doc_id", "left_anti").select("_a", "_b")


def _fit_view(rows: DataFrame, view: str) -> Model:
    model = LogisticRegression(featuresCol=f"_{view}", labelCol="label", predictionCol=f"_{view}_said", maxIter=30, regParam=0.001)
    return model.setProbabilityCol(f"_{view}_probability").setRawPredictionCol(f"_{view}_margin").fit(rows)


def _sure_of(model: Model, rows: DataFrame, view: str) -> DataFrame:
    scored = model.transform(rows).withColumn(f"_{view}_p", vector_to_array(f"_{view}_probability")[1])
    return scored.drop(f"_{view}_probability", f"_{view}_margin", f"_{view}_said")


@dataclass
class QualityModel:
    """Both classifiers with their calibration; without them (labels of one kind only) every score is base."""

    views: dict[str, tuple[Model, Model]]
    base: float

    def score(self, docs: DataFrame) -> DataFrame:
        """docs (row: a struct to keep; text, lang, source, n_chars) to row, text_score, metadata_score, score."""
        if not self.views:
            same = F.lit(self.base)
            return docs.select("row", same.alias("text_score"), same.alias("metadata_score"), same.alias("score"))
        rows = with_views(docs)
        for view, (classifier, calibration) in self.views.items():
            rows = calibration.transform(_sure_of(classifier, rows, view))
        odds = lambda p: F.log(p / (1 - p))
        inside = lambda c: F.least(F.greatest(F.col(c), F.lit(0.001)), F.lit(0.999))
        # Views that say their own about a document: their odds multiply, and the prior they share counts once.
        sum_ = odds(inside("_a_calibrated")) + odds(inside("_b_calibrated")) - odds(F.lit(min(max(self.base, 0.001), 0.999)))
        return rows.select("row", F.col("_a_calibrated").alias("text_score"), F.col("_b_calibrated").alias("metadata_score"), (1 / (1 + F.exp(-sum_))).alias("score"))


def fit(docs: DataFrame, labels: DataFrame, most: int = 16_000, rounds: int = 3, sure: float = 0.95, seed: int = 7) -> QualityModel:
    """Co-train on about `most` labelled documents, none of them held out, and on all documents without a label.

    docs: doc_id, text, lang, source, n_chars; labels: doc_id, quality (0 or 1,
    1 is good; other rows are left aside, and the better of several counts).
    """
    known = labelled_sample(docs.select("doc_id", F.struct("text", "lang", "source", "n_chars").alias("text")), labels, "quality", most, seed)
    known = known.select("doc_id", "text.*", F.col("quality").cast("double").alias("label"))
    rows = stored(with_views(known.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(seed + 2)), F.lit(3)))))
    counts = {(r.part, r.label): r["count"] for r in rows.groupBy("part", "label").count().collect()}
    n = sum(counts.values())
    base = sum(c for (_, label), c in counts.items() if label == 1) / n if n else 0.5
    learn = {label: counts.get((1, label), 0) + counts.get((2, label), 0) for label in (0.0, 1.0)}
    if not all(learn.values()) or not all(counts.get((0, label)) for label in (0.0, 1.0)):
        return QualityModel({}, base)
    labelled = rows.filter("part > 0").select("_a", "_b", "label")
    unlabelled = stored(unlabelled_views(docs, labels))
    taught = {"a": labelled, "b": labelled}
    for _ in range(rounds):
        models = {view: _fit_view(taught[view], view) for view in "ab"}
        both = _sure_of(models["b"], _sure_of(models["a"], unlabelled, "a"), "b")
        for teacher, pupil in ("ab", "ba"):
            p = F.col(f"_{teacher}_p")
            new = both.filter((p >= sure) | (p <= 1 - sure)).select("_a", "_b", (p >= sure).cast("double").alias("label"))
            taught[pupil] = labelled.union(new)
    views = {}
    for view in "ab":
        classifier = _fit_view(taught[view], view)
        isotonic = IsotonicRegression(featuresCol=f"_{view}_p", labelCol="label", predictionCol=f"_{view}_calibrated")
        views[view] = classifier, isotonic.fit(_sure_of(classifier, rows.filter("part = 0"), view).select(f"_{view}_p", "label"))
    return QualityModel(views, base)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, text_score, metadata_score, score, predicted.

    docs: doc_id, text, lang, source, n_chars; nulls count as empty text, empty
    language or source, and no characters. predicted is 1 (good) from threshold on.
    """
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    model = fit(plain, labels, **options)
    scored = model.score(plain.select(F.struct("doc_id").alias("row"), "text", "lang", "source", "n_chars"))
    scored = scored.select("row.doc_id", "text_score", "metadata_score", "score")
    return scored.select("doc_id", held_out().alias("held_out"), "text_score", "metadata_score", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
