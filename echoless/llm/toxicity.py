"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Lexicons are lists of word beginnings: a fixed one, and one that is learned
from labelled texts. Labelled texts are dealt to three parts that learn the
lexicon, the trees and the calibration, so that none of them is judged by
texts that it has learned from.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoless.llm.storage import stored
from echoless.llm.words import Slice, byte_powers, mix, slices

#: Beginnings of insulting words. Fixed values.
INSULTS = (
    "asshole", "bastard", "bitch", "clown", "crap", "cretin", "disgust", "dumb", "filth", "fool", "fuck", "garbage", "idiot", "imbecil",
    "jerk", "loser", "moron", "pathetic", "pig", "retard", "scum", "shit", "stupid", "trash", "ugly", "vermin", "worthless",
    "abschaum", "arschloch", "dummkopf", "hurensohn", "scheiß", "schwein", "trottel", "wertlos",
    "abruti", "connard", "crétin", "débile", "imbécile", "merde", "ordure", "salaud", "salope",
    "basura", "cabrón", "escoria", "estúpid", "gilipollas", "idiota", "imbécil", "mierda", "puta",
)
#: Words for the person that is spoken to. Fixed values.
SECOND_PERSON = ("you", "your", "yours", "yourself", "youre", "ya", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "tes", "vous", "votre", "tú", "ti", "usted", "ustedes", "vosotros")
#: Characters that stand for letters in obfuscated words. Fixed values.
LETTERS_OF = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Words between an insult and a second person that still count as near.
NEAR = 5
#: Characters of a learned beginning; no labelled text may differ in more than these to be told apart.
BEGINNINGS = (4, 5, 6, 7)
FEATURES = (
    "words", "learned_rate", "learned_hits", "fixed_rate", "fixed_hits", "near_second_person",
    "capitals", "capital_words", "punctuation", "exclamations", "obfuscated_rate", "hidden_hits",
)

_UPPER = np.zeros(256, dtype=bool)
_UPPER[0x41:0x5B] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_MARKS = np.zeros(256, dtype=bool)
_MARKS[[ord(c) for c in "*#%&_^~"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_PLAIN = _LOWER.copy()
for _digit, _letter in LETTERS_OF.items():
    _PLAIN[ord(_digit)] = ord(_letter)
del _digit, _letter


def _hash_of(word: bytes, table: np.ndarray, up: np.ndarray) -> int:
    data = np.frombuffer(word, dtype=np.uint8)
    return int(mix((table[data] * up[: len(data)]).sum(dtype=np.uint64)[None])[0])


class Beginnings:
    """Which words of a slice begin with one of some strings, or are one of them."""

    def __init__(self, strings: tuple[str, ...], whole: bool = False):
        self.whole = whole
        self.strings: dict[int, list[bytes]] = {}
        for s in {s.encode() for s in strings}:
            self.strings.setdefault(len(s), []).append(s)

    def prepare(self, table: np.ndarray, up: np.ndarray) -> None:
        self.known = {n: np.sort(np.array([_hash_of(s, table, up) for s in group], dtype=np.uint64)) for n, group in self.strings.items()}

    def found(self, part: Slice, sums: np.ndarray, down: np.ndarray) -> np.ndarray:
        lengths = part.ends - part.starts
        hit = np.zeros(len(lengths), dtype=bool)
        for n, known in self.known.items():
            at = np.flatnonzero(lengths == n if self.whole else lengths >= n)
            start = part.starts[at]
            h = mix((sums[start + n] - sums[start]) * down[start])
            i = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit[at[known[i] == h]] = True
        return hit


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return (sums[bounds[1:]] - sums[bounds[:-1]]).astype(float)


def features_of(part: Slice, raw: np.ndarray, learned: Beginnings, fixed: Beginnings, second: Beginnings) -> np.ndarray:
    """A row of FEATURES for each text of a slice. raw: the slice's bytes as written; part has them in lower case."""
    table = mix(np.arange(1, 257, dtype=np.uint64))
    up, down = byte_powers().upto(len(raw) + 1)
    for lexicon in (learned, fixed, second):
        lexicon.prepare(table, up if len(up) > 64 else byte_powers().upto(64)[0])

    def sums_of(data: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(table[data] * up[: len(data)], out=sums[1:])
        return sums

    sums = sums_of(part.data)
    in_learned, in_fixed, is_second = (x.found(part, sums, down) for x in (learned, fixed, second))
    hit = in_learned | in_fixed
    # Words from the last second person and to the next one.
    n = len(hit)
    at = np.arange(n)
    before = np.maximum.accumulate(np.where(is_second, at, -(1 << 40))) if n else at
    after = np.minimum.accumulate(np.where(is_second, at, 1 << 40)[::-1])[::-1] if n else at
    near = hit & (((at - before <= NEAR) & (before >= part.first[part.doc])) | ((after - at <= NEAR) & (after < part.first[part.doc + 1])))
    # The same text with letters for the signs that stand for them, cut into words anew.
    read = Slice(part.row, _PLAIN[raw], part.offsets, _LETTER)
    sums = sums_of(read.data)
    hidden = _per_row(learned.found(read, sums, down) | fixed.found(read, sums, down), read.first)
    letter = _LETTER[raw]
    odd = _MARKS[raw] | (~letter & (_PLAIN[raw] != _LOWER[raw]))
    inner = np.zeros(len(raw), dtype=bool)
    inner[1:-1] = odd[1:-1] & letter[:-2] & letter[2:]
    upper = _UPPER[raw]
    capital = np.concatenate([[0], np.cumsum(upper)])
    all_capital = (capital[part.ends] - capital[part.starts] == part.ends - part.starts) & (part.ends - part.starts > 1)
    words, hits = np.maximum(part.counts, 1), _per_row(hit, part.first)
    size = np.maximum(np.diff(part.offsets), 1)
    columns = (
        np.log1p(part.counts), _per_row(in_learned, part.first) / words, np.log1p(_per_row(in_learned, part.first)),
        _per_row(in_fixed, part.first) / words, np.log1p(_per_row(in_fixed, part.first)), _per_row(near, part.first) / np.maximum(hits, 1),
        _per_row(upper, part.offsets) / size, _per_row(all_capital, part.first) / words, _per_row(_PUNCTUATION[raw], part.offsets) / size,
        _per_row(raw == 0x21, part.offsets) / size, _per_row(inner, part.offsets) / words, np.log1p(np.maximum(hidden - hits, 0)),
    )
    return np.stack(columns, axis=1)


def _add_features(lexicon: Broadcast, into: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned, fixed, second = Beginnings(lexicon.value), Beginnings(INSULTS), Beginnings(SECOND_PERSON, whole=True)
        for batch in batches:
            found = [np.zeros((0, len(FEATURES)))]
            for part in slices(batch.column("text"), _LETTER):
                lower = Slice(part.row, _LOWER[part.data], part.offsets, _LETTER)
                found.append(features_of(lower, part.data, learned, fixed, second))
            values = np.concatenate(found)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * len(FEATURES), pa.int32()), pa.array(values.ravel()))
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), lists], names=[*names, into])

    return rows


def with_features(docs: DataFrame, lexicon: tuple[str, ...], into: str = "features") -> DataFrame:
    """docs without text but with an array of FEATURES of each whole text; a null text is empty."""
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != "text")
    return docs.mapInArrow(_add_features(docs.sparkSession.sparkContext.broadcast(lexicon), into), f"{ddl}`{into}` array<double>")


def _count_beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for batch in batches:
        for toxic, part in zip(batch.column("toxic").to_pylist(), slices(batch.column("text"), _LETTER, lower=True, limit=0)):
            words = {part.word(i).decode(errors="ignore") for i in range(len(part.starts))}
            counts[toxic].update({w[:k] for w in words for k in BEGINNINGS if len(w) >= k})
    terms = list(counts[0].keys() | counts[1].keys())
    yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()), pa.array([counts[0][t] for t in terms], pa.int64())], names=["term", "bad", "good"])


def learn_lexicon(sample: DataFrame, most: int = 500, precision: float = 0.95, support: float = 0.002) -> tuple[str, ...]:
    """Beginnings of words that labelled texts (text, toxic) have if they are toxic, and hardly ever otherwise.

    At most `most` are kept, those in most toxic texts, and none that a kept shorter one covers.
    """
    least = F.greatest(F.lit(4), F.ceil(F.lit(support * sample.count())))
    counts = sample.select("text", "toxic").mapInArrow(_count_beginnings, "term string, bad long, good long")
    sums = counts.groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    sharp = sums.filter((F.col("bad") >= least) & (F.col("bad") >= precision * (F.col("bad") + F.col("good"))))
    kept: list[str] = []
    for term in sorted((r.term for r in sharp.orderBy(F.desc("bad"), "term").limit(most).collect()), key=len):
        if not any(term.startswith(k) for k in kept):
            kept.append(term)
    return tuple(kept)


@dataclass
class ToxicityModel:
    """Lexicon, trees and calibration; without trees (labels of one kind only) every score is base."""

    lexicon: tuple[str, ...]
    trees: Model | None
    calibration: Model | None
    base: float

    def score(self, docs: DataFrame) -> DataFrame:
        """docs without text but with score, from 0 to 1."""
        if self.trees is None:
            return docs.drop("text").withColumn("score", F.lit(self.base))
        names = [c for c in docs.columns if c != "text"]
        held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "text")  # no name of docs can clash
        raw = _raw(self.trees, with_features(held, self.lexicon, "_array"))
        scored = self.calibration.transform(raw)
        return scored.select("_row.*", F.least(F.greatest("_calibrated", F.lit(0.0)), F.lit(1.0)).alias("score"))


def _raw(trees: Model, featured: DataFrame) -> DataFrame:
    vectors = featured.withColumn("_vector", array_to_vector("_array")).drop("_array")
    scored = trees.transform(vectors)
    return scored.withColumn("_raw", vector_to_array("_probability")[1]).drop("_vector", "_probability", "_margin", "_prediction")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, seed: int = 5) -> DataFrame:
    """About `most` labelled documents at most (doc_id, text, label), none of them held out.

    The labels are thinned by a hash of doc_id before the join, so they are small enough to be broadcast.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias(label)).filter(F.col(label).isin(0, 1) & ~held_out() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(label).alias(label))
    share = min(1.0, most / max(known.count(), 1))
    known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)))
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, most: int = 24_000, rounds: int = 12, depth: int = 3, seed: int = 5) -> ToxicityModel:
    """Learn from at most about `most` labelled documents that are not held out.

    docs: doc_id, text; labels: doc_id, toxic (0 or 1; rows with other values,
    or without doc_id, are left aside, and a document with several counts as
    toxic if one says so).
    """
    sample = stored(labelled_sample(docs, labels, "toxic", most, seed).withColumn("_part", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(4))))
    lexicon = learn_lexicon(sample.filter("_part < 2"))
    featured = stored(with_features(sample.filter("_part >= 2").select("text", "toxic", "_part"), lexicon, "_array"))
    counts = {(r["_part"], r.toxic): r["count"] for r in featured.groupBy("_part", "toxic").count().collect()}
    n = sum(counts.values())
    base = (counts.get((2, 1), 0) + counts.get((3, 1), 0)) / n if n else 0.0
    if any(not counts.get((p, t)) for p in (2, 3) for t in (0, 1)):
        return ToxicityModel(lexicon, None, None, base)
    gbt = GBTClassifier(featuresCol="_vector", labelCol="toxic", predictionCol="_prediction", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=seed, checkpointInterval=-1)
    gbt = gbt.setProbabilityCol("_probability").setRawPredictionCol("_margin")
    vectors = featured.filter("_part = 2").select(array_to_vector("_array").alias("_vector"), F.col("toxic").cast("double").alias("toxic"))
    trees = gbt.fit(vectors.coalesce(8))
    raw = _raw(trees, featured.filter("_part = 3").withColumn("toxic", F.col("toxic").cast("double")))
    isotonic = IsotonicRegression(featuresCol="_raw", labelCol="toxic", predictionCol="_calibrated")
    return ToxicityModel(lexicon, trees, isotonic.fit(raw.select("_raw", "toxic")), base)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted.

    Null and empty texts are scored like others. A null doc_id is not held out.
    """
    scored = fit(docs, labels, **options).score(docs.select("doc_id", "text"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
