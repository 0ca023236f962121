"""Secret scans, judged by how many owners a value has.

Patterns give candidates. The hash of each candidate's value is counted over
the whole corpus by distinct repository and owner: a value that many owners
have is a copied example, one that stays with its owner looks live.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoless.llm.storage import stored
from echoless.llm.words import SPACES, slices

#: Kinds in their order, with the pattern, the group that holds the value, and the fewest characters of that group.
BASE = (
    ("assign", rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE, 2, 6),
    ("access", rb"AKIA[A-Z0-9]+", 0, 0, 20),
    ("hex", rb"[0-9a-f]+", 0, 0, 24),
)
#: Further kinds; a text is searched for one only if it has the literal that every match begins with.
MORE = (
    ("github", b"gh", rb"gh[pousr]_[A-Za-z0-9]{36,}"),
    ("google", b"AIza", rb"AIza[0-9A-Za-z_-]{35,}"),
    ("slack", b"xox", rb"xox[abprs]-[0-9A-Za-z-]{10,}"),
    ("jwt", b"eyJ", rb"eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}"),
    ("pem", b"-----BEGIN ", rb"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
KINDS = tuple(k for k, *_ in BASE) + tuple(k for k, *_ in MORE)
SPANS_DDL = "array<struct<kind:string,start:long,end:long,h:long>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("h", pa.int64())]))


def _value_hash(value: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(value, digest_size=8).digest(), "little", signed=True)


def _finder():
    base = [(kind, re.compile(pattern, flags), group, least) for kind, pattern, flags, group, least in BASE]
    # A run of at least 24 is found as such: runs are maximal, so shorter ones never hide a longer one.
    base[2] = ("hex", re.compile(rb"[0-9a-f]{24,}"), 0, 24)
    more = [(kind, literal, re.compile(pattern)) for kind, literal, pattern in MORE]

    def find(text: bytes) -> list[tuple[int, int, int, int]]:
        """(start, rank of kind, end, hash of value) in bytes, by start and then kind."""
        found = []
        for rank, (_, pattern, group, least) in enumerate(base):
            for m in pattern.finditer(text):
                if m.end(group) - m.start(group) >= least:
                    found.append((m.start(), rank, m.end(), _value_hash(m[group])))
        for rank, (_, literal, pattern) in enumerate(more, len(base)):
            if literal in text:
                found += [(m.start(), rank, m.end(), _value_hash(m[0])) for m in pattern.finditer(text)]
        if found and not text.isascii():
            at = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
            found = [(int(at[s]), k, int(at[e]), h) for s, k, e, h in found]
        return sorted(found)

    return find


def _scan(text: str, into: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder()
        for batch in batches:
            spans = []
            for part in slices(batch.column(text), SPACES):
                data, offsets = part.data.tobytes(), part.offsets.tolist()
                for a, b in zip(offsets, offsets[1:]):
                    spans.append([{"kind": KINDS[k], "start": s, "end": e, "h": h} for s, k, e, h in find(data[a:b])])
            yield batch.append_column(into, pa.array(spans, _SPANS))

    return rows


def with_spans(docs: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """docs with all candidates of each whole text: kind, start, end (code points), h (hash of the value)."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_scan(text, into), f"{ddl}, `{into}` {SPANS_DDL}")


def owner_counts(found: DataFrame, min_owners: int) -> DataFrame:
    """From (repo, owner, spans) the number of distinct repositories and owners of each value: h, repos, owners, example."""
    values = found.select("repo", "owner", F.explode("spans.h").alias("h")).distinct()
    counts = values.groupBy("h").agg(F.count_distinct("repo").alias("repos"), F.count_distinct("owner").alias("owners"))
    return counts.withColumn("example", F.col("owners") >= min_owners)


def default_owner(repo: Column) -> Column:
    """The part of a repository's name before its first slash."""
    return F.substring_index(repo, "/", 1)


def _count(kind: str) -> Column:
    return F.size(F.filter("judged", lambda s: s.kind == kind)).cast("long")


def scan_secrets(docs: DataFrame, repo: str = "source", min_owners: int = 5) -> DataFrame:
    """One row for each row of docs (doc_id, text, repo): doc_id, n_<kind>, spans, n_live, n_example, base.

    spans are structs of kind, start, end, repos, owners and example, by start
    and then kind; base is the text "kind:start:end,..." of the base kinds.
    A null text is empty. A null repository or owner counts as none, so a value
    that only such rows have has no owners and looks live. Rows that repeat are
    judged each on its own. Other columns are left alone.
    """
    plain = docs.select("doc_id", "text", F.col(repo).cast("string").alias("repo"))
    plain = plain.withColumn("owner", default_owner(F.col("repo"))).withColumn("row_id", F.monotonically_increasing_id())
    found = stored(with_spans(plain).drop("text"))
    counts = owner_counts(found, min_owners)
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    each = found.select("row_id", F.explode("spans").alias("s")).select("row_id", "s.*").join(counts, "h")
    spans = F.struct("start", order[F.col("kind")].alias("rank"), "kind", "end", "repos", "owners", "example")
    judged = each.groupBy("row_id").agg(F.array_sort(F.collect_list(spans)).alias("judged"))
    rows = found.drop("spans").join(judged, "row_id", "left")
    rows = rows.withColumn("judged", F.coalesce("judged", F.array().cast(judged.schema["judged"].dataType)))
    line = lambda s: F.concat_ws(":", s.kind, s.start, s.end)
    base = F.filter("judged", lambda s: s["rank"] < len(BASE))
    return rows.select(
        "doc_id",
        *[_count(k).alias(f"n_{k}") for k in KINDS],
        F.concat_ws(",", F.transform(base, line)).alias("base"), F.concat_ws(",", F.transform("judged", line)).alias("lines"),
        F.size(F.filter("judged", lambda s: ~s.example)).cast("long").alias("n_live"),
        F.size(F.filter("judged", lambda s: s.example)).cast("long").alias("n_example"), F.col("judged").alias("spans"),
    )


_OWN = "__echoless_spans"


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column(_OWN).to_pylist()):
            parts, at = [], 0
            for s in spans:
                if s["end"] <= at:
                    continue
                if s["start"] >= at:
                    parts += [text[at : s["start"]], f"<{'example' if s['example'] else 'secret'}-{s['kind']}>"]
                at = s["end"]
            texts.append("".join([*parts, text[at:]]))
        names = batch.schema.names
        yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field("text").type) if n == "text" else batch.column(n) for n in names if n != _OWN], names=[n for n in names if n != _OWN])


def mask_secrets(docs: DataFrame, repo: str = "source", min_owners: int = 5) -> DataFrame:
    """docs with every candidate replaced by <secret-KIND>, or by <example-KIND> if it is a widely copied value.

    No row goes, and texts without candidates, null ones too, stay as they are.
    Overlapping candidates become one mark, of the first one's kind.
    """
    scanned = with_spans(docs, into=_OWN)
    some = stored(scanned.filter(F.size(_OWN) > 0).withColumn("__echoless_row", F.monotonically_increasing_id()))
    repos = some.select(F.col(repo).cast("string").alias("repo"), F.col(_OWN).alias("spans"))
    counts = owner_counts(repos.withColumn("owner", default_owner(F.col("repo"))), min_owners)
    each = some.select("__echoless_row", F.explode(_OWN).alias("s")).select("__echoless_row", "s.*").join(counts, "h")
    spans = each.groupBy("__echoless_row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "example"))).alias(_OWN))
    masked = some.drop(_OWN).join(spans, "__echoless_row").drop("__echoless_row").mapInArrow(_mask, docs.schema)
    return scanned.filter(F.size(_OWN) == 0).drop(_OWN).unionByName(masked)
