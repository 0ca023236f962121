import hashlib
import re
from collections import defaultdict

import pytest

from echoless.llm import exact
from text_tables import DOCS, hard_docs, hard_rows, same


def brute(rows):
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row."""
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, ids[0], len(ids), n == 0, digest) for n, i in enumerate(ids)]
    return out


def found(spark, rows, partitions=None):
    docs = hard_docs(spark, rows).withColumnsRenamed({"h": "_text", "fp": "_row", "part": "_part", "n": "_run"})
    return exact.exact_duplicates(docs, partitions).collect()


@pytest.mark.parametrize("partitions", [None, 1, 7, 40])
def test_against_brute_force(spark, partitions):
    rows = hard_rows() + [(500 + i, "a\t b\n", None, None, None) for i in range(30)] + [(400, " a b ", "x", "y", 1), (3, "", None, None, None)]
    same(found(spark, rows, partitions), brute(rows))


def test_one_text_over_many_ranges(spark):
    rows = [(i * 7 % 1009, "same text " * 20, "en", "s", 1) for i in range(1009)] + [(None, "same  text " * 20, "en", "s", 1)] * 5 + [(5000, "other", "en", "s", 1)]
    got = found(spark, rows, 16)
    same(got, brute(rows))


def test_long_common_beginnings_and_white_space_at_the_ends(spark):
    head = "word " * 5000
    texts = [head + str(i // 3) for i in range(60)] + [" " + head, head, head.strip(), head + "\n", "\x0b", "", None, " ", " "]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    same(found(spark, rows, 8), brute(rows))


def test_few_rows_and_other_ids(spark):
    assert found(spark, []) == []
    same(found(spark, [(None, None, None, None, None)]), [(None, None, 1, True, hashlib.sha256(b"").hexdigest())])
    named = spark.createDataFrame([("b", "x"), ("a", "x "), ("c", "x"), ("é", "x ")], "doc_id string, text string")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_duplicates(named).collect()}
    assert got == {("b", "b", 2, True), ("c", "b", 2, False), ("a", "a", 2, True), ("é", "a", 2, False)}
    assert exact.exact_duplicates(spark.createDataFrame([], DOCS)).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
