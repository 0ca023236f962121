import re

import pyarrow as pa
import pyarrow.parquet as pq

from compare import connect, mismatch
from echoless.llm import decontaminate, repeats
from echoless.llm.catalog import ORACLES, QUERIES
from text_tables import DOCS, hard_docs, hard_rows, same

LOWER = {i: i + 32 for i in range(65, 91)}
ITEMS = "item_id string, text string, n_words long"


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute_hits(docs, items):
    windows = {}
    for item, text, _ in items:
        w = alnum(text)
        m = min(10, len(w))
        for s in range(len(w) - m + 1 if m and item is not None else 0):
            windows.setdefault(tuple(w[s : s + m]), set()).add(item)
    out = []
    for r in docs:
        w, hit, which = alnum(r[1]), set(), set()
        for m in {len(k) for k in windows}:
            for s in range(len(w) - m + 1):
                if found := windows.get(tuple(w[s : s + m])):
                    hit.update(range(s, s + m))
                    which |= found
        out.append((r[0], len(w), len(hit), sorted(which)))
    return out


def test_benchmark_passages(spark):
    rows = hard_rows()
    passage = rows[0][1].split()
    items = [
        ("1", rows[0][1], 1), ("1", rows[0][1], 1), ("2", " ".join(passage[:10]), 1), ("3", " ".join(passage[5:14]), 1), ("4", "ONE", 1), ("5", None, 1), ("6", "", 1),
        ("7", "x " * 12, 1), ("8", "x x x", 1), (None, rows[0][1], 1), ("10", " ".join(passage[20:31]) + ", W1!", 1), ("11", "not there at all", 1), ("12", "dœux trois", 1),
    ]
    found = decontaminate.contamination(hard_docs(spark), spark.createDataFrame(items, ITEMS)).collect()
    same([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found], brute_hits(rows, items))
    for r in found:
        assert r.n_hit == sum(s.end - s.begin for s in r.spans or ()) and r.n_items == len(r["items"])


def test_items_without_an_id_hit_as_the_sql_says(spark, tmp_path):
    words = [f"w{i}" for i in range(60)]
    docs = [(1, " ".join(words[:30])), (2, " ".join(words[30:])), (3, " ".join(words)), (4, "one two"), (5, "none of it")]
    items = [("a", " ".join(words[:12])), (None, " ".join(words[40:55])), (None, "one two"), (None, None)]
    for name, rows, columns in (("documents", docs, ("doc_id", "text")), ("benchmark", items, ("item_id", "text"))):
        pq.write_table(pa.table(dict(zip(columns, map(list, zip(*rows))))), f"{tmp_path}/{name}.parquet")
    found = decontaminate.contamination(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect()
    assert sorted((r.doc_id, r.n_hit, r["items"], r.unnamed) for r in found) == [(1, 12, ["a"], False), (2, 15, [], True), (3, 27, ["a"], True), (4, 2, [], True), (5, 0, [], False)]
    assert mismatch(spark, connect(tmp_path), tmp_path, QUERIES["op3_decontaminate"], ORACLES["op3_decontaminate"]) is None


def test_no_documents_or_no_items(spark):
    items = spark.createDataFrame([("1", "a b c", 1)], ITEMS)
    assert decontaminate.contamination(spark.createDataFrame([], DOCS), items).count() == 0
    found = decontaminate.contamination(hard_docs(spark), items.limit(0)).collect()
    assert len(found) == len(hard_rows()) and not any(r.n_hit for r in found)


def brute_kept(rows, width=13):
    docs = [(r[0] if r[0] is not None else 1 << 63, re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    first = {}
    for i, w in docs:
        for s in range(len(w) - width + 1):
            g = tuple(w[s : s + width])
            first[g] = min(i, first.get(g, i))
    out = []
    for r, (i, w) in zip(rows, docs):
        gone = {p for s in range(len(w) - width + 1) if first[tuple(w[s : s + width])] < i for p in range(s, s + width)}
        out.append((r[0], len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def test_repeated_passages_go(spark):
    for block_bytes in (1 << 22, 3000):  # one block; many blocks
        same(repeats.remove_repeats(hard_docs(spark), block_bytes=block_bytes).collect(), brute_kept(hard_rows()))


def test_runs_and_short_periods(spark):
    words = ["a " * 40, "b " + "a " * 30, "a b " * 20, "c a b " * 15, "a a b " * 14, "b b " + "a b " * 9, "a " * 13, "a " * 12]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(words * 2)]
    same(repeats.remove_repeats(hard_docs(spark, rows), block_bytes=200).collect(), brute_kept(rows))


def test_no_rows(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
