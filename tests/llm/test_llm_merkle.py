import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from echoless.llm import merkle
from echoless.llm.catalog import QUERIES
from text_tables import DOCS, hard_docs, hard_rows, same


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """(root, for each node the (place, siblings) of every level)."""
    paths, at, root = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(root) > 1:
        runs = [root[i : i + 8] for i in range(0, len(root), 8)]
        for path, k in zip(paths, at):
            path.append((k % 8, runs[k // 8][: k % 8] + runs[k // 8][k % 8 + 1 :]))
        at, root = [k // 8 for k in at], [h(*run) for run in runs]
    return root[0], paths


def brute(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row."""
    of_lang = defaultdict(list)
    for r in rows:
        of_lang[r[2]].append(r)
    langs = sorted(of_lang, key=lambda v: (v is not None, (v or "").encode()))
    for own in of_lang.values():
        own.sort(key=lambda r: (r[0] is not None, r[0], leaf(*r)))
    subtrees = {lang: tree([leaf(*r) for r in of_lang[lang]]) for lang in langs}
    root, above = tree([subtrees[lang][0] for lang in langs])
    out = []
    for lang, beyond in zip(langs, above):
        for r, path in zip(of_lang[lang], subtrees[lang][1]):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if changed else r[1]
            node = leaf(r[0], lower, *r[2:])
            for at, others in path + beyond:
                node = h(*others[:at], node, *others[at:])
            proof = h(*(s for _, others in path + beyond for s in others))
            out.append((r[0], leaf(*r), subtrees[lang][0], root, proof, node, node == root))
    return out


def found(spark, rows, every=merkle.EVERY):
    docs = hard_docs(spark, rows).withColumnsRenamed({"h": "tree", "fp": "key", "part": "digest", "taken": "subtree", "kept": "top"})
    got = merkle.document_manifest(docs, every)
    received = F.when(merkle.tampered(), F.col("changed_leaf")).otherwise(F.col("leaf"))
    siblings = F.sha2(F.array_join(F.transform("proof", lambda p: p.siblings), "").cast("binary"), 256)
    got = got.select("doc_id", "leaf", "subroot", "root", siblings, merkle.folded(received).alias("f"))
    return [(*r[:6], r[5] == r[3]) for r in got.collect()]


@pytest.mark.parametrize("every", [1, 2, 3])
def test_against_brute_force(spark, every):
    rows = hard_rows() + [(1000 + i, f"Text {i}", "xx", "A", i) for i in range(530)] + [(3, "Ü", lang, None, 1) for lang in ("", "é", "z", "a-b", "AA", "zz", "Z")]
    got = found(spark, rows, every)
    same(got, brute(rows))
    assert {r[6] for r in got} == {True, False}


def test_sizes_around_powers_of_the_fan(spark):
    rows = [(i, f"T{i}", f"l{n:03}", "s", i) for n in (1, 2, 8, 9, 64, 65, 513) for i in range(n)]
    same(found(spark, rows), brute(rows))


def test_one_leaf_and_none(spark):
    assert found(spark, []) == []
    same(found(spark, [(None, None, None, None, None)]), brute([(None, None, None, None, None)]))
    same(found(spark, [(3, "AbC", "en", "s", 1)]), brute([(3, "AbC", "en", "s", 1)]))


def test_few_levels_are_stored(spark):
    nodes = spark.range(5000).select(F.lit("t").alias("tree"), F.col("id").alias("n"), F.lit(5000).cast("long").alias("size"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    forest = merkle.Forest(nodes)
    assert [level.count() for level in forest.levels] == [5000, 10, 1]  # of 5000, 625, 79, 10, 2, 1


def test_query_on_whole_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = QUERIES["op12_merkle_manifest"](spark, sf_dir).collect()
    same(got, brute(docs))
    assert DOCS.startswith("doc_id long")
