import numpy as np
import pytest
from pyspark.sql import functions as F

from echoless.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    return df.withColumns({n: F.lit(1) for n in ("leaf", "score", "rank", "query", "query_id", "r", "c")})


def brute(rows, k=10):
    fine = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v) and len(v) == 4]
    out = {}
    for q, v in fine:
        if q % 100 == 0:
            out[q] = sorted((float(np.sqrt(((x - v) ** 2).sum())), i) for i, x in fine if i != q)[:k]
    return out


def table(n=900):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).round(3).tolist()) for i in range(n)]
    for i in range(200, 500):  # a very common vector
        rows[i] = (i, [1.0, 0.0, 0.0, 0.0])
    inf, nan = float("inf"), float("nan")
    return rows + [(1000, None), (1100, [0.0] * 4), (1200, [1.0, None, 0.0, 0.0]), (1300, [nan, 0.0, 0.0, 1.0]), (1400, [inf, 0.0, 0.0, 1.0]), (1500, []), (1600, [1.0, 2.0]), (None, [1.0, 0.0, 0.0, 0.0])]


def test_all_leaves_give_the_true_neighbours_with_ties_by_id(spark):
    rows = table()
    found = neighbours.search(vectors(spark, rows), recall=1.0, leaf_rows=40, calibration=1000, branches=3).collect()
    truth = brute(rows)
    assert {r.query_id for r in found} == set(truth)
    got = {q: sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q) for q in truth}
    for q, expected in truth.items():
        assert [g[0] for g in got[q]] == list(range(1, 11))
        assert [g[2] for g in got[q]] == pytest.approx([s for s, _ in expected])
        assert [g[1] for g in got[q]] == [i for _, i in expected]


def test_recall_on_the_given_vectors(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/embeddings.parquet")
    found = neighbours.search(df, every=10, leaf_rows=32).collect()
    x = np.array([r.embedding for r in df.orderBy("vec_id").collect()], dtype=float)
    hits = 0
    by = {}
    for r in found:
        by.setdefault(r.query_id, set()).add(r.vec_id)
    for q in by:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hits += len(by[q] & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits / (10 * len(by)) >= 0.9


def test_few_rows_and_none(spark):
    found = neighbours.search(vectors(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])])).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found)[:2] == [(0, 1, 2), (0, 2, 1)]
    assert neighbours.search(vectors(spark, [(0, [1.0, 2.0])])).count() == 0
    assert neighbours.search(spark.createDataFrame([], SCHEMA)).count() == 0
    assert neighbours.search(vectors(spark, [(0, None), (100, [0.0])])).count() == 0


def test_repeated_rows_take_no_place(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).round(3).tolist()) for i in range(300)]
    near = {q: brute(rows)[q][0][1] for q in (0, 100, 200)}
    truth = brute(rows)
    repeated = rows * 2 + [r for r in rows if r[0] in near.values()] * 10
    found = neighbours.search(vectors(spark, repeated), recall=1.0, leaf_rows=40, calibration=1000, branches=3).collect()
    for q, expected in truth.items():
        assert [v for _, v in sorted((r.rank, r.vec_id) for r in found if r.query_id == q)] == [i for _, i in expected]


def test_queries_in_tiny_leaves_get_all_their_neighbours(spark):
    rng = np.random.default_rng(7)
    rows = [(i + 1, rng.normal(size=4).round(3).tolist()) for i in range(400)]
    rows = [(i, v) for i, v in rows if i % 100] + [(0, [1e4, 0.0, 0.0, 0.0]), (500, [1e4, 1.0, 0.0, 0.0]), (501, [1e4, 2.0, 0.0, 0.0])]
    found = neighbours.search(vectors(spark, rows), recall=0.05, leaf_rows=50, branches=2).collect()
    for q in (0, 500):
        got = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [g[0] for g in got] == list(range(1, 11)) and [g[1] for g in got[:2]] == [i for _, i in brute(rows)[q][:2]]


def test_best_bins_visit_each_leaf_once_nearest_first():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    tree = neighbours.Tree([], [], [])
    tree.add(x, 20, 4, rng)
    own = tree.leaves_of(x)
    for i in range(0, 400, 37):
        bins = tree.best_bins(x[i], tree.n_leaves)
        assert sorted(bins) == list(range(tree.n_leaves)) and bins[0] == own[i]
