"""The chunked fold gives what a row-by-row fold gives, wherever chunks fall."""

import random

import pyarrow as pa
import pytest

from brute import fold
from echoless.operators import spans
from echoless.operators.spans import ROLE_NAMES, _in_order, fold_spans, group_starts, whole_groups

SCHEMA = "k bigint, ts bigint, id bigint, side int"


def run(spark, rows, reply_timeout, linger, chunk):
    df = spark.createDataFrame(rows, SCHEMA)
    out = fold_spans(df, ["k"], "ts", "id", "side", reply_timeout, linger, chunk_us=chunk)
    return {
        r.id: (ROLE_NAMES[r.role], r.flow_t0, r.flow_id, r.reply_ts) for r in out.collect()
    }


def random_rows(seed):
    """Keys from sparse to dense, some one-sided, so that spans cross chunks."""
    rng = random.Random(seed)
    rows, rid = [], 0
    for key in range(40):
        length = rng.choice([3, 20, 120])
        span = rng.choice([15, 60, 300, 900])
        answers = rng.choice([0.0, 0.02, 0.2, 0.5])
        for _ in range(length):
            rows.append((key, rng.randrange(span), rid, int(rng.random() < answers)))
            rid += 1
    for ts in range(0, 900, 4):  # steady one-sided traffic never leaves a pause
        rows.append((99, ts + rng.randrange(3), rid, 0))
        rid += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("limits", [(10, 3), (3, 10), (7, 7)])
def test_matches_row_by_row_fold(spark, seed, limits):
    rows = random_rows(seed)
    expected = fold(rows, *limits)
    for chunk in (10, 23, 10_000):
        assert run(spark, rows, *limits, chunk) == expected


def test_groups_are_never_cut():
    rng = random.Random(5)
    keys = sorted(rng.randrange(30) for _ in range(400))
    table = pa.table({"k": keys, "n": list(range(400))})
    tables = list(whole_groups(table.to_batches(max_chunksize=7), lambda t: group_starts(t, ["k"]), 20))
    assert len(tables) > 3
    assert pa.concat_tables(tables)["n"].to_pylist() == list(range(400))
    seen = [set(t["k"].to_pylist()) for t in tables]
    assert all(not (a & b) for i, a in enumerate(seen) for b in seen[i + 1:])


@pytest.mark.parametrize("collide", [True, False])
def test_hash_collisions_and_ties_are_settled(collide):
    rng = random.Random(8)
    rows = [(rng.randrange(4), rng.randrange(40), tag) for tag in range(300)]
    rng.shuffle(rows)
    rows.sort(key=lambda r: (r[0], r[1] // 10))
    groups = [0 if collide else r[0] * 100 + r[1] // 10 for r in rows]
    table = pa.table({
        "k": [r[0] for r in rows], "_group": groups,
        "_ts": [r[1] for r in rows], "_tag": [r[2] for r in rows],
    })
    order, first = _in_order(table, ["k"], 10)
    ordered = [rows[i] for i in order]
    assert ordered == sorted(rows)
    cuts = [i == 0 or (r[0], r[1] // 10) != (ordered[i - 1][0], ordered[i - 1][1] // 10)
            for i, r in enumerate(ordered)]
    assert first.tolist() == cuts


def test_small_batches_change_nothing(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = random_rows(11)
        assert run(spark, rows, 10, 3, 30) == fold(rows, 10, 3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hot_key_is_spread_and_shuffled_once(spark):
    df = spark.range(1000).selectExpr("id % 2 as k", "id * 3 as ts", "id", "0 as side")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    out = fold_spans(df, ["k"], "ts", "id", "side", 10, 3, chunk_us=50)
    tasks = out.selectExpr("spark_partition_id() as p").distinct().count()
    assert tasks > 1
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert "ReusedExchange" in final


def test_rejects_chunks_shorter_than_the_limits(spark):
    df = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        fold_spans(df, ["k"], "ts", "id", "side", 10, 3, chunk_us=5)


@pytest.mark.parametrize("limits", [(10, 3), (3, 10)])
def test_exits_of_a_busy_key_are_composed_in_a_tree(spark, monkeypatch, limits):
    monkeypatch.setattr(spans, "BUSY_ROWS", 30)
    monkeypatch.setattr(spans, "FAN", 3)
    rows = random_rows(21)
    rid = len(rows)
    for ts in range(1, 700):  # periodic, one-sided: every entry time leads elsewhere
        rows.append((100, ts, rid, 0))
        rid += 1
        if ts % 97 == 0:
            rows.append((100, ts, rid, 1))
            rid += 1
    rows += [(101, ts * 3 - 900, rid + ts, 0) for ts in range(400) if not 120 < ts < 150]
    expected = fold(rows, *limits)
    for chunk in (10, 17):
        assert run(spark, rows, *limits, chunk) == expected
