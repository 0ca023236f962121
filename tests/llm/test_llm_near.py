import re

import numpy as np
import xxhash

from echoless.llm import simhash
from text_tables import DOCS, hard_docs, hard_rows, same


def brute(rows):
    fps = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate({i: i + 32 for i in range(65, 91)}))
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    root = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 3 and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    ids = {}
    for r, k in zip(rows, root):
        if r[0] is not None:
            ids[k] = min(r[0], ids.get(k, r[0]))
    return [(r[0], f"{f:016x}", ids.get(k)) for r, f, k in zip(rows, fps, root)]


def test_fingerprints_and_groups(spark):
    found = simhash.near_duplicates(hard_docs(spark)).select("doc_id", simhash.hex_fingerprint(), "component_id")
    same(found.collect(), brute(hard_rows()))


def test_no_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def _link_and_compare(spark, fps):
    df = spark.createDataFrame([(int(f) - (1 << 64) if f >> 63 else int(f),) for f in fps], "fp long")
    roots = {r.u: r.root for r in simhash.components(simhash.links(df)).collect()}
    mine = {}
    for (f,) in df.collect():
        mine.setdefault(roots.get(f, f), set()).add(f)
    arr = np.array(sorted(fps), dtype=np.uint64)
    label = np.arange(len(arr))
    while True:
        near = np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 3
        new = np.where(near, label[None, :], len(arr)).min(axis=1)
        if (new == label).all():
            break
        label = new
    theirs = {}
    for f, k in zip(arr.view(np.int64).tolist(), label.tolist()):
        theirs.setdefault(k, set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_links_at_every_distance_and_in_long_chains(spark):
    rng = np.random.default_rng(2)
    fps = set(rng.integers(0, 1 << 63, 40, dtype=np.uint64).tolist())
    for f in list(fps)[:20]:
        for d in (1, 2, 3, 4, 5):
            fps.add(f ^ sum(1 << int(b) for b in rng.choice(64, d, replace=False)))
    f = 12345
    for i in range(20):  # each is three bits from the one before
        f ^= 0b111 << (3 * i)
        fps.add(f)
    _link_and_compare(spark, fps)


def test_a_large_group_is_cut_into_chunks_and_stays_whole(spark):
    rng = np.random.default_rng(3)
    base = 0x0F0F_1234_5678_9ABC
    fps = {base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(1800)}
    _link_and_compare(spark, fps)
