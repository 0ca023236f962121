import random
import re

from echoless.llm import near_copies
from text_tables import DOCS, hard_docs, hard_rows, prose, same


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a and b and len(a & b) / len(a | b) >= 0.8):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[find(i)] = min(r[0], ids.get(find(i), r[0]))
    return [(r[0], ids.get(find(i))) for i, r in enumerate(rows)]


def rows_of(texts):
    return [(i, t, "en", "a", 1) for i, t in enumerate(texts)]


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_groups_of_hard_rows(spark):
    same(near_copies.near_copies(hard_docs(spark)).collect(), brute(hard_rows()))


def test_groups_at_every_similarity(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(60):
        words = prose(rng, 220, 3000).split()
        texts += [" ".join(words), edited(rng, words, rng.randrange(1, 4)), edited(rng, words, 9), " ".join(words + prose(rng, rng.choice([30, 90])).split())]
    rows = rows_of(texts)
    same(near_copies.near_copies(spark.createDataFrame(rows, DOCS)).collect(), brute(rows))


def test_texts_of_one_repeated_shingle_stay(spark):
    rng = random.Random(5)
    rows = rows_of("- " * 300 + prose(rng, 60, 3000) for _ in range(30))
    assert {r.component_id for r in near_copies.near_copies(spark.createDataFrame(rows, DOCS)).collect()} == set(range(30))


def test_blocks_that_many_texts_share_are_dealt_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "CHUNK", 16)
    rng = random.Random(6)
    base, other = prose(rng, 200, 3000).split(), prose(rng, 60, 3000).split()
    texts = [edited(rng, base, 1) for _ in range(90)] + [edited(rng, base, 12) for _ in range(40)]
    texts += [" ".join(base[:140] + other[:k]) for k in range(20, 60)]
    rng.shuffle(texts)
    same(near_copies.near_copies(spark.createDataFrame(rows_of(texts), DOCS)).collect(), brute(rows_of(texts)))


def test_no_rows(spark):
    assert near_copies.near_copies(spark.createDataFrame([], DOCS)).count() == 0


def test_close_texts_that_are_no_copies_make_no_table_of_pairs(spark, monkeypatch):
    counts, real = [], near_copies.stored

    def counted(df):
        kept = real(df)
        counts.append(kept.count())
        return kept

    monkeypatch.setattr(near_copies, "stored", counted)
    monkeypatch.setattr(near_copies, "COLUMNS", 64)
    rng = random.Random(7)
    base = prose(rng, 200, 3000).split()
    texts = [edited(rng, base, 5) for _ in range(330)] + [edited(rng, base, 2) for _ in range(30)]
    rng.shuffle(texts)
    rows = rows_of(texts)
    same(near_copies.near_copies(spark.createDataFrame(rows, DOCS)).collect(), brute(rows))
    assert max(counts) < 20_000  # of 64,620 pairs


def test_close_texts_go_to_be_checked_once_not_for_each_block(spark, monkeypatch):
    rng = random.Random(8)
    base = prose(rng, 200, 3000).split()
    texts = [edited(rng, base, rng.choice([2, 4, 5, 6, 8])) for _ in range(300)]
    df, sent = spark.createDataFrame(rows_of(texts), DOCS), []
    real = type(df).mapInArrow

    def counted(self, *args, **more):
        if "shingles" in self.columns:
            sent.append(self.count())
        return real(self, *args, **more)

    monkeypatch.setattr(type(df), "mapInArrow", counted)
    same(near_copies.near_copies(df).collect(), brute(rows_of(texts)))
    assert 0 < max(sent) <= len(texts)


def test_chains_of_close_texts(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "PART", 8)
    rng = random.Random(9)
    words, at, texts = prose(rng, 6000, 50_000).split(), 0, []
    while at < 5600:
        texts.append(" ".join(words[at : at + 200]))
        at += rng.choice([15, 18, 24, 30])
    rng.shuffle(texts)
    same(near_copies.near_copies(spark.createDataFrame(rows_of(texts), DOCS)).collect(), brute(rows_of(texts)))


def test_cells_hold_every_cluster_and_chains_of_clusters_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "PART", 4)
    rng = random.Random(10)
    blob = {(u, v) for v in range(6) for u in [v, *rng.sample(range(6, 40), 28)]}
    chain = {(u, v) for v in range(100, 400, 5) for u in range(v, v + 7)}
    alone = {(u, 1000) for u in range(1000, 1030)}
    stars = sorted(blob | chain | alone)
    cells = {}
    for r in near_copies._cells(spark.createDataFrame(stars, "u long, v long")).collect():
        cells.setdefault(r.cell, []).append(r.u)
    clusters = {v: {u for u, w in stars if w == v} for _, v in stars}
    assert all(any(c <= set(us) for us in cells.values()) for c in clusters.values())
    assert all(len(us) == len(set(us)) for us in cells.values())
    assert sorted(cells[0]) == sorted({u for u, _ in blob}) and max(len(us) for k, us in cells.items() if 100 <= k < 1000) == 7
