import random
from itertools import combinations

import numpy as np
import pyarrow as pa

from echoless.llm import licenses
from echoless.llm.license_texts import LICENSES
from echoless.llm.words import ALPHANUMERIC, slices
from text_tables import DOCS, hard_docs, hard_rows

MIT = LICENSES[0][1]


def test_longest_increasing_is_longest():
    rng = random.Random(6)
    for _ in range(60):
        v = [rng.randrange(12) for _ in range(rng.randrange(9))]
        best = max((len(c) for n in range(len(v) + 1) for c in combinations(v, n) if all(a < b for a, b in zip(c, c[1:]))), default=0)
        places = licenses._longest_increasing(v)
        assert len(places) == best and all(a < b and v[a] < v[b] for a, b in zip(places, places[1:]))


def test_alignment_is_of_equal_words_in_order():
    rng = random.Random(7)
    for _ in range(200):
        a, b = ([rng.randrange(8) for _ in range(rng.randrange(15))] for _ in range(2))
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p < r and q < s for (p, q), (r, s) in zip(pairs, pairs[1:]))
    assert licenses.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]
    assert licenses.patience(list("xaybzc"), list("abc")) == [(1, 0), (3, 1), (5, 2)]
    assert licenses.patience([], [1]) == []


def rows():
    rng = random.Random(8)
    filler = lambda n: " ".join(rng.choice(["the", "of", "software", "to", "any", "foo", "bar", "use", "and"]) for _ in range(n))
    words = MIT.split()
    for i in rng.sample(range(len(words)), 12):
        words[i] = "changed"
    half = " ".join(MIT.split()[: len(MIT.split()) // 2])
    return [
        (1, MIT, "", "", 0), (2, filler(500) + "\n" + MIT.upper() + "\n" + filler(700), "", "", 0), (3, " ".join(words), "", "", 0), (4, half, "", "", 0),
        (5, filler(5000), "", "", 0), (6, MIT + " " + filler(30) + " " + MIT, "", "", 0), (7, "Licensed under the Apache License, Version 2.0.", "", "", 0),
        (8, "Licensed under the Foo License.", "", "", 0), (9, filler(100) + " Released under the MIT License. " + filler(50), "", "", 0), *[(r[0] + 1000, *r[1:]) for r in hard_rows()[3:6]],
    ]


def test_licenses_found(spark):
    found = {r.doc_id: r for r in licenses.scan_licenses(hard_docs(spark, rows())).collect()}
    n = len(licenses.Templates(LICENSES).words[0])
    assert [(f.license, f.coverage, f.begin, f.end) for f in found[1].found] == [("MIT", 1.0, 0, n)]
    assert [(f.license, f.coverage) for f in found[2].found] == [("MIT", 1.0)] and found[2].found[0].begin >= 498
    assert [f.license for f in found[3].found] == ["MIT"] and 0.85 <= found[3].found[0].coverage < 1
    assert [f.license for f in found[6].found] == ["MIT", "MIT"]
    assert [(f.license, f.begin, f.end) for f in found[7].found] == [("Apache-2.0", 0, 8)]
    assert [f.license for f in found[9].found] == ["MIT"]
    assert not found[4].found and not found[5].found and not found[8].found


def test_repeated_copies_are_each_found():
    known = licenses.Templates(LICENSES)
    mit = known.words[0]
    for before, between, after, copies in [(1, 5, 1, 2), (3, 0, 0, 2), (0, 1, 400, 3), (700, 40, 9, 4), (2, 2, 2, 20)]:
        words, at = [-1] * before, []
        for _ in range(copies):
            at.append((len(words), len(words) + len(mit), len(mit)))
            words += mit + [-1] * between
        assert licenses.matches(np.array(words + [-1] * after), known, 0, 0.85) == at


def test_every_notice_is_called_by_its_own_name(spark):
    notice = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the {2} as published by the Free Software Foundation{1} either version {3} of the License, or (at your option) any later version."
    more = " This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {2} for more details."
    kinds = [("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.0", "Library ", "2"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3")]
    texts = [(n, (notice + rest).format(thing, ";", f"GNU {w}General Public License", v)) for n, w, v in kinds for thing in ("program", "library", "tool") for rest in ("", more)]
    texts += [*LICENSES, ("EPL-1.0", next(t for n, t in LICENSES if n == "EPL-1.0").replace("http", "https"))]
    rows = [(i, f"x y {t} z", "en", "s", 0) for i, (_, t) in enumerate(texts)]
    found = {r.doc_id: r.found for r in licenses.scan_licenses(hard_docs(spark, rows)).collect()}
    assert [(t, [f.license for f in found[i]]) for i, (_, t) in enumerate(texts)] == [(t, [n]) for n, t in texts]


def _common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_changed_copies_against_brute_force():
    """As many stretches as there are windows apart from each other that cover the template."""
    template = "a b c d a e f g h b i j k l m a n o p q"
    known = licenses.Templates((("T", template),))
    (t,), n, rng = known.words, 20, random.Random(9)
    for _ in range(40):
        words = [-1] * rng.randrange(5)
        for _ in range(rng.randrange(1, 5)):
            copy = list(t)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(len(copy))] = rng.choice([-1, *t])
            for _ in range(rng.randrange(4)):
                copy.insert(rng.randrange(len(copy)), -1)
            words += copy + [rng.choice([-1, -1, *t]) for _ in range(rng.randrange(8))]
        apart, done = 0, 0
        for e in range(len(words) + 1):
            if e - done >= 17 and _common(words[max(done, e - 2 * n) : e], t) >= 17:
                apart, done = apart + 1, e
        found = licenses.matches(np.array(words), known, 0, 0.85)
        assert len(found) == apart
        assert all(b <= c for (_, b, _), (c, _, _) in zip(found, found[1:]))
        assert all(17 <= k <= _common(words[a:b], t) for a, b, k in found)


def test_filter_loses_nothing(spark):
    """What the filter keeps out cannot reach the coverage: all texts against all templates without it."""
    known = licenses.Templates(LICENSES)
    found = {r.doc_id: {f.license for f in r.found} for r in licenses.scan_licenses(hard_docs(spark, rows())).collect() if r.doc_id != 3}

    for r in rows():
        if r[0] in (None, 3) or not r[1]:
            continue
        part = next(slices(pa.array([r[1]]), ALPHANUMERIC, lower=True))
        numbers = known.numbers(part)
        covered = {known.names[t] for t in range(len(known.words)) if len(licenses._densest(licenses.patience(numbers.tolist(), known.words[t]), len(known.words[t]))) >= licenses.COVERAGE * len(known.words[t])}
        assert covered >= found[r[0]]
        assert bool(covered) == bool(found[r[0]])


def test_no_rows_and_nulls(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], DOCS)).count() == 0
    assert [(r.n_words, r.found) for r in licenses.scan_licenses(spark.createDataFrame([(None, None, None, None, None)] * 2, DOCS)).collect()] == [(0, [])] * 2
