"""License scans by patience alignment.

Words that stand once in the text and once in the template are anchors; the
longest run of anchors in the same order in both is kept, and the gaps between
them are aligned in the same way. Coverage is the share of the template's words
that are aligned.

A text is aligned only where it can reach the wanted coverage: as a whole, and
in the stretches, it must hold enough of the template's words. Where in a
stretch a copy stands is told by longest common subsequences, which are also
taken where copies repeat so much within themselves that anchors are missing.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoless.llm.license_texts import LICENSES
from echoless.llm.words import ALPHANUMERIC, Slice, byte_powers, slices

COVERAGE = 0.85
#: Words of a stretch of text that is aligned at once, in template lengths.
STRETCH = 2


def _longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence: piles of patience, each card knowing the one below."""
    tops, places, below = [], [], []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        below.append(places[pile - 1] if pile else -1)
        tops[pile : pile + 1] = [v]
        places[pile : pile + 1] = [i]
    out, i = [], places[-1] if places else -1
    while i >= 0:
        out.append(i)
        i = below[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places of a and b, in order."""
    pairs, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: i for i, w in enumerate(b[b0:b1], b0) if in_b[w] == 1 and in_a[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if w in place]
        kept = [anchors[i] for i in _longest_increasing([j for _, j in anchors])]
        if not kept:
            continue
        pairs += kept
        bounds = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
        todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(bounds, bounds[1:])]
    return sorted(pairs)


class Templates:
    """The words of the templates as numbers."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        part = next(slices(pa.array([t for _, t in templates], pa.string()), ALPHANUMERIC, lower=True, limit=1 << 30))
        hashes = part.hashes(byte_powers())
        self.known, number = np.unique(hashes, return_inverse=True)
        self.names = [n for n, _ in templates]
        self.words = [number[a:b].tolist() for a, b in zip(part.first, part.first[1:])]
        #: How often each word stands in each template.
        self.times = np.stack([np.bincount(w, minlength=len(self.known)) for w in self.words])
        self.common = [(_Common(w), _Common(w[::-1])) for w in self.words]

    def numbers(self, part: Slice) -> np.ndarray:
        """The number of each word of a slice, -1 if no template has it."""
        hashes = part.hashes(byte_powers())
        i = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[i] == hashes, i, -1)

    def candidates(self, numbers: np.ndarray, part: Slice, coverage: float) -> dict[int, list[int]]:
        """For each row the templates of whose words it has enough: no other can be covered."""
        has = np.flatnonzero(numbers >= 0)
        there = np.zeros((len(part.counts), len(self.known)), dtype=np.float32)
        there[part.doc[has], numbers[has]] = 1
        most = there @ self.times.T.astype(np.float32)
        least = np.array([coverage * len(w) for w in self.words])
        rows, which = np.nonzero(most >= least - 1e-6)
        out: dict[int, list[int]] = {}
        for r, t in zip(rows.tolist(), which.tolist()):
            out.setdefault(r, []).append(t)
        return out


class _Common:
    """Longest common subsequences of a text with a template, a word of text at a time: a bit for each word of the
    template, cleared where one more word is aligned."""

    def __init__(self, template: list[int]):
        self.full = (1 << len(template)) - 1
        self.of: dict[int, int] = {}
        for i, w in enumerate(template):
            self.of[w] = self.of.get(w, 0) | 1 << i

    def lengths(self, words: Iterable[int]) -> Iterator[tuple[int, int]]:
        """(place, aligned words up to there) wherever one more is aligned."""
        free, length = self.full, 0
        for i, w in enumerate(words):
            if m := self.of.get(w):
                u = free & m
                free = ((free + u) | (free - u)) & self.full
                if (now := self.full.bit_count() - free.bit_count()) > length:
                    length = now
                    yield i, now

    def first(self, words: Iterable[int], need: int) -> int:
        """The first place up to which need words are aligned; -1 if there is none."""
        return next((i for i, length in self.lengths(words) if length >= need), -1)

    def closest(self, words: Iterable[int], need: int) -> tuple[int, int]:
        """(place, aligned words) of at least need, with the fewest words that only one side has; the nearest of equals."""
        return min(((i, k) for i, k in self.lengths(words) if k >= need), key=lambda f: (f[0] + 1 - 2 * f[1], f[0]))


def matches(words: np.ndarray, templates: Templates, t: int, coverage: float) -> list[tuple[int, int, int]]:
    """(begin, end, aligned words) of each stretch of a text that covers template t, apart from each other.

    The text is cut into overlapping stretches of twice STRETCH template
    lengths, so that one lies around any place the template can stand in. In a
    stretch the windows of up to STRETCH template lengths that have the wanted
    coverage are taken from the left. So each of several copies is aligned on
    its own: words that both have are no anchors of the stretch.
    """
    template = templates.words[t]
    n, step = len(template), STRETCH * len(template)
    need = max(int(np.ceil(coverage * n - 1e-9)), 1)
    forward, backward = templates.common[t]
    own = templates.times[t]
    inside = np.concatenate([[0], np.cumsum((words >= 0) & (own[words] > 0))])
    text = words.tolist()
    found, done = [], 0
    for a in range(0, max(len(words) - step, 0) + 1, step) if len(words) else ():
        lo, hi = max(a, done), min(a + 2 * step, len(words))
        while hi > lo and inside[hi] - inside[lo] >= need:
            part = words[lo:hi]
            counts = np.bincount(part[part >= 0], minlength=len(own))
            if np.minimum(counts, own).sum() < need:
                break
            last = forward.first(text[lo:hi], need)
            if last < 0:
                break
            end = lo + last + 1
            begin = end - 1 - backward.first(text[lo:end][::-1], need)
            if end - begin > step:  # any that ends later and is shorter begins later too
                lo = begin + 1
                continue
            end = begin + 1 + forward.closest(text[begin : begin + step], need)[0]
            place, aligned = backward.closest(text[max(done, end - step) : end][::-1], need)
            begin = end - 1 - place
            pairs = patience(text[begin:end], template)
            if len(pairs) >= need:
                found.append((begin + pairs[0][0], begin + pairs[-1][0] + 1, len(pairs)))
            else:  # too few words that stand once
                found.append((begin, end, aligned))
            done = lo = end
    return found


def _densest(pairs: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """The most pairs that lie within STRETCH template lengths of text."""
    best, a = (0, 0), 0
    for b in range(len(pairs)):
        while pairs[b][0] - pairs[a][0] >= STRETCH * n:
            a += 1
        if b + 1 - a > best[1] - best[0]:
            best = a, b + 1
    return pairs[best[0] : best[1]]


_FOUND = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("begin", pa.int64()), ("end", pa.int64()), ("n_words", pa.int64())]))


def _best(found: list[tuple]) -> list[tuple]:
    """Of overlapping stretches (..., begin, end, ...) the first ones in order."""
    kept: list[tuple] = []
    for f in sorted(found):
        if all(f[3] <= k[2] or k[3] <= f[2] for k in kept):
            kept.append(f)
    return kept


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = LICENSES, coverage: float = COVERAGE) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_words, found.

    found has each stretch of words (begin to end, end exclusive) that aligns
    with at least coverage of a template's words: license, coverage, begin,
    end and n_words aligned, by begin, the longer first. Words are runs of
    letters and digits in lower case. Null and empty texts have none. Rows
    that repeat are scanned each on its own; other columns are left alone.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates)
        for batch in batches:
            found, counts = [], []
            for part in slices(batch.column("text"), ALPHANUMERIC, lower=True):
                numbers = known.numbers(part)
                at = known.candidates(numbers, part, coverage)
                for r, n in enumerate(part.counts.tolist()):
                    words, own = numbers[part.first[r] : part.first[r + 1]], []
                    for t in at.get(r, ()):
                        own += [(-k, -k / len(known.words[t]), b, e, known.names[t], k / len(known.words[t])) for b, e, k in matches(words, known, t, coverage)]
                    found.append([{"license": name, "coverage": c, "begin": b, "end": e, "n_words": -k} for k, _, b, e, name, c in sorted(_best(own), key=lambda f: f[2])])
                    counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(found, _FOUND)], names=["doc_id", "n_words", "found"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, n_words long, found array<struct<license:string,coverage:double,begin:long,end:long,n_words:long>>"
    return docs.select("doc_id", "text").mapInArrow(rows, ddl)


def licenses_of(found: str = "found"):
    """The distinct licenses found, sorted and joined by a comma."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda f: f.license))), ",")
