"""Substring dedup by recompression.

A text is a string of symbols, at first its words. A round names, everywhere
alike, each run of one symbol and each pair whose left symbol falls on the
left side and whose right symbol falls on the right side of a split of the
alphabet. A symbol's name and side are hashes of what it stands for, so all
tasks agree on them without a shuffle, and equal substrings get equal symbols
except near their ends.

For each symbol it is known on which words around it its being there depends.
A window of words that holds all of these has the symbol wherever the window
occurs. So each window is filed under its highest such symbol (or, if it has
none, under itself), and only windows whose symbol is known from two places
can repeat. Symbols are far fewer than windows. Windows that are left are then
compared by 96 bits of hash.

Texts are dealt to blocks of a few megabytes. A symbol or window is sent once
for each block, however often the block has it, so no passage, copy or word
makes a task large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoless.llm.words import SPACES, Slice, byte_powers, gram_hashes, mix, slices, word_powers

#: Words of a window.
WINDOW = 13
ROUNDS = 4
#: A symbol of fewer words tells too little; a window without a longer one is filed under itself.
LEAST = 3
BLOCK_BYTES = 4 << 20
#: Of the blocks' symbols, as many are compared in one group as this many blocks have.
BLOCKS_A_GROUP = 8
#: A name is sent without its lowest bytes: enough to tell names apart, and windows are compared in full later.
DROPPED_BYTES = 2
_NAME = np.uint64((1 << 64) - (1 << 8 * DROPPED_BYTES))
_FAR = np.int64(1) << 40
_NO_ID = np.iinfo(np.int64).max


def _rounds(words: np.ndarray, first: np.ndarray, n_rounds: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Symbols after each round: where they start, where they end, the words their being there depends on
    (from low on, before high), and their names. first: where the texts start, and the end of the last."""
    n = len(words)
    # Boundary b stands before word b. All are there at first. Those of texts stay, but not because of the words around.
    at = np.arange(n + 1)
    low, high = at.copy(), at.copy()
    edge = np.zeros(n + 1, dtype=bool)
    edge[first] = True
    names = words
    for k in range(n_rounds):
        left, right = names[:-1], names[1:]
        side = (mix(names, k + 1) & np.uint64(1)).astype(bool)
        joined = ((left == right) | (~side[:-1] & side[1:])) & ~edge[at[1:-1]]
        keep = np.ones(len(at), dtype=bool)
        keep[1:-1] = ~joined
        # A run of one symbol, then perhaps a run of another: both runs are named, then the pair of them.
        head = np.flatnonzero(keep[:-1])
        change = np.zeros(len(names), dtype=bool)
        change[1:] = joined & (left != right)
        tail = np.full(len(head), -1)
        group = np.cumsum(keep[:-1]) - 1
        tail[group[change]] = np.flatnonzero(change)
        end = np.append(head[1:], len(names))
        paired = tail >= 0
        run = np.where(paired, tail, end) - head
        new = _named_run(names[head], run, k)
        second = _named_run(names[tail[paired]], (end - tail)[paired], k)
        new[paired] = mix(new[paired] * np.uint64(0x9E3779B97F4A7C15) + second, 1000 + k)
        # What a boundary's fate depends on reaches to the boundaries beside it.
        lower, higher = low.copy(), high.copy()
        lower[1:], higher[:-1] = np.minimum(low[1:], low[:-1]), np.maximum(high[:-1], high[1:])
        lower[edge[at]], higher[edge[at]] = -_FAR, _FAR
        at, low, high, names = at[keep], lower[keep], higher[keep], new
        yield at[:-1], at[1:], low[:-1], high[1:], names


def _named_run(names: np.ndarray, lengths: np.ndarray, k: int) -> np.ndarray:
    return np.where(lengths > 1, mix(names + lengths.astype(np.uint64) * np.uint64(0xA24BAED4963EE407), 2000 + k), names)


class Windows:
    """The windows of a slice: first words, row of each, and 64 bits of hash."""

    def __init__(self, part: Slice, width: int):
        self.part, self.width = part, width
        self.words = part.hashes(byte_powers())
        self.hashes = gram_hashes(self.words, width, word_powers())
        self.at = np.flatnonzero(part.doc[: len(self.hashes)] == part.doc[width - 1 : width - 1 + len(self.hashes)])
        self.row, self.hashes = part.doc[self.at], self.hashes[self.at]

    def files(self, n_rounds: int, least: int) -> np.ndarray:
        """What each window is filed under: a name that is the same wherever the window occurs."""
        filed = mix(self.hashes, 3000)
        if not len(self.at):
            return filed
        for start, end, low, high, names in _rounds(self.words, self.part.first, n_rounds):
            usable = (high - low <= self.width) & (end - start >= least)
            low, high, names = low[usable], high[usable], names[usable]
            if not len(low):
                continue
            # The first such symbol from the window's first word on; a window's content decides which that is.
            i = np.searchsorted(low, self.at)
            i = np.where(i < len(low), i, 0)
            inside = (low[i] >= self.at) & (high[i] <= self.at + self.width)
            filed = np.where(inside, names[i], filed)
        return filed

    def second(self) -> np.ndarray:
        """32 more bits for each window."""
        return (gram_hashes(self.words, self.width, word_powers(other=True))[self.at] >> np.uint64(32)).astype(np.uint32)


def _packed(x: np.ndarray, skip: int = 0) -> bytes:
    """Numbers as bytes without their lowest ones, the same byte of all side by side: if they ascend, the high ones hardly take room."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize)[:, skip:].T).tobytes()


def _unpacked(data: bytes, dtype=np.uint64, skip: int = 0) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(data, np.uint8).reshape(size - skip, -1)
    out = np.zeros((planes.shape[1], size), np.uint8)
    out[:, skip:] = planes.T
    return out.view(dtype).ravel()


def _joined_up(parts: list[np.ndarray], dtype=np.uint64) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype), *parts])


def _by_group(x: np.ndarray, n_groups: int) -> list[tuple[int, int, int]]:
    """(group, begin, end) of ascending x, with its value range cut into n_groups equal parts."""
    width = (1 << 64) // n_groups + 1
    cuts = np.searchsorted(x, np.array([g * width for g in range(n_groups)], dtype=np.uint64)).tolist() + [len(x)]
    return [(g, a, b) for g, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").cast(pa.int64()).fill_null(_NO_ID).combine_chunks().to_numpy(zero_copy_only=False)


def _parts(table: pa.Table) -> Iterator[Slice]:
    texts = table.column("text").combine_chunks()
    yield from slices(texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks), SPACES)


def _sent(block: int, n_groups: int, by: np.ndarray, pack: dict) -> pa.Table:
    """A row for each group that has some of the block's numbers; pack makes bytes of a part of each column."""
    cuts = _by_group(by, n_groups)
    out = {"group": pa.array([g for g, _, _ in cuts], pa.int64()), "block": pa.array([block] * len(cuts), pa.int64())}
    return pa.table(out | {name: pa.array([f(a, b) for _, a, b in cuts], pa.binary()) for name, f in pack.items()})


def _files_of(n_groups: int, width: int, n_rounds: int, least: int):
    def files(key: tuple, table: pa.Table) -> pa.Table:
        """A block's names, each once, and whether two of its documents have it."""
        ids = _ids(table)
        names, docs = [], []
        for part in _parts(table):
            w = Windows(part, width)
            filed = w.files(n_rounds, least) & _NAME
            new = np.append(True, (filed[1:] != filed[:-1]) | (w.row[1:] != w.row[:-1]))[: len(filed)]
            names.append(filed[new])
            docs.append(ids[part.row + w.row[new]])
        names, docs = _joined_up(names), _joined_up(docs, np.int64)
        order = np.lexsort((docs, names))
        names, docs = names[order], docs[order]
        start = np.flatnonzero(np.append(True, names[1:] != names[:-1])[: len(names)])
        last = np.append(start[1:], len(names))[: len(start)] - 1
        names, twice = names[start], docs[start] != docs[last]
        return _sent(key[0].as_py(), n_groups, names, {"names": lambda a, b: _packed(names[a:b], DROPPED_BYTES), "twice": lambda a, b: np.packbits(twice[a:b]).tobytes()})

    return files


def _shared(key: tuple, table: pa.Table) -> pa.Table:
    """The names of a group that two documents have, for each of the blocks that has them."""
    each = [_unpacked(x, skip=DROPPED_BYTES) for x in table.column("names").to_pylist()]
    twice = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(n)).astype(bool) for x, n in zip(table.column("twice").to_pylist(), each)]
    names = np.concatenate(each)
    order = np.argsort(names, kind="stable")
    same = np.append(names[order][1:] == names[order][:-1], False)
    known = np.empty(len(names), dtype=bool)
    known[order] = same | np.append(False, same[:-1])
    known |= np.concatenate(twice)
    kept = [x[m] for x, m in zip(each, np.split(known, np.cumsum([len(x) for x in each])[:-1]))]
    blocks = table.column("block").to_pylist()
    return pa.table({"block": pa.array([b for b, x in zip(blocks, kept) if len(x)], pa.int64()), "names": pa.array([_packed(x, DROPPED_BYTES) for x in kept if len(x)], pa.binary())})


def _windows_of(n_groups: int, width: int, n_rounds: int, least: int):
    def windows(key: tuple, texts: pa.Table, known: pa.Table) -> pa.Table:
        """A block's windows that are filed under known names, each once, with the block's smallest doc_id that has it."""
        known = np.sort(_joined_up([_unpacked(x, skip=DROPPED_BYTES) for x in known.column("names").to_pylist()]))
        ids, h, g, doc = _ids(texts), [], [], []
        for part in _parts(texts) if len(known) else ():
            w = Windows(part, width)
            filed = w.files(n_rounds, least) & _NAME
            chosen = np.flatnonzero(known[np.minimum(np.searchsorted(known, filed), len(known) - 1)] == filed)
            h.append(w.hashes[chosen])
            g.append(w.second()[chosen])
            doc.append(ids[part.row + w.row[chosen]])
        h, g, doc = _joined_up(h), _joined_up(g, np.uint32), _joined_up(doc, np.int64)
        order = np.lexsort((doc, g, h))
        h, g, doc = h[order], g[order], doc[order]
        new = np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]))[: len(h)]
        h, g, doc = h[new], g[new], doc[new]
        return _sent(key[0].as_py(), n_groups, h, {n: lambda a, b, x=x: _packed(x[a:b]) for n, x in (("h", h), ("g", g), ("doc", doc))})

    return windows


def _repeated(key: tuple, table: pa.Table) -> pa.Table:
    """For each block its windows that a document of another block with a smaller doc_id has."""
    each = {n: [_unpacked(x, t) for x in table.column(n).to_pylist()] for n, t in (("h", np.uint64), ("g", np.uint32), ("doc", np.int64))}
    h, g, doc = (np.concatenate(each[n]) for n in ("h", "g", "doc"))
    order = np.lexsort((doc, g, h))
    new = np.append(True, (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1]))
    least = np.empty_like(doc)
    least[order] = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    smaller = np.split(least < doc, np.cumsum([len(x) for x in each["h"]])[:-1])
    blocks = table.column("block").to_pylist()
    rows = [(b, _packed(x[m]), _packed(y[m])) for b, x, y, m in zip(blocks, each["h"], each["g"], smaller) if m.any()]
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("block", pa.int64()), ("h", pa.binary()), ("g", pa.binary())))})


def _kept_of(width: int):
    def kept(key: tuple, texts: pa.Table, known: pa.Table) -> pa.Table:
        """The block's texts with the words that stay, joined by one space."""
        ids = _ids(texts)
        parts = list(_parts(texts))
        all_ = [Windows(p, width) for p in parts]
        h, g = _joined_up([w.hashes for w in all_]), _joined_up([w.second() for w in all_], np.uint32)
        doc = _joined_up([ids[p.row + w.row] for p, w in zip(parts, all_)], np.int64)
        # What other blocks told stands as a document before all others.
        told = [_joined_up([_unpacked(x, t) for x in known.column(n).to_pylist()], t) for n, t in (("h", np.uint64), ("g", np.uint32))]
        n = len(h)
        h, g, doc = np.concatenate([h, told[0]]), np.concatenate([g, told[1]]), np.concatenate([doc, np.full(len(told[0]), np.iinfo(np.int64).min)])
        sorted_ = np.sort(h)
        twice = sorted_[1:][sorted_[1:] == sorted_[:-1]]
        some = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h) if len(twice) else np.zeros(0, np.int64)
        order = some[np.lexsort((doc[some], g[some], h[some]))]
        new = np.append(True, (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1]))[: len(order)]
        covered = np.zeros(n + len(told[0]), dtype=bool)
        if len(order):
            covered[order] = doc[order] > doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        n_words, n_removed, stays, at = [], [], [], 0
        for part, w in zip(parts, all_):
            begin = w.at[covered[at : at + len(w.at)]]
            at += len(w.at)
            gone = np.zeros(len(part.starts) + 1, dtype=np.int64)
            gone[begin] += 1
            gone[begin + width] -= 1
            gone = np.cumsum(gone)[:-1] > 0
            removed = np.concatenate([[0], np.cumsum(gone)])
            n_words += part.counts.tolist()
            n_removed += (removed[part.first[1:]] - removed[part.first[:-1]]).tolist()
            stays += _joined(part, gone)
        return pa.table({"doc_id": texts.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(stays, pa.string())})

    return kept


def _joined(part: Slice, gone: np.ndarray) -> list[str]:
    """The words of each text that are not gone, joined by one space."""
    data = part.data
    # Bytes of words that stay, and one byte after each word for the space.
    mark = np.zeros(len(data) + 1, dtype=np.int8)
    stay = ~gone
    mark[part.starts[stay]] += 1
    mark[part.ends[stay]] -= 1
    inside = np.cumsum(mark, dtype=np.int8) > 0
    after = np.zeros(len(data) + 1, dtype=bool)
    after[part.ends[stay]] = True
    # A word that ends where the next text starts has no byte for its space; its text ends there anyway.
    out = []
    for a, b in zip(part.offsets.tolist(), part.offsets[1:].tolist()):
        take = inside[a:b] | after[a:b]
        if a < b:
            take[0] = inside[a]
        text = np.where(after[a:b] & ~inside[a:b], 0x20, data[a:b])[take]
        out.append(text.tobytes().decode().rstrip(" "))
    return out


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    rounds: int = ROUNDS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_words, n_removed, kept.

    A word goes if one of the windows over it also starts in a row with a
    smaller doc_id. kept has the others, joined by one space. A null text has
    no words. A null doc_id counts as larger than any other, and rows that
    share a doc_id take nothing from each other. Other columns are left alone.
    """
    plain = docs.select("doc_id", "text")
    total = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = total // block_bytes + 1
    n_groups = n_blocks // BLOCKS_A_GROUP + 1
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks))
    blocks = plain.withColumn("block", block).repartition("block")
    options = n_groups, window, rounds, LEAST
    names = blocks.groupBy("block").applyInArrow(_files_of(*options), "group long, block long, names binary, twice binary")
    shared = names.groupBy("group").applyInArrow(_shared, "block long, names binary")
    found = blocks.groupBy("block").cogroup(shared.groupBy("block"))
    found = found.applyInArrow(_windows_of(*options), "group long, block long, h binary, g binary, doc binary")
    repeated = found.groupBy("group").applyInArrow(_repeated, "block long, h binary, g binary")
    kind = docs.schema["doc_id"].dataType.simpleString()
    kept = blocks.groupBy("block").cogroup(repeated.groupBy("block"))
    return kept.applyInArrow(_kept_of(window), f"doc_id {kind}, n_words long, n_removed long, kept string")
