"""The ordered fold behind flow tracking and cooldowns, split by key AND time.

A span starts at a packet, is answered by the first packet of the other side
within the reply timeout, and then lasts until the key has been quiet for the
linger time; unanswered, it lasts for the reply timeout. The packet after a span
starts the next one, so every start depends on the one before.

One key may hold a large share of all rows, so no task ever folds a whole key.
Rows are shuffled once by (key, time chunk). Each chunk is folded for every
state in which the flow before it could leave it; the few rows this gives are
chained per key in chunk order, and each chunk then learns its true state.

    rows -> shuffle(key, chunk) -> sort -+-> chunk_exits -> shuffle(key) -> chain -+
                                         +------------- left join (key, chunk) <---+
                                                            |
                                                     fold -> rows with roles

Dense traffic in one direction gives an exit for every row of a chunk's first
second. What a chunk does to a state is a map, and maps of chunks that follow
each other compose to a map of the same form. So a key with very many rows is
not chained by one task: the maps of FAN chunks are composed to one, those of
FAN ranges again, LEVELS times; only the last ones are chained per key, and the
states found go down the same tree to the chunks. Such keys are found by a count
and folded apart from the others.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema as _arrow_schema

from ..plans.storage import stored

CHUNK_US = 5_000_000
#: A key with more rows than this goes through the tree; each composed range holds FAN maps.
BUSY_ROWS = 500_000
FAN, LEVELS = 16, 3
_FOLD_ROWS = 100_000

# Span states that can cross a chunk border.
_NONE, _PENDING, _REPLIED = 0, 1, 2
# How a chunk's first span can come about; one exit per case and chunk.
_FRESH, _AFTER_LINGER, _AFTER_REPLY, _AFTER_EXPIRY = 0, 1, 2, 3

ROLE_NAMES = ("created", "dup_request", "replied", "linger")
_CREATED, _DUP, _ANSWER, _LINGER = 0, 1, 2, 3


def whole_groups(
    batches: Iterable[pa.RecordBatch], starts, min_rows: int = _FOLD_ROWS
) -> Iterator[pa.Table]:
    """Re-cut sorted Arrow batches so that no group is split.

    `starts` flags the first row of each group of a table.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if rows >= min_rows:
            tail = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch])
            first = np.flatnonzero(starts(tail)[1:])
            if first.size:
                cut = int(first[-1])
                yield pa.Table.from_batches(held + ([batch.slice(0, cut)] if cut else []))
                batch = batch.slice(cut)
                held, rows = [], 0
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """True where a row's key differs from the row before."""
    first = np.ones(table.num_rows, dtype=bool)
    if table.num_rows > 1:
        changed = np.zeros(table.num_rows - 1, dtype=bool)
        for name in keys:
            column = table[name].combine_chunks()
            here, before = column.slice(1), column.slice(0, len(column) - 1)
            differs = pc.not_equal(here, before)
            if column.null_count:
                nulls = pc.xor(pc.is_null(here), pc.is_null(before))
                differs = pc.or_(pc.fill_null(differs, False), nulls)
            changed |= differs.to_numpy(zero_copy_only=False)
        first[1:] = changed
    return first


def _in_order(table: pa.Table, key: list[str], chunk_us: int):
    """Row order by (key, time, tag), and the first rows of each (key, chunk).

    Spark sorts on a hash of (key, chunk) alone, which is one fast radix sort;
    order inside a group is settled here, and so are hash collisions.
    """
    group, ts, tag = (table[c].to_numpy() for c in ("_group", "_ts", "_tag"))
    first = np.ones(len(ts), dtype=bool)
    first[1:] = group[1:] != group[:-1]  # groups arrive together
    order = np.argsort((np.cumsum(first) - 1) * chunk_us + ts % chunk_us)
    columns = [_codes(table[k]) for k in key]
    same_key = np.ones(len(ts) - 1, dtype=bool)
    for x in columns:
        x = x[order]
        same_key &= x[1:] == x[:-1]
    if not (same_key | first[1:]).all():
        order = np.lexsort((tag, ts, *columns[::-1]))
        chunk = np.floor_divide(ts, chunk_us)[order]
        first[1:] = chunk[1:] != chunk[:-1]
        for x in columns:
            first[1:] |= x[order][1:] != x[order][:-1]
        return order, first
    ts = ts[order]
    tied = np.flatnonzero(~first[1:] & (ts[1:] == ts[:-1])) + 1
    if tied.size:
        members = np.union1d(tied - 1, tied)
        run = np.cumsum(~np.isin(members, tied))
        rows = order[members]
        order[members] = rows[np.lexsort((tag[rows], run))]
    return order, first


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers that are equal exactly where the column is."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy()
    encoded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    return encoded.indices.to_numpy()


class _Chunk:
    """Rows of many (key, chunk) groups in order, and the span links between them.

    Index arrays; `end` of a row is the index after its group's last row.
    """

    def __init__(self, table: pa.Table, key, reply_timeout: int, linger: int, chunk_us: int):
        self.order, first = _in_order(table, key, chunk_us)
        self.ts, tag = table["_ts"].to_numpy()[self.order], table["_tag"].to_numpy()[self.order]
        self.id, self.side = tag >> 1, tag & 1
        n = self.n = len(self.ts)
        self.start = np.flatnonzero(first)
        self.group = np.cumsum(first) - 1
        self.group_end = np.append(self.start[1:], n)
        self.end = self.group_end[self.group]
        self.reply_timeout, self.linger = reply_timeout, linger
        # One rising clock over all groups, so one binary search serves them all.
        base = self.ts[self.start]
        since = self.ts - base[self.group]
        self.stride = int(since.max()) + reply_timeout + 1
        self.base, self.clock = base, since + self.group * self.stride
        turn = first.copy()
        turn[1:] |= self.side[1:] != self.side[:-1]
        pause = first.copy()
        pause[1:] |= np.diff(self.ts) >= linger
        self.answer = self._next(turn)  # first row of the other side, or a group end
        self.quiet = self._next(pause)  # first row after a silence, or a group end
        self.answered = self._in_time(self.answer, self.ts, self.end)
        self.next_start = np.where(
            self.answered, self.quiet[np.minimum(self.answer, n - 1)], self.expiry(self.clock)
        )

    def _next(self, flags: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(flags)
        return np.append(at[1:], self.n)[np.cumsum(flags) - 1]

    def _in_time(self, answer, asked, end):
        return (answer < end) & (self.ts[np.minimum(answer, self.n - 1)] - asked < self.reply_timeout)

    def expiry(self, clock: np.ndarray) -> np.ndarray:
        """First row whose clock is at least a reply timeout later."""
        return np.searchsorted(self.clock, clock + self.reply_timeout, side="left")

    def quiet_after(self, row: np.ndarray, end: np.ndarray) -> np.ndarray:
        return np.where(row < end, self.quiet[np.minimum(row, self.n - 1)], end)

    def last_start(self, row: np.ndarray) -> np.ndarray:
        """Last span start reached from each row; spans are never shorter than
        the smaller time limit, so the steps per chunk are few."""
        row = row.copy()
        live = np.flatnonzero(row < self.n)
        while live.size:
            step = self.next_start[row[live]]
            live, step = live[step < self.end[row[live]]], step[step < self.end[row[live]]]
            row[live] = step
        return row

    def mark(self, roots: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Flag every span start, given each group's first one."""
        flags = np.zeros(self.n, dtype=bool)
        row = roots[roots < ends]
        while row.size:
            flags[row] = True
            step = self.next_start[row]
            row = step[step < self.end[row]]
        return flags


def _exit_state(c: _Chunk, last: np.ndarray, chunk_end: np.ndarray):
    """State in which a span started at `last` leaves its chunk."""
    answered = c.answered[last]
    heard = c.ts[c.end[last] - 1]
    lingers = answered & (c.next_start[last] == c.end[last]) & (chunk_end - heard < c.linger)
    waits = ~answered & (chunk_end - c.ts[last] < c.reply_timeout)
    kind = np.where(lingers, _REPLIED, np.where(waits, _PENDING, _NONE))
    return kind, np.where(lingers, heard, c.ts[last])


def _exits_fn(key: list[str], reply_timeout: int, linger: int, chunk_us: int, schema: pa.Schema):
    horizon = max(reply_timeout, linger)

    def exits(table: pa.Table) -> pa.Table:
        c = _Chunk(table, key, reply_timeout, linger, chunk_us)
        start, end = c.start, c.group_end
        chunk = np.floor_divide(c.ts[start], chunk_us)
        opens = chunk * chunk_us
        closes = opens + chunk_us
        turn = c.answer[start]
        early = c.ts[start] < opens + horizon
        fresh_kind, _ = _exit_state(c, c.last_start(start), closes)
        which = np.flatnonzero(early | (fresh_kind != _NONE))
        touched = np.flatnonzero(early)
        # Thresholds: a pending span can end at any early row of the first run,
        # at the turn after it, or at the first row past the horizon.
        edge = np.searchsorted(
            c.clock, opens + horizon - c.base + np.arange(len(start)) * c.stride, side="left"
        )
        edge = np.minimum(edge, end)
        stop = np.minimum(np.minimum(edge, turn) + 1, end)[touched]
        lengths = stop - start[touched]
        owner = np.repeat(touched, lengths)
        rows = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        rows = rows + start[owner]
        reached = c.last_start(rows)
        kind, _ = _exit_state(c, reached, closes[owner])
        outcome = np.where(kind == _NONE, -1, reached)
        final = np.ones(len(rows), dtype=bool)
        final[:-1] = (owner[1:] != owner[:-1]) | (outcome[1:] != outcome[:-1])
        owner, rows = owner[final], rows[final]

        lingered = c.quiet[start[touched]]
        replied = c.quiet_after(turn[touched], end[touched])
        g = np.concatenate([which, touched, touched, owner])
        case = np.repeat(
            [_FRESH, _AFTER_LINGER, _AFTER_REPLY, _AFTER_EXPIRY],
            [len(which), len(touched), len(touched), len(owner)],
        )
        root = np.concatenate([start[which], lingered, replied, rows])
        until = np.concatenate([
            np.zeros(len(which) + 2 * len(touched), dtype=np.int64), c.ts[rows]
        ])
        swallowed = root >= end[g]  # the span before outlasts the whole chunk
        last = c.last_start(np.where(swallowed, start[g], root))
        kind, at = _exit_state(c, last, closes[g])
        heard = c.ts[end[g] - 1]
        kind = np.where(
            swallowed, np.where(closes[g] - heard < linger, _REPLIED, _NONE), kind
        )
        at = np.where(swallowed, heard, at)
        turn_ts = np.where(turn < end, c.ts[np.minimum(turn, c.n - 1)], -1)
        columns = [table[k].take(pa.array(c.order[start[g]])) for k in key]
        columns += [
            pa.array(x)
            for x in (
                chunk[g], chunk[g], case.astype(np.int32), until, kind.astype(np.int32), at,
                c.side[last].astype(np.int32), c.ts[last], c.id[last], swallowed,
                c.ts[start[g]], c.side[start[g]].astype(np.int32),
                turn_ts[g], turn[g] < end[g],
            )
        ]
        return pa.Table.from_arrays(columns, schema=schema)

    def run(batches):
        for table in whole_groups(batches, lambda t: group_starts(t, ["_group"])):
            yield from exits(table).to_batches()

    return run


_EXIT_COLUMNS = (
    ("_last", "bigint"), ("case", "int"), ("until", "bigint"), ("kind", "int"), ("at", "bigint"),
    ("side", "int"), ("t0", "bigint"), ("first_id", "bigint"), ("same", "boolean"),
    ("opens_ts", "bigint"), ("opens_side", "int"), ("turn_ts", "bigint"), ("turns", "boolean"),
)
_REPLY_COLUMN = (("reply_ts", "bigint"),)
_ROLE_COLUMNS = (("role", "int"), ("flow_t0", "bigint"), ("flow_id", "bigint"))
_MISSING = np.iinfo(np.int64).min
# What a chunk is told: the state it begins in, and the first row of each side
# in the next chunk.
_ENTRY_COLUMNS = ("kind", "at", "side", "t0", "first_id", "next_ts0", "next_ts1")


class _Maps:
    """What chunks, or ranges of chunks, do to the state they begin in.

    Rows of a table in the order (key, chunk, case, until); the rows of one chunk
    are its map. `head` is the first row of each map, `of_row` the map of a row.
    """

    def __init__(self, table: pa.Table, key: list[str], reply_timeout: int, linger: int):
        self.key, self.group = key, key + ["_chunk"]
        self.reply_timeout, self.linger = reply_timeout, linger
        heads = group_starts(table, self.group)
        self.table, self.head, self.of_row = table, np.flatnonzero(heads), np.cumsum(heads) - 1
        self.col = {name: table[name].to_numpy() for name, _ in _EXIT_COLUMNS}
        n = self.n = len(self.head)
        self.chunk = table["_chunk"].to_numpy()[self.head]
        self.last = self.col["_last"][self.head]
        firsts = group_starts(table.take(pa.array(self.head)), key)
        self.first_of_key = firsts.copy()
        self.follows = ~firsts
        self.follows[1:] &= self.chunk[1:] == self.last[:-1] + 1
        self.case_at = np.full((3, n), -1)
        for case in (_FRESH, _AFTER_LINGER, _AFTER_REPLY):
            rows = np.flatnonzero(self.col["case"] == case)
            self.case_at[case, self.of_row[rows]] = rows
        steps = self.steps = np.flatnonzero(self.col["case"] == _AFTER_EXPIRY)
        self.low = int(self.col["until"][steps].min()) if steps.size else 0
        self.width = (int(self.col["until"][steps].max()) - self.low if steps.size else 0) + 2
        self.step_clock = self.of_row[steps] * self.width + (self.col["until"][steps] - self.low)
        self.opens, self.opens_side, self.turn_ts, self.turns = (
            self.col[name][self.case_at[_FRESH]] for name in ("opens_ts", "opens_side", "turn_ts", "turns")
        )

    def _first_step(self, groups: np.ndarray, due: np.ndarray) -> np.ndarray:
        """Row whose threshold covers `due`; -1 where the map has none left."""
        if not self.steps.size:
            return np.full(len(groups), -1)
        wanted = np.clip(due - self.low, 0, self.width - 1)
        hit = np.searchsorted(self.step_clock, groups * self.width + wanted, side="left")
        found = self.steps[np.minimum(hit, len(self.steps) - 1)]
        return np.where((hit < len(self.steps)) & (self.of_row[found] == groups), found, -1)

    def fresh(self, now: np.ndarray) -> np.ndarray:
        return self.case_at[_FRESH, now]

    def exit_of(self, now: np.ndarray, kind: np.ndarray, at: np.ndarray, side: np.ndarray) -> np.ndarray:
        """The exit row that the maps `now` give for these states."""
        opens, turn_ts = self.opens[now], self.turn_ts[now]
        pending = kind == _PENDING
        alike = side == self.opens_side[now]
        heard = np.where(alike, turn_ts, opens)
        replied = pending & (heard - at < self.reply_timeout) & (~alike | self.turns[now])
        lingers = (kind == _REPLIED) & (opens - at < self.linger)
        expires = pending & ~replied & (at + self.reply_timeout > opens)
        row = self.case_at[_FRESH, now]
        row = np.where(lingers | (replied & ~alike), self.case_at[_AFTER_LINGER, now], row)
        row = np.where(replied & alike, self.case_at[_AFTER_REPLY, now], row)
        return np.where(expires, self._first_step(now, at + self.reply_timeout), row)

    def leave(self, state: dict[str, np.ndarray], row: np.ndarray) -> dict[str, np.ndarray]:
        """The states in which spans leave by these exit rows, given those in which they came."""
        same = self.col["same"][row]
        after = {name: np.where(same, state[name], self.col[name][row]) for name in _FLOW}
        return {"kind": np.where(row >= 0, self.col["kind"][row], _NONE), "at": self.col["at"][row], **after}


_FLOW = ("side", "t0", "first_id")


def _chain(maps: _Maps, entry: np.ndarray | None, schema: pa.Schema) -> pa.Table:
    """Walk the maps of each key in order, all keys together, and tell each map the state it begins in.

    `entry` is what the range of the only key is told itself.
    """
    n, head, follows = maps.n, maps.head, maps.follows
    state = {name: np.zeros(n, dtype=np.int64) for name in ("kind", "at", *_FLOW)}
    told = entry is not None and entry[0] not in (_NONE, _MISSING)
    now = np.flatnonzero(~follows)
    row = maps.fresh(now)
    if told:
        first = {name: np.array([x]) for name, x in zip(("kind", "at", *_FLOW), entry)}
        row[0] = maps.exit_of(now[:1], first["kind"], first["at"], first["side"])[0]
    while now.size:
        came = {name: state[name][now - 1] for name in state}
        if told and now[0] == 0:
            for name in state:
                came[name][0] = first[name][0]
        for name, values in maps.leave(came, row).items():
            state[name][now] = values
        now = now[now + 1 < n] + 1
        now = now[follows[now]]
        row = maps.exit_of(now, *(state[name][now - 1] for name in ("kind", "at", "side")))

    # A state matters to a chunk that begins before the state runs out, and a
    # first answer to the chunk before it only while that one still waits.
    before = np.flatnonzero(follows) - 1
    after = before + 1
    waits = state["kind"][before] == _PENDING
    limit = np.where(waits, maps.reply_timeout, maps.linger)
    lives = (state["kind"][before] != _NONE) & (maps.opens[after] - state["at"][before] < limit)
    fields = np.full((len(_ENTRY_COLUMNS), n), _MISSING)
    for i, name in enumerate(("kind", "at", *_FLOW)):
        fields[i, after[lives]] = state[name][before[lives]]
    for side in (0, 1):
        first_row = np.where(maps.opens_side == side, maps.opens, maps.turn_ts)[after]
        known = waits & ((maps.opens_side == side) | maps.turns)[after]
        fields[5 + side, before[known]] = first_row[known]
    if entry is not None:
        fields[:5, 0], fields[5:, -1] = entry[:5], entry[5:]
    shown = np.flatnonzero((fields != _MISSING).any(axis=0))
    source = maps.table.take(pa.array(head[shown]))
    offsets = np.arange(len(shown) + 1, dtype=np.int32) * len(fields)
    entries = pa.ListArray.from_arrays(offsets, fields[:, shown].T.ravel())
    return pa.Table.from_arrays([source[k] for k in maps.group] + [entries], schema=schema)


def _chain_fn(key, reply_timeout: int, linger: int, schema: pa.Schema):
    def run(batches):
        for table in whole_groups(batches, lambda t: group_starts(t, key)):
            yield from _chain(_Maps(table, key, reply_timeout, linger), None, schema).to_batches()

    return run


def _in_map_order(table: pa.Table) -> pa.Table:
    return table.sort_by([(c, "ascending") for c in ("_chunk", "case", "until")])


def _compose_fn(key, reply_timeout: int, linger: int, schema: pa.Schema):
    """One map for the chunks of a range: that of the first chunk, carried through the others."""

    def compose(table: pa.Table) -> pa.Table:
        maps = _Maps(_in_map_order(table), key, reply_timeout, linger)
        own = np.arange(maps.head[1] if maps.n > 1 else table.num_rows)
        until = maps.col["until"][own]
        # A span that ends after the first chunk's last row leaves it in no state.
        latest = maps.opens[0] + reply_timeout
        ends = maps.col["case"][own[-1]] == _AFTER_EXPIRY and until[-1] < latest
        if ends:
            own, until = np.append(own, own[-1]), np.append(until, latest)
        none = {name: np.zeros(len(own), dtype=np.int64) for name in ("kind", "at", *_FLOW)}
        state = maps.leave(none, own)
        same = maps.col["same"][own].copy()
        if ends:
            state["kind"][-1], same[-1] = _NONE, False
        for nxt in range(1, maps.n):
            now = np.full(len(own), nxt)
            row = maps.exit_of(now, state["kind"], state["at"], state["side"]) if maps.follows[nxt] else maps.fresh(now)
            state = maps.leave(state, row)
            same &= maps.col["same"][row]
        columns = {name: maps.col[name][own] for name, _ in _EXIT_COLUMNS} | state
        columns |= {"until": until, "same": same, "_last": np.full(len(own), maps.last[-1])}
        # Neighbouring thresholds with one outcome are one.
        keep = np.ones(len(own), dtype=bool)
        if len(own) > 1:
            alike = (columns["case"][1:] == _AFTER_EXPIRY) & (columns["case"][:-1] == _AFTER_EXPIRY)
            for name in ("kind", "at", "same", *_FLOW):
                alike &= columns[name][1:] == columns[name][:-1]
            keep[:-1] = ~alike
        kept = pa.array(own[keep])
        made = [maps.table[k].take(kept) for k in maps.group]
        made += [pa.array(columns[name][keep], schema.field(name).type) for name, _ in _EXIT_COLUMNS]
        return pa.Table.from_arrays(made, schema=schema)

    return compose


def _descend_fn(key, reply_timeout: int, linger: int, schema: pa.Schema):
    """Tell the maps of a range what the range is told."""

    def descend(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        nothing = np.full(len(_ENTRY_COLUMNS), _MISSING)
        entry = np.array(told["_entry"][0].as_py(), dtype=np.int64) if told.num_rows else nothing
        return _chain(_Maps(_in_map_order(table), key, reply_timeout, linger), entry, schema)

    return descend


def _entries_by_tree(exits: DataFrame, key, limits: tuple[int, int], exit_schema, entry_schema, chain) -> DataFrame:
    """Entries of the chunks of keys with many exits; no task holds more than FAN maps, or a key's maps of the last level."""
    exit_arrow, entry_arrow = _arrow_schema(exit_schema), _arrow_schema(entry_schema)
    names = [f.name for f in entry_schema]
    levels = []
    maps = stored(exits)
    for level in range(1, LEVELS + 1):
        placed = maps.withColumn("_range", _range_of("_chunk", level))
        levels.append(placed)
        compose = _compose_fn(key, *limits, exit_arrow)
        maps = stored(placed.groupBy(*key, "_range").applyInArrow(compose, exit_schema))
    entries = maps.repartition(*key).sortWithinPartitions(*key, "_chunk", "case", "until").mapInArrow(chain, entry_schema)
    for level in range(LEVELS, 0, -1):
        told = entries.withColumn("_range", _range_of("_chunk", level))
        descend = _descend_fn(key, *limits, entry_arrow)
        both = levels[level - 1].groupBy(*key, "_range").cogroup(told.groupBy(*names[: len(key)], "_range"))
        entries = both.applyInArrow(descend, entry_schema)
    return entries


def _busy_keys(rows: DataFrame, key: list[str]) -> DataFrame | None:
    """Keys with more than BUSY_ROWS rows, if there are any; one for BUSY_ROWS rows at most."""
    if rows.count() <= BUSY_ROWS:
        return None
    busy = stored(rows.groupBy(*key).count().filter(F.col("count") > BUSY_ROWS).drop("count"))
    return None if busy.isEmpty() else busy


def _range_of(chunk: str, level: int) -> Column:
    return F.expr(f"({chunk} - pmod({chunk}, {FAN**level}L)) div {FAN**level}L")


def _fold_fn(key, kept, reply_timeout, linger, chunk_us, starts_only, schema):
    """`kept` maps each output column to its source in the sorted rows."""

    def fold(table: pa.Table) -> pa.Table:
        c = _Chunk(table, key, reply_timeout, linger, chunk_us)
        start, end, n = c.start, c.group_end, c.n
        kind, at, in_side, in_t0, in_id, next0, next1 = _entries(
            table["_entry"], c.order[start]
        )
        pending, lingering = kind == _PENDING, kind == _REPLIED
        answer = np.where(c.side[start] == in_side, c.answer[start], start)
        replied = pending & c._in_time(answer, at, end)
        expired = np.clip(
            c.expiry(at - c.base + np.arange(len(start)) * c.stride), start, end
        )
        root = np.where(
            replied,
            c.quiet_after(answer, end),
            np.where(
                pending,
                expired,
                np.where(lingering & (c.ts[start] - at < linger), c.quiet[start], start),
            ),
        )
        created = c.mark(root, end)
        rows = np.arange(n)
        owner = np.maximum.accumulate(np.where(created, rows, -1))
        inherited = owner < start[c.group]
        owner = np.maximum(owner, 0)
        asked = c.answered[owner]
        turn = np.where(inherited, answer[c.group], c.answer[owner])
        heard = np.where(inherited, replied[c.group], asked)
        role = np.where(heard & (rows > turn), _LINGER, _DUP)
        role = np.where(heard & (rows == turn), _ANSWER, role)
        role = np.where(inherited & lingering[c.group], _LINGER, role)
        role = np.where(created, _CREATED, role)
        # Answers to spans at the chunk's end may only come in the next chunk.
        opposite = np.where(c.side == 0, next1[c.group], next0[c.group])
        later = (
            created & ~c.answered & (c.answer == c.end)
            & (opposite != _MISSING) & (opposite - reply_timeout < c.ts)
        )
        reply_ts = np.where(later, opposite, c.ts[np.minimum(c.answer, n - 1)])
        no_reply = ~(created & (c.answered | later))
        shown = np.flatnonzero(created) if starts_only else np.arange(n)
        picked = pa.array(c.order[shown])
        made = {"_id": c.id, "_ts": c.ts, "_side": c.side.astype(np.int32)}
        out = [pa.array(made[x][shown]) if x in made else table[x].take(picked) for x in kept]
        out.append(pa.array(reply_ts[shown], mask=no_reply[shown]))
        if not starts_only:
            t0 = np.where(inherited, in_t0[c.group], c.ts[owner])
            first_id = np.where(inherited, in_id[c.group], c.id[owner])
            out += [pa.array(role.astype(np.int32)), pa.array(t0), pa.array(first_id)]
        return pa.Table.from_arrays(out, schema=schema)

    def run(batches):
        for table in whole_groups(batches, lambda t: group_starts(t, ["_group"])):
            yield from fold(table).to_batches()

    return run


def _entries(column: pa.ChunkedArray, rows: np.ndarray) -> np.ndarray:
    """What the groups of these rows are told; one row per entry field."""
    lists = column.combine_chunks().take(pa.array(rows))
    known = np.flatnonzero(pc.is_valid(lists).to_numpy(zero_copy_only=False))
    fields = np.full((len(_ENTRY_COLUMNS), len(rows)), _MISSING)
    fields[0] = _NONE
    if known.size:
        flat = pc.list_flatten(lists).to_numpy()
        fields[:, known] = flat.reshape(-1, len(_ENTRY_COLUMNS)).T
    # Groups that only know their follow-up begin in no state.
    fields[0, fields[0] == _MISSING] = _NONE
    fields[1:5, fields[0] == _NONE] = 0
    return fields


def placed_fold(
    rows: DataFrame,
    key: list[str],
    ts: str,
    row_id: str,
    side: str,
    reply_timeout_us: int,
    linger_us: int,
    starts_only: bool = False,
    chunk_us: int = CHUNK_US,
) -> tuple[DataFrame, DataFrame]:
    """Give every row its role in the spans of its key; also the rows as shuffled, for latest().

    `side` names a column that is 0 or 1; `key`, `ts` and `row_id` must not be
    NULL, and ids stay below 2^62. Adds `reply_ts` on starting rows and, unless
    `starts_only`, `role` (index into ROLE_NAMES), `flow_t0` and `flow_id` (time
    and id of the row that started the span). With `starts_only` just the
    starting rows come out. Rows should be narrow, and keys few and numeric.
    """
    if min(reply_timeout_us, linger_us) <= 0:
        raise ValueError("time limits must be positive")
    if chunk_us < max(reply_timeout_us, linger_us):
        raise ValueError("chunk_us must not be shorter than the time limits")
    limits = (reply_timeout_us, linger_us)
    names = (key, ts, row_id, side)
    busy = _busy_keys(rows, key)
    if busy is None:
        return _folded(rows, *names, *limits, starts_only, chunk_us, False)
    quiet = rows.join(F.broadcast(busy), key, "left_anti").select(rows.columns)
    apart = rows.join(F.broadcast(busy), key, "left_semi").select(rows.columns)
    folded, placed = _folded(quiet, *names, *limits, starts_only, chunk_us, False)
    busy_folded, busy_placed = _folded(apart, *names, *limits, starts_only, chunk_us, True)
    return folded.unionByName(busy_folded), placed.unionByName(busy_placed)


def _folded(
    rows: DataFrame, key: list[str], ts: str, row_id: str, side: str,
    reply_timeout_us: int, linger_us: int, starts_only: bool, chunk_us: int, by_tree: bool,
) -> tuple[DataFrame, DataFrame]:
    kept = rows.columns
    chunk = F.expr(f"(_ts - pmod(_ts, {chunk_us})) div {chunk_us}")
    grouped = F.xxhash64(*[F.col(k) for k in key], chunk).alias("_group")
    # Both branches below read the same columns, so Spark shuffles the rows once.
    placed = rows.select(
        *[F.col(k) for k in key],
        F.col(ts).alias("_ts"),
        (F.col(row_id) * 2 + F.col(side)).alias("_tag"),
        *[F.col(k) for k in kept if k not in (*key, ts, row_id, side)],
    ).repartition(*key, chunk)

    group_fields = [rows.schema[k] for k in key] + [T.StructField("_chunk", T.LongType())]
    exit_schema = T.StructType(group_fields + _fields(_EXIT_COLUMNS))
    entry_schema = T.StructType(
        [T.StructField(f"_k{i}", rows.schema[k].dataType) for i, k in enumerate(key)]
        + [
            T.StructField("_chunk", T.LongType()),
            T.StructField("_entry", T.ArrayType(T.LongType(), False)),
        ]
    )
    added = _REPLY_COLUMN if starts_only else _REPLY_COLUMN + _ROLE_COLUMNS
    out_schema = T.StructType([rows.schema[k] for k in kept] + _fields(added))
    exits = placed.select("*", grouped).sortWithinPartitions("_group").mapInArrow(
        _exits_fn(key, reply_timeout_us, linger_us, chunk_us, _arrow_schema(exit_schema)),
        exit_schema,
    )
    chain = _chain_fn(key, reply_timeout_us, linger_us, _arrow_schema(entry_schema))
    if by_tree:
        entries = _entries_by_tree(exits, key, (reply_timeout_us, linger_us), exit_schema, entry_schema, chain)
    else:
        in_order = exits.repartition(*key).sortWithinPartitions(*key, "_chunk", "case", "until")
        entries = in_order.mapInArrow(chain, entry_schema)
    same = chunk == F.col("_chunk")
    for i, k in enumerate(key):
        same = (F.col(k) == F.col(f"_k{i}")) & same
    source = {ts: "_ts", row_id: "_id", side: "_side"}
    fold = _fold_fn(
        key, [source.get(k, k) for k in kept], reply_timeout_us, linger_us, chunk_us,
        starts_only, _arrow_schema(out_schema),
    )
    folded = (
        placed.join(entries.hint("shuffle_hash"), same, "left")
        .select(*placed.columns, "_entry", grouped)
        .sortWithinPartitions("_group")
        .mapInArrow(fold, out_schema)
    )
    return folded, placed


def fold_spans(rows: DataFrame, *args, **options) -> DataFrame:
    """The first of what placed_fold gives."""
    return placed_fold(rows, *args, **options)[0]


def latest(placed: DataFrame) -> Column:
    """The largest time of the rows that placed_fold has shuffled, as a scalar.

    It takes whole rows, so that Spark reads them from the shuffle that the
    fold has made and not from the input once more.
    """
    row = F.struct("_ts", *[c for c in placed.columns if c != "_ts"])
    return placed.agg(F.max(row)["_ts"].alias("now")).scalar()


def _fields(columns) -> list[T.StructField]:
    types = {"int": T.IntegerType(), "bigint": T.LongType(), "boolean": T.BooleanType()}
    return [T.StructField(name, types[kind]) for name, kind in columns]
