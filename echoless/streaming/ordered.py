"""Event-time ordered folds on streams.

Rows of a key wait in state until the watermark passes them, so a stream gives
what the batch operators give however its rows are split or mixed up within the
watermark. Rows later than that are dropped and counted by Spark.
"""

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from threading import Event

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupStateTimeout

from ..schema import CLOCK_ORIGIN_US

#: Keys are dealt by hash to so many groups; a checkpoint holds for one number.
BUCKETS = 512
_STATE = "open binary, waiting binary"
#: Stands for NULL in arrays of longs.
_NULL = -(1 << 63)
_IDLE, _PENDING, _REPLIED = 0, 1, 2


class Rows:
    """Rows and carried states of many keys in order; a key's state, if any, comes first.

    `kind` is _IDLE for rows; a state has its last time that matters in `ts`.
    `end` is the position after the last row of a row's key.
    """

    def __init__(self, table: np.ndarray, n_keys: int):
        self.keys = table[:, :n_keys]
        self.kind, self.ts, self.t0, self.id, self.side = table[:, n_keys:].T
        new = np.append(True, (self.keys[1:] != self.keys[:-1]).any(axis=1))
        self.number = np.cumsum(new) - 1
        self.last = np.append(np.flatnonzero(new)[1:], len(new)) - 1
        self.end = self.last[self.number] + 1
        self._inner = ~new

    def next(self, flagged: np.ndarray) -> np.ndarray:
        """The next flagged row of the key after each row, else its end; flagged[i] may compare row i + 1 with row i."""
        at = np.append(np.where(self._inner[1:] & flagged, np.arange(1, len(self.ts)), len(self.ts)), len(self.ts))
        return np.minimum(np.minimum.accumulate(at[::-1])[::-1], self.end)

    def after_gap(self, gap_us: int) -> np.ndarray:
        """The next row of the key that comes gap_us or more after the one before it."""
        return self.next(self.ts[1:] - self.ts[:-1] >= gap_us)

    def from_time(self, limit: np.ndarray) -> np.ndarray:
        """The first row of each row's key that is not before limit."""
        n = len(limit)
        ask = np.repeat([True, False], n)
        order = np.lexsort((~ask, np.concatenate([limit, self.ts]), np.tile(self.number, 2)))
        found, before = np.empty(n, np.int64), np.cumsum(~ask[order])
        asked = ask[order]
        found[order[asked]] = before[asked]
        return found


def _starts(following: np.ndarray) -> np.ndarray:
    """From the first row on, where each span ends and the next one starts."""
    following, i, found = following.tolist(), 0, []
    while i < len(following):
        found.append(i)
        i = following[i]
    return np.array(found, np.int64)


class OrderedFold:
    """Base: holds rows back, hands them over in order, wakes up when time is due.

    A group holds many keys. Their rows are folded as arrays, and kept as arrays
    in one state, so a key costs no call of its own.

    Subclasses give `fold(rows, now_us)`: the positions of the rows that output
    is about with its columns, and the states that stay: positions, kinds, last
    times that matter, times and ids of their firsts, sides. `due` is how long
    after its last time a state of each kind has something to do.
    """

    key_columns: list[str] = []
    columns: list[str] = []

    def __init__(self, limits: tuple):
        self.limits = limits

    def __call__(self, key, frames: Iterator[pd.DataFrame], group) -> Iterator[pd.DataFrame]:
        mark, n = group.getCurrentWatermarkMs(), len(self.key_columns)
        now = mark * 1000 - CLOCK_ORIGIN_US
        states, rows = np.zeros((0, n + 5), np.int64), [np.zeros((0, n + 3), np.int64)]
        if group.exists:
            states, waiting = group.get
            states = np.frombuffer(states, np.int64).reshape(-1, n + 5)
            rows.append(np.frombuffer(waiting, np.int64).reshape(-1, n + 3))
        if not group.hasTimedOut:
            names = [*self.key_columns, "ts_us", "pkt_id", "side"]
            rows += [frame[names].to_numpy(np.int64) for frame in frames]
        rows = np.concatenate(rows)
        settled = rows[:, n] <= now
        rows, left = rows[settled], rows[~settled]
        table = np.zeros((len(rows), n + 5), np.int64)
        table[:, :n], table[:, n + 1], table[:, n + 3 :] = rows[:, :n], rows[:, n], rows[:, n + 1 :]
        table = np.concatenate([states, table])
        if len(table):
            by = (table[:, n + 4], table[:, n + 3], table[:, n + 1], table[:, n] == _IDLE)
            table = table[np.lexsort((*by, *table[:, :n].T))]
            folded = Rows(table, n)
            about, out, (at, *kept) = self.fold(folded, now)
            states = np.column_stack([folded.keys[at], *kept]).astype(np.int64)
            if len(about):
                yield self._frame(folded.keys[about], out)
        self._keep(group, states, left, mark)

    def _frame(self, keys: np.ndarray, out: list) -> pd.DataFrame:
        columns = {}
        for name, values in zip(self.key_columns + self.columns, [*keys.T, *out]):
            longs = values.dtype.kind == "i"
            columns[name] = pd.arrays.IntegerArray(values.copy(), values == _NULL) if longs else values
        return pd.DataFrame(columns)

    def _keep(self, group, states, left, mark) -> None:
        n = len(self.key_columns)
        due = [left[:, n], states[:, n + 1] + np.array([0, *self.due])[states[:, n]]]
        due = np.concatenate(due)
        if not len(due):
            group.remove()
            return
        group.update((states.tobytes(), left.tobytes()))
        # Timeouts are whole milliseconds and fire once the watermark is past them.
        group.setTimeoutTimestamp(max(-(-(int(due.min()) + CLOCK_ORIGIN_US) // 1000) - 1, mark, 1))


class FlowFold(OrderedFold):
    """Replied and unanswered flows; limits are (reply timeout, linger)."""

    key_columns = ["proto", "ep_lo", "ep_hi"]
    columns = ["status", "side", "t0", "first_pkt_id", "reply_ts"]

    @property
    def due(self):
        return self.limits

    def fold(self, r: Rows, now: int):
        timeout, linger = self.limits
        reply, quiet = r.next(r.side[1:] != r.side[:-1]), r.after_gap(linger)
        expiry = r.from_time(r.ts + timeout)
        replied = reply < expiry
        over = np.where(replied, quiet[np.minimum(reply, len(reply) - 1)], expiry)
        over = np.where(r.kind == _REPLIED, quiet, over)
        start = _starts(over)
        told = start[r.kind[start] != _REPLIED]
        told = told[replied[told] | (r.ts[told] + timeout <= now)]
        answered = replied[told]
        status = np.where(answered, "replied", "unanswered").astype(object)
        reply_ts = np.where(answered, r.ts[np.where(answered, reply[told], 0)], _NULL)
        out = [status, r.side[told], r.ts[told], r.id[told], reply_ts]
        # The span that reaches the key's last row lives on unless its time is over.
        at = start[over[start] == r.end[start]]
        ended = replied[at] | (r.kind[at] == _REPLIED)
        kind = np.where(ended, _REPLIED, _PENDING)
        last = np.where(ended, r.ts[r.end[at] - 1], r.ts[at])
        lives = last + np.where(ended, linger, timeout) > now
        at, kind, last = at[lives], kind[lives], last[lives]
        return told, out, (at, kind, last, r.ts[at], r.id[at], r.side[at])


class CooldownFold(OrderedFold):
    """Rules that pass the cooldown; the only limit is the cooldown."""

    key_columns = ["ip", "port", "proto"]
    columns = ["ts_us"]

    @property
    def due(self):
        return (*self.limits, 0)

    def fold(self, r: Rows, now: int):
        over = r.from_time(r.ts + self.limits[0])
        start = _starts(over)
        told = start[r.kind[start] == _IDLE]
        at = start[(over[start] == r.end[start]) & (r.ts[start] + self.limits[0] > now)]
        zero = np.zeros(len(at), np.int64)
        return told, [r.ts[told]], (at, zero + _PENDING, r.ts[at], r.ts[at], zero, zero)


class SessionFold(OrderedFold):
    """Lifetimes of rules; rows of side 0 are rules, others hits; the limit is the time to live.

    A pending key has hits only. From its first rule on `first id` counts hits.
    """

    key_columns = ["ip", "port", "proto"]
    columns = ["start_us", "end_us", "n_hits"]

    @property
    def due(self):
        return (self.limits[0] + 1,) * 2  # a use at the last moment still prolongs

    def fold(self, r: Rows, now: int):
        over = r.after_gap(self.limits[0] + 1)
        at = _starts(over)
        over, known = over[at], r.kind[at] == _REPLIED
        rule = (r.side == 0) & (r.kind == _IDLE)
        first = np.where(rule, np.arange(len(rule)), r.next(rule[1:]))[at]
        hits = np.append(0, np.cumsum((r.side != 0) & (r.kind == _IDLE)))
        begun = known | (first < over)
        first = np.where(known, at, np.minimum(first, len(rule) - 1))
        begin = np.where(known, r.t0[first], r.ts[first])
        n_hits = np.where(known, r.id[at], 0) + hits[over] - hits[first]
        last = r.ts[over - 1]
        lives = last + self.limits[0] + 1 > now
        told, kind = begun & ~lives, np.where(begun, _REPLIED, _PENDING)
        zero = np.zeros(len(at), np.int64)
        begin, n_hits = np.where(begun, begin, 0), np.where(begun, n_hits, 0)
        out = [begin[told], last[told] + self.limits[0], n_hits[told]]
        return at[told], out, [x[lives] for x in (at, kind, last, begin, n_hits, zero)]


def fold_stream(
    rows: DataFrame, fold: OrderedFold, schema: str, watermark: str, buckets: int = BUCKETS
) -> DataFrame:
    """`rows` has `ts`, the key columns of the fold, `ts_us`, `pkt_id`, `side`, all of them whole numbers."""
    longs = [*fold.key_columns, "ts_us", "pkt_id", "side"]
    filled = [F.coalesce(F.col(c).cast("bigint"), F.lit(_NULL)).alias(c) for c in longs]
    bucket = F.pmod(F.xxhash64(*fold.key_columns), F.lit(buckets)).alias("bucket")
    return (
        rows.withWatermark("ts", watermark)
        .select("ts", bucket, *filled)
        .groupBy("bucket")
        .applyInPandasWithState(
            fold, schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout
        )
    )


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep keyed state outside the JVM heap, as it grows with the open flows.

    The session's own setting is back afterwards.
    """
    name = "spark.sql.streaming.stateStore.providerClass"
    own = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if own is None else spark.conf.set(name, own)


class LateRows(StreamingQueryListener):
    """Counts the rows that streams drop because they come after the watermark.

    A query only remembers its last progress reports; this listens to all of
    them. Register it with `spark.streams.addListener` before the stream starts.
    """

    def __init__(self):
        self._counts: Counter = Counter()
        self._ended: dict[str, Event] = {}

    def onQueryStarted(self, event) -> None:
        self._ended.setdefault(str(event.runId), Event())

    def onQueryProgress(self, event) -> None:
        for operator in event.progress.stateOperators:
            self._counts[str(event.progress.runId)] += operator.numRowsDroppedByWatermark

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._ended.setdefault(str(event.runId), Event()).set()

    def of(self, query, timeout: float = 30) -> int:
        """Late rows of a query that has ended; waits for its last report."""
        query.awaitTermination()
        self._ended.setdefault(str(query.runId), Event()).wait(timeout)
        return self._counts[str(query.runId)]
