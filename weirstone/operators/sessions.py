"""Splitting a key's events into sessions by inactivity.

The operator keeps, for every key, one open session and one timer. An event in time order updates
the session and resets the timer to ``gap`` past the event; the timer expires when an event later than that
arrives or the key's input ends, and the session is emitted with its start, end and count.
``weirstone.streaming.sessions`` runs the same rule on an unbounded stream with event-time timers.

In batch the rule runs in three rounds. Each takes partial sessions (an event is one of length 0)
and emits merged ones, and merging is exact in whatever groups it happens:

1. inside the partitions left by the de-duplication, whose key (the event id) spreads every account evenly;
2. by key and time bucket, so that a key with a third of all rows is spread over many tasks;
3. by key alone. After round 2 a key has at most (its time span / gap) partial sessions plus one for each
   bucket, however many events it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class InactivityTimers:
    """Open session and timer of the current key, over input in order of key and start."""

    def __init__(self, gap: int):
        self.gap, self.key, self.start, self.end, self.n = gap, None, 0, 0, 0

    def flush(self) -> list[tuple]:
        """The timer of the open session, if any, expires."""
        out = [] if self.key is None else [(self.key, self.start, self.end, self.n)]
        self.key = None
        return out

    def advance(self, keys: pa.Array, start: np.ndarray, end: np.ndarray, n: np.ndarray):
        """Feeds a batch; gives the sessions whose timers expired: (key array, starts, ends, counts).

        The last session of the batch stays open. Vectorised: an event expires the running timer if its key is another or it
        lies more than ``gap`` past the greatest end so far of its key.
        """
        m = len(start)
        new_key = np.ones(m, bool)
        if m > 1:
            new_key[1:] = pc.not_equal(keys.slice(1), keys.slice(0, m - 1)).to_numpy(zero_copy_only=False)
        if self.key is not None and keys[0].as_py() == self.key:  # the open session goes on
            new_key[0] = False
        rank = np.cumsum(new_key)
        first = self.end if not new_key[0] else end[0]
        low = min(int(end.min()), int(first))
        width = max(int(end.max()), int(first)) - low + 1
        if width * int(rank[-1] + 1) < 2**62:  # the greatest end so far within a key, by one running maximum over shifted keys
            reach = np.maximum.accumulate(np.concatenate(([first - low + width * rank[0]], end - low + width * rank)))[:-1] + low - width * rank
        else:
            reach, top = np.empty(m, np.int64), first
            for i in range(m):
                reach[i] = top
                top = end[i] if new_key[i] else max(top, end[i])
        expired = new_key | (start - reach > self.gap)
        at = np.flatnonzero(expired)
        heads = np.concatenate(([0], at)) if len(at) == 0 or at[0] != 0 else at
        s, e, c = start[heads].copy(), np.maximum.reduceat(end, heads), np.add.reduceat(n, heads)
        done: list[tuple] = []
        if not expired[0]:
            s[0], e[0], c[0] = self.start, max(self.end, e[0]), c[0] + self.n
        else:
            done = self.flush()
        names = keys.take(pa.array(heads))
        self.key, self.start, self.end, self.n = names[-1].as_py(), int(s[-1]), int(e[-1]), int(c[-1])
        return done, (names.slice(0, len(names) - 1), s[:-1], e[:-1], c[:-1])


def _fold(gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        timers, kind = InactivityTimers(gap), None

        def pack(names, s, e, c):
            return pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(c, pa.int64())], ["key", "start", "end", "n"])

        for b in batches:
            if not b.num_rows:
                continue
            kind = b.schema.field("key").type
            done, (names, s, e, c) = timers.advance(b.column("key"), *(b.column(x).to_numpy(zero_copy_only=False) for x in ("start", "end", "n")))
            if done:
                yield pack(*map(list, zip(*done)))
            if len(names):
                yield pack(names, s, e, c)
        if done := timers.flush():
            yield pack(*map(list, zip(*done)))

    return run


def _round(df: DataFrame, gap: int) -> DataFrame:
    return df.sortWithinPartitions("key", "start").mapInArrow(_fold(gap), df.schema)


def sessionize(df: DataFrame, key: str, ts: str, gap: int, event_id: str | None = None, bucket: int = 30 * 86400) -> DataFrame:
    """Sessions (``key``, session_start, session_end, duration, n_events) of the events in ``df``.

    ``ts`` is an integer time; neighbours at most ``gap`` apart share a session. With ``event_id``, rows of one key that share
    the id are one event, at its least time. Rows without a key, a time or (where named) an id are left out.
    Ties in time belong to one session. An empty table gives no rows. Other columns, whatever their names, aren't read.
    """
    named = [F.col(key).alias("key"), F.col(ts).cast("bigint").alias("start"), *([F.col(event_id).alias("id")] if event_id else [])]
    events = df.select(*named).dropna()
    if event_id:
        events = events.groupBy("id", "key").agg(F.min("start").alias("start"))
        events = events.select("key", "start", F.col("start").alias("end"), F.lit(1).cast("bigint").alias("n"))
    else:  # equal times need no row each
        events = events.groupBy("key", "start").agg(F.count("*").alias("n")).select("key", "start", F.col("start").alias("end"), "n")
    local = _round(events, gap)
    spread = _round(local.repartition("key", F.floor(F.col("start") / bucket)), gap)
    whole = _round(spread.repartition("key"), gap)
    return whole.select(
        F.col("key").alias(key), F.col("start").alias("session_start"), F.col("end").alias("session_end"),
        (F.col("end") - F.col("start")).alias("duration"), F.col("n").alias("n_events"),
    )


def known_seconds(col: str) -> F.Column:
    """Epoch seconds; null for unknown times (null, 0 or less). Values of 10^11 and more are milliseconds."""
    c = F.col(col)
    return F.when(c >= 100_000_000_000, F.expr(f"`{col}` div 1000")).when(c > 0, c)
