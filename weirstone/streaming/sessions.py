"""Sessions over an unbounded stream, with keyed state and event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, session_start bigint, session_end bigint, n_events bigint"
STATE = "start bigint, end bigint, n bigint"


def _update(gap: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = []
        if state.hasTimedOut:
            done.append((key[0], *state.get))
            state.remove()
        else:
            start, end, n = state.get if state.exists else (None, None, 0)
            times = sorted(t for f in frames for t in f["ts_s"])
            for t in times:
                if start is not None and t - end > gap:
                    done.append((key[0], start, end, n))
                    start, n = None, 0
                if start is None:
                    start, end = t, t
                start, end, n = min(start, t), max(end, t), n + 1
            state.update((start, end, n))
            state.setTimeoutTimestamp(max((end + gap) * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=["key", "session_start", "session_end", "n_events"])

    return run


def stream_sessions(stream: DataFrame, key: str, ts: str, gap: int, lateness: str = "10 minutes") -> DataFrame:
    """Sessions of a stream whose column ``ts`` is a timestamp; a session comes out when the watermark passes its end by ``gap``.

    Events later than ``lateness`` are dropped by the watermark, the rule of a stream. Within one trigger a key's events are put in order.
    """
    events = stream.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, lateness)
    events = events.select(F.col(key).cast("string").alias("key"), F.unix_seconds(ts).alias("ts_s"), F.col(ts))
    return events.groupBy("key").applyInPandasWithState(_update(gap), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
