import random

import pyarrow as pa
import pytest

from weirstone.operators.sessions import InactivityTimers, known_seconds, sessionize
from weirstone.streaming.sessions import stream_sessions


def brute(rows, gap):
    seen = {}
    for k, t, i in rows:
        if k is not None and t is not None and i is not None:
            seen[k, i] = min(t, seen.get((k, i), t))
    out = []
    for key in {k for k, _ in seen}:
        times = sorted(t for (k, _), t in seen.items() if k == key)
        start, last, n = times[0], times[0], 0
        for t in times:
            if t - last > gap:
                out.append((key, start, last, n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((key, start, last, n))
    return sorted(out)


def result(df):
    return sorted((r.k, r.session_start, r.session_end, r.n_events) for r in df.collect())


@pytest.mark.parametrize("bucket", [50, 10**6])
def test_against_brute_force(spark, bucket):
    rnd = random.Random(bucket)
    rows = [(rnd.choice(["a", "a", "a", "b", "c", None]), rnd.choice([None, *range(0, 3000, 3)]), f"e{rnd.randrange(700)}" if rnd.random() > 0.02 else None) for _ in range(900)]
    rows += rows[:200]
    df = spark.createDataFrame(rows, "k string, t bigint, e string").repartition(7)
    assert result(sessionize(df, "k", "t", 12, event_id="e", bucket=bucket)) == brute(rows, 12)


def test_ties_gap_border_and_clashing_names(spark):
    rows = [("a", 0, 1, "x"), ("a", 0, 2, "x"), ("a", 10, 3, "x"), ("a", 21, 4, "x"), ("b", -5, 5, "x")]
    df = spark.createDataFrame(rows, "k string, start bigint, end bigint, n string")
    assert result(sessionize(df, "k", "start", 10)) == [("a", 0, 10, 3), ("a", 21, 21, 1), ("b", -5, -5, 1)]


def test_empty(spark):
    assert result(sessionize(spark.createDataFrame([], "k string, t bigint, e string"), "k", "t", 10, "e")) == []


def test_timers_carry_over_batches_and_wide_times():
    big = 2**61
    rows = [("a", 0), ("a", 5), ("a", 7), ("b", -big), ("b", big), ("b", big + 3)]
    for cut in range(1, len(rows)):
        t, out = InactivityTimers(3), []
        for part in (rows[:cut], rows[cut:]):
            import numpy as np

            s = np.array([x for _, x in part], np.int64)
            done, (k, a, b, n) = t.advance(pa.array([x for x, _ in part]), s, s.copy(), np.ones(len(s), np.int64))
            out += done + list(zip(k.to_pylist(), a.tolist(), b.tolist(), n.tolist()))
        out += t.flush()
        assert out == [("a", 0, 0, 1), ("a", 5, 7, 2), ("b", -big, -big, 1), ("b", big, big + 3, 2)]


def test_known_seconds(spark):
    df = spark.createDataFrame([(None,), (0,), (-3,), (1700000000,), (1700000000999,)], "t bigint")
    assert [r[0] for r in df.select(known_seconds("t")).collect()] == [None, None, None, 1700000000, 1700000000]


def test_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "check")
    rows = [("a", 1000), ("a", 1100), ("b", 1050), ("a", 6000), ("z", 100000)]
    spark.createDataFrame(rows, "k string, s bigint").selectExpr("k", "timestamp_seconds(s) AS ts").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("k string, ts timestamp").parquet(src)
    q = stream_sessions(stream, "k", "ts", 300, "1 second").writeStream.format("memory").queryName("visits").option("checkpointLocation", out).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.table("visits").collect())
    assert ("a", 1000, 1100, 2) in got and ("b", 1050, 1050, 1) in got and ("a", 6000, 6000, 1) in got
    assert all(r[0] != "z" for r in got)  # its timer hasn't expired


def test_queries(spark, data, duck):
    from tests.conftest import agree
    from weirstone.plans import core

    for name in core.SQL:
        if name.startswith("p1_"):
            agree(core.QUERIES[name](spark, data), duck, core.SQL[name])
