"""Threads, quantiles, strata, pinned models and published tables on small rows with nulls, ties and faults."""

import math
import random

import pytest

from weirstone.operators import models, publish, ranks, screening, stats, threads


def test_depth_by_parents(spark):
    chain = [(f"c{i}", f"c{i - 1}" if i else None) for i in range(230)]
    rows = [*chain, *chain[:5], ("lost", "nowhere"), ("below", "lost"), ("x", "y"), ("y", "x"), (None, "c1")]
    got = {r.k: r.depth for r in threads.parent_depth(spark.createDataFrame(rows, "k string, p string"), "k", "p").collect()}
    assert [got[f"c{i}"] for i in (0, 1, 7, 199, 200, 229)] == [0, 1, 7, 199, 200, 200]
    assert got["lost"] == 1 and got["below"] == 2 and got["x"] == got["y"] == threads.GUARD and None not in got
    assert threads.parent_depth(spark.createDataFrame([], "k string, p string"), "k", "p").count() == 0


def test_quantiles_without_a_one_task_aggregate(spark):
    import numpy as np

    rnd = random.Random(2)
    rows = [(rnd.choice([None, 1.0, 2.0, rnd.gauss(0, 9)]), float(i % 7), None) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(3)
    got = {(r.s, r.q): r.v for r in ranks.quantiles(df, ["a", "b", "c"], [0.0, 0.1, 0.5, 0.93, 1.0]).collect()}
    for s, i in ((0, 0), (1, 1)):
        v = [r[i] for r in rows if r[i] is not None]
        assert all(math.isclose(got[s, q], np.quantile(v, q), abs_tol=1e-9) for q in (0.0, 0.1, 0.5, 0.93, 1.0))
    assert not [k for k in got if k[0] == 2]
    assert ranks.quantile_row(df, "c", {"m": 0.5}).first().m is None


def test_strata_of_equal_size(spark, monkeypatch):
    monkeypatch.setattr(ranks, "RANGE", 9)
    rows = [(f"k{i:03}", i % 11) for i in range(97)] + [("none", None)]
    got = {r.k: r.stratum for r in screening.equal_strata(spark.createDataFrame(rows, "k string, v int"), "k", "v", 10).collect()}
    order = sorted((v, k) for k, v in rows if v is not None)
    want, at = {}, 0
    for s in range(10):
        size = 97 // 10 + (s < 97 % 10)
        want |= {k: s + 1 for _, k in order[at : at + size]}
        at += size
    assert got == want


def test_parts_and_sides(spark):
    rows = [(f"k{i}", "ab"[i % 2]) for i in range(41)]
    parts = stats.three_parts(spark.createDataFrame(rows, "k string, s string"), "k", ["s"]).groupBy("s", "part").count().collect()
    assert {(r.s, r.part): r["count"] for r in parts} == {("a", 1): 7, ("a", 2): 7, ("a", 3): 7, ("b", 1): 6, ("b", 2): 6, ("b", 3): 8}
    pairs = [(f"k{i}", f"k{j}") for i in range(12) for j in range(i)]
    got = stats.disjoint_sides(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()
    side = {}
    for r in got:
        for k in (r.a, r.b):
            assert side.setdefault(k, r.side) == r.side
    assert 0 < len(got) < len(pairs)


def test_tail_of_shared_draws():
    for k, a, b, m in [(0, 3, 4, 10), (2, 3, 4, 10), (4, 4, 4, 9), (3, 40, 50, 60), (1, 1, 1, 1), (5, 4, 9, 20), (300, 900, 1000, 2500)]:
        lo, hi = max(k, a + b - m, 0), min(a, b)
        want = sum(math.comb(a, x) * math.comb(m - a, b - x) for x in range(lo, hi + 1)) / math.comb(m, b)
        assert math.isclose(models.hypergeometric_tail(k, a, b, m), want, rel_tol=1e-8, abs_tol=1e-15)


def test_pinned_linear_model(spark, tmp_path):
    path = str(tmp_path / "m" / "model.json")
    spec = {"version": "1", "features": ["a", "b"], "coefficients": [2.0, -1.0], "intercept": 0.5, "medians": {"a": 1.0, "b": 0.0}}
    with pytest.raises(FileNotFoundError):
        models.load_linear(spark, path)
    models.pin_linear(spark, path, spec)
    assert models.load_linear(spark, path) == spec
    with pytest.raises(Exception):  # noqa: B017
        models.pin_linear(spark, path, spec)  # never over another
    with pytest.raises(ValueError):
        models.pin_linear(spark, path + "2", spec | {"coefficients": [1.0]})
    df = spark.createDataFrame([("x", None, 3.0, 0), ("y", 0.0, None, 0)], "k string, a double, b double, score int")
    got = {r.k: r.score for r in models.score_linear(df, spec, "k").collect()}
    assert math.isclose(got["x"], 1 / (1 + math.exp(0.5))) and math.isclose(got["y"], 1 / (1 + math.exp(-0.5)))
    with pytest.raises(ValueError):
        models.score_linear(df.drop("b"), spec, "k")


def test_a_broken_table_is_no_missing_table(spark, tmp_path):
    assert publish.read_if_there(spark, str(tmp_path / "none")) is None
    (tmp_path / "bad").mkdir()
    with pytest.raises(Exception):  # noqa: B017
        publish.read_if_there(spark, str(tmp_path / "bad"))


def test_similar_texts_are_met_by_their_rare_words(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    rows = [("ab"[i % 2], f"k{i}", " ".join(rnd.sample(words, rnd.randrange(3, 12)))) for i in range(60)]
    rows += [("a", f"d{i}", rows[0][2].upper() + ("!" if i else " extra")) for i in range(3)] + [("a", "n", None), ("b", "e", "..."), (None, "g", "w1 w2")]
    sets = {(g, k): set(t.lower().replace("!", "").split()) for g, k, t in rows if g and t and t != "..."}
    want = {g: sum(1 for (h, k), s in sets.items() for (i, j), t in sets.items() if h == i == g and k < j and 5 * len(s & t) > 3 * len(s | t)) for g in "ab"}
    got = {r.g: r.n_pairs for r in threads.similar_rate(spark.createDataFrame(rows, "g string, k string, t string"), "g", "k", "t").collect()}
    assert got == want and want["a"] >= 6


def test_similar_texts_are_counted_without_a_row_for_each_pair_met(spark, monkeypatch):
    from tests.test_operators import _most_rows
    from weirstone.operators import similar

    monkeypatch.setattr(similar, "PART", 90)
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(24)]
    rows = [("ab"[i % 3 == 0], f"k{i:03}", " ".join(rnd.sample(words, rnd.randrange(1, 14)))) for i in range(600)] + [("a", f"r{i}", "same text") for i in range(9)] + [("c", None, "w1 w2"), ("c", "x", "w1 w2"), ("d", "y", "one")]
    df = threads.similar_rate(spark.createDataFrame(rows, "g string, k string, t string"), "g", "k", "t")
    assert _most_rows(df) <= len(rows)
    sets = {(g, k): set(t.split()) for g, k, t in rows if k}
    want = {g: sum(1 for (h, k), s in sets.items() for (i, j), t in sets.items() if h == i == g and k < j and 5 * len(s & t) > 3 * len(s | t)) for g in "abcd"}
    got = {r.g: (r.n, r.n_pairs) for r in df.collect()}
    assert got == {g: (sum(h == g for h, *_ in rows), want[g]) for g in "abcd"} and want["a"] > 100


@pytest.mark.parametrize("extend, small, tile, parts", [(1500, 48, 1 << 16, 1), (20, 5, 64, 1), (3, 2, 7, 4), (10, 100, 50, 3)])
def test_similar_sets_in_cells_that_are_parted(monkeypatch, extend, small, tile, parts):
    import numpy as np

    from weirstone.operators import similar

    for k, v in (("EXTEND", extend), ("SMALL", small), ("TILE", tile)):
        monkeypatch.setattr(similar, k, v)
    rnd = random.Random(5)
    sets = {tuple(sorted(rnd.sample(range(30), rnd.randrange(1, 14)))) for _ in range(300)}
    sets = sorted(sets | {tuple(sorted(set(x) ^ {rnd.randrange(60)})) for x in sorted(sets)[:80]} - {()})
    m = np.array([rnd.randrange(1, 4) for _ in sets])
    want = sum(int(k * (k - 1) // 2) for k in m) + sum(int(m[i] * m[j]) for i, x in enumerate(sets) for j in range(i) if 5 * len(set(x) & set(sets[j])) > 3 * len(set(x) | set(sets[j])))
    got = 0
    for b in range(parts):
        at = [i for i, x in enumerate(sets) if b in (similar._mixed(np.array(x[: len(x) - 3 * len(x) // 5], np.uint64)) % np.uint64(parts)).tolist()]
        got += similar.similar_pairs([np.array(sets[i], np.uint64).tobytes() for i in at], m[at], b, parts)
    assert got == want
