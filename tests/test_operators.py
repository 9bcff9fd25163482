import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirstone.operators import graph, models, prevalence, publish, ranks, stats
from weirstone.sources import tables
from weirstone.streaming import ingest


def test_percent_ranks_with_ties_and_ranges(spark):
    rnd = random.Random(1)
    rows = [(f"k{i}", rnd.choice([None, float(rnd.randrange(9)), rnd.random()])) for i in range(300)]
    v = [x for _, x in rows if x is not None]
    for ranges in (1, 7):
        got = {r.k: (r.p, r.a) for r in ranks.ranked(spark.createDataFrame(rows, "k string, x double"), "k", ["x"], ranges).select("k", ranks.percent_rank().alias("p"), ranks.average_rank().alias("a")).collect()}
        want = {k: (sum(y < x for y in v) / (len(v) - 1), sum(y < x for y in v) + (v.count(x) + 1) / 2) for k, x in rows if x is not None}
        assert set(got) == set(want) and all(math.isclose(a, b) for k in got for a, b in zip(got[k], want[k]))


def test_auc_with_ties(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("b", 0, 0.8), ("c", 1, 0.7), ("d", 0, 0.7), ("e", 0, 0.1)], "k string, y int, s double")
    assert stats.auc(df, "k", "y", "s").first()[0] == 0.75


def test_benjamini_hochberg(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.216]
    df = spark.createDataFrame([(f"k{i}", x) for i, x in enumerate(p)], "k string, p double")
    assert {r.k for r in stats.benjamini_hochberg(df, "k", "p").filter("rejected").collect()} == {"k0", "k1"}


def test_samples_do_not_depend_on_order(spark):
    df = spark.createDataFrame([(f"k{i}", f"s{i % 3}") for i in range(100)], "k string, s string")
    a = {r.k for r in stats.hash_sample(df, "k", 10).collect()}
    assert a == {r.k for r in stats.hash_sample(df.repartition(5).orderBy(F.desc("k")), "k", 10).collect()} and len(a) == 10
    assert {r[0]: r[1] for r in stats.hash_sample(df, "k", 4, ["s"]).groupBy("s").count().collect()} == {"s0": 4, "s1": 4, "s2": 4}


def test_suppression_and_poster_weights(spark):
    people = spark.createDataFrame([("x", "m", f"a{i % 3}", "poster") for i in range(20)], "sub string, month string, author string, role string")
    scores = spark.createDataFrame([("a0", 0.9), ("a1", 0.1)], "author string, score double")
    r = prevalence.prevalence(people, scores, floor=14).first()
    assert (r.n, r.n_scored, r.coverage_pct, r.pct_high_risk) == (20, 14, 70.0, 50.0)
    assert prevalence.prevalence(people, scores, floor=15).first().pct_high_risk is None


def test_publishing_is_append_only(spark, tmp_path):
    cells = lambda m, v: spark.createDataFrame([("a", m, "combined", 30, 20, 66.7, v, 0.3, "high"), ("b", m, "combined", 30, 20, 66.7, 1.0, 0.3, "low")], "sub string, month string, role string, n int, n_scored int, coverage_pct double, pct_high_risk double, mean_score double, severity string")
    path = str(tmp_path / "published")
    assert publish.publish(spark, path, cells("2024-01", 50.0), "v1", "d1") == 1
    assert publish.publish(spark, path, cells("2024-01", 99.0).unionByName(cells("2024-02", 60.0)), "v1", "d2") == 1
    p = spark.read.parquet(path)
    assert {(r.sub, r.month): r.pct_high_risk for r in p.collect()}["a", "2024-01"] == 50.0
    assert {(r.month, r.first_published) for r in publish.manifest(p).collect()} == {("2024-01", "d1"), ("2024-02", "d2")}
    assert {r.delta for r in publish.changes(p, "pct_high_risk").filter("sub = 'a' AND month = '2024-02'").collect()} == {10.0}
    bands = publish.frozen_bands(spark, str(tmp_path / "bands"), p, "pct_high_risk", "1")
    again = publish.frozen_bands(spark, str(tmp_path / "bands"), p.limit(0), "pct_high_risk", "2")
    assert again.collect() == bands.collect() and bands.first().moderate == 20.0
    assert {(r.sub, r.why) for r in publish.inconsistencies(p, bands, "pct_high_risk").collect()} == set()
    assert {r.why for r in publish.inconsistencies(p.withColumn("severity", F.lit("low")), bands, "pct_high_risk").collect()} == {"severity"}
    assert publish.month_documents(p).count() == 2 and "25.5 %" in [r.headline for r in publish.narrative(p, "pct_high_risk").orderBy("month").collect()][0]
    fixed = publish.repair(p, p.filter("month = '2024-01'").withColumn("n", F.lit(1)), ["month"])
    assert fixed.groupBy("month").agg(F.max("n")).filter("month = '2024-01'").first()[1] == 1 and fixed.count() == 4


def test_pair_graph(spark):
    rows = [("s", p, x) for p, xs in {"1": "abc", "2": "ab", "3": "c"}.items() for x in xs] + [("s", "1", "a"), ("s", None, "a"), ("s", "2", None)]
    e = graph.pair_edges(spark.createDataFrame(rows, "s string, p string, x string"), "s", "p", "x", least=1)
    assert {(r.a1, r.a2, r.n, r.d1, r.d2, r.t) for r in e.collect()} == {("a", "b", 2, 2, 2, 3), ("a", "c", 1, 2, 2, 3), ("b", "c", 1, 2, 2, 3)}
    assert {(r.author, r.degree, r.strength) for r in graph.degrees(e).collect()} == {("a", 2, 3), ("b", 2, 3), ("c", 2, 2)}
    replies = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("a", "a"), ("a", "b")], "x string, y string")
    assert tuple(graph.reciprocity(replies, "x", "y").first()) == (3, 2, 2 / 3)


def test_small_sample_procedures(spark):
    rnd = np.random.default_rng(3)
    two, one_ = np.concatenate([rnd.normal(0, 1, 300), rnd.normal(8, 1, 300)]), rnd.normal(0, 1, 600)
    assert models.dip_statistic(two) > 3 * models.dip_statistic(one_)
    assert models.mixture_1d(two, 2)[0] < models.mixture_1d(two, 1)[0] and models.mixture_1d(one_, 1)[0] < models.mixture_1d(one_, 2)[0] + 1
    rows = [("g", f"t{i}", True, float(i)) for i in range(3)] + [("g", f"c{i}", False, i + 0.1) for i in range(2)]
    got = {(r.key, r.match) for r in models.match_without_replacement(spark.createDataFrame(rows, "g string, k string, t boolean, v double"), ["g"], "k", "t", "v").collect()}
    assert got == {("t0", "c0"), ("t1", "c1")}
    df = spark.createDataFrame([(float(i), 2.0 * i, float((i * 7) % 5)) for i in range(40)], "a double, b double, c double")
    assert len(models.vif_kept(df, ["a", "b", "c"])) == 2
    assert models.correlation_kept({("a", "b"): 0.9, ("a", "c"): 0.4, ("b", "c"): 0.1}, ["a", "b", "c"]) == ["b", "c"]


@pytest.mark.parametrize("n", [3, 40, 150, 400])
def test_dip_is_that_of_the_best_of_all_modes(n):
    def gap(a, b):  # greatest distance from the lower hull
        at, low = [0], 0
        while low < len(a) - 1:
            low += 1 + int(np.argmin((b[low + 1 :] - b[low]) / (a[low + 1 :] - a[low])))
            at.append(low)
        return (b - np.interp(a, a[at], b[at])).max()

    rnd = np.random.default_rng(n)
    for x in (rnd.normal(0, 1, n), np.concatenate([rnd.normal(0, 1, n // 3), rnd.normal(5, 2, n - n // 3)])):
        v, c = np.unique(x, return_counts=True)
        f = np.cumsum(c) / n
        want = min(max(gap(v[: m + 1], f[: m + 1]), gap(-v[m:][::-1], -f[m:][::-1])) for m in range(1, len(v) - 1))
        got = models.dip_statistic(x)
        assert math.isclose(got, max(want / 2, 1 / (2 * n)), rel_tol=1e-9)


def test_pinned_model(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(f"k{i}", None if i % 17 == 0 else i % 2 + rnd.gauss(0, 0.3), rnd.random(), i % 2 if i % 5 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, a double, b double, y int")
    m = models.train(df, models.logistic(["a", "b"], "y"), "y")
    path = str(tmp_path / "model")
    models.pin(m, path, {"features": ["a", "b"]})
    s = models.score(df, models.load_pinned(path), "k")
    assert stats.auc(s.join(df.dropna(subset=["y"]), "k"), "k", "y", "score").first()[0] > 0.9
    with pytest.raises(FileNotFoundError):
        models.load_pinned(str(tmp_path / "none"))
    with pytest.raises(ValueError):
        models.score(df.drop("a"), m, "k")


def test_sources(spark, tmp_path):
    import json

    import zstandard

    folder = tmp_path / "raw"
    folder.mkdir()
    lines = "\n".join(json.dumps(x) for x in ({"post_id": "p1", "score": 3}, {"post_id": "p2", "first10_authors": ["a"]}))
    (folder / "x[1].ndjson.zst").write_bytes(zstandard.compress(lines.encode()))
    got = tables.ndjson(spark, str(folder), tables.POSTS_SCHEMA)
    assert {(r.post_id, r.score, r.month) for r in got.collect()} == {("p1", 3, None), ("p2", None, None)}
    with pytest.raises(FileNotFoundError):
        tables.ndjson(spark, str(tmp_path), tables.POSTS_SCHEMA)
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("x\n3\n")
    u = tables.csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], {"z": "double"})
    assert {tuple(r) for r in u.collect()} == {(1, 2, None), (3, None, None)}
    (tmp_path / "names.txt").write_text("# all\n\n r/One \ntwo\n")
    assert [r[0] for r in tables.name_list(spark, str(tmp_path / "names.txt")).select(tables.canonical_sub("name")).collect()] == ["one", "two"]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [("a", "x", 1000), ("a", "x", 1001), ("b", "y", 90000), ("c", "y", 900000)]
    spark.createDataFrame(rows, "id string, k string, s bigint").selectExpr("id", "k", "timestamp_seconds(s) AS ts").coalesce(1).write.parquet(src)
    read = lambda: spark.readStream.schema("id string, k string, ts timestamp").parquet(src)
    q = ingest.windowed_counts(read(), "ts", ["k"], "1 day", "1 hour").writeStream.format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.k, r.n) for r in spark.table("w").collect()} == {("x", 2), ("y", 1)}
    out = str(tmp_path / "out")
    for c in ("c2", "c3"):  # the second run sees all rows again
        ingest.append_once(read().select("id", "k"), out, ["id"], str(tmp_path / c)).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
    land = str(tmp_path / "land")
    ingest.land(ingest.deduplicated(read(), "id", "ts"), land, str(tmp_path / "c4")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(land).collect()) == ["a", "b", "c"]


def _most_rows(df):
    """The most rows that a step of the run plan gave."""
    seen = []

    def walk(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        m = node.metrics().get("numOutputRows")
        if m.isDefined():
            seen.append(m.get().value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    df.collect()
    walk(df._jdf.queryExecution().executedPlan())
    return max(seen)


def test_arrival_gaps_start_from_the_account_with_fewer_threads(spark):
    rows = [("all", f"p{i}", 10 * i) for i in range(400)] + [(f"b{i}", f"p{i + j}", 10 * (i + j) + j + i % 3) for i in range(60) for j in range(2)] + [("b0", "p0", 5), ("b1", "elsewhere", 1), ("b2", "p2", None)]
    c = spark.createDataFrame(rows, "author string, post_id string, ts bigint")
    pairs = spark.createDataFrame([("all", f"b{i}") for i in range(60)] + [("Z", "all"), ("b0", "b1"), ("b0", "b9")], "a1 string, a2 string")
    df = graph.arrival_gaps(c, pairs)
    assert _most_rows(df) < 2000  # from the other side it would be 60 x 400
    first = {}
    for a, p, t in rows:
        if t is not None:
            first[a, p] = min(t, first.get((a, p), t))
    want = {}
    for a, b in [("all", f"b{i}") for i in range(60)] + [("b0", "b1")]:
        gaps = [abs(first[a, p] - t) for (x, p), t in first.items() if x == b and (a, p) in first]
        want[a, b] = (len(gaps), float(np.median(gaps)), min(gaps))
    assert {(r.a1, r.a2): (r.shared, r.median_gap, r.min_gap) for r in df.collect()} == want


def test_tfidf_of_all_grams_of_a_length(spark):
    from collections import Counter

    from weirstone.operators import text

    rows = [("a", "The rain, the Rain"), ("b", "then İt rained 😀😀😀"), ("c", "no"), ("d", None), ("e", "the\\0the"), ("f", "rainy"), ("g", "qqq")] + [(f"z{i}", "it rains 😀😀" + "n" * i) for i in range(4)]
    df = text.tfidf(spark.createDataFrame(rows, "k string, t string").repartition(3), "k", "t", features=20, min_df=2)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()  # a text's grams stay where it is read
    low = {k: t.lower() for k, t in rows if t and len(t) >= 3}
    tf = {k: Counter(t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1)) for k, t in low.items()}
    held, total = Counter(g for c in tf.values() for g in c), sum(tf.values(), Counter())
    top = sorted((g for g in total if held[g] >= 2), key=lambda g: (-total[g], g.encode()))[:20]
    w = {k: {g: c[g] * (math.log((1 + len(tf)) / (1 + held[g])) + 1) for g in top if g in c} for k, c in tf.items()}
    want = {(k, g): x / math.sqrt(sum(y * y for y in v.values())) for k, v in w.items() for g, x in v.items()}
    got = {(r.k, r.gram): r.w for r in df.collect()}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k]) for k in want) and len(top) == 20
