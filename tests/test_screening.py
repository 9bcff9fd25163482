import math

import pytest
from pyspark.sql import functions as F

from weirstone.operators import screening as S
from weirstone.sources import sinks


def test_months_and_cross_table(spark):
    assert [r[0] for r in S.months(spark, "2023-11", "2024-02").collect()] == ["2023-11", "2023-12", "2024-01", "2024-02"]
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "r string, c string")
    assert {tuple(r) for r in S.cross_table(df, "r", "c", ["x", "y"]).collect()} == {("a", 2, 0), ("b", 0, 1)}


def test_strata_keep_ties_together(spark):
    df = spark.createDataFrame([(float(v),) for v in [1] * 50 + list(range(2, 52))] + [(None,)], "v double")
    s = S.strata(df, "v", 4)
    assert s.filter("v = 1").select("stratum").distinct().count() == 1
    assert s.filter("v IS NULL").first().stratum is None and s.count() == 101


def test_boundary_rule(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, None), (3.0, 1.0)], "a double, b double")
    assert [(r.step, r.n) for r in S.boundary_rule(df, [("a", ">=", 2.0), ("b", "<=", 3.0)]).orderBy("step").collect()] == [(1, 2), (2, 1)]


def test_precision_curve(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.7), (0, 0.1), (None, 0.5)], "y int, s double")
    c = S.curve(df, "y", "s")
    assert {(r.score, r.tp, r.fp) for r in c.collect()} == {(0.9, 1, 0), (0.8, 1, 1), (0.7, 2, 2), (0.1, 2, 3)}
    r = S.average_precision(c).first()
    assert math.isclose(r.ap, 0.5 * 1 + 0.5 * 0.5) and r.recall_at_1pct == 0.5


def test_positive_unlabelled_and_ratio(spark):
    df = spark.createDataFrame([(1, 0.8, True), (1, 0.6, False), (0, 0.4, False), (0, 0.2, False)], "y int, s double, h boolean")
    r = S.elkan_noto(df, "y", "s", "h").first()
    assert (r.c, r.naive, r.degenerate) == (0.8, 0.5, False) and math.isclose(r.corrected, 0.625)
    q = S.rate_ratio(df.withColumn("e", F.col("s") > 0.3), "y", "e").first()
    assert (q.rate_1, q.rate_0, q.ratio) == (1.0, 0.5, 2.0)


@pytest.mark.parametrize("t,df,p", [(2.228, 10, 0.05), (12.706, 1, 0.05), (0.0, 5, 1.0), (3.169, 10, 0.01)])
def test_student_tail(t, df, p):
    assert math.isclose(S.student_tail(t, df), p, rel_tol=1e-3)


def test_trends(spark):
    df = spark.createDataFrame([("a", i, float(i) + (i % 2) * 0.1) for i in range(8)] + [("b", i, 3.0 - i) for i in range(3)] + [("c", 1, 1.0)], "g string, m int, v double")
    r = {x.g: x for x in S.trends(df, ["g"], "m", "v").collect()}
    assert r["a"].worsening and r["a"].p < 1e-6 and not r["b"].worsening and r["c"].p is None


def test_mode_distance(spark):
    df = spark.createDataFrame([("a", 10.0)] * 40 + [("a", 100.0)] + [("b", 1.0)], "g string, v double")
    r = {(x.g, x.v): x.vs_mode for x in S.mode_distance(df, "g", "v").collect()}
    assert abs(r["a", 10.0]) < 1 and 89 < r["a", 100.0] < 91 and r["b", 1.0] is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("k1", "2024-01", 1), ("k2", "2024-02", 2)], "k string, month string, v int")
    p = str(tmp_path / "m")
    sinks.by_month(df, p)
    sinks.by_month(df.filter("k = 'k2'").withColumn("v", F.lit(9)), p)
    assert {(r.k, r.v) for r in spark.read.parquet(p).collect()} == {("k1", 1), ("k2", 9)}
    sinks.latest_month(df, str(tmp_path / "l"))
    assert [r.k for r in spark.read.parquet(str(tmp_path / "l")).collect()] == ["k2"]
    for _ in range(2):
        sinks.append_new(df, str(tmp_path / "a"), ["k"])
    assert spark.read.parquet(str(tmp_path / "a")).count() == 2
    sinks.one_csv(df, str(tmp_path / "c"))
    sinks.documents(df, str(tmp_path / "d"), "k", ["month", "v"])
    assert {r.document for r in spark.read.parquet(str(tmp_path / "d")).collect()} == {'{"month":"2024-01","v":1}', '{"month":"2024-02","v":2}'}
