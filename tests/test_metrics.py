"""Closed-form cases of the metrics."""

import math

import pytest
from pyspark.sql import functions as F

from weirstone.functions import metrics as M


def one(spark, col, **values):
    kinds = {"times": "array<bigint>", "gap": "array<bigint>", "x": "array<double>", "s": "string", "n": "bigint", "a": "array<string>", "b": "array<string>", "r": "double"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[k]}" for k in values))
    return df.select(col).first()[0]


@pytest.mark.parametrize("x,want", [([1, 2, 3, 4], 0.25), ([5, 5, 5], 0.0), ([0, 0, 10], 2 / 3), ([7], None), ([0, 0], None), ([], None)])
def test_gini(spark, x, want):
    got = one(spark, M.gini(F.col("x")), x=[float(v) for v in x])
    assert got is None if want is None else math.isclose(got, want, abs_tol=1e-12)


@pytest.mark.parametrize("q,want", [(0.5, 7), (0.9, 9)])
def test_nearest_rank(spark, q, want):
    assert one(spark, M.nearest_rank(F.col("gap"), q), gap=[5, 1, 9, 7]) == want


@pytest.mark.parametrize("gap,want", [([10, 20, 30, 100], 0.6020599913279624), ([10, 10], 0.0), ([5], None), ([-3, 0], None)])
def test_interval_entropy(spark, gap, want):
    got = one(spark, M.interval_entropy(F.col("gap")), gap=gap)
    assert got is None if want is None else math.isclose(got, want, abs_tol=1e-12)


@pytest.mark.parametrize("gap,want", [([10, 20, 30, 100], 0.12591941011692753), ([5, 5, 5], -1.0), ([1, 2], None), ([0, 0, 0], None)])
def test_burstiness(spark, gap, want):
    got = one(spark, M.burstiness(F.col("gap")), gap=gap)
    assert got is None if want is None else math.isclose(got, want, abs_tol=1e-12)


@pytest.mark.parametrize("gap,want", [([61, 300, 899, 45, 0], 0.6), ([], None)])
def test_quantization(spark, gap, want):
    assert one(spark, M.quantization(F.col("gap")), gap=gap) == want


@pytest.mark.parametrize("s,want", [("zz", 1295), ("abc123", 623698779), ("a$", None), (None, None), ("", None)])
def test_base36(spark, s, want):
    assert one(spark, M.base36(F.col("s")), s=s) == want


def test_gaps_entropy_votes_bands(spark):
    assert one(spark, M.gaps(F.col("times")), times=[1, 4, 9]) == [3, 5]
    assert one(spark, M.gaps(F.col("times")), times=[1]) == []
    assert one(spark, M.char_entropy(F.col("s")), s="aabc") == 1.5
    votes, downs, ups = (one(spark, c, n=100, r=0.9) for c in M.implied_votes(F.col("n"), F.col("r")))
    assert (round(votes, 9), round(downs, 9), round(ups, 9)) == (125.0, 12.5, 112.5)
    assert [one(spark, M.band(F.col("r"), 10.66, 14.63, 18.22), r=v) for v in (18.22, 14.63, 10.66, 10.65, None)] == ["critical", "high", "moderate", "low", None]


def test_sets(spark):
    assert one(spark, M.jaccard(F.col("a"), F.col("b")), a=["x", "y"], b=["y", "z"]) == 1 / 3
    assert one(spark, M.jaccard(F.col("a"), F.col("b")), a=[], b=[]) is None
    assert one(spark, M.overlap(F.col("a"), F.col("b")), a=["x", "y", "q"], b=["y"]) == 1.0


def test_hypergeometric_and_tail(spark):
    from weirstone.operators.models import with_tail

    df = spark.createDataFrame([(2, 3, 4, 10)], "n bigint, d1 bigint, d2 bigint, t bigint")
    mean, var, z = M.hypergeometric(*map(F.col, ("n", "d1", "d2", "t")))
    r = with_tail(df).select(mean.alias("m"), var.alias("v"), z.alias("z"), "p").first()
    assert all(math.isclose(a, b) for a, b in zip(r, (1.2, 0.56, 1.0690449676496976, 1 / 3)))


def test_skewness(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (7.0,), (9.0,)], "x double")
    assert math.isclose(df.agg(M.skewness_g1("x")).first()[0], 0.16923763134384168)
