import pytest

from tests.conftest import agree
from weirstone.plans import registry

OWN = [n for n in sorted(registry.SQL) if not n.startswith("p1_")]


@pytest.mark.parametrize("name", OWN)
def test_sql(spark, data, duck, name):
    agree(registry.QUERIES[name](spark, data), duck, registry.SQL[name])


def test_components_of_whole_vectors(spark, data, duck):
    import numpy as np

    rows = duck.sql("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    x = np.array([v for _, v in rows], float)
    x = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    want = x @ np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:3].T
    got = {r.vec_id: r.pc for r in registry.QUERIES["embedding_components"](spark, data).collect()}
    mine = np.array([got[i] for i, _ in rows])
    assert len(got) == len(rows) and np.allclose(np.abs(mine), np.abs(want), atol=1e-6)


def test_coordinates_of_one_width(spark):
    from weirstone.operators import models

    df, names = models.coordinates(spark.createDataFrame([(1, [1.0] * 9), (2, None)], "k int, v array<double>"), "k", "v")
    assert len(names) == 9 and {tuple(r) for r in df.collect()} == {(1, *[1.0] * 9), (2, *[None] * 9)}
    with pytest.raises(ValueError):
        models.coordinates(spark.createDataFrame([(1, [1.0] * 9), (2, [1.0])], "k int, v array<double>"), "k", "v")


def test_tight_pairs_work_out_the_gaps_once(spark, data):
    plan = registry.QUERIES["tight_pairs"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2 and "median(" not in plan and "post_id" not in plan


def test_model_scores_have_all_rounds(spark, data, monkeypatch):
    from weirstone.plans import modelling

    seen, train = [], modelling.L.train
    monkeypatch.setattr(modelling.L, "train", lambda *a: seen.append(train(*a)) or seen[-1])
    scores = [r.score for r in registry.QUERIES["model_scores"](spark, data).collect()]
    assert seen[0].stages[-1].getNumTrees == 150 and scores and all(0 <= s <= 1 for s in scores)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["account_features", "anomaly_scores", "pair_tails", "volume_regimes", "matched_posts"])
def test_others_run(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0
