"""Models on account features: training with persisted medians, pinned scoring, linear models, clusters and small-sample procedures."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirstone.operators import ranks, screening, stats


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Adds ``weight``: rows of each label weigh the same together."""
    n = df.groupBy(label).agg(F.count("*").alias("_k"))
    total = n.agg(F.sum("_k").alias("_n"), F.count("*").alias("_c"))
    return df.join(F.broadcast(n.join(F.broadcast(total))), label).withColumn("weight", F.col("_n") / (F.col("_c") * F.col("_k"))).drop("_k", "_n", "_c")


def boosted(features: list[str], label: str, rounds: int = 20, depth: int = 4, seed: int = 42) -> Pipeline:
    """Median imputation, assembly, gradient-boosted trees. The medians are those of the labelled rows and stay in the model."""
    filled = [f"_{f}" for f in features]
    return Pipeline(stages=[Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_x"), GBTClassifier(featuresCol="_x", labelCol=label, weightCol="weight", maxIter=rounds, maxDepth=depth, seed=seed)])


def logistic(features: list[str], label: str, reg: float = 0.01) -> Pipeline:
    filled = [f"_{f}" for f in features]
    return Pipeline(stages=[Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_r"), StandardScaler(inputCol="_r", outputCol="_x", withMean=True), LogisticRegression(featuresCol="_x", labelCol=label, weightCol="weight", regParam=reg, standardization=False)])


def train(df: DataFrame, pipeline: Pipeline, label: str) -> PipelineModel:
    """Labelled rows only; columns cast to double, as the imputer wants."""
    return pipeline.fit(balanced(_doubles(df, pipeline).filter(F.col(label).isNotNull()), label))


def _inputs(stages) -> list[str]:
    return list(stages[0].getInputCols())


def _doubles(df: DataFrame, pipeline) -> DataFrame:
    stages = pipeline.stages if isinstance(pipeline, PipelineModel) else pipeline.getStages()
    missing = [c for c in _inputs(stages) if c not in df.columns]
    if missing:
        raise ValueError(f"the model needs columns that aren't there: {missing}")
    return df.withColumns({c: F.col(c).cast("double") for c in _inputs(stages)})


def score(df: DataFrame, model: PipelineModel, key: str, activity: str | None = None, floor: int = 10) -> DataFrame:
    """(key, score) of the rows with enough activity. A missing column is an error, not a null."""
    rows = df.filter(F.col(activity) >= floor) if activity else df
    return model.transform(_doubles(rows, model)).select(key, vector_to_array("probability")[1].alias("score"))


def _path(spark: SparkSession, path: str):
    """(file system, path): any that Hadoop knows, local ones included."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file; never over another."""
    fs, p = _path(spark, path)
    out = fs.create(p, False)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _path(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    return "\n".join(r.value for r in spark.read.text(path).collect())  # one small file


def pin(model: PipelineModel, path: str, meta: dict) -> None:
    """Writes the model and its description; never over another."""
    model.save(path)
    write_text(SparkSession.active(), f"{path}/meta.json", json.dumps(meta))


def load_pinned(path: str) -> PipelineModel:
    """The pinned model; an error if there is none, never an implicit training."""
    fs, p = _path(SparkSession.active(), path)
    if not fs.exists(p):
        raise FileNotFoundError(f"no pinned model at {path}")
    return PipelineModel.load(path)


def pin_linear(spark: SparkSession, path: str, spec: dict) -> None:
    """Writes a logistic model's description: version, features, coefficients, intercept and the medians that stand for nulls. Never over another."""
    if set(spec["medians"]) != set(spec["features"]) or len(spec["coefficients"]) != len(spec["features"]):
        raise ValueError("every feature needs a coefficient and a median")
    write_text(spark, path, json.dumps(spec))


def load_linear(spark: SparkSession, path: str) -> dict:
    """The pinned description; an error if there is none."""
    return json.loads(read_text(spark, path))


def score_linear(df: DataFrame, spec: dict, key: str) -> DataFrame:
    """(key, score): the logistic of the pinned linear form. A feature that isn't a column is an error; null values take the pinned medians."""
    missing = [f for f in spec["features"] if f not in df.columns]
    if missing:
        raise ValueError(f"the model needs columns that aren't there: {missing}")
    form = F.lit(float(spec["intercept"]))
    for f, c in zip(spec["features"], spec["coefficients"]):
        form = form + F.coalesce(F.col(f).cast("double"), F.lit(float(spec["medians"][f]))) * float(c)
    return df.select(key, (1 / (1 + F.exp(-form))).alias("score"))


def cross_validated(df: DataFrame, pipeline: Pipeline, key: str, label: str, k: int = 3) -> DataFrame:
    """(auc, n_pos, n_neg) of out-of-fold scores, folds by a hash of the key."""
    parts = stats.folds(df.filter(F.col(label).isNotNull()), key, k)
    out = None
    for i in range(k):
        s = score(parts.filter(F.col("fold") == i), train(parts.filter(F.col("fold") != i), pipeline, label), key)
        out = s if out is None else out.unionByName(s)
    return stats.auc(out.join(df.select(key, label), key), key, label, "score")


def permutation_floor(df: DataFrame, key: str, label: str, value: str, volume: str, strata: int = 10, seed: int = 1) -> DataFrame:
    """AUC of the score against labels shuffled within strata of equal volume: what volume alone would give.

    A row's score meets the label that has its place in another hash order of the same stratum.
    """
    a = screening.equal_strata(df.select(key, label, value, volume).dropna(), key, volume, strata, "_s")
    order = lambda s: F.row_number().over(Window.partitionBy("_s").orderBy(stats.hash_order(key, s), key))
    a = a.withColumns({"_i": order(seed), "_j": order(seed + 1)})
    two = a.select("_s", F.col("_j").alias("_i"), F.col(label).alias("_label"))
    return stats.auc(a.select(key, value, "_s", "_i").join(two, ["_s", "_i"]), key, "_label", value)


def principal_components(df: DataFrame, key: str, features: list[str], k: int) -> tuple[DataFrame, list[float]]:
    """((key, pc array), explained shares) of standardised features, medians for nulls."""
    filled = [f"_{f}" for f in features]
    pipe = Pipeline(stages=[Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_r"), StandardScaler(inputCol="_r", outputCol="_x", withMean=True), PCA(k=k, inputCol="_x", outputCol="_p")])
    m = pipe.fit(_doubles(df, pipe))
    return m.transform(_doubles(df, m)).select(key, vector_to_array("_p").alias("pc")), m.stages[-1].explainedVariance.toArray().tolist()


def coordinates(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, list[str]]:
    """((key, a column for each coordinate of an array column), their names). The width is that of the data; vectors of different widths are an error, null vectors give nulls."""
    n = F.when(F.col(vector).isNotNull(), F.size(vector))
    least, most = df.agg(F.min(n), F.max(n)).first()  # one row
    if not most or least != most:
        raise ValueError(f"vectors of one width are needed, not of {least} to {most} coordinates")
    names = [f"e{i}" for i in range(most)]
    return df.select(key, *[F.col(vector)[i].alias(c) for i, c in enumerate(names)]), names


def clusters(df: DataFrame, key: str, vector: str, k: int, seed: int = 42) -> DataFrame:
    """(key, cluster) by k-means on an array column."""
    from pyspark.ml.functions import array_to_vector

    v = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=20).fit(v).transform(v).select(key, F.col("prediction").alias("cluster"))


def nearest_centre(df: DataFrame, key: str, vector: str, centres: list[list[float]]) -> DataFrame:
    """(key, centre, distance) of the nearest of a few given centres."""
    d = lambda c: F.sqrt(F.aggregate(F.zip_with(F.col(vector), F.array(*map(F.lit, c)), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    best = F.array_min(F.array(*[F.struct(d(c).alias("distance"), F.lit(i).alias("centre")) for i, c in enumerate(centres)]))
    return df.select(key, best.alias("b")).select(key, "b.centre", "b.distance")


def mixture_1d(x: np.ndarray, k: int, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(bic, weights, means, deviations) of a one-dimensional Gaussian mixture from quantile starts."""
    n = len(x)
    w, mu, sd = np.full(k, 1 / k), np.quantile(x, (np.arange(k) + 0.5) / k), np.full(k, max(x.std(), 1e-6))
    for _ in range(rounds):
        p = w * np.exp(-((x[:, None] - mu) ** 2) / (2 * sd**2)) / (sd * math.sqrt(2 * math.pi)) + 1e-300
        r = p / p.sum(axis=1, keepdims=True)
        nk = r.sum(axis=0) + 1e-12
        w, mu = nk / n, (r * x[:, None]).sum(axis=0) / nk
        sd = np.sqrt((r * (x[:, None] - mu) ** 2).sum(axis=0) / nk) + 1e-6
    p = w * np.exp(-((x[:, None] - mu) ** 2) / (2 * sd**2)) / (sd * math.sqrt(2 * math.pi)) + 1e-300
    return (3 * k - 1) * math.log(n) - 2 * float(np.log(p.sum(axis=1)).sum()), w, mu, sd


def regimes(monthly: DataFrame, group: str, month: str, value: str, least: int = 12, spike: float = 0.45) -> DataFrame:
    """(group, month, regime): 'spike' or 'normal' months of groups whose log1p values two Gaussians fit better than one.

    A group has a row a month, so a task's frame is small.
    """

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        x = np.log1p(f["v"].to_numpy(float))
        out = np.full(len(x), "normal", object)
        if len(x) >= least:
            one, (bic, w, mu, sd) = mixture_1d(x, 1), mixture_1d(x, 2)
            if bic < one[0] and w[mu.argmax()] < spike:
                p = w * np.exp(-((x[:, None] - mu) ** 2) / (2 * sd**2)) / sd
                out[p.argmax(axis=1) == mu.argmax()] = "spike"
        return pd.DataFrame({"g": key[0], "m": f["m"], "regime": out})

    rows = monthly.select(F.col(group).alias("g"), F.col(month).alias("m"), F.col(value).cast("double").alias("v")).dropna()
    return rows.groupBy("g").applyInPandas(run, "g string, m string, regime string").select(F.col("g").alias(group), F.col("m").alias(month), "regime")


def dip_statistic(x: np.ndarray) -> float:
    """Greatest distance between the empirical distribution and the nearest unimodal one on its own support, at the best of all modes.

    The distribution below the mode is held against its greatest convex minorant, above it against its least concave majorant; half the larger gap at the best mode.
    The first gap never falls and the second never grows as the mode moves up, so the best mode is where they cross, which halving finds.
    """
    v, c = np.unique(np.asarray(x, float), return_counts=True)
    if len(v) < 3:
        return 1.0 / (2 * max(1, c.sum()))
    f = np.cumsum(c) / c.sum()

    def hull_gap(a: np.ndarray, b: np.ndarray) -> float:  # b against its lower hull
        keep: list[int] = []
        for i in range(len(a)):
            while len(keep) > 1 and (b[keep[-1]] - b[keep[-2]]) * (a[i] - a[keep[-2]]) >= (b[i] - b[keep[-2]]) * (a[keep[-1]] - a[keep[-2]]):
                keep.pop()
            keep.append(i)
        return float(np.max(b - np.interp(a, a[keep], b[keep])))

    def gaps(m: int) -> tuple[float, float]:
        return hull_gap(v[: m + 1], f[: m + 1]), hull_gap(-v[m:][::-1], -f[m:][::-1])

    lo, hi = 1, len(v) - 2  # the first mode whose lower gap is the larger one, or the last mode
    while lo < hi:
        m = (lo + hi) // 2
        below, above = gaps(m)
        lo, hi = (lo, m) if below >= above else (m + 1, hi)
    best = min(max(gaps(m)) for m in {max(1, lo - 1), lo})
    return max(best / 2, 1.0 / (2 * c.sum()))


def match_without_replacement(df: DataFrame, groups: list[str], key: str, treated: str, value: str) -> DataFrame:
    """(groups, key, match, gap): within each group every treated row, in order of value and key, takes the nearest control that is still free.

    The choice is sequential by definition, so a group is one task; groups are cells of (community, month), bounded by a month's posts.
    """
    schema = ", ".join([*(f"{g} string" for g in groups), "key string", "match string", "gap double"])

    def run(k: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["v", "key"])
        t, c = f[f["t"]], f[~f["t"]]
        values, names, free = c["v"].to_numpy(), c["key"].to_numpy(), np.ones(len(c), bool)
        out = []
        for name, v in zip(t["key"], t["v"]):
            if not free.any():
                break
            gap = np.where(free, np.abs(values - v), np.inf)
            i = int(gap.argmin())
            free[i] = False
            out.append((*k, name, names[i], float(gap[i])))
        return pd.DataFrame(out, columns=[*groups, "key", "match", "gap"])

    rows = df.select(*groups, F.col(key).cast("string").alias("key"), F.col(treated).alias("t"), F.col(value).cast("double").alias("v")).dropna()
    return rows.groupBy(*groups).applyInPandas(run, schema)


def vif_kept(df: DataFrame, features: list[str], limit: float = 10.0) -> list[str]:
    """Columns left after dropping, one by one, the one with the greatest variance inflation over ``limit``. One pass gives all cross products."""
    n = len(features)
    cells = [F.sum(F.col(a).cast("double") * F.col(b)) for i, a in enumerate(features) for b in features[i:]]
    row = df.select(*features).fillna(0).agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)]).first()  # one row
    gram, it = np.zeros((n, n)), iter(row)
    for i in range(n):
        for j in range(i, n):
            gram[i, j] = gram[j, i] = next(it) or 0.0
    keep = [i for i in range(n) if gram[i, i] > 0]
    while len(keep) > 1:
        vif = np.empty(len(keep))
        for k, i in enumerate(keep):  # what the other columns leave of a column's sum of squares, without an intercept
            rest = [j for j in keep if j != i]
            left = gram[i, i] - gram[i, rest] @ np.linalg.pinv(gram[np.ix_(rest, rest)]) @ gram[rest, i]
            vif[k] = gram[i, i] / max(left, 1e-12 * gram[i, i])
        if vif.max() <= limit:
            break
        keep.pop(int(vif.argmax()))
    return [features[i] for i in keep]


def correlation_kept(matrix: dict[tuple[str, str], float], names: list[str], limit: float = 0.5) -> list[str]:
    """Names left after dropping, of each pair over ``limit``, the one that correlates more with all others."""
    r = lambda a, b: abs(matrix.get((a, b), matrix.get((b, a), 0.0)))
    keep = list(names)
    while True:
        pairs = [(r(a, b), a, b) for i, a in enumerate(keep) for b in keep[i + 1 :] if r(a, b) > limit]
        if not pairs:
            return keep
        _, a, b = max(pairs)
        mean = lambda x: sum(r(x, o) for o in keep if o != x) / (len(keep) - 1)
        keep.remove(a if mean(a) >= mean(b) else b)


def hypergeometric_tail(k: int, a: int, b: int, m: int) -> float:
    """P(X >= k) for X shared of a and b among m: the first term by log gammas, the next ones by their ratios, until they add nothing."""
    lo, hi = max(k, a + b - m, 0), min(a, b)
    if lo > hi:
        return 0.0
    g = math.lgamma
    choose = lambda n, x: g(n + 1) - g(x + 1) - g(n - x + 1)
    term = math.exp(choose(a, lo) + choose(m - a, b - lo) - choose(m, b))
    total, x = term, lo
    while x < hi:
        y = np.arange(x, min(hi, x + 256), dtype=float)
        terms = term * np.cumprod((a - y) * (b - y) / ((y + 1) * (m - a - b + y + 1)))
        total += float(terms.sum())
        x, term = x + len(y), float(terms[-1])
        if x > a * b / m and term < 1e-18 * total:
            break
    return min(total, 1.0)


def log_hypergeometric_tail(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The tails of a batch; equal arguments are worked out once."""
    known: dict = {}
    for columns in batches:
        keys = list(zip(*(c.astype(int).tolist() for c in columns)))
        known |= {x: hypergeometric_tail(*x) for x in set(keys) - known.keys()}
        yield pd.Series([known[x] for x in keys])
        if len(known) > 500_000:
            known.clear()


def with_tail(edges: DataFrame) -> DataFrame:
    """Adds ``p`` to pair edges (n, d1, d2, t)."""
    from pyspark.sql.functions import pandas_udf
    from pyspark.sql.types import DoubleType

    tail = pandas_udf(log_hypergeometric_tail, DoubleType())
    return edges.withColumn("p", tail("n", "d1", "d2", "t"))


def anomaly_scores(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """(key, anomaly): root mean square of robust z-scores. It stands where an isolation forest would, which Spark doesn't have."""
    mid = ranks.medians(df, features, "m_")
    away = df.join(F.broadcast(mid)).select(key, *[(F.col(f) - F.col(f"m_{f}")).alias(f) for f in features])
    mad = ranks.medians(away.select(*[F.abs(f).alias(f) for f in features]), features, "d_")
    z = [F.coalesce(F.try_divide(F.col(f), 1.4826 * F.col(f"d_{f}")), F.lit(0.0)) for f in features]
    return away.join(F.broadcast(mad)).select(key, F.sqrt(sum((x * x for x in z), F.lit(0.0)) / len(features)).alias("anomaly"))


def model_frame(features: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Features with labels where known; of several labels of a key the greatest."""
    return features.join(labels.groupBy(key).agg(F.max(label).alias(label)), key, "left")
