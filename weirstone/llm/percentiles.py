"""Percentiles per group by radix selection, exact or as a summary that can be combined.

Values are mapped to 64-bit integers in the same order. Each pass counts one digit of the integers and follows, for each group and rank,
only the digit that holds the rank. Equal values are counted into one row before anything else, so a large group is spread by its
values, and each histogram has at most 2**digit_bits rows.

The same counts, cut off after some leading bits, are a summary: histograms of separate days or files are united by adding
their counts, and a percentile read from one lies within 2**-(bits - 12) of the exact value, relative to it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from weirstone.session import written

LOW = -(2**63)


@pandas_udf(T.LongType())
def float_key(v: pd.Series) -> pd.Series:
    """Order-preserving integer of a double; null for null and NaN. -0.0 is 0.0."""
    x = v.to_numpy(dtype=np.float64, na_value=np.nan) + 0.0
    bits = x.view(np.int64)
    return pd.Series(np.where(bits >= 0, bits, bits ^ np.int64(2**63 - 1)), dtype="Int64").mask(np.isnan(x))


@pandas_udf(T.DoubleType())
def key_float(k: pd.Series) -> pd.Series:
    """The double of an integer made by :func:`float_key`."""
    null = k.isna().to_numpy()
    bits = k.fillna(0).to_numpy(dtype=np.int64)
    return pd.Series(np.where(bits >= 0, bits, bits ^ np.int64(2**63 - 1)).view(np.float64)).mask(null)


def radix_histogram(df: DataFrame, groups: list[str], key: str, bits: int = 64) -> DataFrame:
    """(groups, u, c): how many rows of a group have the leading ``bits`` bits u. Rows with a null key or group are left out.

    u is the key with its sign bit turned, shifted right as an unsigned number.
    """
    u = F.col(key).bitwiseXOR(F.lit(LOW))
    u = F.shiftrightunsigned(u, 64 - bits) if bits < 64 else u
    return df.select(*groups, u.alias("u")).dropna().groupBy(*groups, "u").agg(F.count("*").alias("c"))


def merge_histograms(*parts: DataFrame) -> DataFrame:
    """The histogram of all rows behind the given ones (same groups and bits)."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(*[c for c in whole.columns if c != "c"]).agg(F.sum("c").alias("c"))


def select_ranks(hist: DataFrame, groups: list[str], quantiles: list[float], bits: int = 64, digit_bits: int = 16) -> DataFrame:
    """(groups, q, n, key): for each group and quantile the key at rank ceil(q n), 1 at least, of the n rows.

    Of a histogram with fewer than 64 bits the key is the least that its leading bits allow.
    """
    n = hist.groupBy(*groups).agg(F.sum("c").alias("n"))
    ranks = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), F.greatest(F.lit(1), F.ceil(F.lit(float(q)) * F.col("n"))).cast("bigint").alias("r")) for q in quantiles]))
    at = n.select(*groups, "n", ranks.alias("x")).select(*groups, "n", "x.q", "x.r", F.lit(0).cast("bigint").alias("prefix"))
    names = [f"h_{i}" for i in range(len(groups))]
    for done in range(0, bits, digit_bits):
        width = min(digit_bits, bits - done)
        prefix = F.shiftrightunsigned("u", bits - done) if done else F.lit(0).cast("bigint")
        digit = F.shiftrightunsigned("u", bits - done - width).bitwiseAND(F.lit((1 << width) - 1))
        rows = hist.select(*groups, prefix.alias("prefix"), digit.alias("digit"), "c")
        if done:
            rows = rows.join(at.select(*groups, "prefix").distinct(), [*groups, "prefix"], "left_semi")
        counts = rows.groupBy(*groups, "prefix", "digit").agg(F.sum("c").alias("c"))
        # a histogram of at most 2**width digits for each group and prefix
        upto = F.sum("c").over(Window.partitionBy(*groups, "prefix").orderBy("digit"))
        counts = counts.withColumn("upto", upto).select(*[F.col(g).alias(h) for g, h in zip(groups, names)], F.col("prefix").alias("h_prefix"), "digit", "c", "upto")
        same: Column = F.col("prefix") == F.col("h_prefix")
        for g, h in zip(groups, names):
            same = same & (F.col(g) == F.col(h))
        hit = at.join(counts, same & (F.col("r") <= F.col("upto")) & (F.col("r") > F.col("upto") - F.col("c")))
        at = hit.select(*groups, "n", "q", (F.col("r") - F.col("upto") + F.col("c")).alias("r"), F.shiftleft("prefix", width).bitwiseOR(F.col("digit")).alias("prefix"))
    key = F.shiftleft("prefix", 64 - bits) if bits < 64 else F.col("prefix")
    return at.select(*groups, "q", "n", key.bitwiseXOR(F.lit(LOW)).alias("key"))


def percentiles(df: DataFrame, groups: list[str], value: str, quantiles: list[float], bits: int = 64) -> DataFrame:
    """(groups, q, n, value) of a numeric column; exact with 64 bits.

    Nulls and NaN aren't values; infinities are the extremes. A group without values has no row, nor has an empty table.
    Rows with a null group column are left out.
    """
    whole = dict(df.dtypes)[value] in ("tinyint", "smallint", "int", "bigint")
    key = F.col(value).cast("bigint") if whole else float_key(F.col(value).cast("double"))
    inner = [f"_g{i}" for i in range(len(groups))]  # no name of the caller's meets one of ours
    keyed = df.select(*[F.col(g).alias(x) for g, x in zip(groups, inner)], key.alias("_key"))
    # counted once; all digit passes read the counts
    out = select_ranks(written(radix_histogram(keyed, inner, "_key", bits)), inner, quantiles, bits)
    return out.select(*[F.col(x).alias(g) for g, x in zip(groups, inner)], "q", "n", (F.col("key") if whole else key_float("key")).alias("value"))
