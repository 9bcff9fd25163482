"""Text statistics: repeated bodies, links, vocabularies, character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirstone.operators.accounts import rate
from weirstone.session import shuffles_dropped, written

#: Texts whose character n-grams are counted at once.
PIECE = 2_000
#: Numbers up to which a table tells what occurs.
TABLE = 1 << 21


@lru_cache(maxsize=1)
def stop_words() -> tuple[str, ...]:
    """The English stop words that Spark's own StopWordsRemover comes with (the Glasgow Information Retrieval Group's list), read from Spark's files."""
    import glob
    import os
    import zipfile

    import pyspark

    home = os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__)
    for jar in glob.glob(os.path.join(home, "jars", "spark-mllib_*.jar")):
        with zipfile.ZipFile(jar) as z:
            return tuple(z.read("org/apache/spark/ml/feature/stopwords/english.txt").decode().split())
    from pyspark.ml.feature import StopWordsRemover  # needs a running session

    return tuple(StopWordsRemover.loadDefaultStopWords("english"))


def normal(text: Column) -> Column:
    """Lower case, letters a-z, digits and single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", ""), " +", " "))


def words(text: Column) -> Column:
    """Words of three letters or more that are no stop words or numbers."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9_]+"), lambda w: (F.length(w) > 2) & ~w.isin(*stop_words()) & ~F.rlike(w, F.lit("^[0-9]+$")))


def repeated_bodies(c: DataFrame, least: int = 10) -> DataFrame:
    """(author, extra, groups): an author's comments beyond the first of each body, and the bodies posted more than once."""
    per = c.filter(F.length("body") >= least).groupBy("author", "body").agg(F.count("*").alias("k"))
    return per.groupBy("author").agg(F.sum(F.col("k") - 1).alias("extra"), F.count_if(F.col("k") > 1).alias("groups"))


def cross_thread_bodies(c: DataFrame, least: int = 30) -> DataFrame:
    """(author, n_dup_bodies, total_repeat_comments, max_subs_for_one_body) of bodies that an author repeated letter for letter in two threads or more."""
    per = c.filter(F.length("body") >= least).groupBy("author", "body").agg(F.count("*").alias("k"), F.countDistinct("post_id").alias("threads"), F.countDistinct("sub").alias("subs")).filter("threads >= 2")
    return per.groupBy("author").agg(F.count("*").alias("n_dup_bodies"), F.sum("k").alias("total_repeat_comments"), F.max("subs").alias("max_subs_for_one_body"))


def link_rate(c: DataFrame) -> DataFrame:
    return c.groupBy("author").agg(rate(F.rlike("body", F.lit(r"https?://|www\."))).alias("url_rate"))


def word_counts(df: DataFrame, groups: list[str], text: str) -> DataFrame:
    return df.select(*groups, F.explode(words(F.col(text))).alias("word")).groupBy(*groups, "word").agg(F.count("*").alias("n"))


def shared_normal_texts(c: DataFrame, least: int = 20) -> DataFrame:
    """(text, authors) of normalised bodies that several authors posted."""
    n = c.select("author", normal(F.col("body")).alias("text")).filter(F.length("text") >= least).distinct()
    return n.groupBy("text").agg(F.count("*").alias("authors")).filter("authors > 1")


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts; for each of them its text's number and how many follow it there, itself included."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return points, np.repeat(np.arange(len(texts)), lens), np.repeat(np.cumsum(lens), lens) - np.arange(lens.sum())


def _numbered(x: np.ndarray, space: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of numbers under ``space``, and the place among them of each."""
    if space > TABLE:
        return np.unique(x, return_inverse=True)
    seen = np.bincount(x, minlength=space) > 0
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[x]


def _gram_counts(n: tuple[int, ...]):
    """(gram, df, total) of a piece of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, PIECE) for i in range(0, b.num_rows, PIECE)):
                points, row, left = _points(part.column(0).to_pylist())
                at = np.arange(len(points))
                chars, c = _numbered(points, 0x110000)
                names, ids = [chr(x) for x in chars.tolist()], c
                for k in range(1, max(n) + 1):
                    if k > 1:  # a gram is the one without its last character, and that character; those that occur are numbered anew
                        go = left[at] >= k
                        at = at[go]
                        own, ids = _numbered(ids[go] * len(chars) + c[at + k - 1], len(names) * len(chars))
                        names = [names[x // len(chars)] + chr(chars[x % len(chars)]) for x in own.tolist()]
                    if k in n:
                        each = np.sort(row[at] * len(names) + ids)
                        each = each[np.diff(each, prepend=-1) > 0] % max(len(names), 1)
                        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array(np.bincount(x, minlength=len(names)), pa.int64()) for x in (each, ids))], ["gram", "df", "total"])

    return run


def _gram_weights(key: str, grams: list[str], idf: list[float]):
    """(key, gram, w) of each text: a walk along the vocabulary's prefixes from all of its places at once, and the norm over what is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars = sorted({x for g in grams for x in g})
        kind = np.zeros(0x110000, np.int32)
        kind[[ord(x) for x in chars]] = np.arange(1, len(chars) + 1)
        nodes = {p: i for i, p in enumerate(sorted({g[:k] for g in grams for k in range(len(g) + 1)}, key=lambda p: (len(p), p)), 1)}  # 1 is the root, 0 no way on
        step, end = np.zeros((len(nodes) + 1, len(chars) + 1), np.int32), np.full(len(nodes) + 1, -1, np.int64)
        for p, i in nodes.items():
            if p:
                step[nodes[p[:-1]], kind[ord(p[-1])]] = i
        end[[nodes[g] for g in grams]] = np.arange(len(grams))
        words, weight = pa.array(grams, pa.string()), np.array(idf, float)
        for b in batches:
            for part in (b.slice(i, PIECE) for i in range(0, b.num_rows, PIECE)):
                points, row, left = _points(part.column("t").to_pylist())
                c, at, hits = kind[points], np.arange(len(points)), []
                node = np.ones(len(points), np.int32)
                for k in range(1, max(map(len, grams), default=0) + 1):
                    go = left[at] >= k
                    at = at[go]
                    node = step[node[go], c[at + k - 1]]
                    at, node = at[node > 0], node[node > 0]
                    g = end[node]
                    hits.append(row[at][g >= 0] * len(grams) + g[g >= 0])
                found, tf = np.unique(np.concatenate(hits) if hits else np.empty(0, np.int64), return_counts=True)
                text, g = found // max(len(grams), 1), found % max(len(grams), 1)
                w = tf * weight[g]
                w /= np.sqrt(np.bincount(text, w * w, minlength=part.num_rows))[text]
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(text)), words.take(pa.array(g)), pa.array(w)], [key, "gram", "w"])

    return run


def tfidf(df: DataFrame, key: str, text: str, n: tuple[int, ...] = (2, 3), features: int = 1200, min_df: int = 3) -> DataFrame:
    """(key, gram, w): L2-normalised tf-idf of character n-grams; the ``features`` most frequent grams of at least ``min_df`` texts. A key has one text.

    A text's grams are counted where it is read, so none of them is shuffled or sorted with others': what goes through a shuffle are counts by gram. The
    vocabulary goes to the driver and the tasks; its size is its parameter.
    """
    with shuffles_dropped(df.sparkSession):
        rows = written(df.filter(F.length(text) >= max(n)).select(key, F.lower(F.col(text)).alias("t")))
        counts = rows.select("t").mapInArrow(_gram_counts(n), "gram string, df bigint, total bigint").groupBy("gram").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
        idf = F.ln((1 + F.lit(rows.count())) / (1 + F.col("df"))) + 1
        top = counts.filter(F.col("df") >= min_df).orderBy(F.desc("total"), "gram").limit(features).select("gram", idf.alias("idf")).collect()
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(_gram_weights(key, [r.gram for r in top], [r.idf for r in top]), f"`{key}` {kind}, gram string, w double")
