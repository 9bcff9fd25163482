"""The best N items of every group, by bisection of cut-offs in all groups at once.

An item's code is a row of integer words, smaller for better items: the two halves of the negated score, then the identifier's bytes, seven to a word, as
many words as the longest identifier needs. For each group the cut-off is found word by word. A pass splits each group's interval into ``ways`` cells (as many
midpoints as log2(ways) halvings would test), counts rows by cell, and keeps the cell in which the count reaches what the group still
needs: rows in better cells are taken, rows in worse ones leave the data, and only those in the cell go on. What moves
in a pass is one count for each cell and group, however many items a group has; rows are sorted only once a group is down to its N.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirstone.llm.percentiles import float_key
from weirstone.session import checkpointed, written

ID_BYTES = 7


def score_code(df: DataFrame, score: str) -> Column:
    """An integer that is smaller for better scores; null for null and NaN."""
    kind = dict(df.dtypes)[score]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.bitwise_not(F.col(score).cast("bigint"))
    if kind in ("float", "double"):
        return F.bitwise_not(float_key(F.col(score).cast("double")))
    raise TypeError(f"a score of type {kind} has no order-preserving code; cast it to bigint or double")


def id_word(ident: Column, i: int) -> Column:
    """The identifier's bytes from 7 i on as an integer; shorter ones are filled with zero bytes, which sort first."""
    part = F.rpad(F.hex(F.substring(F.encode(ident, "UTF-8"), 1 + i * ID_BYTES, ID_BYTES)), 2 * ID_BYTES, "0")
    return F.conv(part, 16, 10).cast("bigint")


def top_n(df: DataFrame, groups: list[str], score: str, ident: str, n: int, ways: int = 4096) -> DataFrame:
    """(groups, rn, ``ident``) of the ``n`` best rows of each group by ``score`` descending, then ``ident`` ascending by its bytes.

    ``score`` is an integer or floating column, ``ident`` a string of any length; an identifier that a group holds several times counts once, with its best score. Rows with a
    null or NaN score or a null identifier or group are left out; smaller groups come out whole; an empty table gives no rows.
    """
    g = [f"g{i}" for i in range(len(groups))]
    base = df.select(*[F.col(c).alias(x) for c, x in zip(groups, g)], score_code(df, score).alias("code"), F.col(ident).alias("id")).dropna()
    rows = written(base.groupBy(*g, "id").agg(F.min("code").alias("code")).withColumn("need", F.lit(n).cast("bigint")))
    longest = rows.agg(F.max(F.octet_length("id"))).first()[0]
    words = [F.shiftright("code", 32), F.col("code").bitwiseAND(F.lit(0xFFFFFFFF))] + [id_word(F.col("id"), i) for i in range(-(-(longest or 0) // ID_BYTES))]
    taken = []
    for word in words:
        while True:
            ends = checkpointed(rows.groupBy(*g).agg(F.min(word).alias("lo"), F.max(word).alias("hi"), F.max("need").alias("need"), F.count("*").alias("open")))
            if not ends.filter("lo < hi OR open <= need").head(1):
                break
            # a group that is down to what it needs is taken whole, one whose rows all agree in the word waits for the next one
            span = ends.filter("lo < hi AND open > need").select(*g, "lo", "need", F.expr(f"(hi - lo) div {ways} + 1").alias("width"))
            counts = rows.drop("need").join(span, g).groupBy(*g, "need", ((word - F.col("lo")) / F.col("width")).cast("bigint").alias("cell")).agg(F.count("*").alias("c"))
            upto = F.sum("c").over(Window.partitionBy(*g).orderBy("cell"))  # at most ``ways`` cells for a group
            hit = counts.withColumn("upto", upto).filter("need <= upto AND need > upto - c").select(*g, "cell", (F.col("need") - F.col("upto") + F.col("c")).alias("left"))
            step = checkpointed(ends.select(*g, "lo", "hi", "open", "need").join(hit, g, "left"))
            mine = ((word - F.col("lo")) / F.expr(f"(hi - lo) div {ways} + 1")).cast("bigint")
            fate = F.when(F.col("open") <= F.col("need"), -1).when(F.col("cell").isNull(), 0).otherwise(F.signum(mine - F.col("cell")).cast("int"))
            marked = rows.drop("need").join(step, g).select(*g, "id", "code", F.coalesce("left", "need").alias("need"), fate.alias("fate"))
            marked = written(marked.filter("fate <= 0"))
            taken.append(marked.filter("fate < 0").select(*g, "id", "code"))
            rows = marked.filter("fate = 0").select(*g, "id", "code", "need")
    # what is left agrees in all words: identifiers that differ in zero bytes at their end only
    last = F.row_number().over(Window.partitionBy(*g).orderBy("id"))
    taken.append(rows.withColumn("last", last).filter("last <= need").select(*g, "id", "code"))
    kept = reduce(DataFrame.unionByName, taken)
    rn = F.row_number().over(Window.partitionBy(*g).orderBy("code", "id"))
    return kept.withColumn("rn", rn).select(*[F.col(x).alias(c) for c, x in zip(groups, g)], F.col("rn").cast("bigint").alias("rn"), F.col("id").alias(ident))
