"""Queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirstone.llm import cooccur, encode, formdups, fusion, leaks, neardups, percentiles, personal, topn
from weirstone.sources.tables import SENTINELS, canonical_sub, latest_rows, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as the query of its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_SUB_SQL = "trim(regexp_replace(lower(trim(sub)), '^/?r/', ''))"

# 2 ---------------------------------------------------------------------------

_PAIRS_SQL = """
WITH m AS (SELECT DISTINCT month, post_id, author FROM presence WHERE author IS NOT NULL AND author <> '[deleted]' AND month IS NOT NULL AND post_id IS NOT NULL),
     d AS (SELECT month, author, count(*) AS d FROM m GROUP BY 1, 2),
     t AS (SELECT month, count(DISTINCT post_id) AS t FROM m GROUP BY 1),
     n AS (SELECT x.month, x.author AS a1, y.author AS a2, count(*) AS n FROM m x JOIN m y ON x.month = y.month AND x.post_id = y.post_id AND x.author < y.author GROUP BY 1, 2, 3),
     r AS (SELECT n.*, d1.d AS d1, d2.d AS d2, t.t FROM n JOIN d d1 ON d1.month = n.month AND d1.author = a1 JOIN d d2 ON d2.month = n.month AND d2.author = a2 JOIN t ON t.month = n.month)
"""


def _presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "presence").filter(~F.col("author").isin(*SENTINELS))


@query(_PAIRS_SQL + "SELECT a1, a2, month, n AS n_coappear FROM r WHERE n >= 3 AND n * t >= 8 * d1 * d2")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cooccur.cooccurrence(_presence(spark, sf_dir), "author", "post_id", "month", min_n=3, min_lift=8.0)
    return pairs.select("a1", "a2", "month", F.col("n").alias("n_coappear"))


@query(_PAIRS_SQL + "SELECT a1, a2, month, n, d1, d2, t, n * t / (d1 * d2) AS lift, (1 - d2 / t) / nullif(1 - n / d1, 0) AS conviction FROM r WHERE n >= 2")
def p2_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair that met twice in a month, with lift and conviction."""
    return cooccur.cooccurrence(_presence(spark, sf_dir), "author", "post_id", "month", min_n=2)


# 3 ---------------------------------------------------------------------------

_FIELDS_SQL = f"""
WITH p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY retrieved_at DESC NULLS LAST) AS k FROM posts WHERE post_id IS NOT NULL) WHERE k = 1),
     a AS (SELECT author, max(median_comment_score) AS v, max(first_seen_utc) AS s FROM account_comment_stats WHERE author IS NOT NULL GROUP BY 1),
     x AS (SELECT 'comment_score_p50' AS field, {_SUB_SQL} AS sub, month, comment_score_p50::DOUBLE AS v FROM p
           UNION ALL SELECT 'comment_score_p90', {_SUB_SQL}, month, comment_score_p90::DOUBLE FROM p
           UNION ALL SELECT 'median_comment_score', '', strftime(make_timestamp(s * 1000000), '%Y-%m'), v FROM a),
     o AS (SELECT field, sub, month, v, row_number() OVER w AS r, count(*) OVER (PARTITION BY field, sub, month) AS n FROM x
           WHERE v IS NOT NULL AND NOT isnan(v) AND sub IS NOT NULL AND month IS NOT NULL WINDOW w AS (PARTITION BY field, sub, month ORDER BY v)),
     q AS (SELECT field, sub, month, max(n) AS n, max(v) FILTER (WHERE r = greatest(1, ceil(0.5 * n))) AS p50, max(v) FILTER (WHERE r = greatest(1, ceil(0.9 * n))) AS p90 FROM o GROUP BY 1, 2, 3)
"""


def score_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, sub, month, v) of the three columns whose percentiles are wanted."""
    p = latest_rows(table(spark, sf_dir, "posts"), "post_id", "retrieved_at", ["sub", "month", "comment_score_p50", "comment_score_p90"])
    both = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in ("comment_score_p50", "comment_score_p90")]))
    p = p.select(canonical_sub("sub").alias("sub"), "month", both.alias("x")).select("x.field", "sub", "month", "x.v")
    a = latest_rows(table(spark, sf_dir, "account_comment_stats"), "author", "last_seen_utc", ["first_seen_utc", "median_comment_score"])
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("first_seen_utc") / 86400).cast("int"))
    a = a.select(F.lit("median_comment_score").alias("field"), F.lit("").alias("sub"), F.date_format(day, "yyyy-MM").alias("month"), F.col("median_comment_score").alias("v"))
    return p.unionByName(a)


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = percentiles.percentiles(score_fields(spark, sf_dir), ["field", "sub", "month"], "v", [0.5, 0.9])
    at = lambda x: F.max(F.when(F.col("q") == x, F.col("value")))
    return q.groupBy("field", "sub", "month").agg(F.max("n").alias("n"), at(0.5).alias("p50"), at(0.9).alias("p90"))


@query(_FIELDS_SQL + "SELECT field, sub, month FROM q WHERE n >= 15 AND p50 > 0 AND p90 >= 6 * p50")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark, sf_dir).filter("n >= 15 AND p50 > 0 AND p90 >= 6 * p50").select("field", "sub", "month")


@query(_FIELDS_SQL + "SELECT * FROM q")
def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and 90th percentile of every group."""
    return _fields(spark, sf_dir)


@query()
def p3_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same per field over all months, read from the months' united 24-bit summaries (within 2**-12 of the exact value)."""
    keyed = score_fields(spark, sf_dir).withColumn("key", percentiles.float_key("v"))
    monthly = percentiles.radix_histogram(keyed, ["field", "sub", "month"], "key", bits=24)
    whole = percentiles.merge_histograms(monthly.drop("month", "sub"))
    return percentiles.select_ranks(whole, ["field"], [0.5, 0.9, 0.99], bits=24).select("field", "q", "n", percentiles.key_float("key").alias("value"))


# 4 ---------------------------------------------------------------------------

SCORES = ["thin_history_raw", "karma_extremeness_raw", "karma_per_post_extremeness_raw"]

_MARKS_SQL = """
WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY computed_at DESC NULLS LAST, thin_history_raw DESC NULLS LAST, karma_extremeness_raw DESC NULLS LAST, karma_per_post_extremeness_raw DESC NULLS LAST) AS k FROM account_botmarkers WHERE author IS NOT NULL) WHERE k = 1),
     x AS (SELECT author, 0 AS s, thin_history_raw AS v FROM l UNION ALL SELECT author, 1, karma_extremeness_raw FROM l UNION ALL SELECT author, 2, karma_per_post_extremeness_raw FROM l),
     k AS (SELECT author, s, v, count(*) OVER (PARTITION BY s) AS n FROM x WHERE v IS NOT NULL AND isfinite(v)),
     p AS (SELECT author, s, n, (rank() OVER (PARTITION BY s ORDER BY v) - 1) / n AS place FROM k)
"""


#: Places nearer than this are a tie; from STRICT on one account is preferred outright.
INDIFFERENT, STRICT = 0.05, 0.5


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = latest_rows(table(spark, sf_dir, "account_botmarkers"), "author", "computed_at", SCORES)
    return fusion.net_flow(latest, "author", dict.fromkeys(SCORES, 1.0), INDIFFERENT, STRICT)


@query(_MARKS_SQL + "SELECT author FROM p GROUP BY 1 HAVING count(*) = 3 AND avg(place) >= 0.78")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts high enough in the outranking to be a case, then the check on their places.

    A flow is at least its place plus the least difference of the two in that score, so a mean place of 0.78 needs a net flow of at least 0.78 plus the mean of these differences.
    """
    r = _marks(spark, sf_dir).filter("n_scores = 3")
    bound = 0.78 + (F.col("least_0") + F.col("least_1") + F.col("least_2")) / 3
    return r.filter((F.col("net_flow") >= bound - 1e-9) & ((F.col("place_0") + F.col("place_1") + F.col("place_2")) / 3 >= 0.78)).select("author")


_PREFERENCE = f"least(1, greatest(0, ({{}} - {INDIFFERENT}) / ({STRICT} - {INDIFFERENT})))"


@query(_MARKS_SQL + f""", d AS (SELECT s, place, max(n) AS n, count(*) AS c FROM p GROUP BY 1, 2),
     g AS (SELECT x.s, x.place, sum(y.c * ({_PREFERENCE.format('x.place - y.place')} - {_PREFERENCE.format('y.place - x.place')})) / greatest(max(x.n) - 1, 1) AS flow FROM d x JOIN d y ON x.s = y.s GROUP BY 1, 2)
SELECT author, round(avg(flow), 9) + 0.0 AS net_flow, count(*) AS n_scores FROM p JOIN g USING (s, place) GROUP BY 1""")
def p4_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net flow of every account; the ranking is its descending order, then the name. The SQL compares all pairs of places, so it's for small tables."""
    return _marks(spark, sf_dir).select("author", (F.round("net_flow", 9) + 0.0).alias("net_flow"), "n_scores")


# 5 ---------------------------------------------------------------------------

_FORMS_SQL = r"""
WITH c AS (SELECT DISTINCT comment_id, body FROM commenters WHERE comment_id IS NOT NULL AND body IS NOT NULL),
     x AS (SELECT comment_id, regexp_replace(lower(body), '[^\p{L}\p{M}\p{N}]+', '', 'g') AS t, list_filter(regexp_split_to_array(body, '[\n;|]'), lambda p: NOT regexp_matches(p, '^[\s\pZ]*$')) AS ps FROM c),
     f AS (SELECT comment_id, t, CASE WHEN len(ps) >= 2 AND len(list_filter(ps, lambda p: NOT regexp_matches(p, '^[\s\pZ]*[A-Za-z][A-Za-z ]{0,19}:'))) = 0
             THEN 'fields:' || array_to_string(list_sort(list_transform(ps, lambda p: regexp_replace(lower(p), '[^\p{L}\p{M}\p{N}]+', '', 'g'))), chr(10)) ELSE 'text:' || t END AS form FROM x),
     g AS (SELECT comment_id, min(comment_id) OVER (PARTITION BY form) AS first_id FROM f WHERE length(t) >= 30)
"""


@query(_FORMS_SQL + "SELECT first_id AS first_comment_id, comment_id FROM g WHERE comment_id <> first_id")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = formdups.form_duplicates(table(spark, sf_dir, "commenters"), "comment_id", "body")
    return d.select(F.col("first").alias("first_comment_id"), F.col("id").alias("comment_id"))


@query(_FORMS_SQL + "SELECT first_id AS first_comment_id, count(*) AS copies FROM g GROUP BY 1 HAVING count(*) > 1")
def p5_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each form that several comments share, with its number of copies."""
    return formdups.form_classes(table(spark, sf_dir, "commenters"), "comment_id", "body").select(F.col("first").alias("first_comment_id"), "copies")


# 7 ---------------------------------------------------------------------------


@query(f"""
SELECT sub, month, rn, post_id FROM (
  SELECT {_SUB_SQL} AS sub, month, post_id, row_number() OVER (PARTITION BY {_SUB_SQL}, month ORDER BY score DESC, post_id) AS rn
  FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY retrieved_at DESC NULLS LAST) AS k FROM posts WHERE post_id IS NOT NULL)
  WHERE k = 1 AND score IS NOT NULL AND sub IS NOT NULL AND month IS NOT NULL) WHERE rn <= 10
""")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = latest_rows(table(spark, sf_dir, "posts"), "post_id", "retrieved_at", ["sub", "month", "score"])
    return topn.top_n(p.withColumn("sub", canonical_sub("sub")), ["sub", "month"], "score", "post_id", 10)

# 8 ---------------------------------------------------------------------------

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


@query()
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(table(spark, sf_dir, "documents"), "doc_id", "text", os.path.join(TOKENIZERS, "byte_bpe_50k.json"))


@query()
def p8_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, offsets and the decoded text of every document. Rows of a document that stands several times stay apart, as the text is decoded beside its ids."""
    path = os.path.join(TOKENIZERS, "byte_bpe_50k.json")
    e = encode.encode_offsets(table(spark, sf_dir, "documents"), "doc_id", "text", path).select(F.struct("doc_id", "ids", "starts", "ends").alias("row"), "ids")
    return encode.decode(e, "row", "ids", path).select("row.*", "text")


# 9 ---------------------------------------------------------------------------


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


_GRAMS_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
     i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS ws FROM eval_items WHERE text IS NOT NULL),
     k AS (SELECT item_id, ws, least(13, len(ws)) AS k FROM i WHERE len(ws) > 0),
     q AS (SELECT DISTINCT item_id, k, array_to_string(ws[j : j + k - 1], ' ') AS g FROM (SELECT item_id, k, ws, unnest(range(1, len(ws) - k + 2)) AS j FROM k)),
     c AS (SELECT DISTINCT doc_id, k, array_to_string(ws[j : j + k - 1], ' ') AS g FROM (SELECT doc_id, k, ws, unnest(range(1, len(ws) - k + 2)) AS j FROM w, (SELECT DISTINCT k FROM k)))
"""


@query(_GRAMS_SQL + "SELECT DISTINCT doc_id, item_id FROM q JOIN c USING (k, g)")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


@query(r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
     i AS (SELECT item_id, ws, least(13, len(ws)) AS k FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS ws FROM eval_items WHERE text IS NOT NULL) WHERE len(ws) > 0),
     q AS (SELECT item_id, k, j, array_to_string(ws[j : j + k - 1], ' ') AS g FROM (SELECT item_id, k, ws, unnest(range(1, len(ws) - k + 2)) AS j FROM i)),
     c AS (SELECT doc_id, k, p, array_to_string(ws[p : p + k - 1], ' ') AS g FROM (SELECT doc_id, k, ws, unnest(range(1, len(ws) - k + 2)) AS p FROM w, (SELECT DISTINCT k FROM i))),
     h AS (SELECT doc_id, item_id, k, p, p - j AS diagonal, p - row_number() OVER (PARTITION BY doc_id, item_id, p - j ORDER BY p) AS island FROM q JOIN c USING (k, g)),
     m AS (SELECT doc_id, item_id, count(*) + max(k) - 1 AS n_words, min(p) - 1 AS place FROM h GROUP BY doc_id, item_id, diagonal, island)
SELECT doc_id, item_id, n_words, place FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_words DESC, place) = 1""")
def p9_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest verbatim match of each document and item, and its place."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id", "n_words", F.col("at").alias("place"))


@query(_GRAMS_SQL + "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM q JOIN c USING (k, g))")
def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are left when those with leaks are removed."""
    return leaks.without_leaks(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", _leaks(spark, sf_dir))

# 6 ---------------------------------------------------------------------------


def _near(spark: SparkSession, sf_dir: str) -> neardups.NearDuplicates:
    c = table(spark, sf_dir, "commenters").filter(~F.col("author").isin(*SENTINELS))
    return neardups.NearDuplicates(c, "comment_id", "author", "body", 7, 10, 20)


@query(r"""
WITH x AS (SELECT DISTINCT comment_id, author, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(body), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> ''))) AS ws
           FROM commenters WHERE comment_id IS NOT NULL AND author IS NOT NULL AND author <> '[deleted]' AND body IS NOT NULL),
     s AS (SELECT row_number() OVER () AS k, ws, len(ws) AS n FROM (SELECT DISTINCT ws FROM x WHERE len(ws) >= 20)),
     w AS (SELECT k, n, unnest(ws) AS w FROM s),
     p AS (SELECT a.k AS i, b.k AS j FROM w a JOIN w b ON a.w = b.w AND a.k < b.k AND 10 * least(a.n, b.n) >= 7 * greatest(a.n, b.n) GROUP BY 1, 2 HAVING 10 * count(*) >= 7 * (max(a.n) + max(b.n) - count(*))),
     m AS (SELECT comment_id, author, k FROM x JOIN s USING (ws)),
     l AS (SELECT i, j FROM p UNION ALL SELECT k, k FROM s)
SELECT DISTINCT least(a.comment_id, b.comment_id) AS comment_id_a, greatest(a.comment_id, b.comment_id) AS comment_id_b
FROM l JOIN m a ON a.k = l.i JOIN m b ON b.k = l.j WHERE a.author <> b.author AND a.comment_id <> b.comment_id""")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).pairs().select(F.col("a").alias("comment_id_a"), F.col("b").alias("comment_id_b"))

# 10 --------------------------------------------------------------------------


@query()
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.find_personal(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with typed placeholders."""
    return personal.redacted(table(spark, sf_dir, "documents"), "doc_id", "text")
