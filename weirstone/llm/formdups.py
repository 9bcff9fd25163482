"""Records that differ only in formatting, by progressive partition refinement.

Refinement 1 splits the records by invariants that cost little and that no change of formatting or order of fields can alter: the
number of letters, marks and digits, and a histogram of them, kept as one sum of weights by byte. For ASCII bodies it is read off the raw
bytes of an Arrow batch at once, with no regular expression and no lower-casing. Only classes with several records go on to refinement 2, which
builds the full form of a body and its digest. Members of a class that nothing shares leave the data before the costly key is built.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirstone.session import written

#: All but letters, marks and digits.
NOISE = r"[^\p{L}\p{M}\p{N}]+"
_WS = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]"
_BLANK = rf"^{_WS}*$"
_FIELD = rf"^{_WS}*[A-Za-z][A-Za-z ]{{0,19}}:"


def stripped(body: Column) -> Column:
    """Lower case, letters, marks and digits only."""
    return F.regexp_replace(F.lower(body), NOISE, "")


def _weights() -> np.ndarray:
    """A weight for each byte: 0 for ASCII signs, the same for both cases of an ASCII letter."""
    w = np.random.default_rng(20_240_517).integers(1, 2**63, 256, dtype=np.uint64)
    for c in range(128):
        w[c] = w[ord(chr(c).lower())] if chr(c).isalnum() else 0
    return w


def invariants(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text the number of its letters, marks and digits, and a sum of weights that only depends on which these are, in lower case.

    A text with other than ASCII characters is reduced first; both forms of a small sigma, which depend on the place in the word, count as one.
    """
    import regex

    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    start, w = offsets - offsets[0], _weights()
    total = lambda x: np.diff(np.concatenate((np.zeros(1, x.dtype), np.cumsum(x)))[start])
    with np.errstate(over="ignore"):
        size, mark = total((w[raw] > 0).astype(np.int64)), total(w[raw])
        for i in np.flatnonzero(total((raw >= 128).astype(np.int64))):
            kept = regex.sub(NOISE, "", texts[int(i)].as_py().lower()).replace("ς", "σ")
            size[i], mark[i] = len(kept), w[np.frombuffer(kept.encode(), np.uint8)].sum(dtype=np.uint64)
    return size, mark


def _classes(min_chars: int, with_body: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, mark = invariants(b.column("body").cast(pa.string()))
            with np.errstate(over="ignore"):
                code = (mark + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            keep = pa.array(size >= min_chars)
            columns = ["id", "body"] if with_body else ["id"]
            yield pa.RecordBatch.from_arrays([pa.array(code).filter(keep), *(b.column(c).filter(keep) for c in columns)], ["class", *columns])

    return run


def form(body: Column) -> Column:
    """The full form: the stripped text, or the sorted stripped pieces of a body made of named fields."""
    pieces = F.filter(F.split(body, r"[\n;|]"), lambda p: ~F.rlike(p, F.lit(_BLANK)))
    fields = (F.size(pieces) >= 2) & F.forall(pieces, lambda p: F.rlike(p, F.lit(_FIELD)))
    several = F.rlike(body, F.lit(r"[\n;|]")) & F.contains(body, F.lit(":"))
    many = F.concat(F.lit("fields\n"), F.array_join(F.sort_array(F.transform(pieces, stripped)), "\n"))
    return F.when(several & fields, many).otherwise(F.concat(F.lit("text\n"), stripped(body)))


def members_by_form(df: DataFrame, record_id: str, body: str, min_chars: int = 30) -> DataFrame:
    """(form, id): each record of a form that at least two records may share, form as a digest; written once."""
    rows = df.select(F.col(record_id).alias("id"), F.col(body).alias("body")).dropna().filter(F.length("body") >= min_chars)
    kind = rows.schema["id"].dataType.simpleString()
    h = F.xxhash64("id")
    several = rows.mapInArrow(_classes(min_chars, False), f"class bigint, id {kind}").groupBy("class").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).filter("lo <> hi").select("class")
    left = rows.mapInArrow(_classes(min_chars, True), f"class bigint, id {kind}, body string").join(several, "class", "left_semi")
    return written(left.select(F.unhex(F.md5(form(F.col("body")).cast("binary"))).alias("form"), "id").distinct())


def form_classes(df: DataFrame, record_id: str, body: str, min_chars: int = 30) -> DataFrame:
    """(form, first, copies): every form shared by several records, its smallest id and its number of records."""
    m = members_by_form(df, record_id, body, min_chars)
    return m.groupBy("form").agg(F.min("id").alias("first"), F.count("*").alias("copies")).filter("copies > 1")


def form_duplicates(df: DataFrame, record_id: str, body: str, min_chars: int = 30) -> DataFrame:
    """(first, id): every record whose form is that of a record with a smaller id, and the smallest such id.

    Rows of one id are one record. Null ids, null bodies and forms under ``min_chars`` characters don't count; an empty table gives no rows.
    Whole texts are compared, whatever their length. A form of a third of all records has one row on the classes' side of the last join, and adaptive
    execution splits the other side.
    """
    m = members_by_form(df, record_id, body, min_chars)
    first = m.groupBy("form").agg(F.min("id").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    return m.join(first, "form").filter(F.col("id") != F.col("first")).select("first", "id")
