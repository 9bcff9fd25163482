import math

import pytest

from tests.conftest import agree
from weirstone.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, data, duck, name):
    agree(queries.QUERIES[name](spark, data), duck, queries.SQL[name])


def test_near_duplicates_of_the_table(spark, data, duck):
    import regex

    rows = duck.sql("SELECT DISTINCT comment_id, author, body FROM commenters WHERE author IS NOT NULL AND author <> '[deleted]' AND body IS NOT NULL").fetchall()
    sets = [(i, a, s) for i, a, b in rows if len(s := set(regex.findall(r"[\p{L}\p{M}\p{N}]+", b.lower()))) >= 20]
    want = {(min(i, j), max(i, j)) for n, (i, a, s) in enumerate(sets) for j, b, t in sets[:n] if a != b and 10 * len(s & t) >= 7 * len(s | t)}
    assert {tuple(r) for r in queries.p6_found(spark, data).collect()} == want


def test_ids_of_the_table(spark, data, duck):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.TOKENIZERS + "/byte_bpe_50k.json")
    t.encode_special_tokens = True
    want = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in duck.sql("SELECT doc_id, text FROM documents").fetchall()}
    assert {r.doc_id: r.ids for r in queries.p8_ids(spark, data).collect()} == want


def test_decoded_texts_of_the_table(spark, data, duck):
    want = {i: x or "" for i, x in duck.sql("SELECT doc_id, text FROM documents").fetchall()}
    assert {r.doc_id: r.text for r in queries.p8_offsets(spark, data).collect()} == want


def test_combined_percentiles_are_within_their_bound(spark, data):
    rows = [(r.field, r.v) for r in queries.score_fields(spark, data).collect() if r.v is not None and r.v == r.v and r["sub"] is not None and r.month is not None]
    got = queries.p3_combined(spark, data).collect()
    assert len(got) == 3 * len({f for f, _ in rows}) > 0
    for r in got:
        v = sorted(x for f, x in rows if f == r.field)
        exact = v[max(1, math.ceil(r.q * len(v))) - 1]
        assert r.n == len(v) and abs(r.value - exact) <= abs(exact) * 2**-11


def test_redacted_texts_hold_no_found_value(spark, data):
    found = {}
    for r in queries.p10_found(spark, data).collect():
        found.setdefault(r.doc_id, []).append(r)
    texts = {r.doc_id: r.text for r in queries.p10_redacted(spark, data).collect()}
    assert found and all(f"[{r.kind.upper()}]" in texts[i] and (r.kind in ("name", "id_number") or r.value not in texts[i]) for i, rs in found.items() for r in rs)
