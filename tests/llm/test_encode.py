import os

import pytest

from weirstone.llm import encode

PATH = os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "byte_bpe_50k.json")
TEXTS = [
    "Hello  world\n\n it's'll 12345 <|endoftext|> end ", "", " ", "\t\t x\r\n", "naïve café — “quotes”… भाषा 中文 한국어 עברית 👍🏽👩‍👩‍👧 ﷽   \x1c \x85  z",
    "Ⅷ ½ ² ꙮ \U0001fbf5 \U00010400", "a" * 30000, " " * 5000 + "b", "don't DON'T 'll 've", "�\x00\x01",
]


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_same_ids_and_round_trip(spark, tok):
    rows = [(i, t, 0) for i, t in enumerate([*TEXTS, None, None, TEXTS[0]])]
    df = spark.createDataFrame(rows, "k bigint, text string, ids int").repartition(3)
    out = encode.encode(df, "k", "text", PATH)
    got = {r.k: r.ids for r in out.collect()}
    assert got == {i: tok.encode(t or "", add_special_tokens=False).ids for i, t, _ in rows}
    back = {r.k: r.text for r in encode.decode(out, "k", "ids", PATH).collect()}
    assert back == {i: t or "" for i, t, _ in rows}
    assert encode.encode(df.limit(0), "k", "text", PATH).count() == 0


def test_offsets(tok):
    for t in TEXTS:
        e = tok.encode(t, add_special_tokens=False)
        start, end = encode.char_offsets(t, e.ids, PATH)
        assert list(zip(start.tolist(), end.tolist())) == [tuple(o) for o in e.offsets]


def test_offsets_of_rows(spark, tok):
    rows = [(i, t) for i, t in enumerate([*TEXTS, None, TEXTS[0]])]
    df = spark.createDataFrame(rows, "k bigint, text string").repartition(3)
    got = {r.k: (r.ids, list(zip(r.starts, r.ends))) for r in encode.encode_offsets(df, "k", "text", PATH).collect()}
    want = {i: tok.encode(t or "", add_special_tokens=False) for i, t in rows}
    assert got == {i: (e.ids, [tuple(o) for o in e.offsets]) for i, e in want.items()}
    assert encode.encode_offsets(df.limit(0), "k", "text", PATH).count() == 0


def test_offsets_and_round_trip_of_all_documents(spark, data, tok, duck):
    from weirstone.llm import queries

    docs = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    texts = dict(docs)
    rows = queries.QUERIES["p8_offsets"](spark, data).collect()
    assert len(rows) == len(docs)
    for r in rows:
        e = tok.encode(texts[r.doc_id] or "", add_special_tokens=False)
        assert r.text == (texts[r.doc_id] or "") and r.ids == e.ids and list(zip(r.starts, r.ends)) == [tuple(o) for o in e.offsets]


def test_cache_limit(monkeypatch, tok):
    monkeypatch.setattr(encode, "CACHE", 3)
    enc = encode.PieceEncoder(PATH)
    for _ in range(2):
        for t in TEXTS:
            assert enc.ids([t]) == [tok.encode(t, add_special_tokens=False).ids]


def test_another_tokenizer_file(spark):
    """Lower-casing BPE with word ends isn't split by the byte-level pattern: texts go through the library whole, and there is nothing to decode."""
    from tokenizers import Tokenizer

    path = os.path.join(os.path.dirname(PATH), "word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    texts = ["Hello  World's 123", "", None, "naïve café"]
    got = {r.k: r.ids for r in encode.encode(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), "k", "text", path).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    assert encode.byte_level(PATH) and not encode.byte_level(path)
    with pytest.raises(ValueError):
        encode.token_bytes(path)
