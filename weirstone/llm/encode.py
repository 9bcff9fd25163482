"""Encoding of a corpus with a public byte-level BPE tokenizer, offsets and decoding.

Byte-level BPE splits a text by a fixed pattern and merges inside the pieces only, so a piece has the same ids wherever it stands. Each task
encodes each distinct piece once, with the tokenizers library, and assembles the texts from those. The
split by pattern is trusted only for characters whose Unicode class has long been fixed; a text with any other goes through the library as a whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pattern of byte-level BPE, a fixed value of the tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A character whose class may depend on the Unicode version, or that Python counts as space and others don't.
UNSURE = re.compile("[^\\x00-\\x1b\\x20-\\u024f\\u0300-\\u036f\\u0391-\\u03c9\\u0400-\\u045f\\u05d0-\\u05ea\\u0620-\\u064a\\u0900-\\u0970\\u2010-\\u2027\\u2030-\\u205e\\u200d\\u20ac\\ufe0f\\uff01-\\uff5e\\U0001f300-\\U0001faff]")
#: Pieces kept by a task; beyond it the cache starts anew.
CACHE = 400_000


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@lru_cache(maxsize=4)
def byte_level(path: str) -> bool:
    """Whether the file is of a plain byte-level BPE: no normalizer, the fixed pattern, no prefix, and no tokens with options of their own.

    Only then do pieces of the pattern have the same ids wherever they stand.
    """
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    before = t.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    model = t["model"]
    return bool(
        plain and t.get("normalizer") is None and t.get("post_processor") is None and t.get("truncation") is None and t.get("padding") is None
        and model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        and all(x.get("special") for x in t.get("added_tokens") or [])
    )


class PieceEncoder:
    """Ids of texts, with a cache of pieces. A tokenizer that isn't plain byte-level BPE takes each text as a whole."""

    def __init__(self, path: str):
        import regex

        self.tok, self.split, self.cache, self.pieces = _tokenizer(path), regex.compile(PATTERN).findall, {}, byte_level(path)

    def _learn(self, pieces) -> None:
        new = [p for p in set(pieces) if p not in self.cache]
        for p, e in zip(new, self.tok.encode_batch(new, add_special_tokens=False)):
            self.cache[p] = e.ids

    def ids(self, texts: list[str | None]) -> list[list[int]]:
        if len(self.cache) > CACHE:
            self.cache.clear()
        out: list = [[]] * len(texts)
        plain, whole = [], []
        for i, t in enumerate(texts):
            if t:
                (plain if self.pieces and not UNSURE.search(t) else whole).append(i)
        split = [self.split(texts[i]) for i in plain]
        self._learn(chain.from_iterable(split))
        get = self.cache.__getitem__
        for i, pieces in zip(plain, split):
            out[i] = list(chain.from_iterable(map(get, pieces)))
        for i, e in zip(whole, self.tok.encode_batch([texts[i] for i in whole], add_special_tokens=False)):
            out[i] = e.ids
        return out


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = PieceEncoder(path)
        for b in batches:
            for part in (b.slice(i, 1000) for i in range(0, b.num_rows, 1000)):
                ids = enc.ids(part.column("text").to_pylist())
                ends = np.cumsum([0, *map(len, ids)])
                flat = np.fromiter(chain.from_iterable(ids), np.int32, ends[-1])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists], ["id", "ids"])

    return run


def encode(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(``key``, ids) of every row: the ids of ``text`` by the tokenizer file at ``path``, without special tokens.

    Any file of the tokenizers library will do. An empty list for an empty and for a null text; strings that look like special tokens are ordinary text; texts are encoded whole. Rows
    are neither moved nor merged: repeated rows stay. An empty table gives no rows.
    """
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    out = rows.mapInArrow(_encode(path), f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")
    return out.select(F.col("id").alias(key), "ids")


def _byte_table() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, reversed."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in printable}
    rest = (b for b in range(256) if b not in set(printable))
    return table | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of every id of a plain byte-level BPE; other files are an error, since their tokens don't give the text back."""
    if not byte_level(path):
        raise ValueError(f"{path} is no plain byte-level BPE: its ids have no bytes to decode or to take offsets from")
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    table, out = _byte_table(), [b""] * (max(vocab.values()) + 1)
    for t, i in vocab.items():
        out[i] = bytes(table[c] for c in t) if all(c in table for c in t) else t.encode()
    return out


def decode_ids(ids: list[int], path: str) -> str:
    """The text of the ids. Characters split between tokens are put together again; bytes that form none become U+FFFD."""
    t = token_bytes(path)
    return b"".join(t[i] for i in ids).decode("utf-8", errors="replace")


def char_offsets(text: str, ids: list[int], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each token in characters of the text. Tokens that share a character all cover it."""
    raw = np.frombuffer(text.encode(), np.uint8)
    lead = np.cumsum((raw & 0xC0) != 0x80)  # 1-based number of the character each byte belongs to
    t = token_bytes(path)
    ends = np.cumsum([len(t[i]) for i in ids], dtype=np.int64)
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    return lead[starts] - 1, lead[ends - 1]


def _tokens(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = PieceEncoder(path)
        for b in batches:
            for part in (b.slice(i, 1000) for i in range(0, b.num_rows, 1000)):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = enc.ids(texts)
                spans = [char_offsets(t, x, path) for t, x in zip(texts, ids)]
                ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                lists = lambda values, ends=ends: pa.ListArray.from_arrays(ends, pa.array(values.astype(np.int32)))
                flat = np.fromiter(chain.from_iterable(ids), np.int32, ends[-1].as_py())
                start, end = (np.concatenate([s[k] for s in spans] or [flat]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists(flat), lists(start), lists(end)], ["id", "ids", "starts", "ends"])

    return run


def encode_offsets(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(``key``, ids, starts, ends): the ids of ``encode()`` with the first character of each token and the one after its last, as ``char_offsets`` gives them. Empty lists for empty and null texts."""
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    out = rows.mapInArrow(_tokens(path), f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, starts array<int>, ends array<int>")
    return out.select(F.col("id").alias(key), "ids", "starts", "ends")


def decode(df: DataFrame, key: str, ids: str, path: str) -> DataFrame:
    """(``key``, text) of rows of ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [decode_ids(x or [], path) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    rows = df.select(F.col(key).alias("id"), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string").select(F.col("id").alias(key), "text")
