"""Evaluation passages inside a corpus, by suffix arrays over shards of it.

The held-out items are the query set; they are read in blocks of bounded size and go to every shard. A shard is a batch of whole
documents as numbers of the items' words. Its suffix array holds, in the order of whole suffixes (made by prefix doubling), each suffix that could match: one from
which on as many successive word pairs as the shortest match needs occur in some item. (A shared run shares its pairs, so no other suffix can.)
Every suffix of every item is binary-searched in it, which gives all places that share its first words, and each place is followed to the end of
what it shares: the longest verbatim match of each document and item, and where it stands. No document is moved.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Item words in a block. A block goes to the executors with the tasks, so its size is bounded by this, whatever the number of items.
BLOCK_WORDS = 1_000_000
_BREAK = "\x00"


def word_text(text: Column) -> Column:
    """The words of a text (runs of letters, marks and digits in lower case) with one blank between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " "))


def suffix_order(words: np.ndarray) -> np.ndarray:
    """The positions of ``words`` (numbers from 0 on, 0 at every break) in the order of their whole suffixes, by prefix doubling."""
    n, rank, k = len(words), words.astype(np.int64), 1
    stretch = int(np.diff(np.flatnonzero(np.concatenate(([0], words, [0])) == 0)).max()) if n else 0
    while k < stretch:  # a suffix ends at its break
        after = np.zeros(n, np.int64)
        after[:-k] = rank[k:] + 1
        _, rank = np.unique(rank * (int(after.max()) + 1) + after, return_inverse=True)
        k *= 2
    return np.argsort(rank, kind="stable")


class ItemSuffixes:
    """The suffixes of a block of items, ready to be searched in shards. Items: (id, words)."""

    def __init__(self, items: list[tuple[object, list[str]]], run: int):
        self.run = run
        words = sorted({w for _, ws in items for w in ws})
        self.number = {w: i + 1 for i, w in enumerate(words)} | {_BREAK: 0}
        self.size = len(words) + 1
        keys, ids, at, lens, pairs, single, whole = [], [], [], [], [], set(), []
        for item, (_, ws) in enumerate(items):
            n = [self.number[w] for w in ws]
            pairs += [a * self.size + b for a, b in zip(n, n[1:])]
            k = min(run, len(n))
            if k == 1:
                single.add(n[0])
            for j in range(len(n) - k + 1 if k == run else 1):
                keys.append(n[j : j + k] + [0] * (run - k))
                ids.append(item)
                at.append(len(whole) + j)
                lens.append(k)
            whole += [*n, -1]  # no word of a document
        self.names, self.whole = [i for i, _ in items], np.array(whole, np.int64)
        self.pairs = np.unique(np.array(pairs, np.int64)) if pairs else np.array([-1])
        self.single = np.array(sorted(single), np.int64)
        self.keys = np.array(keys, np.int64).reshape(-1, run)
        self.ids, self.at, self.lens = np.array(ids, np.int64), np.array(at, np.int64), np.array(lens, np.int64)
        self.least = int(self.lens.min()) if len(lens) else run

    @staticmethod
    def _packed(rows: np.ndarray) -> np.ndarray:
        """Rows of numbers as strings of bytes in the same order."""
        wide = np.ascontiguousarray(rows.astype(">u4"))
        return wide.view(f"S{4 * rows.shape[1]}").ravel() if len(rows) else np.empty(0, f"S{4 * rows.shape[1]}")

    def _stretches(self, arr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The positions whose suffixes could match, and all positions of these suffixes up to their ends, both rising."""
        n = len(arr)
        cand = np.flatnonzero((arr[:-1] > 0) & (arr[1:] > 0))
        code = arr[cand] * self.size + arr[cand + 1]
        pos = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        ok = np.zeros(n, bool)
        ok[cand[self.pairs[pos] == code]] = True
        # how many known pairs follow each position without a gap
        stop = np.flatnonzero(~ok)
        follow = stop[np.searchsorted(stop, np.arange(n))] - np.arange(n)
        starts = follow >= max(self.least - 1, 1)
        if len(self.single):
            starts |= np.isin(arr, self.single)
        starts = np.flatnonzero(starts)
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + follow[starts] + 1, -1)
        return starts, np.flatnonzero(np.cumsum(cover)[:n] > 0)

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(text's index, item's index, words of the longest match, its first word in the text) of every text and item that match."""
        words = f" {_BREAK} ".join(texts).split(" ")
        arr = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        doc = np.cumsum(arr == 0)
        arr[arr < 0] = 0
        starts, held = self._stretches(arr)
        if not len(starts):
            return []
        # the shard: the stretches one after the other, with a break after each
        gap = np.flatnonzero(np.diff(held) > 1)
        shard = np.insert(arr[held], gap + 1, 0)
        place = np.insert(held, gap + 1, -1)
        order = suffix_order(np.append(shard, 0))
        shard = np.concatenate((shard, np.zeros(self.run, np.int64)))
        order = order[order < len(place)]
        order = order[np.isin(place[order], starts)]
        rows = shard[order[:, None] + np.arange(self.run)]
        rows[np.cumsum(rows == 0, axis=1) > 0] = 0  # a suffix ends at its break
        sa = self._packed(rows)
        low = np.searchsorted(sa, self._packed(self.keys), "left")
        top = self.keys.copy()
        top[np.arange(self.run) >= self.lens[:, None]] = 2**32 - 1
        hits = np.searchsorted(sa, self._packed(top), "right") - low
        q = np.repeat(np.arange(len(self.keys)), hits)
        if not len(q):
            return []
        p = order[np.repeat(low - np.cumsum(hits) + hits, hits) + np.arange(len(q))]
        # each match followed to its end
        size, at, j = self.lens[q].copy(), np.arange(len(q)), self.at[q]
        while len(at):
            more = (p[at] + size[at] < len(shard)) & (shard[np.minimum(p[at] + size[at], len(shard) - 1)] == self.whole[np.minimum(j[at] + size[at], len(self.whole) - 1)])
            at = at[more]
            size[at] += 1
        item, p = self.ids[q], place[p]
        d = doc[p]
        o = np.lexsort((p, -size, item, d))
        o = o[np.concatenate(([True], (np.diff(d[o]) != 0) | (np.diff(item[o]) != 0)))]
        begin = np.append(-1, np.flatnonzero(np.diff(doc)))  # the place before each text's break or first word
        first = begin[d[o]] + np.where(d[o] == 0, 1, 2)
        return list(zip(d[o].tolist(), item[o].tolist(), size[o].tolist(), (p[o] - first).tolist()))


def _search(items: list[tuple[object, list[str]]], run: int, kind: pa.DataType):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes = ItemSuffixes(items, run)
        for b in batches:
            found = suffixes.search(b.column("words").to_pylist()) if b.num_rows else []
            docs = b.column("id").take(pa.array([a for a, *_ in found], pa.int64()))
            names = pa.array([suffixes.names[f[1]] for f in found], kind)
            yield pa.RecordBatch.from_arrays([docs, names, *(pa.array([f[k] for f in found], pa.int64()) for k in (2, 3))], ["id", "item", "words", "at"])

    return go


def _blocks(items: DataFrame) -> Iterator[list[tuple[object, list[str]]]]:
    block, size = [], 0
    for r in items.toLocalIterator():
        if words := r.w.split():
            block.append((r.i, words))
            size += len(words)
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, run: int = 13) -> DataFrame:
    """(``doc_id``, ``item_id``, n_words, at): documents that share a run of ``run`` words with an item, or hold all words of a shorter item as a run.

    n_words is the longest such run, at its first word's number (from 0) in the document, the first place of several. Ids may be of any type. Null and wordless
    texts match nothing; repeated rows of a document are found once. Empty tables give no rows. Documents are searched whole.
    """
    rows = docs.select(F.col(doc_id).alias("id"), word_text(F.col(text)).alias("words")).dropna().filter("words <> ''")
    asked = items.select(F.col(item_id).alias("i"), word_text(F.col(item_text)).alias("w")).dropna().distinct()
    schema = f"id {rows.schema['id'].dataType.simpleString()}, item {asked.schema['i'].dataType.simpleString()}, words bigint, at bigint"
    kind = to_arrow_type(asked.schema["i"].dataType)
    out = None
    for block in _blocks(asked):
        part = rows.mapInArrow(_search(block, run, kind), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    best = out.groupBy("id", "item").agg(F.max(F.struct("words", (-F.col("at")).alias("back"))).alias("b"))
    return best.select(F.col("id").alias(doc_id), F.col("item").alias(item_id), F.col("b.words").alias("n_words"), (-F.col("b.back")).alias("at"))


def without_leaks(docs: DataFrame, doc_id: str, leaks: DataFrame) -> DataFrame:
    """The documents that give no item away."""
    return docs.join(leaks.select(doc_id).distinct(), doc_id, "left_anti")
