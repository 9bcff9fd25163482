"""Counting similar word sets inside groups: an exact similarity join in memory, part by part.

Words are put in one order, rare ones first. Two sets of more than num / den similarity share a word among the first |x| - floor(num |x| / den) of each, so
a group is parted by words: a part gets all sets that have one of its words among their first ones, whole, and compares those that meet in a cell of such a
word. A cell of more than ``EXTEND`` sets is parted by a second shared word, which stands one place further at most. Sketches (the parities of the words hashed to each of
128 bits, which never lie further apart than the sets) drop most pairs of a cell; those left are checked on their whole sets. A pair counts in the part
that has the first word it shares, so none counts twice. Nothing is capped or sampled; words are known by 63 bits of their hash, or by their place among the frequent ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirstone.session import written

#: Frequent words with a known place in the order; it changes no result. The list goes to every task, so this bounds it.
FREQUENT = 20_000
#: Sets of a group from which on it has a further part.
PART = 150_000
#: Sets of a cell from which on it is parted by a second word, sets up to which cells are compared together, and pairs looked at at once.
EXTEND, SMALL, TILE = 1_500, 48, 1 << 16
OFTEN = np.uint64(1 << 63)


def _mixed(a: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _ranges(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each of the numbers."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _emit(frequent: list[int], num: int, den: int):
    """(g, b, codes): each set with the words in order, for each part that has one of its first words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.array(frequent, np.int64)
        o = np.argsort(known)
        known, place = known[o], (len(known) - o).astype(np.uint64)
        for batch in batches:
            lists = batch.column("ws")
            sizes, words = np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten().to_numpy()
            codes = words.view(np.uint64) >> np.uint64(1)
            if len(known):
                at = np.minimum(np.searchsorted(known, words), len(known) - 1)
                codes = np.where(known[at] == words, OFTEN | place[at], codes)
            row = np.repeat(np.arange(len(sizes)), sizes)
            codes = codes[np.lexsort((codes, row))]
            start = np.cumsum(sizes) - sizes
            first = sizes - num * sizes // den
            rep = np.repeat(np.arange(len(sizes)), first)
            parts = batch.column("parts").to_numpy()
            b = (_mixed(codes[start[rep] + _ranges(first)]) % parts[rep].astype(np.uint64)).astype(np.int64)
            to = np.unique(rep * (int(parts.max(initial=1)) + 1) + b)
            rep, b = np.divmod(to, int(parts.max(initial=1)) + 1)
            data, begin = codes.tobytes(), start * 8
            sets = [data[begin[i] : begin[i] + 8 * sizes[i]] for i in rep.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("g").take(pa.array(rep)), pa.array(b), pa.array(parts[rep]), pa.array(sets, pa.binary())], ["g", "b", "parts", "codes"])

    return run


def similar_pairs(sets: list[bytes], m: np.ndarray, part: int = 0, parts: int = 1, num: int = 3, den: int = 5) -> int:
    """Pairs of records whose sets are similar by more than num / den and whose first shared word belongs to ``part``; ``m``: the records of each set."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets)) // 8
    o = np.argsort(sizes, kind="stable")
    sizes, m = sizes[o], m[o]
    known, words = np.unique(np.frombuffer(b"".join([sets[i] for i in o.tolist()]), np.uint64), return_inverse=True)
    mine = (_mixed(known) % np.uint64(parts)).astype(np.int64) == part
    start = np.cumsum(sizes) - sizes
    total = int((m * (m - 1) // 2)[mine[words[start]]].sum())  # records of one set
    row = np.repeat(np.arange(len(sizes)), sizes)
    bit = _mixed(known) >> np.uint64(57)
    parity = np.bincount(row * 128 + bit[words].astype(np.int64), minlength=len(sizes) * 128) & 1
    sketch = np.packbits(parity.astype(np.uint8).reshape(-1, 128), axis=1).view("<u8")
    half, rest = np.ascontiguousarray(sketch[:, 0]), np.ascontiguousarray(sketch[:, 1])
    # sets lie less than (den - num) / (den + num) of their sizes apart; beyond 128 bits the sizes don't matter
    most = 128 * (num + den) + 1
    reach = np.minimum((den - num) * sizes, most).astype(np.int32)
    far = den * sizes // num  # the greatest partner
    found: list[np.ndarray] = []

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        d = np.bitwise_count(half[i] ^ half[j]).astype(np.int32) + np.bitwise_count(rest[i] ^ rest[j])
        ok = (d * (num + den) < reach[i] + reach[j]) & (sizes[j] <= far[i]) & (i != j)
        if ok.any():
            found.append(i[ok] * len(sizes) + j[ok])

    def compare(rows: np.ndarray, head: np.ndarray, count: np.ndarray) -> None:
        """Rows by cell and, in it, by size."""
        left = np.where(np.repeat(count, count) <= SMALL, np.repeat(head + count, count) - np.arange(len(rows)) - 1, 0)
        i, step = np.flatnonzero(left > 0), 0
        left = left[i]
        while len(i):
            step += 1
            a, b = rows[i], rows[i + step]
            near = np.bitwise_count(half[a] ^ half[b]).astype(np.int32) * (num + den) < reach[a] + reach[b]
            keep(a[near], b[near])
            go = left > step
            i, left = i[go], left[go]
        for h, c in zip(head[count > SMALL].tolist(), count[count > SMALL].tolist()):
            r = rows[h : h + c]
            s, q, x = sizes[r], reach[r], half[r]
            t = 0
            while t < c:
                to = min(c, t + max(1, TILE // (c - t)))
                end = int(np.searchsorted(s, far[r[to - 1]], "right"))
                d = np.bitwise_count(x[t:to, None] ^ x[None, t:end]).astype(np.int32)
                d *= num + den
                y, z = np.nonzero(d < q[t:to, None] + q[None, t:end])
                up = z > y
                keep(r[t + y[up]], r[t + z[up]])
                t = to

    first = sizes - num * sizes // den
    first[sizes < 2] = 0  # a set of one word is similar to none but its equals
    entry = np.repeat(np.arange(len(sizes)), first)
    place = _ranges(first)
    word = words[start[entry] + place]
    own = mine[word]
    entry, place, word = entry[own], place[own], word[own]
    o = np.argsort(word, kind="stable")  # rows stay in the order of their sizes
    entry, place, word = entry[o], place[o], word[o]

    def cells(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        head = np.flatnonzero(np.diff(key, prepend=-1))
        return head, np.diff(np.append(head, len(key)))

    head, count = cells(word)
    small = np.repeat(count <= EXTEND, count)
    compare(entry[small], *cells(word[small]))
    for h, c in zip(head[count > EXTEND].tolist(), count[count > EXTEND].tolist()):
        # sets that are similar share a second word: 2 words or more are over 0 and under all that two sets of 2 words or more must share
        r, p = entry[h : h + c], place[h : h + c]
        n = np.minimum(first[r] + 1, sizes[r]) - p - 1
        rr = np.repeat(r, n)
        second = words[start[rr] + np.repeat(p + 1, n) + _ranges(n)]
        o = np.argsort(second, kind="stable")
        compare(rr[o], *cells(second[o]))
        if sum(map(len, found)) > 4_000_000:
            found[:] = [np.unique(np.concatenate(found))]
    pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    held = row * len(known) + words
    for at in range(0, len(pairs), 50_000):
        i, j = np.divmod(pairs[at : at + 50_000], len(sizes))
        n = sizes[i]
        pair, w = np.repeat(np.arange(len(i)), n), words[np.repeat(start[i], n) + _ranges(n)]
        asked = j[pair] * len(known) + w
        hit = held[np.minimum(np.searchsorted(held, asked), len(held) - 1)] == asked
        pair, w = pair[hit], w[hit]
        both = np.bincount(pair, minlength=len(i))
        lead = np.full(len(i), len(known))
        np.minimum.at(lead, pair, w)
        ok = (den * both > num * (sizes[i] + sizes[j] - both)) & np.append(mine, False)[lead]
        total += int((m[i] * m[j])[ok].sum())
    return total


def _count(num: int, den: int):
    def run(t: pa.Table) -> pa.Table:
        n = similar_pairs(t.column("codes").to_pylist(), t.column("m").to_numpy(), t.column("b")[0].as_py(), t.column("parts")[0].as_py(), num, den)
        return pa.table({"g": t.column("g").slice(0, 1), "n_pairs": pa.array([n], pa.int64())})

    return run


def counted_pairs(rows: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """(g, n_pairs) of rows (g, ws), ws being hashes of words; ``sizes``: (g, n). For num / den of 1/2 or more."""
    if 2 * num < den:
        raise ValueError("sets that are less alike may share one word only")
    top = rows.select(F.explode("ws").alias("w")).groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(FREQUENT).select("w").collect()  # bounded
    kind = rows.schema["g"].dataType.simpleString()
    parted = rows.join(sizes.select("g", F.ceil(F.col("n") / PART).alias("parts")), "g").select("g", "parts", "ws")
    cells = parted.mapInArrow(_emit([r.w for r in top], num, den), f"g {kind}, b bigint, parts bigint, codes binary")
    sets = cells.repartition("g", "b").groupBy("g", "b", "parts", "codes").agg(F.count("*").alias("m"))
    found = written(sets.groupBy("g", "b").applyInArrow(_count(num, den), f"g {kind}, n_pairs bigint"))
    return found.groupBy("g").agg(F.sum("n_pairs").alias("n_pairs"))
