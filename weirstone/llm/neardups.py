"""Near-duplicate records: an exact similarity join of word sets by prefix filtering and pigeonring chains.

Equal sets are collapsed into one representative before anything is compared, and the links found between representatives are
expanded to records at the end.

Candidates. Words are put in one order, rare ones first. Two sets with a Jaccard similarity of t or more share a word among the first
|x| - ceil(t |x|) + 1 of the larger set x and the first |y| - ceil(2 t / (1 + t) |y|) + 1 of the smaller set y. Each representative
goes to a cell for each of its first words. With a vocabulary that doesn't grow, cells grow with the records and the work in them with their square; so an entry
carries hashes of the words that may be the next ones shared, and a cell of more than ``EXTEND`` entries is parted by a second word and, where that isn't enough,
by a third, in memory: sets that share s words have their k-th common word at place |x| - s + k - 1 or before (from 0). The entries that are shuffled
stay in proportion to the records. Only cells that ``BLOCK`` entries can't bound are split into blocks, each two of which meet in a cell of their own.

Pruning. t bounds the Hamming distance of two sets by H = (1 - t) / (1 + t) (|x| + |y|). A sketch holds the parities of the words
hashed to each of its bits and never lies further apart than the sets. Its four segments form a ring. A pair is admitted
only if some chain of three consecutive segments has each of its beginnings within its share of the budget: the first segment
within H / 4, the first two within 2 H / 4, all three within 3 H / 4. Each pair of distance H or less has such a chain, so no link is lost; a pair that has
none is dropped without its fourth segment or its words being looked at. In large cells the first half of the sketch
is held against the whole of H beforehand, for blocks of rows at once. Pairs that are left are checked on their whole sets.
The sketch grows with the sets (128 bits up to 96 words, four times as wide for each four times as many), so long texts are told apart as well.

Nothing is capped or sampled. The list of frequent words only sets the order; any order gives the same links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirstone.session import checkpointed, shuffles_dropped, written

#: Frequent words with a known place in the order. The list goes to every task, so this bounds it.
FREQUENT = 20_000
#: Entries of a word, from which on its cell is split; this bounds what a task holds of one cell.
BLOCK = 2_000_000
#: Entries from which on a cell is parted by a further shared word, and shared words at most.
EXTEND, DEPTH = 400, 3
#: Cell entries in a bucket, and in a partition of buckets.
BUCKET, PART = 130_000, 260_000
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a word's place in the order; frequent words have the top one set and the others grow with the frequency.
ORDER_BITS = 51
OFTEN = np.uint64(1 << (ORDER_BITS - 1))
#: Words up to which a sketch of 128 bits serves; each further class is four times as large.
CLASS_WORDS, CLASSES = 96, 8
TILE = 1 << 17
#: Entries up to which cells are compared together, and the further words that are looked at at once.
SMALL, ROOM = 400, 4_000_000
_SPACED = str.maketrans({chr(c): " " for c in range(128) if not chr(c).isalnum()})


def entry_type(kind: int) -> np.dtype:
    """A cell entry of a size class.

    cell: 32 bits of it within its bucket (two cells that agree there are compared as one, which only costs time); short: 64 bits of the set's key; place: that of
    the word in its set; side: 0 within a block, else which of two blocks.
    """
    count = "u1" if kind == 0 else "<u2" if kind < 5 else "<u4"
    return np.dtype([("cell", "<u4"), ("short", "<u8"), ("sketch", "<u8", 2 * 4**kind), ("size", count), ("place", count), ("side", "u1")])


class Coder(dict):
    """64-bit codes of words, kept while they are few."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        c = self[word] = xxhash.xxh3_64_intdigest(word) - 2**63
        return c


def _code(least: int):
    """Rows (key, short, id, author, sorted codes of the words); the key is a 96-bit digest of the set, short its first 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        import xxhash

        find, get = regex.compile(r"[\p{L}\p{M}\p{N}]+").findall, Coder().__getitem__
        for b in batches:
            at, keys, codes, ends = [], [], [], [0]
            for i, text in enumerate(b.column("text").to_pylist()):
                low = text.lower()
                words = set(low.translate(_SPACED).split() if low.isascii() else find(low))
                if len(words) >= least:
                    a = np.fromiter(map(get, words), np.int64, len(words))
                    a.sort()
                    at.append(i)
                    codes.append(a)
                    ends.append(ends[-1] + len(a))
                    keys.append(xxhash.xxh3_128_digest(a.tobytes())[:12])
            rows = pa.array(at, pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(codes) if codes else np.empty(0, np.int64)))
            short = pa.array([int.from_bytes(k[:8], "little", signed=True) for k in keys], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), short, b.column("id").take(rows), b.column("author").take(rows), lists], ["key", "short", "id", "author", "codes"])

    return run


def _mixed(a: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a * MIX
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _ceil(a, b):
    return -(-a // b)


def _ranges(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each of the numbers."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _further(sizes: np.ndarray, place: np.ndarray, num: int, den: int, depth: int) -> np.ndarray:
    """How many words after ``place`` may be the next shared one after ``depth`` of them."""
    return np.minimum(sizes - _ceil(num * sizes, den) + depth, sizes - 1) - place


def _class(size: np.ndarray) -> np.ndarray:
    """The size class of sets of so many words."""
    return np.searchsorted([CLASS_WORDS * 4**k for k in range(CLASSES - 1)], size)


class Order:
    """The places of words in the order, and the number of blocks of the most frequent ones."""

    def __init__(self, ranked: list[tuple[int, int]], block: int):
        """``ranked``: (code, records) of frequent words, the most frequent first."""
        codes = np.array([c for c, _ in ranked], np.int64)
        o = np.argsort(codes)
        self.codes, self.ranks = codes[o], (len(ranked) - np.arange(len(ranked)))[o].astype(np.uint64)
        n = np.array([n for _, n in ranked][::-1], np.int64)
        self.blocks = np.concatenate(([1], np.maximum(1, _ceil(n, block))))  # by rank

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        rare = codes.view(np.uint64) & (OFTEN - np.uint64(1))
        if not len(self.codes):
            return rare
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.ranks[at] | OFTEN, rare)

    def split(self, word: np.ndarray) -> np.ndarray:
        return self.blocks[np.where(word & OFTEN, word & (OFTEN - np.uint64(1)), 0).astype(np.int64)]


def _firsts(sizes: np.ndarray, codes: np.ndarray, order: Order, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(representative, place) of the words that give cells; all words in order, and where each representative's begin."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    ordered = np.sort((row.astype(np.uint64) << np.uint64(ORDER_BITS)) | order(codes)) & np.uint64((1 << ORDER_BITS) - 1)
    probe = sizes - _ceil(num * sizes, den) + 1
    return np.repeat(np.arange(len(sizes)), probe), _ranges(probe), ordered, np.cumsum(sizes) - sizes


def entries(short: np.ndarray, sizes: np.ndarray, codes: np.ndarray, order: Order, num: int, den: int, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cell entries of representatives in a size class, the hashes of their cells, and those of the words that may be shared next; similarity num / den."""
    n, bits = len(sizes), 128 * 4**kind
    rep, nth, ordered, start = _firsts(sizes, codes, order, num, den)
    bit = (_mixed(codes.view(np.uint64)) >> np.uint64(64 - 7 - 2 * kind)).astype(np.int64)
    sketch = np.packbits((np.bincount(np.repeat(np.arange(n), sizes) * bits + bit, minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits), axis=1).view("<u8")
    word = ordered[start[rep] + nth]
    g = order.split(word)
    own = (short[rep] % g.astype(np.uint64)).astype(np.int64)
    other = _ranges(g)
    rep, nth, word, own = (np.repeat(x, g) for x in (rep, nth, word, own))
    lo, hi = np.minimum(own, other), np.maximum(own, other)
    cell = _mixed(word ^ (_mixed((lo * 1_000_003 + hi).astype(np.uint64) + np.uint64(1 + kind))))
    e = np.empty(len(rep), entry_type(kind))
    e["cell"], e["short"] = cell >> np.uint64(32), short[rep]
    e["sketch"], e["size"], e["place"] = sketch[rep], sizes[rep], nth
    e["side"] = np.where(lo == hi, 0, np.where(own == lo, 1, 2))
    n_next = _further(sizes[rep], nth, num, den, DEPTH - 1)
    further = (_mixed(ordered) >> np.uint64(48)).astype("<u2")[np.repeat(start[rep] + nth + 1, n_next) + _ranges(n_next)]
    return e, cell & np.uint64(0xFFFFFFFF), further


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(short, sizes, codes) of representatives, 4,000 at a time."""
    for b in batches:
        for part in (b.slice(i, 4000) for i in range(0, b.num_rows, 4000)):
            lists = part.column("codes")
            yield part.column("short").to_numpy().view(np.uint64), np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten().to_numpy()


def _count(num: int, den: int, order: Order):
    """Entries by frequent word (its rank in the order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sizes, codes in _sets(batches):
            rep, nth, ordered, start = _firsts(sizes, codes, order, num, den)
            word = ordered[start[rep] + nth]
            rank, n = np.unique((word & (OFTEN - np.uint64(1)))[(word & OFTEN) > 0].astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(rank), pa.array(n)], ["rank", "n"])

    return run


def _emit(num: int, den: int, order: Order, buckets: int):
    """Entries by bucket. A set also goes to the next size class where a larger partner may be in it. Bucket numbers tell the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for short, sizes, codes in _sets(batches):
            first, last = _class(sizes), _class(den * sizes // num)
            start = np.cumsum(sizes) - sizes
            for kind in range(int(first.min()), int(last.max()) + 1):
                here = np.flatnonzero((first <= kind) & (last >= kind))
                step = max(1, (1 << 22) // (128 * 4**kind))  # sketches of a step take 4 MB
                for at in (here[i : i + step] for i in range(0, len(here), step)):
                    own = np.concatenate([codes[start[i] : start[i] + sizes[i]] for i in at.tolist()]) if len(at) < len(sizes) else codes
                    e, cell, further = entries(short[at], sizes[at], own, order, num, den, kind)
                    bucket = (cell % np.uint64(buckets)).astype(np.int64)
                    o = np.argsort(bucket, kind="stable")
                    n = _further(e["size"].astype(np.int64), e["place"].astype(np.int64), num, den, DEPTH - 1)
                    begin = (np.cumsum(n) - n)[o]
                    e, bucket, n = e[o], bucket[o], n[o]
                    further, ends = further[np.repeat(begin, n) + _ranges(n)], np.append(0, np.cumsum(n))
                    heads = np.flatnonzero(np.diff(bucket, prepend=-1))
                    parts = list(zip(heads.tolist(), np.append(heads[1:], len(e)).tolist()))
                    blocks, nexts = [e[i:j].tobytes() for i, j in parts], [further[ends[i] : ends[j]].tobytes() for i, j in parts]
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[heads] * CLASSES + kind), pa.array(blocks, pa.binary()), pa.array(nexts, pa.binary())], ["bucket", "block", "further"])

    return run


def ring(d: np.ndarray, most: np.ndarray, length: int = 3) -> np.ndarray:
    """Which rows of segment distances have a chain of ``length`` consecutive segments, each of whose beginnings keeps within its share of ``most``."""
    m, found = d.shape[1], np.zeros(len(most), bool)
    budget = [k * most.astype(np.int64) // m for k in range(length + 1)]
    for i in range(m):
        at, total = np.arange(len(most)), np.zeros(len(most), np.int64)
        for k in range(1, length + 1):
            total = total + d[at, (i + k - 1) % m]
            keep = total <= budget[k][at]
            at, total = at[keep], total[keep]
        found[at] = True
    return found


def _pruned(e: np.ndarray, y: np.ndarray, x: np.ndarray, py: np.ndarray, px: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of entries (y the smaller set) that pass the sizes, the places ``py`` and ``px``, the sides, and the ring."""
    sy, sx = e["size"][y].astype(np.int64), e["size"][x].astype(np.int64)
    a, b = e["side"][y], e["side"][x]
    # in the cell of the first words they share, what they share lies at or after their place in both
    shared = _ceil(num * (sx + sy), num + den)
    keep = (den * sy >= num * sx) & (py <= sy - shared) & (px <= sx - shared) & ((a == 0) | (a != b))
    y, x, sy, sx = y[keep], x[keep], sy[keep], sx[keep]
    s = e["sketch"]
    d = np.bitwise_count((s[y] ^ s[x]).view(np.uint32)).reshape(len(y), 4, s.shape[1] // 2).sum(axis=2, dtype=np.int64)
    keep = ring(d, (den - num) * (sx + sy) // (den + num))
    return y[keep], x[keep]


def _near(g: np.ndarray, place: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a large cell, sorted by size, whose sketch halves form a chain, looked for in blocks of rows at once: no half over the budget before it counts as within its share."""
    sizes = g["size"].astype(np.int64)
    middle = g["sketch"].shape[1] // 2
    halves = [np.ascontiguousarray(g["sketch"][:, k]) for k in (0, middle)]  # of wider sketches a part of each half
    room = [np.empty(max(TILE, len(g)), t) for t in (np.uint64, np.uint8, bool)]
    rows = np.flatnonzero(place <= sizes - _ceil(2 * num * sizes, num + den))
    # partners by the place of the word in them, which bounds their sizes from below
    columns = [(int(p), np.flatnonzero(place == p)) for p in np.unique(place)] if len(g) > 400 else [(0, np.arange(len(g)))]
    for p in np.unique(place[rows]).tolist():
        ys = rows[place[rows] == p]
        for q, xs in columns:
            width, ends = max(1, TILE // len(xs)), sizes[xs]
            for y in (ys[t : t + width] for t in range(0, len(ys), width)):
                sy = sizes[y]
                # the greatest size a partner may have, by the similarity and by the place of the word
                top = np.minimum(den * sy // num, (num + den) * (sy - p) // num - sy)
                least = max(int(sy[0]), _ceil((num + den) * q + num * int(sy[0]), den))
                begin, end = np.searchsorted(ends, [least, int(top[-1]) + 1])
                if begin >= end:
                    continue
                most = np.minimum((den - num) * (sy + top) // (den + num), 255).astype(np.uint8)
                x = xs[begin:end]
                cells = len(y) * len(x)
                differ, far, near = (a[:cells].reshape(len(y), len(x)) for a in room)
                np.bitwise_xor(halves[0][y][:, None], halves[0][x][None, :], out=differ)
                np.less_equal(np.bitwise_count(differ, out=far), most[:, None], out=near)
                at = np.flatnonzero(room[2][:cells])
                i = at // len(x)
                share = most[i] // 2
                i, j, one = y[i], x[at - i * len(x)], room[1][at]
                # the ring of the two halves: one of them keeps within half of the budget
                keep = (i < j) & ((one <= share) | (np.bitwise_count(halves[1][i] ^ halves[1][j]) <= share))
                yield i[keep], j[keep]


def candidates(e: np.ndarray, further: np.ndarray, num: int, den: int, extend: int = EXTEND) -> np.ndarray:
    """Distinct pairs of short keys, the lesser first, that survive the pruning in the cells of ``e``. ``further``: hashes of the words that may be shared next, entry by entry."""
    begin = _further(e["size"].astype(np.int64), e["place"].astype(np.int64), num, den, DEPTH - 1)
    begin = np.cumsum(begin) - begin
    o = np.lexsort((e["size"], e["cell"]))
    e = e[o]
    sizes, first = e["size"].astype(np.int64), e["place"].astype(np.int64)
    begin = begin[o] - first - 1  # where a set's words would begin
    half, most = np.ascontiguousarray(e["sketch"][:, 0]), np.minimum((den - num) * (sizes + den * sizes // num) // (den + num), 64).astype(np.uint8)
    own = sizes - _ceil(2 * num * sizes, num + den)  # the last place of a first shared word in the smaller of two sets
    found = []

    def compare(rows: np.ndarray, at: np.ndarray, cell: np.ndarray, depth: int, whole: bool) -> None:
        """Rows by cell and size; ``at``: the places of the last of their ``depth`` shared words; ``whole``: cells aren't parted."""
        head = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        count = np.diff(np.append(head, len(rows)))
        place = at - (depth - 1)
        # small cells together: each row with the one that stands 1, 2, ... rows after it
        left = np.where(np.repeat(count, count) <= SMALL, np.repeat(head + count, count) - np.arange(len(rows)) - 1, 0)
        i, step = np.flatnonzero((left > 0) & (place <= own[rows])), 0
        left, h, top = left[i], half[rows], most[rows[i]]
        while len(i):
            step += 1
            near = np.bitwise_count(h[i] ^ h[i + step]) <= top
            if near.any():
                j = i[near]
                found.append(_pruned(e, rows[j], rows[j + step], place[j], place[j + step], num, den))
            go = left > step
            if not go.all():
                i, left, top = i[go], left[go], top[go]
        for h0, c in zip(head[count > SMALL].tolist(), count[count > SMALL].tolist()):
            r, p = rows[h0 : h0 + c], place[h0 : h0 + c]
            if whole or c <= extend or depth == DEPTH:
                for i, j in _near(e[r], p, num, den):
                    if len(i):
                        found.append(_pruned(e, r[i], r[j], p[i], p[j], num, den))
                continue
            # sets that may share no more words than these are compared here, all others in the cells of the words after them
            few = _ceil(num * sizes[r], den) <= depth
            if few.any():
                compare(r[few], at[h0 : h0 + c][few], np.zeros(few.sum(), np.int64), depth, True)
            n = _further(sizes[r], at[h0 : h0 + c], num, den, depth)
            passes = int(_ceil(n.sum(), ROOM))
            for k in range(passes):
                x, y = np.repeat(r, n), np.repeat(at[h0 : h0 + c] + 1, n) + _ranges(n)
                word = further[begin[x] + y]
                if passes > 1:
                    mine = word % passes == k
                    x, y, word = x[mine], y[mine], word[mine]
                if len(x):
                    o = np.argsort(word, kind="stable")  # rows stay in the order of their sizes
                    compare(x[o], y[o], word[o], depth + 1, False)

    if len(e):
        compare(np.arange(len(e)), first, e["cell"], 1, False)
    if not found:
        return np.empty((0, 2), np.int64)
    y, x = (e["short"][np.concatenate(z)].view(np.int64) for z in zip(*found))
    lo, hi = np.minimum(y, x), np.maximum(y, x)
    o = np.lexsort((hi, lo))
    lo, hi = lo[o], hi[o]
    return np.stack([lo, hi], axis=1)[(lo != hi) & np.concatenate(([True], (np.diff(lo) != 0) | (np.diff(hi) != 0)))[: len(lo)]]


def _meet(num: int, den: int, extend: int):
    def run(t: pa.Table) -> pa.Table:
        kind = entry_type(t.column("bucket")[0].as_py() % CLASSES)
        e, further = (np.frombuffer(b"".join(t.column(k).to_pylist()), v) for k, v in (("block", kind), ("further", "<u2")))
        rows = candidates(e, further, num, den, extend)
        return pa.table({"sa": rows[:, 0], "sb": rows[:, 1]})

    return run


class NearDuplicates:
    """Links between the records of ``df`` whose word sets are similar by num / den or more.

    Words are runs of letters, marks and digits in lower case; sets under ``least`` words take no part. Rows with a null id, author or text
    don't either, rows of one id, author and text are one record, other columns aren't read, texts are taken whole, and empty tables give
    empty results.

    ``members``: rows (key, id, author), key being the class of equal word sets. ``links``: (ka, kb) between classes, ka < kb. ``pairs()``: (a, b),
    a < b, all pairs of ids of different authors.
    """

    def __init__(self, df: DataFrame, record_id: str, author: str, text: str, num: int = 7, den: int = 10, least: int = 20):
        rows = df.select(F.col(record_id).alias("id"), F.col(author).alias("author"), F.col(text).alias("text")).dropna()
        rows = rows.filter(F.length("text") >= 2 * least - 1)  # so many words and what parts them
        kinds = {k: rows.schema[k].dataType.simpleString() for k in ("id", "author")}
        with shuffles_dropped(df.sparkSession):
            # one pass over the texts; everything after reads this table
            coded = written(rows.mapInArrow(_code(least), f"key binary, short bigint, id {kinds['id']}, author {kinds['author']}, codes array<bigint>"))
            counted = coded.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
            top = counted.orderBy(F.desc("n"), "code").limit(FREQUENT).collect()  # bounded: FREQUENT rows of two numbers
            held = coded.agg(F.sum(F.size("codes"))).first()[0] or 0
            expected = held * (den - num) // den + held // least  # entries, about
            buckets, parts = max(64, expected // BUCKET), max(8, expected // PART)
            self.members = coded.select("key", "id", "author")
            reps = coded.select("short", "key", "codes").dropDuplicates(["short", "key"])
            order = Order([(r.code, r.n) for r in top], BLOCK)
            if top and top[0].n > BLOCK:  # a word has no more entries than records; those it has are counted where that isn't enough
                reps = written(reps)
                n = reps.mapInArrow(_count(num, den, order), "rank bigint, n bigint").groupBy("rank").agg(F.sum("n").alias("n")).collect()  # bounded as before
                n = {r["rank"]: r["n"] for r in n}
                order = Order([(r.code, n.get(len(top) - i, 0)) for i, r in enumerate(top)], BLOCK)
            cells = reps.mapInArrow(_emit(num, den, order, buckets), "bucket bigint, block binary, further binary")
            met = cells.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_meet(num, den, EXTEND), "sa bigint, sb bigint").distinct()
            self.candidates = met = checkpointed(met)  # those that are left, two numbers each
            # two sets that share a short key are told apart by the check
            sets = coded.join(met.selectExpr("explode(array(sa, sb)) AS short").distinct(), "short", "left_semi").select("short", "key", "codes").dropDuplicates(["short", "key"])
            side = lambda x: sets.select(F.col("short").alias(f"s{x}"), F.col("key").alias(f"k{x}"), F.col("codes").alias(f"c{x}"))
            both = F.size(F.array_intersect("ca", "cb"))
            similar = den * both >= num * (F.size("ca") + F.size("cb") - both)
            links = met.join(side("a"), "sa").join(side("b"), "sb").filter(similar)
            self.links = written(links.select(F.least("ka", "kb").alias("ka"), F.greatest("ka", "kb").alias("kb")))

    def pairs(self) -> DataFrame:
        """Authors are paired before their records, so one author's copies are never held against each other."""
        h = F.xxhash64("author")
        same = self.members.groupBy("key").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).filter("lo <> hi").select("key")
        touched = self.links.selectExpr("explode(array(ka, kb)) AS key").unionByName(same).distinct()
        # only classes with a partner go on
        with shuffles_dropped(self.members.sparkSession):
            m = written(self.members.join(touched, "key", "left_semi").distinct())
        by = m.select("key", "author").distinct()
        alone = by.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select(F.col("key").alias("ka"), F.col("key").alias("kb"))
        links = self.links.unionByName(alone)
        one = by.select(F.col("key").alias("ka"), F.col("author").alias("xa"))
        two = by.select(F.col("key").alias("kb"), F.col("author").alias("xb"))
        authors = links.join(one, "ka").join(two, "kb").filter((F.col("xa") != F.col("xb")) & ((F.col("ka") != F.col("kb")) | (F.col("xa") < F.col("xb"))))
        ids = authors.join(m.select(F.col("key").alias("ka"), F.col("author").alias("xa"), F.col("id").alias("ia")), ["ka", "xa"])
        ids = ids.join(m.select(F.col("key").alias("kb"), F.col("author").alias("xb"), F.col("id").alias("ib")), ["kb", "xb"])
        return ids.filter("ia <> ib").select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b")).distinct()
