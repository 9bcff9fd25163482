"""Personal names by a fitted skip-chain conditional random field.

Nodes are the tokens of every run of capitalised words in a text (a lower-case word can't be part of a name, so its label is known); labels are O, B (a name begins) and
I (it goes on). A token's potential adds the weights of its features: the word, its shape, its beginning and end, the words on both sides and what parts them. Chain
edges join neighbours in a run, by what parts them. Skip edges join tokens of a text that are the same word, whatever their distance, and draw them to the same answer to whether they belong
to a name, so that a name without any cue is found if it stands with one elsewhere.

Fitting. No table holds labels, so the weights are fitted to the texts themselves, all of them, labelled by public patterns: a title, an introduction or a closing
before two or three capitalised words speaks for a name, and words that the texts mostly write in lower case are none. The fitted field then labels the rest of the
texts where it is sure, and is fitted again (``ROUNDS`` times): it learns given names, endings of surnames and further contexts from the texts. The strength of skip
edges is the agreement of repeated words in the labelled texts. There is no list of names. Each step takes the gradient of the likelihood over all labelled runs; a
:class:`Batch` holds the runs of some texts and a :class:`Part` those labelled, and their gradients and counts add up, wherever they are.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Rounds of labelling, and steps of fitting before the first and after each.
ROUNDS, STEPS, MORE = 4, 80, 30
#: Texts that must hold a word in lower case, or alone, before that speaks against it.
LEAST = 3
BITS, SWEEPS = 18, 4
#: Characters of texts whose words are counted together.
ONCE = 4_000_000
#: Characters of a word, or of a piece between white space, whose analysis is kept for the next.
KEPT = 40
SPACE, COMMA, STOP = range(3)
O, B, I = range(3)  # noqa: E741
#: Features of a token by what they are of: the word, what stands before, what stands after, the rest; those of a word with hyphens come last.
GROUPS = (0, 5, 7, 9, 19)

_TOKEN = r"\p{Lu}[\p{L}\p{M}]*+(?:['’]\p{L}[\p{L}\p{M}]*+)?+(?:-\p{Lu}[\p{L}\p{M}]*+)*+"
_LINK = r"(?: |, |(?<=(?<![\p{L}\p{M}])[\p{L}\p{M}]{1,4})\. ?)"
RUN = regex.compile(rf"(?<![\w@/.'’\-#]){_TOKEN}(?:{_LINK}{_TOKEN})+(?![\w@/])")
TOKEN = regex.compile(_TOKEN)
_BESIDE = regex.compile(r"([^\w'’]*)([\w'’]+)(?:[^\w'’]+([\w'’]+))?")

_WORD = regex.compile(r"(?<![\w'’@/.-])[\p{L}\p{M}]+(?![\w@/]|\.\w)")

#: Public cues for labelling: titles; introductions; closings.
TITLES = "mr mrs ms miss mx dr prof herr frau señor señora sr sra mme shri smt".split()
_SEED = regex.compile(
    rf"(?:\b(?i:{'|'.join(TITLES)})\.? |\b(?i:name is|name's|me llamo|mi nombre es|ich hei(?:ß|ss)e|je m['’]appelle|mi chiamo|mera naam) |\b(?i:signed|sincerely|faithfully|regards),\s|\b(?i:thanks|cheers),\n)"
    rf"({_TOKEN}(?:(?: | ?\. ?){_TOKEN}){{1,2}}|{_TOKEN}, {_TOKEN})"
)


def _feature(x: str) -> int:
    return 1 + (zlib.crc32(x.encode()) & ((1 << BITS) - 2))


@lru_cache(maxsize=1 << 16)
def _of_word(w: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """The features of a word, and those of its parts by hyphens."""
    f = [f"w{w}", f"e{w[-3:]}", f"E{w[-4:]}", f"b{w[:3]}", f"c{w[:4]}"]
    parts = [f"e{x[-3:]}" for x in w.split("-")[:-1]] + [f"b{x[:3]}" for x in w.split("-")[1:]] if "-" in w else []
    return tuple(map(_feature, f)), tuple(map(_feature, parts))


@lru_cache(maxsize=1 << 16)
def _of_place(shape: str, gap: str, ngap: str, begins: bool, ends: bool, rate: int, alone: int) -> tuple[int, ...]:
    """The features of a token that aren't of words."""
    f = [f"s{shape}", f"g{gap}", f"h{ngap}", f"k{begins}{ends}{shape}", f"r{rate}", f"R{rate}{shape}{begins}", f"a{alone}", f"A{alone}{shape}{ends}{ngap[:1]}", f"S{shape}{gap[:1]}{ngap[:1]}", "bias"]
    return tuple(map(_feature, f))


class Order:
    """Tokens of runs by their place in them, longer runs first: those at place k are ``parts[k]``, and their runs are the first of those at place k - 1."""

    def __init__(self, gap: np.ndarray):
        first = np.flatnonzero(gap < 0)
        size = np.diff(np.append(first, len(gap)))
        longest = np.argsort(-size, kind="stable")
        many = np.searchsorted(-size[longest], -np.arange(size.max(initial=0)), side="left")  # runs of more than k tokens
        ends = np.cumsum(many)
        self.parts = [slice(e - m, e) for e, m in zip(ends.tolist(), many.tolist())]
        self.run = np.concatenate([longest[:m] for m in many]) if len(many) else longest
        self.at = first[self.run] + np.repeat(np.arange(len(many)), many)
        self.gap = np.maximum(gap[self.at], 0)
        self.later = int(many[0]) if len(many) else 0  # from here on tokens have one before them,
        self.before = np.arange(self.later, len(gap)) - np.repeat(many[:-1], many[1:])  # and that is where


@lru_cache(maxsize=1)
def _cues():
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in [f"{t}{x} " for t in TITLES for x in ("", ".")] + ["name is ", "name's ", "me llamo ", "mi nombre es ", "ich hei", "je m", "mi chiamo ", "mera naam ", "signed,", "sincerely,", "faithfully,", "regards,", "thanks,", "cheers,"]:
        a.add_word(w, len(w) - 1)
    a.make_automaton()
    return a


def _cued(text: str) -> bool:
    """Whether ``_SEED`` may match: one of its cues stands in the text where a word may begin. The letters besides are those that other cases of a to z can be."""
    low = text.lower()
    return any(end == n or not low[end - n - 1].isalnum() for end, n in _cues().iter(low)) or any(x in text for x in "ſ\u212aİı")


class Runs:
    """The runs of some texts as flat arrays. ``text``, ``start``, ``end``, ``run`` by token; ``gap``: what parts a token from the one before in its run (-1 for the first)."""

    def __init__(self, texts: list[str | None], rates: dict[str, tuple[int, int]] | None = None):
        """``rates``: how often words stand in lower case, and outside of runs."""
        self.rates, self.links, self.placed = rates or {}, None, None
        self.text, self.start, self.end, self.run, self.gap, self.words, self.features, self.doc_runs = [], [], [], [], [], [], [], []
        n = 0
        for i, t in enumerate(texts):
            if not t:
                continue
            for m in RUN.finditer(t):
                self._add(t, i, n, m.start(), m.end())
                n += 1
        self.count = n
        for k in ("text", "start", "end", "run", "gap"):
            setattr(self, k, np.array(getattr(self, k), np.int64))
        size = np.fromiter(map(len, self.features), np.int64, len(self.features))
        width = int(size.max(initial=1))
        self.index = np.zeros((len(size), width), np.int32)  # feature 0 is kept at weight 0
        self.index[np.arange(width) < size[:, None]] = np.fromiter(chain.from_iterable(self.features), np.int32, size.sum())

    def _add(self, t: str, i: int, n: int, begin: int, end: int) -> None:
        spans = [(m.start(), m.end()) for m in TOKEN.finditer(t, begin, end)]
        left, right = _BESIDE.match(t[max(0, begin - 40) : begin][::-1]), _BESIDE.match(t[end : end + 40])
        l1 = l2 = r1 = r2 = ""
        lgap = rgap = "#"
        if left:
            lgap, l1, l2 = left[1][::-1], left[2][::-1], (left[3] or "")[::-1]
        if right:
            rgap, r1, r2 = right[1], right[2], right[3] or ""
        l1, l2, r1, r2 = l1.lower(), l2.lower(), r1.lower(), r2.lower()
        words = [t[a:b].lower() for a, b in spans]
        for k, (a, b) in enumerate(spans):
            w, raw = words[k], t[a:b]
            p1, gap, p2 = (l1, lgap, l2) if k == 0 else (words[k - 1], t[spans[k - 1][1] : a], words[k - 2] if k > 1 else l1)
            n1, ngap, n2 = (r1, rgap, r2) if k == len(spans) - 1 else (words[k + 1], t[b : spans[k + 1][0]], words[k + 2] if k + 2 < len(spans) else r1)
            shape = ("." if t[b : b + 1] == "." else "1") if len(raw) == 1 else "A" if raw.isupper() else "x" if raw[1:].islower() else "m"
            gap, ngap = gap[:3], ngap[:3]
            rate, alone = self.rates.get(w, (0, 0))
            of_word, of_parts = (_of_word if len(w) <= KEPT else _of_word.__wrapped__)(w)
            self.features.append((*of_word, *map(_feature, (f"p{p1}", f"P{p2}|{p1}{gap}", f"n{n1}", f"N{n1}|{n2}")), *_of_place(shape, gap, ngap, k == 0, k == len(spans) - 1, rate, alone), *of_parts))
            self.words.append(w)
            self.text.append(i)
            self.start.append(a)
            self.end.append(b)
            self.run.append(n)
            self.gap.append(-1 if k == 0 else COMMA if gap.startswith(",") else STOP if gap.startswith(".") else SPACE)

    def order(self) -> Order:
        if self.placed is None:
            self.placed = Order(self.gap)
        return self.placed

    def edges(self) -> np.ndarray:
        """Skip edges along the repetitions of a word in a text, in order: n - 1 for n of them."""
        if self.links is None:
            seen, e = {}, []
            for k, (i, w) in enumerate(zip(self.text.tolist(), self.words)):
                if len(w) > 1:
                    if (i, w) in seen:
                        e.append((seen[i, w], k))
                    seen[i, w] = k
            self.links = np.array(e, np.int64).reshape(-1, 2)
        return self.links


class Batch:
    """The runs of some texts without the texts, and their labels by public patterns: what fitting needs of them."""

    def __init__(self, index: np.ndarray, gap: np.ndarray, links: np.ndarray, given: np.ndarray):
        self.index, self.gap, self.links, self.given, self.count, self.placed = index, gap, links, given, int((gap < 0).sum()), None

    order = Runs.order

    def edges(self) -> np.ndarray:
        return self.links

    def packed(self) -> bytes:
        return pickle.dumps((self.index, self.gap.astype(np.int8), self.links.astype(np.int32), self.given.astype(np.int8)))

    @staticmethod
    def unpacked(x: bytes) -> Batch:
        index, gap, links, given = pickle.loads(x)
        return Batch(index, gap.astype(np.int64), links.astype(np.int64), given.astype(np.int64))

    @staticmethod
    def joined(some: list[Batch]) -> Batch:
        """Several batches as one; features are padded by 0."""
        width, at = max(b.index.shape[1] for b in some), np.cumsum([0, *(len(b.gap) for b in some)])
        index = np.concatenate([np.pad(b.index, ((0, 0), (0, width - b.index.shape[1]))) for b in some])
        return Batch(index, np.concatenate([b.gap for b in some]), np.concatenate([b.links + k for b, k in zip(some, at)]), np.concatenate([b.given for b in some]))

    def labels(self, field: Field | None) -> np.ndarray:
        """Labels by public patterns, and with ``field`` those of runs of whose every token it is sure; -1 for unknown."""
        if field is None or not self.count:
            return self.given
        b = field.beliefs(self)
        sure = (b.max(axis=1) > np.log(0.85)) & ((b.argmax(axis=1) > O) | (b[:, O] > np.log(0.95)))
        first = np.flatnonzero(self.gap < 0)
        whole = np.logical_and.reduceat(sure, first)[np.cumsum(self.gap < 0) - 1]  # runs are labelled as a whole
        return np.where(self.given >= 0, self.given, np.where(whole, b.argmax(axis=1), -1))

    def agreement(self, labels: np.ndarray) -> tuple[int, int]:
        """How many skip edges join words that are both in names or both in none, by the labels, and how many others with labels."""
        a, b = labels[self.links[:, 0]], labels[self.links[:, 1]]
        both = (a >= 0) & (b >= 0)
        same = int(((a[both] > 0) == (b[both] > 0)).sum())
        return same, int(both.sum()) - same


def _distinct(index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of ``index``, and for each of its rows which one it is."""
    key = np.zeros(len(index), np.uint64)
    for k in range(index.shape[1]):
        key = key * np.uint64(0x9E3779B97F4A7C15) + index[:, k].astype(np.uint64)
    _, first, rows = np.unique(key, return_index=True, return_inverse=True)
    table = index[first]
    if not np.array_equal(table[rows], index):  # two rows with one key
        table, rows = np.unique(index, axis=0, return_inverse=True)
    return rows.reshape(-1).astype(np.int32), table


class Part:
    """The labelled runs of a batch. ``named``, ``others``: how many runs have a name by their labels, and how many none.

    Tokens share most of their features with others, so each group of ``GROUPS`` is held as a table of its distinct rows, and the row of each token: sums over features and over tokens
    are taken row by row. ``bytes``: what the features take, one by one.
    """

    def __init__(self, batch: Batch, labels: np.ndarray):
        first = np.flatnonzero(batch.gap < 0)
        keep = np.logical_or.reduceat(labels >= 0, first)[np.cumsum(batch.gap < 0) - 1] if len(first) else np.zeros(0, bool)
        index = batch.index[keep]
        ends = [*GROUPS[1:], index.shape[1]]
        groups = [index[:, a:b] for a, b in zip(GROUPS, ends) if b > a]
        self.bytes = index.nbytes
        self._set(batch.gap[keep], labels[keep], [_distinct(g) for g in groups])

    def _set(self, gap: np.ndarray, y: np.ndarray, groups: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.gap, self.y = gap, y
        self.used, at = np.unique(np.concatenate([t.ravel() for _, t in groups]) if groups else np.zeros(0, np.int32), return_inverse=True)
        cut = np.cumsum([t.size for _, t in groups])[:-1]
        self.groups = [(rows.astype(np.int64), x.reshape(t.shape)) for (rows, t), x in zip(groups, np.split(at, cut))]
        self._count()

    def _count(self) -> None:
        first = np.flatnonzero(self.gap < 0)
        self.run, self.count, self.placed = np.cumsum(self.gap < 0) - 1, len(first), None
        self.has = np.logical_or.reduceat(self.y > 0, first) if len(first) else np.zeros(0, bool)
        self.named, self.others = int(self.has.sum()), int((~self.has).sum())
        # runs of which every label is known need no sums over labels; the others do
        known = np.logical_and.reduceat(self.y >= 0, first)[self.run] if len(first) else np.zeros(0, bool)
        self.open = np.flatnonzero(~known)
        self.rest = Batch(np.zeros((0, 1), np.int32), self.gap[self.open], np.zeros((0, 2), np.int64), self.y[self.open])
        self.clamp = np.where((self.rest.given >= 0)[:, None] & (np.arange(3) != self.rest.given[:, None]), -40.0, 0.0)
        self.own = np.where(known[:, None], np.arange(3) == self.y[:, None], 0.0)
        self.pair = np.flatnonzero(known & (self.gap >= 0))
        self.step = (self.gap[self.pair] * 3 + self.y[self.pair - 1]) * 3 + self.y[self.pair]

    order = Runs.order

    def packed(self) -> bytes:
        groups = [(rows.astype(np.int32), table.astype(np.int32)) for rows, table in self.groups]
        return pickle.dumps((self.used.astype(np.int32), groups, self.gap.astype(np.int8), self.y.astype(np.int8)))

    @staticmethod
    def unpacked(x: bytes) -> Part:
        p = object.__new__(Part)
        p.used, groups, gap, y = pickle.loads(x)
        p.groups = [(rows.astype(np.int64), table.astype(np.int64)) for rows, table in groups]
        p.gap, p.y = gap.astype(np.int64), y.astype(np.int64)
        p._count()
        return p

    @staticmethod
    def joined(some: list[Part]) -> Part:
        """Several parts as one, rows that are in several of them once; features are padded by 0."""
        p, groups = object.__new__(Part), []
        for n in range(max(len(x.groups) for x in some)):
            own = [(*x.groups[n], x.used) if n < len(x.groups) else (np.zeros(len(x.gap), np.int32), np.zeros((min(1, len(x.gap)), 1), np.int32), np.zeros(1, np.int32)) for x in some]
            width, at = max(t.shape[1] for _, t, _ in own), np.cumsum([0, *(len(t) for _, t, _ in own)])
            rows, table = _distinct(np.concatenate([np.pad(used[t], ((0, 0), (0, width - t.shape[1]))) for _, t, used in own]))
            groups.append((rows[np.concatenate([r + k for (r, _, _), k in zip(own, at)])], table))
        p._set(np.concatenate([x.gap for x in some]), np.concatenate([x.y for x in some]), groups)
        return p

    def gradient(self, field: Field, w: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """That of the labels' likelihood (with -1 summed over) by the weights of ``used`` features and the transitions; ``ratio``: what a run with a name counts."""
        weight = np.where(self.has, ratio, 1.0)
        own, s = w[self.used], np.zeros((len(self.gap), 3))
        for rows, table in self.groups:
            s += own.take(table.ravel(), axis=0).reshape(*table.shape, 3).sum(axis=1).take(rows, axis=0)
        s[self.gap < 0, I] -= 20.0
        model = np.zeros_like(field.t)
        p = field.probabilities(s, self, model, weight)
        held = np.bincount(self.step, weight[self.run[self.pair]], 27).reshape(3, 3, 3)
        p -= self.own
        if len(self.open):
            p[self.open] -= field.probabilities(s[self.open] + self.clamp, self.rest, held, weight[self.run[self.open[self.rest.gap < 0]]])
        p, d = np.ascontiguousarray(p.T) * weight[self.run], np.zeros(own.shape)
        for k in range(3):
            for rows, table in self.groups:
                d[:, k] += np.bincount(table.ravel(), np.repeat(np.bincount(rows, p[k], len(table)), table.shape[1]), len(own))
        return d, model - held


def summed(parts: Iterable[Part], field: Field, w: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features that occur, gradient by weight, gradient by transition) of all the parts."""
    d, dt, seen = np.zeros(w.shape), np.zeros_like(field.t), np.zeros(len(w), bool)
    for p in parts:
        if p.count:
            own, own_t = p.gradient(field, w, ratio)
            d[p.used] += own
            dt += own_t
            seen[p.used] = True
    return seen, d, dt


class Field:
    """Weights by feature and label, transitions by gap, and the strength of skip edges."""

    def __init__(self):
        self.w, self.t, self.skip, self.rates = np.zeros((1 << BITS, 3), np.float32), np.zeros((3, 3, 3)), 0.0, {}
        self.t[:, O, I] = -20.0  # nothing goes on that hasn't begun

    def unary(self, runs: Runs) -> np.ndarray:
        u = self.w[runs.index].sum(axis=1, dtype=np.float64)
        u[runs.gap < 0, I] -= 20.0
        return u

    def probabilities(self, unary: np.ndarray, runs: Runs, pairs: np.ndarray | None = None, weight: np.ndarray | None = None) -> np.ndarray:
        """Exact beliefs of all runs by forward and backward sums, one place of all runs at once. ``pairs`` takes up the expected transitions, times ``weight`` (by run)."""
        out = np.zeros_like(unary)
        if not runs.count:
            return out
        o = runs.order()
        u = np.ascontiguousarray(unary.take(o.at, axis=0).T)
        u = np.exp(u - u.max(axis=0))  # sums are scaled at each step, which changes no belief
        step = np.exp(self.t).reshape(3, 9).T.take(o.gap, axis=1).reshape(3, 3, -1)
        forward, backward = u.copy(), np.ones_like(u)
        for last, here in zip(o.parts, o.parts[1:]):
            f, t = forward[:, last.start : last.start + here.stop - here.start], step[:, :, here]
            x = (f[0] * t[0] + f[1] * t[1] + f[2] * t[2]) * u[:, here]
            forward[:, here] = x / x.sum(axis=0)
        for last, here in zip(o.parts[-2::-1], o.parts[:0:-1]):
            b, t = u[:, here] * backward[:, here], step[:, :, here]
            x = t[:, 0] * b[0] + t[:, 1] * b[1] + t[:, 2] * b[2]
            backward[:, last.start : last.start + here.stop - here.start] = x / x.sum(axis=0)
        both = forward * backward
        both /= both.sum(axis=0)
        out[o.at] = both.T
        if pairs is not None:
            f, b, t, gap = forward[:, o.before], (u * backward)[:, o.later :], step[:, :, o.later :], o.gap[o.later :]
            x = [[f[i] * t[i, j] * b[j] for j in range(3)] for i in range(3)]
            scale = weight[o.run[o.later :]] / sum(map(sum, x))
            for i in range(3):
                for j in range(3):
                    pairs[:, i, j] += np.bincount(gap, x[i][j] * scale, 3)
        return out

    def chains(self, unary: np.ndarray, runs: Runs) -> np.ndarray:
        """The logarithms of :meth:`probabilities`."""
        return np.log(np.maximum(self.probabilities(unary, runs), 1e-300))

    def beliefs(self, runs: Runs, skips: bool = True) -> np.ndarray:
        """Log probabilities of the labels by loopy message passing: exact sums along chains, between them messages over the skip edges."""
        unary = self.unary(runs)
        e = runs.edges() if skips and self.skip > 0 else np.zeros((0, 2), np.int64)
        if not len(e):
            return self.chains(unary, runs)
        source, to = np.concatenate((e[:, 0], e[:, 1])), np.concatenate((e[:, 1], e[:, 0]))
        back = np.concatenate((np.arange(len(e)) + len(e), np.arange(len(e))))
        message = np.zeros(len(source))  # log odds for being part of a name
        for _ in range(SWEEPS):
            extra = np.bincount(to, message, len(unary))
            b = self.chains(unary + extra[:, None] * np.array([0.0, 1.0, 1.0]), runs)
            odds = np.logaddexp(b[source, B], b[source, I]) - b[source, O] - message[back]
            new = np.logaddexp(0, odds + self.skip) - np.logaddexp(odds, self.skip)
            message = 0.5 * message + 0.5 * new
        extra = np.bincount(to, message, len(unary))
        return self.chains(unary + extra[:, None] * np.array([0.0, 1.0, 1.0]), runs)

    def spans(self, runs: Runs, skips: bool = True) -> list[tuple[int, int, int, float]]:
        """(text, start, end, log odds) of the names found: a beginning and one token or more that go on, at most one comma."""
        b = self.beliefs(runs, skips)
        odds = np.logaddexp(b[:, B], b[:, I]) - b[:, O]
        label, out, k = b.argmax(axis=1), [], 0
        while k < len(label):
            j = k + 1
            if label[k] == B:
                while j < len(label) and label[j] == I and runs.gap[j] >= 0:
                    j += 1
                if j - k > 1 and any(runs.end[x] - runs.start[x] > 1 for x in range(k, j)) and (runs.gap[k + 1 : j] == COMMA).sum() <= 1:
                    out.append((int(runs.text[k]), int(runs.start[k]), int(runs.end[j - 1]), float(odds[k:j].min())))
            k = j
        return out

    def learn(self, total: Callable, named: int, others: int, steps: int, l2: float = 0.01) -> None:
        """Fits weights and transitions to the likelihood of the labels, with scaled gradient steps from where they are. ``total``: :func:`summed` over all parts."""
        if not named + others:
            return
        ratio = float(np.clip(others / max(named, 1), 1.0, 4.0))  # names are rare among the labelled
        w = self.w.astype(np.float64)
        gt = np.full(self.t.shape, 1e-6)
        free = self.t > -10
        for n in range(steps):
            seen, d, dt = total(self, w, ratio)
            if not n:  # the same features occur in each step
                seen[0] = False
                at = np.flatnonzero(seen)
                own, gw = w[at], np.full((len(at), 3), 1e-6)
            d = d[at] + l2 * own
            dt = np.where(free, dt + l2 * self.t, 0.0)
            gw += d * d
            gt += dt * dt
            own -= 0.3 * d / np.sqrt(gw)
            w[at] = own
            self.t -= np.where(free, 0.3 * dt / np.sqrt(gt), 0.0)
        self.w = w.astype(np.float32)

    def couple(self, same: int, other: int) -> None:
        """The strength of skip edges: the log odds, 3 at most, that repeated words of a text are both in names or both in none, by the labels so far."""
        self.skip = float(np.clip(np.log((1 + same) / (1 + other)), 0.0, 3.0))


@lru_cache(maxsize=1 << 16)
def _words(piece: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The words of a piece without white space, all in lower case; those that begin in lower case, as they stand."""
    words = _WORD.findall(piece)
    return tuple({w.lower() for w in words}), tuple({w for w in words if w[0].islower()})


def _add_words(texts: list[str], lower: Counter, whole: Counter) -> None:
    """Each distinct piece between white space is looked at once, as no word goes over white space."""
    pieces = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    coded = pieces.flatten().dictionary_encode()
    piece, text = coded.indices.to_numpy(), np.repeat(np.arange(len(texts)), pc.list_value_length(pieces).to_numpy())
    found = [(_words if len(x) <= KEPT else _words.__wrapped__)(x) for x in coded.dictionary.to_pylist()]
    for k, counter in enumerate((whole, lower)):
        number: dict[str, int] = {}
        words = np.array([number.setdefault(w, len(number)) for f in found for w in f[k]], np.int64)
        size = np.array([len(f[k]) for f in found], np.int64)
        n = size[piece]
        at = np.repeat((np.cumsum(size) - size)[piece] - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.sort(np.repeat(text, n) * len(number) + words[at])
        once = both[np.append(both[1:] != both[:-1], len(both) > 0)[: len(both)]]
        counter.update(dict(zip(number, np.bincount(once % max(len(number), 1), minlength=len(number)).tolist())))


def word_counts(texts: list[str | None]) -> tuple[Counter, Counter, Counter]:
    """Texts that hold a word in lower case, at all, and within a run of capitalised words. Words of addresses of any kind don't count."""
    lower, whole, inside, some, size = Counter(), Counter(), Counter(), [], 0
    for t in texts:
        if t:
            if "@" in t or "＠" in t:
                t = "".join(x for x in regex.split(r"(\s)", t) if "@" not in x and "＠" not in x)  # noqa: PLW2901
            inside.update({w.lower() for m in RUN.finditer(t) for w in TOKEN.findall(m.group())})
            some.append(t)
            size += len(t)
            if size >= ONCE:
                _add_words(some, lower, whole)
                some, size = [], 0
    _add_words(some, lower, whole)
    return lower, whole, inside


def rates_of(counts: Iterable[tuple[str, int, int, int]]) -> dict[str, tuple[int, int]]:
    """For each word, from the counts, how often it stands in lower case, and how often outside of runs of capitalised words: 0 for never (fewer than ``LEAST`` texts), 1 if less often than otherwise, 3 if
    nine times as often or more, 2 between."""
    rate = lambda n, rest: 0 if n < LEAST else 3 if n >= 9 * rest else 2 if n >= rest else 1
    return {w: (rate(lower, n - lower), rate(n - inside, inside)) for w, lower, n, inside in counts if n and (lower or n > inside)}


def word_rates(texts: list[str | None]) -> dict[str, tuple[int, int]]:
    lower, whole, inside = word_counts(texts)
    return rates_of((w, lower[w], n, inside[w]) for w, n in whole.items())


def seeds(texts: list[str | None], runs: Runs, taken: list | dict) -> np.ndarray:
    """Labels by public patterns; -1 where they say nothing. ``taken``: (start, end) of spans of each text that are something else (addresses and the like)."""
    labels = np.full(len(runs.words), -1)
    named: dict[int, list[tuple[int, int]]] = {}
    for i in set(runs.text.tolist()):
        if _cued(texts[i]):
            named[i] = [m.span(1) for m in _SEED.finditer(texts[i])]
    rates = [runs.rates.get(w, (0, 0)) for w in runs.words]
    bare = np.array([len(w) == 1 and (texts[i] or "")[e : e + 1] != "." for w, i, e in zip(runs.words, runs.text.tolist(), runs.end.tolist())], bool)
    ordinary = bare | np.array([len(w) > 1 and r > 1 or w in TITLES for w, (r, _) in zip(runs.words, rates)], bool)
    common = ordinary | np.array([len(w) > 1 and a > 1 for w, (_, a) in zip(runs.words, rates)], bool)
    elsewhere = np.array([a == 3 for _, a in rates], bool)
    first = np.flatnonzero(runs.gap < 0)
    for a, b in zip(first.tolist(), np.append(first[1:], len(labels)).tolist()):
        i = int(runs.text[a])
        other = np.array([any(s < runs.end[k] and runs.start[k] < e for s, e in taken[i]) for k in range(a, b)]) if taken[i] else np.zeros(b - a, bool)
        labels[a:b][ordinary[a:b] | other | elsewhere[a:b].all()] = O
        for s, e in named.get(i, []):
            k = [x for x in range(a, b) if s <= runs.start[x] and runs.end[x] <= e]
            cut = next((x for x in k if common[x]), None)
            k = [x for x in k if cut is None or x < cut]
            if len(k) > 1 and not other.any() and common[k[-1] + 1 : b].all():
                labels[a:b][labels[a:b] < 0] = O
                labels[k[0]], labels[k[1:]] = B, I
    return labels


def batch(texts: list[str | None], rates: dict[str, tuple[int, int]], taken: Callable[[str], list[tuple[int, int]]] | list) -> Batch:
    """The runs of some texts with their labels by public patterns; ``taken`` as a function is asked for texts with runs only."""
    runs = Runs(texts, rates)
    if callable(taken):
        taken = {i: taken(texts[i]) for i in set(runs.text.tolist())}
    return Batch(runs.index, runs.gap, runs.edges(), seeds(texts, runs, taken))


def train(field: Field, label: Callable) -> Field:
    """``label(field)`` labels all texts (None: by public patterns alone) and gives the sum of gradients over them as a function, the runs with a name and without,
    and the agreement of skip edges."""
    for n in range(ROUNDS + 1):
        total, named, others, same, other = label(field if n else None)
        field.learn(total, named, others, MORE if n else STEPS)
        field.couple(same, other)
    return field


def fit(texts: list[str | None], taken: list[list[tuple[int, int]]]) -> Field:
    """A field fitted to texts in memory."""
    field = Field()
    field.rates = word_rates(texts)
    own = batch(texts, field.rates, taken)
    if not own.count:
        return field

    def label(f: Field | None) -> tuple:
        y = own.labels(f)
        part = Part(own, y)
        return lambda f, w, ratio: summed([part], f, w, ratio), part.named, part.others, *own.agreement(y)

    return train(field, label)
