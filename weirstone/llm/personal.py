"""Personal information in free text, by skip-chain conditional random fields.

Names are found by the fitted token field of :mod:`weirstone.llm.names`. For the four kinds that have a form of their own (e-mail addresses, phone and identity
numbers, street addresses) patterns propose spans; each span is a binary node, and so is each name that the field found, with the field's log odds. A span's own
potential adds up what speaks for and against it: its form and the words before and after it. Edges join the nodes of a document:

* chain: overlapping spans exclude each other; neighbouring ones in one line (a name before a phone number) support each other a little;
* skip: spans of one kind that repeat the same text, whatever their distance, are drawn to the same label, so a number that is once called an order number
  isn't taken for a phone number further down.

Loopy message passing gives each node's belief; nodes over 1/2 are found. The potentials of the four kinds are set by hand: their forms are public standards. All values below are parameters
of the model, in units of log odds.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirstone.llm.names import BITS, LEAST, Batch, Field, Part, Runs, batch, rates_of, summed, train, word_counts
from weirstone.session import shuffles_dropped, written

KINDS = ("email", "phone", "id_number", "address", "name")

_DIGIT = re.compile(r"\d")
_AT_BRACKET = re.compile(r"[\[({<] ?(?:AT|at) ?[\])}>]")
_RUN = re.compile(r"[+(]?\d[\d \-‐‑–.()\u00a0]*\d")
_SIX = regex.compile(r"\d(?:[ \-‐‑–.()\u00a0]*+\d){5}")
_LETTERED = re.compile(r"[A-Z]{5}\d{4}[A-Z]")
_FOUR = regex.compile(r"\d{4}[A-Z]")
_D = r"\d"  # digits of any script
_SEP = r"[ .\-‐‑–\u00a0]"
_U, _W = r"[A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĪİŁŃŇŐŘŚŞŠŤŪŮŰŹŻŽ]", r"[^\W\d_]"

_LOCAL = r"[\w%+][\w.%+\-]*"
_DOT = r"(?: ?\. ?|\.| ?[\[({] ?(?:dot|DOT) ?[\])}] ?| (?:dot|DOT) )"
_AT = r"(?: ?[@＠] ?| ?[\[({<] ?(?:at|AT|@) ?[\])}>] ?| (?:AT|at) (?=[\w-]+(?:(?: ?[\[({] ?(?:dot|DOT) ?[\])}] ?| (?:dot|DOT) )[\w-]+)))"
EMAIL = re.compile(rf"(?<![\w.%+\-@/]){_LOCAL}{_AT}[\w][\w\-]*(?:(?:\.| ?[\[({{] ?(?:dot|DOT) ?[\])}}] ?| (?:dot|DOT) )[A-Za-z0-9][\w\-]*)+")
FILE_END = re.compile(r"(?i)\.(?:png|jpe?g|gif|svg|webp|pdf|txt|js|css|py|zip)$")

_EDGE, _END = r"(?<![\w.,:/+\-‐‑@#])", r"(?![\w@/]|[.,:\-‐‑]\d)"
ZERO = 1.2
PHONES = [  # (weight, pattern)
    (3.0, re.compile(rf"{_EDGE}\+{_D}{{1,3}}(?:{_SEP}?\(?{_D}{{1,5}}\)?){{2,6}}{_END}")),
    (2.5, re.compile(rf"{_EDGE}(?:1{_SEP})?\({_D}{{2,4}}\){_SEP}?{_D}{{3,4}}{_SEP}?{_D}{{3,4}}{_END}")),
    (2.0, re.compile(rf"{_EDGE}(?:1{_SEP})?{_D}{{3}}({_SEP}){_D}{{3}}\1{_D}{{4}}{_END}")),
    (ZERO, re.compile(rf"{_EDGE}0{_D}{{2,4}}(?:{_SEP}{_D}{{2,6}}){{1,3}}{_END}")),
    (-1.5, re.compile(rf"{_EDGE}{_D}{{7,12}}{_END}")),
]
_ID_END = r"(?![\w@/]|[-.]\d)"
IDS = [
    (2.5, re.compile(rf"{_EDGE}{_D}{{3}}([ \-‐‑]){_D}{{2}}\1{_D}{{4}}{_ID_END}")),
    (2.5, re.compile(rf"{_EDGE}[A-Z]{{2}}([ -]?){_D}{{2}}\1{_D}{{2}}\1{_D}{{2}}\1[A-D]{_ID_END}")),
    (1.5, re.compile(rf"{_EDGE}[A-Z]{{5}}{_D}{{4}}[A-Z]{_ID_END}")),
    (2.0, re.compile(rf"{_EDGE}(?:{_D}{{8}}|[XYZ]{_D}{{7}})-?[A-Z]{_ID_END}")),
    (1.5, re.compile(rf"{_EDGE}[A-Z]{{2}}{_D}{{2}} ?{_D}{{11}}{_ID_END}")),
    (0.2, re.compile(rf"{_EDGE}{_D}{{4}}([ \-]){_D}{{4}}\1{_D}{{4}}{_ID_END}")),
    (-1.0, re.compile(rf"{_EDGE}[A-Z]{{1,2}}{_D}{{6,9}}{_ID_END}")),
    (-2.0, re.compile(rf"{_EDGE}{_D}{{8,12}}{_ID_END}")),
]

#: Words for ways in addresses.
_WAYS = r"(?:street|st\.?|road|rd\.?|lane|ln\.?|avenue|ave\.?|drive|dr\.?|court|ct\.?|boulevard|blvd\.?|close|cl\.?|way|place|pl\.?|crescent|terrace|square|sq\.?|row|hill|gardens)"
_UNIT = r"(?:flat|apt\.?|apartment|unit|suite|room|#)"
_CAP = rf"{_U}[\w'’\-]*\.?"
ADDRESSES = [
    (2.0, re.compile(rf"(?:(?i:{_UNIT}) ?\w{{1,5}}, ?)?(?<![\w.,/\-])\d{{1,5}}(?:[ -]?[A-Za-z](?![\w.]))?,? (?:[NSEW]{{1,2}}\.? )?(?:{_CAP} ){{1,3}}?(?i:{_WAYS})(?!\w)(?:,? (?i:{_UNIT}) ?\d+\w*)?")),
    (2.0, re.compile(r"(?<![\w.,/\-])\d{1,5}(?: ?(?:bis|ter))?,? (?i:rue|avenue|boulevard|place|chemin|impasse|quai)(?: (?i:de la|de l'|des|du|de|d'))? ?[A-ZÀ-Þ][\w'’\-]*")),
    (2.0, re.compile(r"(?i:\b(?:calle|avenida|paseo|plaza|camino|via|viale|rua))(?: (?i:de la|de los|de las|del|de|da|do|dei))? [A-ZÀ-Þ][\w'’\-]*,? (?:n\.?[ºo°] ?)?\d{1,5}[a-z]?\b(?:,? (?:piso|apto\.?|puerta) ?\w+)?")),
    (2.0, re.compile(r"\b[A-ZÄÖÜ][\w\-]*(?:(?i:stra(?:ße|sse)|str\.|gasse|weg|platz|allee|ufer|damm)|(?<=-)Str\.) \d{1,4}[a-z]?\b")),
]

_PHONE_CUE = re.compile(r"(?i)(?:phone|call(?: me)?|tel|mobile|cell|ring(?:ing)?(?: from)?|text|whats ?app|sms|fax|number(?: is)?|numero|número|ruf an|telefon|naam?ber|hotline)\W*(?:on|at|is|from|me|no\.?)?\W*$")
_ID_CUE = re.compile(r"(?i)(?:\bssn|social security|national id|citizen|passport|licen[cs]e|tax (?:id|number|no)|insurance|\bni\b|\bdni\b|\bnie\b|identity|aadhaar|\bpan\b|steuer|ausweis|\bid (?:number|no|card))(?:[^\n.;]|no\.){0,24}$")
_ID_AFTER = re.compile(r"(?i)[^\n.;]{0,30}(?:social security|my ssn|tax number|tax id|passport|licen[cs]e|national id|insurance n)")
_NOT_NUMBER = re.compile(r"(?i)(?:order|ref|lot|epoch|score|build|version|ticket|invoice|tracking|batch|serial|seen from|thread|post|item|sku|isbn|part|case|bug|issue)\b(?:[^\n.;]|no\.){0,24}$")
_ADDRESS_CUE = re.compile(r"(?i)(?:live[sd]? at|address|meet(?: me)? (?:outside|at)|pickup from|moved to|ship(?:ped)? to|deliver(?:ed)? to)\W*$")
#: Words for ways, one of which any address has; found by one pass of an automaton.
WAY_ANCHORS = [f" {w}" for w in "street st road rd lane ln avenue ave drive dr court ct boulevard blvd close cl way place pl crescent terrace square sq row hill gardens rue chemin impasse quai de des".split()] + ["calle", "avenida", "paseo", "plaza", "camino", "via ", "viale", "rua ", "straße", "strasse", "str.", "gasse", "weg ", "platz ", "allee ", "ufer ", "damm "]
#: A span and its repetition lose by different labels.
REPEAT, NEIGHBOUR, EXCLUDE = 1.6, 0.3, 12.0
ROUNDS = 12
#: Characters of texts, and bytes of runs, that are looked at together in fitting; bytes of labelled runs up to which the driver adds up their gradients; tasks whose sums it takes. Beyond, bytes of
#: labelled runs that a task adds up, piece by piece, where that leaves each core a task.
TOGETHER, PIECE, HELD, SUMS, BULK = 20_000_000, 8_000_000, 24_000_000, 16, 256_000_000


class Node:
    """A candidate: where, what, and the log odds of its own evidence."""

    __slots__ = ("end", "kind", "odds", "start", "value")

    def __init__(self, start: int, end: int, kind: str, value: str, odds: float):
        self.start, self.end, self.kind, self.value, self.odds = start, end, kind, value, odds


def _digits(v: str) -> int:
    return sum(c.isdigit() for c in v)


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


@lru_cache(maxsize=1)
def _anchors():
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in WAY_ANCHORS:
        a.add_word(w, w[0] == " ")
    a.make_automaton()
    return a


def _regions(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Where numbers and addresses may stand: around six digits or more, and around a word for a way. No pattern below can match elsewhere."""
    size = len(text)
    numbers = [(max(0, m.start() - 8), min(size, m.end() + 4)) for m in _RUN.finditer(text) if _digits(m.group()) >= 6] if _SIX.search(text) else []
    if _FOUR.search(text):
        numbers += [(m.start(), m.end()) for m in _LETTERED.finditer(text)]
    if not _DIGIT.search(text):
        return _united(numbers), []
    low = text.lower()
    if len(low) != size:
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    # a word for a way that goes on in lower case is another word, and an address has a digit
    placed = [(max(0, end - 120), min(size, end + 120)) for end, whole in _anchors().iter(low) if not (whole and text[end + 1 : end + 2].islower())]
    return _united(numbers), [(s, e) for s, e in _united(placed) if _DIGIT.search(text, s, e)]


def candidates(text: str) -> list[Node]:
    """All spans of the four kinds that some pattern proposes, with their own potentials."""
    out: dict[tuple[int, int, str], Node] = {}

    def add(m: re.Match, kind: str, odds: float, start: int | None = None, end: int | None = None) -> None:
        s, e = m.start() if start is None else start, m.end() if end is None else end
        old = out.get((s, e, kind))
        if old is None or old.odds < odds:
            out[s, e, kind] = Node(s, e, kind, text[s:e], odds)

    def cue(p: re.Pattern, s: int) -> bool:
        return p.search(text, max(0, s - 48), s) is not None

    # a sign or 'at' in brackets; 'at' as a word only where 'dot' is one
    if "@" in text or "＠" in text or _AT_BRACKET.search(text) or ((" at " in text or " AT " in text) and ("dot" in text or "DOT" in text)):
        for m in EMAIL.finditer(text):
            v = m.group()
            s = m.start() + (7 if v.lower().startswith("mailto:") else 0)
            add(m, "email", -4.0 if FILE_END.search(v) else 3.0, start=s)
    numbers, placed = _regions(text)
    for s, e in numbers:
        for w, p in PHONES:
            for m in p.finditer(text, s, e):
                n, s0 = _digits(m.group()), m.start()
                if 7 <= n <= 15 and (w != ZERO or n >= 10):
                    add(m, "phone", w + 3.0 * cue(_PHONE_CUE, s0) - 3.5 * cue(_NOT_NUMBER, s0) - 2.5 * cue(_ID_CUE, s0))
        for w, p in IDS:
            for m in p.finditer(text, s, e):
                near = cue(_ID_CUE, m.start()) or _ID_AFTER.match(text, m.end(), m.end() + 60) is not None
                add(m, "id_number", w + 3.0 * near - 3.5 * cue(_NOT_NUMBER, m.start()) - 1.5 * (not near and cue(_PHONE_CUE, m.start())))
    for s, e in placed:
        for w, p in ADDRESSES:
            for m in p.finditer(text, s, e):
                add(m, "address", w + 2.0 * cue(_ADDRESS_CUE, m.start()))
    return sorted(out.values(), key=lambda x: (x.start, -x.end, x.kind))


def _edges(nodes: list[Node]) -> list[tuple[int, int, float, float]]:
    """(i, j, both, one): what is added to the log potential if both are on, or if exactly one is."""
    edges = []
    for i, a in enumerate(nodes):
        for j in range(i + 1, len(nodes)):
            b = nodes[j]
            if b.start >= a.end:
                if b.start - a.end <= 40 and a.kind != b.kind:
                    edges.append((i, j, NEIGHBOUR, 0.0))
                break_far = b.start - a.end > 40
                if break_far:
                    break
            else:
                edges.append((i, j, -EXCLUDE, 0.0))
    # skip edges run along the repetitions in order, so a value repeated n times has n - 1 of them
    seen: dict[tuple, int] = {}
    for i, a in enumerate(nodes):
        key = (a.kind, re.sub(r"\W+", "", a.value).lower())
        if key in seen:
            edges.append((seen[key], i, 0.0, -REPEAT))
        seen[key] = i
    return edges


def beliefs(odds: list[float], edges: list[tuple[int, int, float, float]]) -> list[float]:
    """Log odds of each node after damped loopy message passing. Exact on trees."""
    to: list[list[tuple[int, int]]] = [[] for _ in odds]
    for k, (i, j, _, _) in enumerate(edges):
        to[j].append((2 * k, i))
        to[i].append((2 * k + 1, j))
    msg = [0.0] * (2 * len(edges))
    soft = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    for _ in range(ROUNDS):
        total = [o + sum(msg[k] for k, _ in to[n]) for n, o in enumerate(odds)]
        change = 0.0
        for k, (i, j, both, one) in enumerate(edges):
            for m, src, back in ((2 * k, i, 2 * k + 1), (2 * k + 1, j, 2 * k)):
                x = total[src] - msg[back]
                new = soft(one, x + both) - soft(0.0, x + one)
                new = 0.5 * msg[m] + 0.5 * new
                change = max(change, abs(new - msg[m]))
                msg[m] = new
        if change < 1e-3:
            break
    return [o + sum(msg[k] for k, _ in to[n]) for n, o in enumerate(odds)]


def decide(nodes: list[Node]) -> list[Node]:
    """The nodes found, in order and without overlaps."""
    if not nodes:
        return []
    nodes = sorted(nodes, key=lambda x: (x.start, -x.end, x.kind))
    belief = beliefs([n.odds for n in nodes], _edges(nodes))
    taken: list[Node] = []
    for b, n in sorted(zip(belief, nodes), key=lambda z: (-z[0], z[1].start - z[1].end, z[1].start)):
        if b > 0 and all(n.end <= t.start or n.start >= t.end for t in taken):
            taken.append(n)
    return sorted(taken, key=lambda n: n.start)


def find_all(texts: list[str | None], field: Field) -> list[list[Node]]:
    """The spans found in each text."""
    nodes = [candidates(t) if t else [] for t in texts]
    for i, s, e, odds in field.spans(Runs(texts, field.rates)):
        nodes[i].append(Node(s, e, "name", texts[i][s:e], min(odds, 8.0)))
    return [decide(x) for x in nodes]


def find(text: str, field: Field) -> list[Node]:
    return find_all([text], field)[0]


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    return (x for b in batches for x in b.column("packed").to_pylist())


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lower, whole, inside = word_counts(b.column("text").to_pylist())
        w = list(whole)
        yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), *(pa.array([c[x] for x in w], pa.int64()) for c in (lower, whole, inside))], ["word", "low", "n", "inside"])


def _runs(rates: dict[str, tuple[int, int]]):
    """The runs of all texts, packed."""
    taken = lambda t: [(n.start, n.end) for n in decide(candidates(t))]

    def pack(texts: list[str]) -> pa.RecordBatch:
        own = batch(texts, rates, taken)
        return pa.RecordBatch.from_arrays([pa.array([own.packed()] if own.count else [], pa.binary())], ["packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some, size = [], 0
            for t in b.column("text").to_pylist():
                if t:
                    some.append(t)
                    size += len(t)
                    if size >= TOGETHER:
                        yield pack(some)
                        some, size = [], 0
            yield pack(some)

    return run


def _labelled(field: Field | None):
    """The labelled runs, packed, and what is counted of them."""

    def one(some: list[Batch]) -> pa.RecordBatch:
        own = Batch.joined(some)
        y = own.labels(field)
        part = Part(own, y)
        packed = part.packed()
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in (packed, part.bytes, part.named, part.others, *own.agreement(y))], ["packed", "bytes", "named", "others", "same", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, size = [], 0
        for x in map(Batch.unpacked, _values(batches)):
            some.append(x)
            size += x.index.nbytes
            if size >= PIECE:
                yield one(some)
                some, size = [], 0
        if some:
            yield one(some)

    return run


def _added(found: Iterator[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    seen, d, dt = np.zeros(1 << BITS, bool), np.zeros((1 << BITS, 3)), np.zeros((3, 3, 3))
    for at, own, own_t in found:
        seen[at] = True
        d[at] += own
        dt += own_t
    return seen, d, dt


def _packed_sum(seen: np.ndarray, d: np.ndarray, dt: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(seen).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array([pickle.dumps((at, d[at], dt))], pa.binary())], ["packed"])


def _totals(parts: DataFrame, field: Field, w: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`names.summed` over a table of parts: by task, then over groups of tasks, and at last here. The weights go to the tasks once a step, and none stay on disk after it."""
    transitions, told = field.t, parts.sparkSession.sparkContext.broadcast(w)

    def gradients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bare = Field()
        bare.w, bare.t = None, transitions  # the weights are those told
        yield _packed_sum(*summed(map(Part.unpacked, _values(batches)), bare, told.value, ratio))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _packed_sum(*_added(map(pickle.loads, _values(batches))))

    sums, tasks = parts.select("packed").mapInArrow(gradients, "packed binary"), parts.rdd.getNumPartitions()
    while tasks > SUMS:
        tasks = -(-tasks // SUMS)
        sums = sums.repartition(tasks).mapInArrow(add, "packed binary")
    try:
        return _added(pickle.loads(r.packed) for r in sums.collect())  # bounded: SUMS rows of 2**BITS weights
    finally:
        told.destroy()


def fit_names(df: DataFrame, key: str, text: str) -> Field:
    """The name field fitted to all texts of ``df``, whole: :func:`names.fit` of them, wherever they are.

    Words are counted over all texts, and each step's gradient is summed over the labelled runs of all texts. The driver holds the weights, and the rates of the words that
    stand in runs and at least ``names.LEAST`` times outside of them; labelled runs only where they take no more than ``HELD`` bytes.
    """
    field, texts = Field(), df.select(F.col(text).alias("text"))
    with shuffles_dropped(df.sparkSession):
        counts = texts.mapInArrow(_word_counts, "word string, low bigint, n bigint, inside bigint").groupBy("word").agg(*(F.sum(k).alias(k) for k in ("low", "n", "inside")))
        # words that stand in no run are never looked up, and rarer ones count as unknown
        counts = counts.filter((F.col("inside") > 0) & (F.greatest("low", F.col("n") - F.col("inside")) >= LEAST))
        field.rates = rates_of((r.word, r.low, r.n, r.inside) for r in counts.collect())
        runs = written(texts.mapInArrow(_runs(field.rates), "packed binary"))
        if runs.isEmpty():
            return field

        def label(f: Field | None) -> tuple:
            parts = written(runs.mapInArrow(_labelled(f), "packed binary, bytes bigint, named bigint, others bigint, same bigint, other bigint"))
            n = parts.agg(*(F.sum(k) for k in ("bytes", "named", "others", "same", "other"))).first()
            if n[0] > HELD:
                fewer = parts.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-n[0] // BULK)))
                return lambda *x: _totals(fewer, *x), *n[1:]
            own = [Part.unpacked(r.packed) for r in parts.select("packed").collect()]  # bounded: HELD bytes
            own = [Part.joined(own)]
            return lambda *x: summed(own, *x), *n[1:]

        return train(field, label)


def redact(text: str, found: list[Node]) -> str:
    """The text with each span replaced by its kind, [EMAIL] and so on."""
    out, at = [], 0
    for n in found:
        out += [text[at : n.start], f"[{n.kind.upper()}]"]
        at = n.end
    return "".join([*out, text[at:]])


def _scan(field: Field, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column("text").to_pylist()
            found = find_all(values, field)
            if with_text:
                texts = [redact(t, f) if t else t for t, f in zip(values, found)]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string())], ["id", "text"])
            else:
                rows = [(i, k, v) for i, f in enumerate(found) for k, v in sorted({(n.kind, n.value) for n in f})]
                at, kinds, spans = ([r[x] for r in rows] for x in range(3))
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(spans, pa.string())], ["id", "kind", "value"])

    return run


def _rows(df: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return rows, rows.schema["id"].dataType.simpleString()


def find_personal(df: DataFrame, key: str, text: str, field: Field | None = None) -> DataFrame:
    """(``key``, kind, value) of each distinct piece of personal information in a row's text, as written there.

    ``field``: the fitted names; without it they are fitted to ``df``. Null and empty texts have none; texts are searched whole; repeated rows give repeated
    results; other columns aren't read. No row is moved.
    """
    rows, kind = _rows(df, key, text)
    return rows.mapInArrow(_scan(field or fit_names(df, key, text), False), f"id {kind}, kind string, value string").withColumnRenamed("id", key)


def redacted(df: DataFrame, key: str, text: str, field: Field | None = None) -> DataFrame:
    """(``key``, text) with typed placeholders in place of personal information. Null stays null."""
    rows, kind = _rows(df, key, text)
    return rows.mapInArrow(_scan(field or fit_names(df, key, text), True), f"id {kind}, text string").select(F.col("id").alias(key), F.col("text").alias(text))
