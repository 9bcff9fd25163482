"""Each operator against a brute-force version on small tables with nulls, ties, repeats and clashing names."""

import itertools
import math
import random
from collections import Counter

import pytest

from weirstone.llm import cooccur, formdups, fusion, leaks, names, neardups, percentiles, personal, topn

# co-occurrence


def brute_pairs(rows, min_n, min_lift):
    rows = {r for r in rows if None not in r}
    out = []
    for s in {r[0] for r in rows}:
        baskets, degree = {}, Counter()
        for _, p, x in (r for r in rows if r[0] == s):
            baskets.setdefault(p, set()).add(x)
            degree[x] += 1
        n = Counter(pair for b in baskets.values() for pair in itertools.combinations(sorted(b), 2))
        t = len(baskets)
        out += [(s, a, b, k, degree[a], degree[b], t) for (a, b), k in n.items() if k >= min_n and k * t >= min_lift * degree[a] * degree[b]]
    return sorted(out)


@pytest.mark.parametrize("hot", [3, 512])
@pytest.mark.parametrize("min_n,min_lift", [(1, 0.0), (3, 1.2)])
def test_cooccurrence(spark, hot, min_n, min_lift):
    rnd = random.Random(hot)
    rows = [(rnd.choice("mn"), f"p{rnd.randrange(14)}", f"x{int(rnd.paretovariate(0.5)) % 17}") for _ in range(400)]
    rows += rows[:50] + [(None, "p1", "x1"), ("m", None, "x1"), ("m", "p1", None)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "month string, p string, x string, n int")
    got = cooccur.cooccurrence(df, "x", "p", "month", min_n, min_lift, hot=hot).collect()
    assert sorted((r.month, r.a1, r.a2, r.n, r.d1, r.d2, r.t) for r in got) == brute_pairs(rows, min_n, min_lift)
    for r in got:
        assert math.isclose(r.lift, r.n * r.t / (r.d1 * r.d2))
        assert (r.conviction is None) == (r.n == r.d1)
    assert cooccur.cooccurrence(df.limit(0), "x", "p", "month").count() == 0


def test_cooccurrence_of_one_giant_basket(spark):
    """50,000 items in one basket: no pair of it is formed, since none can meet three times there; the pairs of other baskets are whole."""
    few = [("m", f"p{p}", f"x{x}") for p in range(4) for x in (1, 2, 3)]
    df = spark.range(50_000).selectExpr("'m' AS month", "'giant' AS p", "concat('x', id) AS x").unionByName(spark.createDataFrame(few, "month string, p string, x string"))
    got = cooccur.cooccurrence(df, "x", "p", "month", min_n=3).collect()
    assert sorted((r.a1, r.a2, r.n) for r in got) == [("x1", "x2", 5), ("x1", "x3", 5), ("x2", "x3", 5)]


# percentiles


def test_percentiles_doubles(spark):
    rnd = random.Random(3)
    odd = [float("nan"), None, float("inf"), -float("inf"), 0.0, -0.0, 5e-324, -1.5, 1e300]
    rows = [(g, rnd.choice([rnd.gauss(0, 1e3), 1.0, rnd.choice(odd)])) for g in "abc" for _ in range(301)] + [("only null", None), (None, 1.0), ("one", 4.0)]
    got = percentiles.percentiles(spark.createDataFrame(rows, "u string, key double").repartition(5), ["u"], "key", [0.0, 0.5, 0.9, 1.0]).collect()
    want = {}
    for g in {"a", "b", "c", "one"}:
        v = sorted(x for k, x in rows if k == g and x is not None and x == x)
        want |= {(g, q): (len(v), v[max(1, math.ceil(q * len(v))) - 1]) for q in (0.0, 0.5, 0.9, 1.0)}
    assert {(r.u, r.q): (r.n, r.value) for r in got} == want


def test_percentiles_integers_and_summaries(spark):
    rnd = random.Random(4)
    rows = [("g", rnd.choice([rnd.randrange(-(2**63), 2**63), rnd.randrange(100)])) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, v bigint")
    v = sorted(x for _, x in rows)
    assert [r.value for r in percentiles.percentiles(df, ["g"], "v", [0.5]).collect()] == [v[249]]
    days = [df.filter("v % 2 = 0"), df.filter("v % 2 <> 0")]
    whole = percentiles.merge_histograms(*[percentiles.radix_histogram(d.select("g", percentiles.float_key(d.v.cast("double")).alias("k")), ["g"], "k", 24) for d in days])
    (r,) = percentiles.select_ranks(whole, ["g"], [0.9], 24).select(percentiles.key_float("key").alias("x"), "n").collect()
    assert r.n == 500 and math.isclose(r.x, v[449], rel_tol=2**-11)
    assert percentiles.percentiles(df.limit(0), ["g"], "v", [0.5]).count() == 0


# fusion


@pytest.mark.parametrize("q,p", [(0.0, 1.0), (0.05, 0.4)])
def test_net_flow(spark, q, p):
    rnd = random.Random(5)
    pick = lambda: rnd.choice([None, float("nan"), float("inf"), rnd.randrange(6) * 1.0, 10 ** rnd.uniform(-3, 9)])
    rows = [(f"k{i}", pick(), pick()) for i in range(120)] + [(None, 1.0, 1.0)]
    got = fusion.net_flow(spark.createDataFrame(rows, "s string, a double, b double"), "s", {"a": 1.0, "b": 3.0}, q, p, ranges=5).collect()
    flow = {}
    pref = lambda d: min(1.0, max(0.0, (d - q) / (p - q)))
    for i, w in ((1, 1.0), (2, 3.0)):
        known = {r[0]: r[i] for r in rows if r[0] and r[i] is not None and math.isfinite(r[i])}
        place = {k: sum(o < v for o in known.values()) / len(known) for k, v in known.items()}
        for k, x in place.items():
            f = sum(pref(x - y) - pref(y - x) for y in place.values()) / (len(known) - 1)
            flow.setdefault(k, []).append((w, f))
    want = {k: sum(w * f for w, f in z) / sum(w for w, _ in z) for k, z in flow.items()}
    assert {r.s for r in got} == set(want)
    for r in got:
        assert math.isclose(r.net_flow, want[r.s], abs_tol=1e-9) and r.n_scores == len(flow[r.s])
        assert all(r[f"flow_{i}"] >= r[f"place_{i}"] + r[f"least_{i}"] - 1e-12 for i in (0, 1) if r[f"place_{i}"] is not None)


def test_thresholds_make_another_order_than_the_mean_place(spark):
    """Being outright better in one score counts for more than many small leads that are within indifference."""
    rows = [(f"k{i:02}", float(i), float((7 * i) % 40)) for i in range(40)]
    got = fusion.net_flow(spark.createDataFrame(rows, "k string, a double, b double"), "k", {"a": 1.0, "b": 1.0}, 0.1, 0.3).collect()
    by = lambda f: [r.k for r in sorted(got, key=lambda r: (-round(f(r), 9), r.k))]
    assert by(lambda r: r.net_flow) != by(lambda r: r.place_0 + r.place_1)


def test_net_flow_empty(spark):
    assert fusion.net_flow(spark.createDataFrame([], "k string, a double"), "k", {"a": 1.0}).count() == 0


# formatting duplicates


def test_form_duplicates(spark):
    base = "The quick brown fox jumps over the lazy dog, again and again"
    fields = "Name: Ann Example\nPlace: Somewhere far away\nNote: nothing at all"
    rows = [
        ("c3", base), ("c1", base.upper() + "!!"), ("c2", "  " + base.replace(" ", "\t ")), ("c2", "  " + base.replace(" ", "\t ")),
        ("d2", fields), ("d1", "note: NOTHING at all; name: ann example | place: somewhere far away"),
        ("d0", "Name Ann Example Place Somewhere far away Note nothing at all"),  # no fields: another form
        ("e1", "too short"), ("e2", "Too short!"), ("f1", None), (None, base), ("g1", ""), ("h1", base[::-1]), ("i1", "word " * 20000), ("i0", "WORD" * 20000),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, body string, form int")
    got = sorted(tuple(r) for r in formdups.form_duplicates(df, "id", "body").collect())
    assert got == [("c1", "c2"), ("c1", "c3"), ("d1", "d2"), ("i0", "i1")]
    assert sorted((r["first"], r.copies) for r in formdups.form_classes(df, "id", "body").collect()) == [("c1", 3), ("d1", 2), ("i0", 2)]
    assert formdups.form_duplicates(df.limit(0), "id", "body").count() == 0


def test_cheap_invariants_never_part_one_form(spark):
    import pyarrow as pa

    texts = ["Straße, 12!", "STRASSE 12", "straße12", "ΣΑΣ σας", "σασ ΣΑΣ", "a-b C", "CBA", "", "१२ भा षा", "भाषा१२", "\u212a1", "k1"]
    size, mark = formdups.invariants(pa.array(texts))
    same = lambda i, j: (size[i], mark[i]) == (size[j], mark[j])
    assert same(0, 2) and not same(0, 1) and same(3, 4) and same(5, 6) and size[7] == 0 and same(8, 9) and same(10, 11)
    part = formdups.invariants(pa.array(texts).slice(3, 4))
    assert part[0].tolist() == size[3:7].tolist() and part[1].tolist() == mark[3:7].tolist()


# near duplicates


def word_sets(rows, least):
    import regex

    return [(i, a, s) for i, a, t in rows if i is not None and a is not None and t is not None and len(s := set(regex.findall(r"[\p{L}\p{M}\p{N}]+", t.lower()))) >= least]


@pytest.mark.parametrize("block", [3, 20_000])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(neardups, "BLOCK", block)
    rnd = random.Random(block)
    vocabulary = [f"w{int(rnd.paretovariate(0.7)) % 90}" for _ in range(400)] + ["Über", "naïve", "भाषा"]
    texts = [" ".join(rnd.sample(vocabulary, rnd.randrange(25, 60))) for _ in range(60)]
    for t in texts[:40]:
        for _ in range(3):
            w = t.split()
            for _ in range(rnd.randrange(0, 9)):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            texts.append(", ".join(w).upper())
    rows = [(f"c{i:03}", rnd.choice("abc"), t) for i, t in enumerate(texts)]
    rows += rows[:20] + [("n1", None, texts[0]), (None, "a", texts[0]), ("n2", "a", None), ("n3", "b", ""), ("n4", "a", "few words")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, author string, body string, key int").repartition(3)
    sets = {(i, a): s for i, a, s in word_sets(rows, 12)}
    want = {(i, j) for ((i, a), s), ((j, b), t) in itertools.product(sets.items(), repeat=2) if i < j and a != b and 10 * len(s & t) >= 7 * len(s | t)}
    got = [tuple(r) for r in neardups.NearDuplicates(df, "id", "author", "body", least=12).pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30


def test_near_duplicates_empty(spark):
    assert neardups.NearDuplicates(spark.createDataFrame([], "id string, author string, body string"), "id", "author", "body").pairs().count() == 0


def test_near_duplicates_of_long_texts(spark):
    """Sets on both sides of the size classes' limits."""
    rnd = random.Random(9)
    texts = []
    for size in (80, 96, 110, 380, 420):
        for _ in range(6):
            base = [f"v{rnd.randrange(3000)}" for _ in range(size)]
            texts += [base, base[: int(size * 0.8)], [*base, *(f"u{k}" for k in range(int(size * rnd.uniform(0.3, 0.5))))], rnd.sample(base, int(size * 0.68))]
    rows = [(f"c{i:03}", f"a{i}", " ".join(t)) for i, t in enumerate(texts)]
    sets = word_sets(rows, 20)
    want = {(i, j) for (i, _, s), (j, _, t) in itertools.product(sets, repeat=2) if i < j and 10 * len(s & t) >= 7 * len(s | t)}
    df = spark.createDataFrame(rows, "id string, author string, body string")
    got = {tuple(r) for r in neardups.NearDuplicates(df, "id", "author", "body").pairs().collect()}
    assert got == want and len(want) > 45


def test_entries_of_a_fixed_vocabulary_grow_with_the_records_only():
    """Ten times the records over the same words give ten times the entries, and cells parted by further words the same pairs as whole ones; both hold against all pairs."""
    import numpy as np

    rnd = np.random.default_rng(2)
    weight = 1.0 / np.arange(4, 64)
    base = [rnd.choice(60, rnd.integers(1, 30), replace=False, p=weight / weight.sum()) for _ in range(1500)]
    base += [np.unique(np.append(b[: len(b) - k], rnd.integers(0, 60, k))) for b in base[:300] for k in (1, 2)]
    sets = list({frozenset(b.tolist()) for b in base})
    codes = np.sort(rnd.integers(-(2**63), 2**63 - 1, 60))
    lists = [np.sort(codes[list(x)]) for x in sets]
    sizes, short = np.array([len(x) for x in lists]), np.arange(len(lists)).astype(np.uint64)
    held = Counter(c for x in lists for c in x.tolist())
    want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 10 * len(sets[i] & sets[j]) >= 7 * len(sets[i] | sets[j])}
    volume = {}
    for times in (1, 100):  # as many records hold each word
        order = neardups.Order([(c, n * times) for c, n in held.most_common()], neardups.BLOCK)
        e, cell, further = neardups.entries(short, sizes, np.concatenate(lists), order, 7, 10, 0)
        volume[times] = len(e), len(further)
    assert volume[1] == volume[100] and volume[1][0] == sum(n - -(-7 * n // 10) + 1 for n in sizes.tolist())
    got = {x: {tuple(p) for p in neardups.candidates(e, further, 7, 10, x).tolist()} for x in (0, 500, 10**9)}
    assert len(want) > 100 and all(want <= p for p in got.values())


def test_ring_loses_no_pair_within_the_budget_and_is_no_plain_distance_check():
    import numpy as np

    rnd = np.random.default_rng(1)
    d, most = rnd.integers(0, 12, (5000, 4)), rnd.integers(0, 40, 5000)
    kept = neardups.ring(d, most)
    assert np.all(kept[d.sum(axis=1) <= most]) and np.any(kept & (d.sum(axis=1) > most)) and not np.all(kept)
    chain = lambda r, m: any(all(4 * sum(r[(i + k) % 4] for k in range(n)) <= n * m for n in (1, 2, 3)) for i in range(4))
    assert kept.tolist() == [chain(r, m) for r, m in zip(d.tolist(), most.tolist())]


# top n


@pytest.mark.parametrize("ways", [200, 4096])
def test_top_n(spark, ways):
    rnd = random.Random(6)
    big = 2**63 - 1
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([None, 5, 5, 7, rnd.randrange(100), big, -big - 1]), f"id{i:04}" if rnd.random() > 0.05 else None) for i in range(400)]
    rows += [("long", 1, "x" * 40 + str(i)) for i in range(9)] + [("few", 3, "é"), ("few", 3, "z")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "g0 string, score bigint, id string, rn int")
    want = []
    for g in {r[0] for r in rows} - {None}:
        v = sorted(((-s, i) for k, s, i in rows if k == g and s is not None and i is not None), key=lambda x: (x[0], x[1].encode()))
        want += [(g, n + 1, i) for n, (_, i) in enumerate(v[:4])]
    assert sorted(tuple(r) for r in topn.top_n(df, ["g0"], "score", "id", 4, ways=ways).collect()) == sorted(want)
    assert topn.top_n(df.limit(0), ["g0"], "score", "id", 4).count() == 0


def test_top_n_with_long_identifiers_and_real_scores(spark):
    """Identifiers of 200 bytes that differ in the last one only, repeated identifiers, and scores with fractions."""
    rnd = random.Random(61)
    rows = [("a", rnd.choice([0.25, 0.5, -1.5, float("nan"), None, float("inf")]), "https://example.org/" + "p" * 180 + f"{i % 90:03}") for i in range(200)]
    rows += [("z", 1.0, "é" * 60), ("z", 1.0, "é" * 60 + "\0"), ("z", 1.0, "")]
    best = {}
    for g, s, i in rows:
        if s is not None and s == s:
            best[g, i] = max(s, best.get((g, i), s))
    want = []
    for g in "az":
        v = sorted(((-s, i.encode()) for (k, i), s in best.items() if k == g))
        want += [(g, n + 1, i.decode()) for n, (_, i) in enumerate(v[:5])]
    df = spark.createDataFrame(rows, "g string, s double, id string").repartition(3)
    assert sorted(tuple(r) for r in topn.top_n(df, ["g"], "s", "id", 5, ways=300).collect()) == sorted(want)


# leaks


def brute_leaks(docs, items, run):
    words = lambda t: leaks_words(t)
    out = {}
    for (d, t), (i, u) in itertools.product(docs, items):
        if t is None or u is None or d is None:
            continue
        a, b = words(t), words(u)
        best = 0
        for x in range(len(a)):
            for y in range(len(b)):
                n = 0
                while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                    n += 1
                best = max(best, n)
        if b and best >= min(run, len(b)):
            out[d, i] = best
    return out


def leaks_words(t):
    import regex

    return regex.findall(r"[\p{L}\p{M}\p{N}]+", t.lower())


def test_find_leaks(spark):
    rnd = random.Random(7)
    pool = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rnd.choice(pool) for _ in range(rnd.choice([1, 2, 3, 6, 9])))) for i in range(14)] + [(90, None), (91, " !! ")]
    docs = [(i, " ".join(rnd.choice([*pool, "other", "İstanbul"]) for _ in range(rnd.randrange(0, 60)))) for i in range(70)]
    docs += [(200 + i, f"x {u.upper().replace(' ', ' - ')}, y") for i, u in items if u] + [(300, None), (301, ""), (None, items[0][1])]
    d = spark.createDataFrame([(*r, 0) for r in docs + docs[:5]], "id bigint, text string, words int").repartition(4)
    i = spark.createDataFrame(items, "item bigint, words string")
    found = leaks.find_leaks(d, "id", "text", i, "item", "words", run=4)
    got = {(r.id, r.item): r for r in found.collect()}
    want = brute_leaks(docs, items, 4)
    assert {k: r.n_words for k, r in got.items()} == want
    text, item = dict(docs), dict(items)
    for (a, b), r in got.items():
        run = leaks_words(text[a])[r["at"] : r["at"] + r.n_words]
        assert " ".join(run) in " ".join(leaks_words(item[b]))
    assert leaks.find_leaks(d.limit(0), "id", "text", i, "item", "words").count() == 0
    assert leaks.find_leaks(d, "id", "text", i.limit(0), "item", "words").count() == 0
    named = leaks.find_leaks(d, "id", "text", i.selectExpr("concat('item ', item) AS item", "words"), "item", "words", run=4)
    assert {(r.id, r.item) for r in named.collect()} == {(a, f"item {b}") for a, b in want}
    left = {r.id for r in leaks.without_leaks(d, "id", found).collect()}
    assert left == {a for a, _ in docs} - {a for a, _ in want}


def test_suffix_order_is_that_of_whole_suffixes():
    import numpy as np

    rnd = np.random.default_rng(0)
    for _ in range(50):
        w = rnd.integers(0, 4, rnd.integers(1, 60))
        ends = np.append(np.flatnonzero(w == 0), len(w) - 1)
        whole = [w[i : ends[np.searchsorted(ends, i)] + 1].tolist() for i in leaks.suffix_order(w)]
        assert whole == sorted(whole)


# personal information

LINES = [
    ("my name is Ravi Sundgrenko and I run the stall", {("name", "Ravi Sundgrenko")}),
    ("Dr. Siân B. Tarnvald told me to rest", {("name", "Siân B. Tarnvald")}),
    ("Signed, Morvlund, Ingrid", {("name", "Morvlund, Ingrid")}),
    ("ask for QUOMA ZELLBURG at the counter", {("name", "QUOMA ZELLBURG")}),
    ("The Polite Invoices and Early Account Megathread open", set()),
    ("mail me (anna.lund+x@dept.office.example) or anna AT example DOT org", {("email", "anna.lund+x@dept.office.example"), ("email", "anna AT example DOT org")}),
    ("see icon@2x.png and @opal_echo and u/JonasLund", set()),
    ("write to a_b [at] mx [dot] invalid", {("email", "a_b [at] mx [dot] invalid")}),
    ("call me on +44 (0)7700 900 002 after six", {("phone", "+44 (0)7700 900 002")}),
    ("Tel.: (02) 5550 1035", {("phone", "(02) 5550 1035")}),
    ("whatsapp ８３６-５５５-０１７２ only", {("phone", "８３６-５５５-０１７２")}),
    ("Order no. 6828480610, lot 502227356004, epoch 1623064100, score 113-29-65, thread t3_zy has 027.499.190 views", set()),
    ("Seen from 192.0.2.148 at 2023-06-10 04:17, build 4.68.652", set()),
    ("the form shows SSN 932 52 7275 and insurance number QQ 37 56 12 A", {("id_number", "932 52 7275"), ("id_number", "QQ 37 56 12 A")}),
    ("passport no. S0517615 expires, tax ID QKUZQ5115H, DNI 00007400-A", {("id_number", "S0517615"), ("id_number", "QKUZQ5115H"), ("id_number", "00007400-A")}),
    ("parcel went to 671a Quillfeather Boulevard, Apt 4B", {("address", "671a Quillfeather Boulevard, Apt 4B")}),
    ("I live at Flat 26, 156 Marrow-Gate Ave. now; Saltcellarstraße 89; Calle de Grist 843; 616 rue des Lilas", {("address", "Flat 26, 156 Marrow-Gate Ave."), ("address", "Saltcellarstraße 89"), ("address", "Calle de Grist 843"), ("address", "616 rue des Lilas")}),
]


@pytest.fixture(scope="module")
def field():
    """The name field fitted to the documents of a small table, as the query fits it to its own."""
    import duckdb

    texts = [t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL ORDER BY doc_id").fetchall()]
    return names.fit(texts, [[(n.start, n.end) for n in personal.decide(personal.candidates(t))] for t in texts])


@pytest.mark.parametrize("text,want", LINES)
def test_personal_lines(field, text, want):
    assert {(n.kind, n.value) for n in personal.find(text, field)} == want


@pytest.mark.parametrize("before", ["My name is ", "Mr ", "Kind regards,\n", "Signed, "])
@pytest.mark.parametrize("name", ["Olufemi Adeyemi", "O. Adeyemi"])
def test_names_of_which_no_text_knows(field, before, name):
    assert [(n.kind, n.value) for n in personal.find(f"{before}{name} refused to pay.", field)] == [("name", name)]


@pytest.mark.parametrize("text", ["The Polite Invoices and Early Account Megathread open", "Well, I saw it", "see u/JonasLund and @opal_echo"])
def test_no_names(field, text):
    assert [n for n in personal.find(text, field) if n.kind == "name"] == []


def test_skip_edges_find_a_name_without_a_cue(field):
    """The name stands nowhere in the fitted sample; alone it isn't found, with a repetition that has a cue it is, whatever the distance."""
    weak = "* Quoma Zellburg Megathread\n"
    assert personal.find(weak, field) == []
    both = weak + "x " * 400 + "My name is Quoma Zellburg and I run the stall."
    assert [n.value for n in personal.find(both, field)] == ["Quoma Zellburg"] * 2
    assert len(field.spans(names.Runs([both], field.rates), skips=False)) == 1


@pytest.mark.parametrize("held", [0, 10**9])
def test_names_are_fitted_to_all_texts(spark, monkeypatch, held):
    """20,400 texts of which only a few, one of them of over 100,000 characters, teach anything: the field is that of all of them, whether the driver holds the runs or not."""
    import numpy as np

    monkeypatch.setattr(personal, "HELD", held)
    monkeypatch.setattr(names, "ROUNDS", 1)
    texts = [f"plain line {i} of the minutes" for i in range(20_000)] + [f"Old Harbour Road {i} and the mill" for i in range(200)] + [f"My name is Ravi Sund{x} and I sell" for x in "abcdefgh" * 24]
    texts += ["filler words " * 9000 + "Kind regards,\nQuoma Zellburg"] * 8
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(6)
    got, want = personal.fit_names(df, "id", "text"), names.fit(texts, [[(n.start, n.end) for n in personal.decide(personal.candidates(t))] if len(t) < 200 else [] for t in texts])
    assert np.allclose(got.w, want.w, atol=1e-3) and np.allclose(got.t, want.t, atol=1e-3) and math.isclose(got.skip, want.skip)
    assert {k: v for k, v in want.rates.items() if v != (0, 0) and k in got.rates} == got.rates
    word = 1 + (names.zlib.crc32(b"wzellburg") & ((1 << names.BITS) - 2))
    assert got.w[word].any()  # from the long texts alone


def test_beliefs_of_chains_are_exact(field):
    """Forward and backward sums against all labellings of a run."""
    import numpy as np

    runs = names.Runs(["Dr. Anna B. Lund-Berg, Mods"], field.rates)
    u, n = field.unary(runs), len(runs.words)
    p = np.zeros((n, 3))
    for y in itertools.product(range(3), repeat=n):
        s = sum(u[k, y[k]] for k in range(n)) + sum(field.t[runs.gap[k], y[k - 1], y[k]] for k in range(1, n))
        for k in range(n):
            p[k, y[k]] += math.exp(s)
    assert n == 5 and np.allclose(np.exp(field.chains(u, runs)), p / p.sum(axis=1, keepdims=True))


def test_shared_features_are_held_once_and_give_the_same_gradient(field):
    """Against sums token by token, feature by feature; parts that the driver joins, and those that are packed, too."""
    import numpy as np

    texts = [f"{a} Ravi{x} Sund{y}-Lund {b}" for a in ("My name is", "Dr.", "the") for x in ("", "n", "sh") for y in ("gren", "holm", "berg") for b in ("and I run the stall", "refused.")] + ["Old Harbour Road Market Hall, Well Street"] * 9
    batches = [names.batch(some, field.rates, lambda t: []) for some in (texts[:20], [], texts[20:])]
    whole = names.Batch.joined(batches)
    labels = whole.labels(field)
    own = names.Part(whole, labels)
    assert 0 < sum(t.size for _, t in own.groups) < own.bytes / 4 / 3  # of a feature's four bytes, a third at most is looked at in a step
    w = np.random.default_rng(1).normal(size=(1 << names.BITS, 3))
    w[0] = 0.0
    keep = np.logical_or.reduceat(labels >= 0, np.flatnonzero(whole.gap < 0))[np.cumsum(whole.gap < 0) - 1]
    index, weight = whole.index[keep], np.where(own.has, 3.0, 1.0)
    s = w[index].sum(axis=1)
    s[own.gap < 0, names.I] -= 20.0
    want, clamped = np.zeros_like(w), s + np.where((own.y >= 0)[:, None] & (np.arange(3) != own.y[:, None]), -40.0, 0.0)
    np.add.at(want, index, ((np.exp(field.chains(s, own)) - np.exp(field.chains(clamped, own))) * weight[own.run][:, None])[:, None, :])
    parts = [names.Part(b, b.labels(field)) for b in batches]
    moved = own.gradient(field, w, 3.0)[1]
    for some in ([own], [names.Part.unpacked(own.packed())], [names.Part.joined([p for p in parts if p.count])], [names.Part.joined(parts)], parts):
        seen, d, dt = names.summed(some, field, w, 3.0)
        assert np.allclose(d[1:], want[1:], atol=1e-6) and np.allclose(dt, moved) and seen[np.unique(index)].all()


def test_steps_of_tasks_leave_no_weights_and_keep_to_few_tasks(spark, monkeypatch):
    import pyspark

    gone, tasks, destroy, totals = [], [], pyspark.Broadcast.destroy, personal._totals
    monkeypatch.setattr(pyspark.Broadcast, "destroy", lambda b, *a: (gone.append(b.value.shape), destroy(b, *a)))
    monkeypatch.setattr(personal, "_totals", lambda parts, *x: (tasks.append(parts.rdd.getNumPartitions()), totals(parts, *x))[1])
    for k, v in (("STEPS", 3), ("MORE", 2), ("ROUNDS", 1)):
        monkeypatch.setattr(names, k, v)
    monkeypatch.setattr(personal, "HELD", 0)
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # a task a file
    try:
        df = spark.createDataFrame([(i, f"My name is Ravi Sund{'abcdefgh'[i % 8]} and I sell") for i in range(800)], "id int, text string").repartition(12)
        assert personal.fit_names(df, "id", "text").w.any()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert gone == [(1 << names.BITS, 3)] * 5
    assert tasks == [spark.sparkContext.defaultParallelism] * 5


def test_words_are_counted_as_in_whole_texts():
    import regex

    rnd = random.Random(3)
    bits = ["word", "Word", "two-part", "don’t", "it's", "a/b", "x.y", "end.", "u@v.w", "＠", "İstanbul", "हिन्दी", "中文字", "\x1c", "\u00a0", " ", "\n", "O'Neil", "Ann", "Lund", "_a", "1b"]
    texts = [None, "", *("".join(rnd.choice(bits) + rnd.choice(["", " ", "  "]) for _ in range(rnd.randrange(1, 25))) for _ in range(3000))]
    lower, whole, inside = names.word_counts(texts)
    want = [{}, {}]
    for t in filter(None, texts):
        if "@" in t or "＠" in t:
            t = "".join(x for x in regex.split(r"(\s)", t) if "@" not in x and "＠" not in x)
        words = set(regex.findall(r"(?<![\w'’@/.-])[\p{L}\p{M}]+(?![\w@/]|\.\w)", t))
        for n, some in enumerate(({w for w in words if w[0].islower()}, {w.lower() for w in words})):
            for w in some:
                want[n][w] = want[n].get(w, 0) + 1
    assert [dict(lower), dict(whole)] == want and inside["lund"] > 0
    names._words.cache_clear()
    names.word_counts(["the same words again"] * 500)
    assert names._words.cache_info()[:2] == (0, 4)  # each piece once, not once for each text


def test_patterns_that_cannot_match_are_not_run(monkeypatch):
    class Never:
        def finditer(self, *a):
            raise AssertionError(a)

    plain = "We met at noon, lot 12 of 345, on the 6th; ABCDE and 99"
    want = personal.candidates("a at b dot c, (at) x.y, QKUZQ5115H, ８３６-５５５-０１７２")
    assert [(n.kind, n.value) for n in want if n.odds > 0] == [("email", "a at b dot c"), ("id_number", "QKUZQ5115H"), ("phone", "８３６-５５５-０１７２")]
    for k in ("EMAIL", "_LETTERED", "_RUN"):
        monkeypatch.setattr(personal, k, Never())
    assert personal.candidates(plain) == []
    monkeypatch.setattr(names, "_SEED", Never())
    names.batch(["drums Hall Road regards Hall Road"], {}, lambda t: [])  # no cue begins a word


@pytest.mark.parametrize("cue", ["Mr ", "dr. ", "SIGNED, ", "\u017figned, ", "NAME I\u017f ", "Señora ", "ICH HEI\u1e9eE ", "je m’appelle ", "thanks,\n", "(Ms "])
def test_cues_are_seen_in_any_case(cue):
    import numpy as np

    text = f"so {cue}Quoma Zellburg"
    assert names._SEED.search(text) and names._cued(text)
    assert np.array_equal(names.batch([text], {}, lambda t: []).given[-2:], [names.B, names.I])


def test_an_unfitted_field_finds_nothing():
    empty = names.fit([None, "", "no capitals here"], [[], [], []])
    assert personal.find_all(["My name is Ravi Sund", None, ""], empty) == [[], [], []]


def test_spans_of_one_kind_repeat(field):
    odds = [-1.0, 6.0]
    free, tied = personal.beliefs(odds, []), personal.beliefs(odds, [(0, 1, 0.0, -personal.REPEAT)])
    assert tied[0] > free[0] and free == odds


def test_message_passing_is_exact_on_trees():
    rnd = random.Random(8)
    odds = [rnd.uniform(-2, 2) for _ in range(6)]
    edges = [(i, rnd.randrange(i + 1, 6), rnd.uniform(-2, 2), rnd.uniform(-2, 2)) for i in range(5)]
    z = [[0.0, 0.0] for _ in odds]
    for y in itertools.product((0, 1), repeat=6):
        e = sum(o for o, v in zip(odds, y) if v) + sum(b if y[i] and y[j] else o if y[i] != y[j] else 0.0 for i, j, b, o in edges)
        for n, v in enumerate(y):
            z[n][v] += math.exp(e)
    want = [math.log(b / a) for a, b in z]
    monkey, personal.ROUNDS = personal.ROUNDS, 80
    try:
        got = personal.beliefs(odds, edges)
    finally:
        personal.ROUNDS = monkey
    assert all(math.isclose(a, b, abs_tol=0.02) for a, b in zip(got, want))


def test_personal_tables(spark, field):
    long = "filler words " * 5000 + "my name is Ravi Sundgrenko and I run the stall"
    df = spark.createDataFrame([(1, "mail a@b.example, again a@b.example", 0), (2, None, 0), (3, "", 0), (4, long, 0)], "id int, text string, kind int")
    assert sorted(tuple(r) for r in personal.find_personal(df, "id", "text", field).collect()) == [(1, "email", "a@b.example"), (4, "name", "Ravi Sundgrenko")]
    out = {r.id: r.text for r in personal.redacted(df, "id", "text", field).collect()}
    assert out[1] == "mail [EMAIL], again [EMAIL]" and out[2] is None and out[3] == "" and out[4].endswith("my name is [NAME] and I run the stall")
    assert personal.find_personal(df.limit(0), "id", "text").count() == 0
    assert sorted(r.kind for r in personal.find_personal(df, "id", "text").collect()) in (["email"], ["email", "name"])  # fitted to these four rows
