import hashlib
import random

import duckdb
import numpy as np
from brute import base_spans, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from ringforge.llm import decontaminate, pii
from ringforge.llm.queries import QUERIES

ITEM = "Which of these rivers flows through the largest city in the north, and into which sea does it flow at last?"


def slow_tiles(a, b, least):
    """Greedy string tiling as first described: all maximal matches of unmarked tokens, longest first."""
    fa, fb, out = [True] * len(a), [True] * len(b), []
    while True:
        best, found = least, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and fa[i + n] and fb[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best:
                    found.append((i, j))
        done = False
        for i, j in found:
            if all(fa[i : i + best]) and all(fb[j : j + best]):
                out.append(best)
                fa[i : i + best] = [False] * best
                fb[j : j + best] = [False] * best
                done = True
        if not done:
            return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=14), st.lists(st.integers(1, 4), max_size=40), st.integers(1, 4))
def test_tiles_cover_what_greedy_tiling_covers(a, b, least):
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    got = decontaminate.tiles(x, y, least)
    used_a, used_b = [0] * len(a), [0] * len(b)
    for i, j, n in got:
        assert n >= least and (x[i : i + n] == y[j : j + n]).all()
        for k in range(n):
            used_a[i + k] += 1
            used_b[j + k] += 1
    assert max(used_a, default=0) <= 1 and max(used_b, default=0) <= 1
    assert [n for _, _, n in got] == slow_tiles(a, b, least)


def test_tiles_of_repeated_words_and_long_texts():
    import time

    one, rng = np.full(400, 7, np.uint64), np.random.default_rng(1)
    t = time.perf_counter()
    assert [x[2] for x in decontaminate.tiles(one, np.full(100_000, 7, np.uint64))] == [400]
    broken = np.full(100_000, 7, np.uint64)
    broken[::37] = 9
    assert sum(x[2] for x in decontaminate.tiles(one, broken)) == 400
    few = rng.integers(0, 3, 20_000).astype(np.uint64)
    got = decontaminate.tiles(rng.integers(0, 3, 400).astype(np.uint64), few)
    assert sum(x[2] for x in got) > 300
    assert time.perf_counter() - t < 10


def test_seeds_that_very_many_items_share(spark, docs_of):
    import time

    items = [(k, f"which of the following words is right {prose(k, 14)}") for k in range(3000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(k, "which of the following words is right " * 200 + prose(10_000 + k, 100)) for k in range(30)] + [(100, prose(99_999, 30) + " " + items[7][1])]
    t = time.perf_counter()
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs_of(rows), bench).collect()}
    assert (100, 7) in got and time.perf_counter() - t < 60
    assert all(i == 7 for d, i in got if d == 100)


def test_short_items(spark, docs_of):
    bench = spark.createDataFrame([(1, "Quokka!"), (2, "blue whale"), (3, "a b c"), (4, " . "), (5, "one two three four")], "item_id long, text string")
    rows = [(1, "the quokka sleeps"), (2, "a blue, whale"), (3, "whale blue"), (4, "b c a b"), (5, "x a b c y"), (6, "zero one two three four five"), (7, "one two three"), (8, None)]
    assert {(r.doc_id, r.item_id, r.coverage) for r in decontaminate.leaks(docs_of(rows), bench).collect()} == {(1, 1, 1.0), (2, 2, 1.0), (5, 3, 1.0), (6, 5, 1.0)}
    assert sorted(r.doc_id for r in decontaminate.clean(docs_of(rows), bench, block_bytes=8).collect()) == [3, 4, 7, 8]


def test_leaks(spark, docs_of):
    w = ITEM.split()
    parts = [w[:7], w[7:14], w[14:]]
    moved = " ".join(prose(9, 5) + " " + " ".join(p) for p in (parts[2], parts[0], parts[1]))
    rows = [(1, prose(1, 200) + " " + ITEM + " " + prose(2, 50)), (2, ITEM.upper().replace(",", "")), (3, moved), (4, " ".join(w[:6]) + " " + prose(4, 100)), (5, prose(5, 300)), (6, None), (7, ""), (None, ITEM), (8, (prose(8, 50_000) + " " + ITEM)), (1, "clean")]
    bench = spark.createDataFrame([(10, ITEM, "x"), (11, "too short", "x"), (12, None, "x"), (13, prose(77, 30), "x"), (14, "", "x")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs_of(rows), bench).collect()}
    assert got == {(1, 10), (2, 10), (3, 10), (8, 10)}
    blocks = decontaminate.leaks(docs_of(rows), bench, block_bytes=64)
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == got
    kept = decontaminate.clean(docs_of(rows), bench)
    assert kept.columns == docs_of(rows).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([4, 5, 6, 7, 1], key=str)
    assert decontaminate.leaks(docs_of([]), bench).count() == 0 and decontaminate.leaks(docs_of(rows), bench.limit(0)).count() == 0


def test_leaks_whole_table(spark, sf):
    """Against a plain count of shared token 4-grams: nearly all of an item, or nearly none."""
    import re

    tok = lambda t: re.findall(r"[^\s!-/:-@\[-`{-~]+", t.lower())
    items = {i: tok(t) for i, t in duckdb.sql(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall()}
    grams = lambda w: {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
    want = set()
    for d, t in duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall():
        g = grams(tok(t))
        want |= {(d, i) for i, w in items.items() if len(grams(w) & g) >= 0.8 * len(grams(w))}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op7_decontaminate"](spark, sf).collect()}
    assert got == want and got


ALPHABET = "ab1230459.@+- ()%é\n"


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet=ALPHABET, max_size=60), st.lists(st.sampled_from(["4207051279108084", "a.b@c-d.ef", "1.2.3.4", "+1 (705) 555-6638", "@", ".", "256.1.1.1", " ", "x@y", "12-34", "+"]), max_size=8).map("".join)))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == base_spans(text)


def test_pii_whole_table(spark, sf):
    rows = dict(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())
    for r in QUERIES["op8_pii"](spark, sf).collect():
        want = base_spans(rows[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in want) for j in range(4)]
        text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))


def test_pii_adds_spans_and_leaves_clean_text_alone(spark, docs_of):
    rng = random.Random(2)
    rows = [(k, f"Please call our office at ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)} or write to jane.doe [at] example [dot] org about this") for k in range(40)]
    rows += [(100 + k, prose(k, 80)) for k in range(40)] + [(200 + k, f"see version {rng.randint(100, 999)} {rng.randint(100, 999)} {rng.randint(100, 999)} of the part") for k in range(40)]
    rows += [(900, None), (901, ""), (None, "mail me: a@b.co"), (902, "1" * 300_000), (903, "a" * 200_000 + "@"), (904, "+1 " * 50_000)]
    got = {r.doc_id: r for r in pii.find(docs_of(rows)).collect()}
    assert len(got) == len(rows)
    assert np.mean([got[k].n_added == 2 for k in range(40)]) > 0.9
    assert all(got[100 + k].spans == "" for k in range(40)) and sum(got[200 + k].n_added for k in range(40)) <= 4
    assert got[None].n_email == 1 and got[900].spans == "" and got[900].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find(docs_of([])).count() == 0


def test_reliabilities_find_the_good_labeler():
    rng = random.Random(1)
    n = {}
    for _ in range(4000):
        y = rng.random() < 0.4
        v = "".join(("1" if (y if rng.random() < a else not y) else "0") for a in (0.95, 0.9, 0.85)) + "----"
        n["name:" + v] = n.get("name:" + v, 0) + 1
    post = pii.reliabilities(sorted(n.items()))
    assert post["name:111----"] > 0.95 and post["name:000----"] < 0.05 and post["name:110----"] > post["name:001----"]


def test_reliabilities_and_prior_are_of_each_kind():
    """Two kinds with the same labelers: what is reliable for one is noise for the other, and one is rare."""
    rng = random.Random(3)
    n = {}
    for kind, prior, right in (("iban", 0.9, (0.95, 0.55, 0.9)), ("secret", 0.15, (0.55, 0.95, 0.9))):
        for _ in range(6000):
            y = rng.random() < prior
            v = "".join("-" if rng.random() < 0.2 else ("1" if (y if rng.random() < a else not y) else "0") for a in right)
            n[f"{kind}:{v}"] = n.get(f"{kind}:{v}", 0) + 1
    post = pii.reliabilities(sorted(n.items()))
    assert post["iban:101"] > 0.9 > post["iban:010"] + 0.4 and post["secret:011"] > 0.8 > post["secret:100"] + 0.6
    assert post["iban:---"] > 0.5 > post["secret:---"]
    assert pii.reliabilities([]) == {}


def slow_added(text):
    """Candidates by trying each pattern in turn and comparing with every span before it."""
    base = base_spans(text)
    out = []
    for kind, pattern in pii._CANDIDATES:
        for m in pattern.finditer(text):
            first = m[0].split(" ")[0].rstrip(".").lower()
            if kind == "secret" and not (any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])) or kind == "name" and first not in pii._TITLES | set(pii.GAZETTEERS["given"].split()):
                continue
            if all(m.end() <= s or e <= m.start() for s, _, e in base) and all(m.end() <= s or e <= m.start() for s, _, e in out):
                out.append((m.start(), pii.MORE.index(kind), m.end()))
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["(555) 123-4567", "555-123-4567", "a.b@c.de", "jo [at] x [dot] org", "123-45-6789", "DE44 5001 0517 5407 3249 31", "Dr. Anna Berg", "Anna Berg", "token = deadbeef0123456789abcdef", "1.2.3.4", "of", ", "]), max_size=14))
def test_candidates_equal_a_slow_search(parts):
    text = " ".join(parts)
    assert [x[:3] for x in pii.candidates(text, pii.base_spans(text))] == slow_added(text)


def test_pii_time_is_in_proportion():
    import time

    text = "call (555) 123-4567 or 123-45-6789, " * 20_000
    t = time.perf_counter()
    assert len(pii.candidates(text, pii.base_spans(text))) == 40_000
    assert time.perf_counter() - t < 30


def test_pii_kinds(spark, docs_of):
    rng = random.Random(7)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    iban = lambda: next(x for x in (f"DE{k:02d}{bban}" for bban in [digits(18)] for k in range(2, 99)) if pii._iban_ok(x))
    make = [lambda: f"transfer to account IBAN {iban()} today", lambda: f"my social security number {rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)} is private", lambda: "yesterday Dr. Maria Weber said so",
            lambda: f'token = "{rng.getrandbits(160):040x}" thh', lambda: f"commit {rng.getrandbits(160):040x} checksum sha", lambda: "He went. The House was open and Green Trees stood"]
    rows = [(100 * j + k, prose(k, 20) + " " + f() + " " + prose(k + 1, 20)) for j, f in enumerate(make) for k in range(60)]
    got = {r.doc_id: r for r in pii.find(docs_of(rows)).collect()}
    for j, kind in enumerate(("iban", "national_id", "name", "secret")):
        assert np.mean([kind in got[100 * j + k].spans for k in range(60)]) > 0.9, kind
    assert sum(got[400 + k].n_spans for k in range(60)) <= 6 and sum(got[500 + k].n_spans for k in range(60)) <= 6
