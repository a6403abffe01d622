import hashlib
import random

import duckdb
import numpy as np
import pytest
from brute import near_duplicates, prose, words
from hypothesis import given, settings
from hypothesis import strategies as st

from ringforge.llm import common, exact_dedup, ngram_join
from ringforge.llm import words as hashing
from ringforge.llm.queries import QUERIES, SQL


def changed(text, seed, n):
    rng, w = random.Random(seed), text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbZé \t\n ,", max_size=30), max_size=6))
def test_word_hashes_tell_words_apart(texts):
    import pyarrow as pa

    data, off = hashing.text_buffers(pa.array(texts, pa.string()))
    h, wo = hashing.word_hashes(data, off)
    want = [w for t in texts for w in words(t)]
    assert len(h) == len(want) and np.diff(wo).tolist() == [len(words(t)) for t in texts]
    assert len(set(h.tolist())) == len(set(want))


def hashed(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_near_duplicates_equal_brute_force(spark, docs_of, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", 4)  # so that long lists, hubs and the rest are met
    rows, k = [], 0
    for g in range(6):
        base = prose(g, 80)
        for j in range(14):
            rows.append((k, changed(base, k, j % 6)))
            k += 1
    rows += [(k + i, prose(1000 + i, 30)) for i in range(20)]
    k += 20
    rows += [(k, "one two"), (k + 1, "One  TWO"), (k + 2, "one"), (k + 3, ""), (k + 4, None), (k + 5, " \n"), (k + 6, "one two three four five"), (k + 7, prose(0, 80))]
    got = hashed(ngram_join.near_duplicates(docs_of(rows)))
    assert got == near_duplicates(rows)


def test_near_duplicates_odd_rows(spark, docs_of):
    t = prose(5, 40)
    rows = [(3, t), (3, t), (7, t + " more"), (None, t), (9, "x" * 200_000 + " " + t)]
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.near_duplicates(docs_of(rows)).collect()), key=str)
    assert got == sorted([(3, 3), (3, 3), (7, 3), (None, None), (9, 3)], key=str)
    assert ngram_join.near_duplicates(docs_of([])).count() == 0
    kept = [r.doc_id for r in ngram_join.one_of_each(docs_of(rows)).collect()]
    assert sorted(kept, key=str) == [3, None]


def test_near_duplicates_whole_table(spark, sf):
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    assert hashed(QUERIES["op2_ngram_jaccard_join"](spark, sf)) == near_duplicates(rows)


def test_sketch_is_a_lower_bound():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.integers(0, len(a), 300)], rng.integers(0, 2**63, 50, dtype=np.uint64)]))
        x, y = (np.unpackbits(np.frombuffer(ngram_join._sketch(s), np.uint8)) for s in (a, b))
        assert (x != y).sum() <= len(np.setxor1d(a, b))


def test_components(spark):
    ws = common.Workspace(spark, "t")
    chain = [(i, i + 1) for i in range(60)] + [(100 + i, 100) for i in range(1, 40)] + [(200, 201), (202, 201), (200, 202)]
    random.Random(3).shuffle(chain)
    got = {r.node: r.component for r in common.components(ws, spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(40)} | {200: 200, 201: 200, 202: 200}
    assert common.components(ws, spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=5000), st.binary(max_size=5000))
def test_fingerprints_combine(x, y):
    f = lambda b: exact_dedup.fingerprint(np.frombuffer(b, np.uint8))
    assert exact_dedup.combine(f(x), f(y)) == f(x + y)
    slow = [len(x), 0, 0]
    for c in x:
        slow[1:] = [(h * b + c) % exact_dedup.P for h, b in zip(slow[1:], exact_dedup.BASES, strict=True)]
    assert tuple(slow) == f(x)


def test_fingerprint_of_a_huge_document():
    x = np.random.default_rng(0).integers(0, 256, 3_000_001).astype(np.uint8)
    a = exact_dedup.fingerprint(x)
    assert a == exact_dedup.combine(exact_dedup.fingerprint(x[:1_234_567]), exact_dedup.fingerprint(x[1_234_567:]))


def exact(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


def sha(t):
    return hashlib.sha256((t or "").encode()).hexdigest()


def test_exact_duplicates(spark, docs_of):
    big = "é" * 100_000
    rows = [(1, "a"), (5, "a"), (3, "a"), (2, "b"), (4, None), (6, ""), (None, "a"), (None, "z"), (8, "q"), (8, "q"), (9, big), (10, big), (11, big[:-1] + "e")]
    got = exact(exact_dedup.exact_duplicates(docs_of(rows)))
    want = [(1, 5, 4, False, sha("a")), (5, 5, 4, True, sha("a")), (3, 5, 4, False, sha("a")), (None, 5, 4, False, sha("a")), (2, 2, 1, True, sha("b")), (4, 6, 2, False, sha("")), (6, 6, 2, True, sha("")), (None, None, 1, True, sha("z")),
            (8, 8, 2, True, sha("q")), (8, 8, 2, False, sha("q")), (9, 10, 2, False, sha(big)), (10, 10, 2, True, sha(big)), (11, 11, 1, True, sha(big[:-1] + "e"))]
    assert got == sorted(want, key=str)
    assert exact_dedup.exact_duplicates(docs_of([])).count() == 0


def test_colliding_fingerprints_are_told_apart(spark, docs_of, monkeypatch):
    real = exact_dedup.fingerprints
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "fingerprints", lambda d: real(d).withColumns({"n_bytes": F.lit(1).cast("long"), "f1": F.lit(0).cast("long"), "f2": F.lit(0).cast("long")}))
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, "c"), (5, "b"), (6, "d")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs_of(rows)).collect()}
    assert got == {1: (3, 2, False), 3: (3, 2, True), 2: (5, 2, False), 5: (5, 2, True), 4: (4, 1, True), 6: (6, 1, True)}


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    a, b = QUERIES[name](spark, sf).toPandas(), con.execute(SQL[name]).df()
    key = lambda d: sorted(map(repr, d[sorted(d.columns)].round(6).itertuples(index=False, name=None)))
    assert key(a) == key(b)


def test_hot_shingles_in_blocks(spark, docs_of, monkeypatch):
    """Shingles count as hot from three sets on: their lists are dealt in blocks, and no link is lost."""
    import random

    monkeypatch.setattr(ngram_join, "HOT", 3)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(40)]
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(40)] = f"x{rng.randrange(300)}"
        rows.append((k, " ".join(w)))
    rows += [(1000 + k, " ".join(base[:20]) + f" tail{k} " + " ".join(f"y{k}z{j}" for j in range(30))) for k in range(40)] + [(2000 + k, rows[k][1]) for k in range(20)]
    want = near_duplicates(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs_of(rows)).collect()}
    assert got == want


def test_components_of_odd_graphs(spark):
    from ringforge.llm import common

    ws = common.Workspace(spark, "test")
    edges = [(k, k + 1) for k in range(3000)] + [(10_000, 10_001 + k) for k in range(3000)] + [(-5, -9), (-9, 20_000), (7, 7), (30_001, 30_000), (30_000, 30_001)]
    got = {r.node: r.component for r in common.components(ws, spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    want = {k: 0 for k in range(3001)} | {k: 10_000 for k in range(10_000, 13_001)} | {-5: -9, -9: -9, 20_000: -9, 30_000: 30_000, 30_001: 30_000}
    assert got == want


def test_one_of_each_odd_rows(spark):
    rows = [(1, "a b c d e f", "x", "p"), (1, "other words than those before", "x", "p"), (1, "a b c d e f", "y", "p"), (2, "a b c d e f", "z", "p"), (None, "a b c d e f", "n", "p"), (None, None, "n", "p"), (5, None, None, "p"), (6, "", "s", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, text_hash string")
    got = ngram_join.one_of_each(docs)
    assert got.columns == docs.columns
    kept = sorted(map(tuple, got.collect()), key=str)
    assert [(r[0], r[1]) for r in kept] == sorted([(1, "a b c d e f"), (1, "other words than those before"), (None, "a b c d e f"), (None, None), (5, None), (6, "")], key=str)
    again = sorted(map(tuple, ngram_join.one_of_each(docs.repartition(5)).collect()), key=str)
    assert again == kept
    assert ngram_join.one_of_each(docs.limit(0)).count() == 0


def test_large_groups_of_copies_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SALT", 3)
    monkeypatch.setattr(exact_dedup, "REPEATED", 4)
    rows = [(k, "same") for k in range(40)] + [(None, "")] * 23 + [(None, None)] * 5 + [(7, "same")] * 9 + [(100, "other"), (101, "x" * 200_000), (102, "x" * 200_000), (103, "x" * 199_999 + "y")]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for text, keep, size in (("same", 39, 49), ("", None, 28), ("other", 100, 1), ("x" * 200_000, 102, 2), ("x" * 199_999 + "y", 103, 1)):
        g = by[sha(text)]
        assert len(g) == size and {(r.keep_id, r.group_size) for r in g} == {(keep, size)}
        assert [r.doc_id for r in g if r.kept] == [keep]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=60))
def test_suffix_filter_bounds_from_below(a, b, c):
    x, y = (np.array(sorted(z), np.uint64) for z in (a | c, b | c))
    assert ngram_join.apart(x, y) <= len((a | c) ^ (b | c))
    assert ngram_join.apart(x, x) == 0
