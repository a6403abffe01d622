import random
import zlib
from collections import defaultdict

import pytest
from brute import prose, targets, words
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from ringforge.llm import mixing, sharding
from ringforge.llm.queries import QUERIES


def check_mix(got, rows, slack):
    size, by = defaultdict(int), {}
    for d, t, _, s in rows:
        size[s] += len(words(t))
    want = targets(dict(size))
    taken = defaultdict(int)
    src = {d: (s, t) for d, t, _, s in rows}
    for r in got:
        s, t = src[r.doc_id]
        assert r.size == len(words(t)) and r.source_size == size[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
        by[s] = max(by.get(s, 0), r.size)
    for s in size:
        assert abs(taken[s] - want[s]) <= max(by[s] * slack, 1)


def test_mix(spark, docs_of):
    rng = random.Random(5)
    rows = [(k, prose(k, rng.randint(1, 60)), "en", rng.choice(["b", "b", "b", "a", "ü", "Z", "", None, "c", "d"])) for k in range(600)] + [(1000, None, "en", "a"), (1001, "", "en", "empty"), (1002, prose(1, 20_000), "en", "huge")]
    got = mixing.mix(docs_of(rows)).collect()
    assert len(got) == len(rows)
    check_mix(got, rows, 1)
    assert sorted(got) == sorted(mixing.mix(docs_of(rows[::-1])).collect())  # reruns agree
    assert mixing.mix(docs_of([])).count() == 0
    only = mixing.mix(docs_of([(1, "", "en", "a"), (2, None, "en", None)])).collect()
    assert {(r.doc_id, r.target, r.taken) for r in only} == {(1, 0, 0), (2, 0, 0)}


def test_mix_odd_rows(spark, docs_of):
    rows = [(None, "a b c", "en", "s"), (3, "x y", "en", "s"), (3, "x y", "en", "s"), (4, "one", "en", "t")]
    got = mixing.mix(docs_of(rows)).collect()
    assert len(got) == 4
    twins = [r for r in got if r.doc_id == 3]
    assert twins[0] == twins[1]  # rows of one id share their fate


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 500), min_size=1, max_size=60), st.integers(1, 8))
def test_packing(sizes, shards):
    sizes = sorted(sizes, reverse=True)
    got = sharding.pack(sizes, shards)
    load = [sum(s for s, b in zip(sizes, got, strict=True) if b == k) for k in range(shards)]
    assert len(got) == len(sizes) and max(got) < shards
    fair = max(sizes[0], -(-sum(sizes) // shards))
    assert max(load) <= 2 * fair
    if shards * 4 < len(sizes) and sizes[0] * 8 < fair:
        assert max(load) <= 1.15 * fair


def slow_best_fit(sizes, capacity):
    left, out = [], []
    for s in sizes:
        fit = [(c, k) for k, c in enumerate(left) if c >= s]
        if fit:
            _, k = min(fit)
        else:
            left.append(capacity)
            k = len(left) - 1
        left[k] -= s
        out.append(k)
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=300))
def test_tree_equals_a_plain_search(sizes):
    sizes = sorted(sizes, reverse=True)
    assert sharding.best_fit_decreasing(sizes, 100) == slow_best_fit(sizes, 100)


def check_shards(got, rows, spread):
    assert len(got) == len(rows)
    where, load, slots = {}, defaultdict(int), defaultdict(list)
    text = defaultdict(list)
    for d, t in rows:
        text[d].append(t or "")
    for r in got:
        t = next(x for x in text[r.doc_id] if len(x.encode()) + 1 == r.size)
        assert r.text_crc32 == zlib.crc32(t.encode()) and r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16
        assert where.setdefault(t, r.shard) == r.shard
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    assert max(load.values()) - min(load.values()) <= spread * max(load.values())


def test_shards(spark, docs_of):
    rng = random.Random(8)
    rows = [(k, prose(k % 500, rng.randint(5, 5 + k % 300) if k >= 500 else 40)) for k in range(1500)] + [(5000, None), (5001, ""), (None, "x"), (7, "é" * 500)]
    check_shards(sharding.shard(docs_of(rows)).collect(), rows, 0.02)
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.shard(docs_of(rows[::-1])).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in sharding.shard(docs_of(rows)).collect()}
    assert sharding.shard(docs_of([])).count() == 0


def test_a_group_above_a_fair_part_has_its_own_shard(spark, docs_of):
    rows = [(k, "same text " * 30) for k in range(300)] + [(1000 + k, prose(k, 50)) for k in range(300)]
    got = sharding.shard(docs_of(rows)).collect()
    big = {r.shard for r in got if r.doc_id < 300}
    assert len(big) == 1 and all(r.shard not in big for r in got if r.doc_id >= 300)


def test_whole_tables(spark, sf):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_mix(QUERIES["op9_mix_sources"](spark, sf).collect(), rows, 1)
    check_shards(QUERIES["op10_sharding"](spark, sf).collect(), [r[:2] for r in rows], 0.02)


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen, df = {}, docs
    for name, f in corpus_pipeline.STAGES:
        df = f(spark, df, sf).persist()
        seen[name] = df
        if name != "sharding":
            assert df.columns == docs.columns
    n = {k: v.count() for k, v in seen.items()}
    assert docs.count() >= n["language_id"] >= n["ngram_jaccard_join"] >= n["benchmark_decontamination"] > 0
    near = {r.component_id for r in QUERIES["op2_ngram_jaccard_join"](spark, sf).collect()}
    assert {r.doc_id for r in seen["ngram_jaccard_join"].collect()} <= near
    leaks = {r.doc_id for r in QUERIES["op7_decontaminate"](spark, sf).collect()}
    assert leaks.isdisjoint({r.doc_id for r in seen["benchmark_decontamination"].collect()})
    mixed = seen["mix_sources"].groupBy("doc_id").count().agg({"count": "max"}).first()[0]
    assert mixed <= 2 and n["sharding"] == n["mix_sources"]
    assert corpus_pipeline.run(spark, sf).count() == n["sharding"]
