"""The pipeline's stages on odd rows, and the whole of it against plain versions."""

import random
import zlib
from collections import Counter

import pytest
import xxhash
from brute import near_duplicates, prose, targets, words
from pyspark.sql import functions as F
from test_leaks_and_pii import slow_tiles

import corpus_pipeline
from ringforge.llm import decontaminate, langid, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _copy long, key string, row string, bundle int, held_out boolean, salt int"
EXTRA = (None, 1, "k", "r", 2, True, None)
BENCH = "Which of these rivers flows through the largest city in the north, and into which sea does it flow at last?"


def table(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def bench_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    items = [(1, BENCH), (2, prose(900, 30)), (3, None), (4, ""), (None, prose(901, 12))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), items


def odd_rows():
    rng = random.Random(3)
    rows = [(k, prose(k, rng.randint(8, 60)), "ab"[k % 2] * 2, rng.choice(["web", "web", "web", "books", None])) for k in range(120)]
    rows += [(200 + k, rows[k][1], "aa", "web") for k in range(20)]  # copies
    rows += [(300 + k, rows[k][1] + " " + prose(k + 50, 2), "bb", "books") for k in range(20)]  # near copies
    rows += [(400, prose(7, 20) + " " + BENCH, "aa", "web"), (401, "x " * 30_000 + prose(8, 500), "aa", "web"), (402, "one", None, None), (403, prose(30, 40), None, "books")]
    rows += [(None, prose(500, 30), "aa", "web"), (None, prose(501, 30), None, None), (500, None, "aa", "web"), (501, "", "bb", "web"), (502, " \n\t ", "bb", None), (503, "12 34 !", "aa", "web")]
    rows += [(3, rows[3][1], "bb", "web")] * 2 + [(5, prose(777, 25), "bb", "books")]  # repeated rows, and an id with two texts
    return rows


def slow_stage(name, rows, items, model):
    """Rows (doc_id, text, lang, source) that a stage keeps, sorted; for mixing only what is fixed."""
    if name == "language_id":
        import pyarrow as pa

        gone = langid._verdicts(model, pa.array([r[1] for r in rows], pa.string()))[2]
        return [r for r, g in zip(rows, gone, strict=True) if not g]
    if name == "ngram_jaccard_join":
        # rows of one id are one node: link their texts by hand
        texts = {}
        for d, t, *_ in rows:
            if d is not None:
                texts.setdefault(d, []).append(t)
        flat = [((d, k), t) for d, ts in texts.items() for k, t in enumerate(ts)]
        of = near_duplicates(flat)
        parent = {d: d for d in texts}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for (d, _), (_, (e, _)) in of.items():
            p, q = sorted((root(d), root(e)))
            parent[q] = p
        kept, seen = [], set()
        for r in rows:
            if r[0] is None or root(r[0]) == r[0] and (r[0], r[1]) not in seen:
                kept.append(r)
                seen.add((r[0], r[1]))
        return kept
    if name == "benchmark_decontamination":
        toks = [decontaminate.tokens(t).tolist() for _, t in items if t]

        def leaks(text):
            w = decontaminate.tokens(text).tolist()
            return any(t and sum(slow_tiles(t, w, min(4, len(t)))) >= 0.6 * len(t) for t in toks)

        return [r for r in rows if r[1] is None or not leaks(r[1][:3000] + " " + r[1][-3000:] if len(r[1]) > 6000 else r[1])]
    raise KeyError(name)


def by_row(rows):
    return Counter((d, t) for d, t, *_ in rows)


def test_stages_equal_plain_versions(spark, bench_dir):
    path, items = bench_dir
    docs = table(spark, odd_rows())
    model = langid.learn(docs.select("doc_id", "text", "lang"))
    rows = odd_rows()
    for name, stage in corpus_pipeline.STAGES[:3]:
        want = slow_stage(name, rows, items, model)
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        got = [tuple(r)[:4] for r in out.collect()]
        assert by_row(got) == by_row(want), name
        assert all(tuple(r)[4:] == EXTRA for r in out.collect())
        docs, rows = spark.createDataFrame([(*r, *EXTRA) for r in sorted(got, key=str)], SCHEMA), sorted(got, key=str)
    out = corpus_pipeline.mix_sources(spark, docs, path)
    assert out.columns == docs.columns
    mixed = [tuple(r) for r in out.collect()]
    size, taken = Counter(), Counter()
    for _, t, _, s in rows:
        size[s] += len(words(t))
    for _, t, _, s, *_ in mixed:
        taken[s] += len(words(t))
    times = by_row([r[:4] for r in mixed])
    assert all(times[k] <= 2 * n for k, n in by_row(rows).items()) and set(times) <= set(by_row(rows))
    largest = {s: max(len(words(t)) for _, t, _, x in rows if x == s) for s in size}
    assert all(abs(taken[s] - v) <= largest[s] for s, v in targets(size).items())
    shards = corpus_pipeline.shards(spark, out, path).collect()
    assert len(shards) == len(mixed)
    assert Counter((r.doc_id, r.text_crc32) for r in shards) == Counter((d, zlib.crc32((t or "").encode())) for d, t, *_ in mixed)


def test_stages_take_empty_tables(spark, bench_dir):
    docs = table(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, bench_dir[0]).count() == 0, name


def slow_pack(sizes, shards):
    """The smallest capacity for which best fit needs no more bins than that, by trying each."""
    from test_mix_and_shards import slow_best_fit

    first, left = [], sum(sizes)
    while len(first) < min(shards - 1, len(sizes)) and sizes[len(first)] * (shards - len(first)) > left:
        left -= sizes[len(first)]
        first.append(len(first))
    rest, n = sizes[len(first) :], shards - len(first)
    if not rest:
        return first
    capacity = max(-(-left // n), rest[0])
    while max(slow_best_fit(rest, capacity)) >= n:
        capacity += 1
    return first + [len(first) + b for b in slow_best_fit(rest, capacity)]


@pytest.mark.parametrize("items", [1 << 14, 40])
def test_shards_equal_a_plain_packing(spark, docs_of, items):
    import hashlib

    rng = random.Random(6)
    rows = [(k, prose(k % 70, rng.randint(1, 40) if k >= 70 else 25)) for k in range(150)] + [(900, None), (901, ""), (902, "same " * 400), (903, "same " * 400)]
    groups = Counter()
    for _, t in rows:
        groups[t or ""] += len((t or "").encode()) + 1
    total, packed = sum(groups.values()), Counter()
    key = lambda t: hashlib.sha256(t.encode()).hexdigest()
    bundle = lambda t: (xxhash.xxh64(key(t), seed=42).intdigest() + 2**63) % 2**64 - 2**63
    item = {t: (-1, key(t)) if n * items > total else (bundle(t) % items, "") for t, n in groups.items()}
    for t, n in groups.items():
        packed[item[t]] += n
    order = sorted(packed, key=lambda x: (-packed[x], x))
    shard = dict(zip(order, slow_pack([packed[x] for x in order], 16), strict=True))
    text = dict(rows)
    for r in sharding.shard(docs_of(rows), items=items).collect():
        assert r.shard == shard[item[text[r.doc_id] or ""]]


def test_given_capacity(spark, docs_of):
    rows = [(k, prose(k, 30 + k % 50)) for k in range(400)] + [(900, "long " * 3000)]
    got = sharding.shard(docs_of(rows), capacity=10_000).collect()
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    big = {r.shard for r in got if r.doc_id == 900}
    assert len(big) == 1 and all(v <= 10_000 for k, v in load.items() if k not in big)
    rest = sum(v for k, v in load.items() if k not in big)
    assert len(load) - 1 <= 1.1 * rest / 10_000 + 1
    with pytest.raises(ValueError):
        sharding.shard(docs_of(rows), capacity=0 + 1).count()


def slow_scores(op, text, model, names=2):
    """Features one by one in plain Python integers, then the mean, the softmax."""
    import math

    from ringforge.llm import subword

    m32 = 2**32 - 1
    fold = subword.FOLD if op is langid else subword.PLAIN
    data = text.encode()
    code = [int(fold[b]) for b in data]

    def bucket(h):
        h = (h ^ (h >> 15)) * 0xC2B2AE35 & m32
        h = (h ^ (h >> 13)) * 0x27D4EB2F & m32
        return h >> (32 - op.LOG2)

    found = []
    for k in op.ORDERS:
        for i in range(len(code) - k + 1):
            c = code[i : i + k]
            if all(c[1:-1]) and (k != 2 or any(c)):
                h = k
                for j, x in enumerate(c):
                    h = (h * 0x85EBCA6B + x * 0x165667B1 + j) & m32
                found.append(bucket(h))
    z = [sum(float(model["table"][f][y]) for f in found) / max(1, len(found)) + float(model["bias"][y]) for y in range(model["table"].shape[1])]
    e = [math.exp((x - max(z)) * model["t"]) for x in z]
    return [x / sum(e) for x in e]


def test_language_scores_equal_plain_ones(spark, docs_of):
    en, de = "the house and the tree with some water", "das Haus und der Baum mit etwas Wasser"
    rows = [(k, (en if k % 2 else de) + " " + prose(k, 3), "en" if k % 2 else "de") for k in range(60)] + [(100, "é", None), (101, "The.  END\n", None)]
    model = langid.learn(docs_of(rows).select("doc_id", "text", "lang"))
    text = {r[0]: r[1] for r in rows}
    for r in langid.predict(docs_of(rows).select("doc_id", "text"), model).collect():
        want = slow_scores(langid, text[r.doc_id], model)
        assert r.score == pytest.approx(max(want), abs=1e-9) and r.lang_pred == model["labels"][want.index(max(want))]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_quality_scores_equal_plain_ones(spark, docs_of, monkeypatch):
    """With its character n-grams alone, which the plain version has."""
    from ringforge.llm import quality, subword

    rows = [(k, prose(k, 20) if k % 2 else "BUY!! now " * 5) for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, label int")
    docs = docs_of(rows).select("doc_id", "text")
    chars = lambda data, off: subword.char_ngrams(data, off, subword.PLAIN, quality.ORDERS, quality.LOG2)
    chars.reach = 1
    monkeypatch.setattr(quality, "_features", chars)
    model = quality.learn(docs, labels)
    import numpy as np
    import pyarrow as pa

    from ringforge.llm import words as hashing

    data, off = hashing.text_buffers(pa.array([t for _, t in rows], pa.string()))
    got = subword.softmax((subword.text_scores(model["table"], chars, data, off) + model["bias"]) * model["t"])
    for (_, t), p in zip(rows, got, strict=True):
        assert np.allclose(p, slow_scores(quality, t, model), atol=1e-6)


def test_word_and_pattern_ngrams(spark):
    import numpy as np

    from ringforge.llm import subword

    texts = ["a b a a", "a", "", "x y x y z"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0] + [len(t) for t in texts])
    for f, orders in ((subword.word_ngrams, (1, 2)), (subword.pattern_ngrams, (2, 3, 4))):
        ids, who = f(data, off, 16)
        for j, t in enumerate(texts):
            w = t.split()
            grams = [tuple(w[i : i + k]) for k in orders for i in range(len(w) - k + 1)]
            if f is subword.pattern_ngrams:
                grams = [tuple(g.index(x) for x in g) for g in grams]
            mine = ids[who == j].tolist()
            assert len(mine) == len(grams) and len(set(mine)) == len(set(grams))


def test_duplicates_of_rows_without_id(spark, bench_dir):
    docs = table(spark, [(None, "a b c d e f g", "aa", None)] * 3 + [(1, "a b c d e f g", "aa", "s")])
    assert corpus_pipeline.near_duplicates(spark, docs, bench_dir[0]).count() == 4
    assert docs.where(F.col("doc_id").isNull()).count() == 3
