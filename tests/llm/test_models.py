import duckdb
import numpy as np
import pytest
from brute import crc, lm_scores, prose

from ringforge.llm import langid, lm_score, quality, subword
from ringforge.llm.queries import QUERIES


ROWS = [(1, "a b a c"), (2, "b a"), (3, "d"), (4, ""), (5, None), (6, "zz " * 5000), (7, "the"), (8, "THE of\tAND"), (9, "the of"), (100, "one"), *[(10 + k, f"the of and {prose(k % 7, 25 + k)} the of the of") for k in range(60)]]


@pytest.mark.parametrize("heavy", [10, 100_000])  # few heavy n-grams, and many
@pytest.mark.parametrize("order", [2, 3, 4])
def test_lm_scores_equal_brute_force(spark, docs_of, order, heavy):
    got = {r.doc_id: (r.n_tokens, r.log_prob) for r in lm_score.score(docs_of(ROWS), order=order, heavy=heavy).collect()}
    want = lm_scores(ROWS, order)
    assert got.keys() == want.keys()
    for k, (n, s) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(s, abs=1e-6)


@pytest.mark.parametrize("order", [2, 3])
def test_lm_rare_ngrams_back_off(spark, docs_of, order):
    want = lm_scores(ROWS, order, min_count=2)
    got = lm_score.score(docs_of(ROWS), order=order, min_count=2).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.n_tokens == want[r.doc_id][0] and r.log_prob == pytest.approx(want[r.doc_id][1], abs=1e-6)


def test_lm_many_short_rows(spark, docs_of):
    rows = [(k, f"w{k % 50} x") for k in range(9000)]
    got = {r.doc_id: r.log_prob for r in lm_score.score(docs_of(rows)).collect()}
    want = lm_scores(rows)
    assert all(got[k] == pytest.approx(s, abs=1e-6) for k, (_, s) in want.items())


def test_lm_odd_rows(spark, docs_of):
    got = sorted(((r.doc_id, r.n_tokens) for r in lm_score.score(docs_of([(None, "a b"), (None, "c"), (4, "a"), (4, "b c"), (5, "")])).collect()), key=str)
    assert got == sorted([(None, 3), (4, 3), (5, 0)], key=str)
    assert lm_score.score(docs_of([])).count() == 0


def test_lm_whole_table(spark, sf):
    want = lm_scores(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())
    got = lm_score.score(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.n_tokens == want[r.doc_id][0] and r.log_prob == pytest.approx(want[r.doc_id][1], rel=1e-9, abs=1e-6)
    # the query gives the same, rounded for comparison with SQL
    rounded = {r.doc_id: r.log_prob for r in QUERIES["op4_lm_scoring"](spark, sf).collect()}
    assert len(rounded) == len(got) and all(abs(rounded[r.doc_id] - r.log_prob) <= 5.1e-5 for r in got)


def test_language_id_held_out(spark, sf):
    lang = dict(duckdb.sql(f"select doc_id, lang from '{sf}/documents.parquet' where n_chars > 20").fetchall())
    got = [r for r in QUERIES["op6_language_id"](spark, sf).collect() if r.doc_id in lang]
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95


def test_language_id_odd_rows(spark, docs_of):
    en, de = "the house and the tree with some water", "das haus und der baum mit etwas wasser"
    rows = [(k, en if k % 2 else de, "en" if k % 2 else "de") for k in range(40)] + [(None, en, "en"), (90, None, "en"), (91, "", "de"), (92, "12 !? 34", "en"), (93, en * 60_000, None), (94, "é", None)]
    got = {r.doc_id: r for r in langid.identify(docs_of(rows)).collect()}
    assert len(got) == len(rows) and got[None].lang_pred == "en" and got[None].held_out is False
    assert all(got[k].lang_pred == "und" and got[k].score == 0 and got[k].rejected for k in (90, 91, 92))
    assert got[93].lang_pred == "en" and got[94].lang_pred in ("en", "de")
    none = langid.identify(docs_of([(1, "text", None)])).first()
    assert (none.lang_pred, none.score, none.rejected) == ("und", 0, True)
    assert langid.identify(docs_of([])).count() == 0
    docs = docs_of(rows)
    kept = langid.accepted(docs, langid.learn(docs.select("doc_id", "text", "lang")))
    assert kept.columns == docs.columns and {90, 91, 92}.isdisjoint({r.doc_id for r in kept.collect()})


def test_quality_held_out(spark, sf):
    label = dict(duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall())
    got = QUERIES["op5_quality"](spark, sf).collect()
    assert all(r.held_out == (crc(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == label[r.doc_id] for r in got if r.doc_id in label]) > 0.9


def test_quality_odd_rows(spark, docs_of):
    rows = [(k, prose(k, 60) if k % 2 else "BUY!! NOW!! " * 20) for k in range(60)] + [(None, prose(3, 30)), (90, None), (91, ""), (92, "BUY!! " * 300_000), (5, prose(5, 60))]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)] + [(None, 1, 0), (3, None, 0), (4, 0, 1), (999, 1, 0)], "doc_id long, quality int, toxic int")
    got = sorted(quality.classify(docs_of(rows), labels).collect(), key=lambda r: str(r.doc_id))
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[92].predicted == 0 and by[7].predicted == 1 and by[None].held_out is False
    assert {r.score for r in quality.classify(docs_of(rows), labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs_of([]), labels).count() == 0


@pytest.mark.parametrize("op", [langid, quality])
def test_long_texts_score_as_if_whole(op):
    rng = np.random.default_rng(0)
    buckets = 1 << op.LOG2
    table = rng.normal(size=(buckets, 3)).astype(np.float32)
    texts = [prose(1, 4000) + " ", "x y x y " * 900, "é" * 9000 + " a b", " " * 7000 + "end", "short one", "", "  \n\t ".join(prose(2, 3000).split())]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0] + [len(t.encode()) for t in texts])
    whole = subword.scores(table, *op._features(data, off), len(texts))
    for block in (700, 5000):
        parts = subword.text_scores(table, op._features, data, off, block=block)
        assert np.allclose(whole, parts, atol=1e-9)
        for k, t in enumerate(texts):
            u, c = subword.text_shares(op._features, t.encode(), buckets, block)
            x, y = subword.shares(op._features(data[off[k] : off[k + 1]], np.array([0, off[k + 1] - off[k]]))[0])
            assert (u == x).all() and np.allclose(c, y, atol=1e-7)


def test_a_language_that_was_not_learned_is_rejected(spark, docs_of):
    rng = np.random.default_rng(5)
    vocabulary = {x: ["".join(rng.choice(list(letters), 5)) for _ in range(60)] for x, letters in (("aa", "abcdefgh"), ("bb", "ijklmnop"), ("cc", "qrstuvwxyz"))}
    text = lambda x: " ".join(rng.choice(vocabulary[x], 30))
    rows = [(k, text(("aa", "bb")[k % 2]), ("aa", "bb")[k % 2]) for k in range(400)] + [(1000 + k, text("cc"), None) for k in range(50)]
    got = langid.identify(docs_of(rows)).collect()
    assert np.mean([r.rejected for r in got if r.doc_id >= 1000]) > 0.9
    assert np.mean([r.rejected for r in got if r.doc_id < 1000]) < 0.02
    assert all(r.lang_pred == ("aa", "bb")[r.doc_id % 2] for r in got if r.doc_id < 1000)


def test_samples_are_bounded_and_the_same_each_time(spark):
    rows = spark.range(20_000).selectExpr("id % 5000 as doc_id", "concat('l', id % 5000 % 3 % 2) as label")
    a, b = [sorted(map(tuple, langid.sample(rows.repartition(k), 300).collect())) for k in (2, 7)]
    assert a == b and len(a) == len(set(a)) <= 600 and {x[1] for x in a} == {"l0", "l1"}
    many = spark.range(3000).selectExpr("id as doc_id", "concat('l', id) as label")
    assert langid.sample(many, 300, most=1000).count() == 3000  # every language has a row
    docs = spark.createDataFrame([(1, "b", "x"), (1, "a", "x"), (1, None, "x"), (2, "", "x")], "doc_id long, text string, label string")
    assert [r.text for r in langid.texts_of(docs, docs.select("doc_id", "label").distinct(), "doc_id", "label").collect()][0] in ("a", "b")


def test_quality_of_one_class(spark, docs_of):
    labels = spark.createDataFrame([(k, 1) for k in range(20)], "doc_id long, quality int")
    assert {r.predicted for r in quality.classify(docs_of([(k, prose(k, 20)) for k in range(30)]), labels).collect()} == {1}
