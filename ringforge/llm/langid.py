"""Language identification by averaged hashed subword embeddings with a linear softmax.

Learned from a bounded sample: at most ``per_label`` rows of each language, those of the least hash of their id, whatever their length (a text counts by its
distinct features: 2^15 at most).  Features are taken where the texts are, training runs in one task.  A fifth of the sample isn't trained on but calibrates: a
temperature that makes the softmax a probability, and the rejection threshold: the value that all but ``lost`` of the rightly predicted calibration
rows reach.  All languages with a labelled row are learned.

Every whole text is then scored.  Texts that are null or have no letter: 'und', score 0, rejected.  If there is no
row to learn from, everything is 'und'.  Rows without id are scored like others, are never learned from and count as not
held out.  Repeated rows get equal results; extra columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, subword, words

LOG2 = 15
ORDERS = (2, 3, 4)
#: Rows of each language that are learned from, and the part of rightly predicted calibration rows that the rejection threshold may lose.
PER_LABEL = 1000
LOST = 0.001


def remainder(id_col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod."""
    return F.crc32(id_col.cast("string").cast("binary")) % mod


def sample(rows: DataFrame, per_label: int, most: int = 20_000) -> DataFrame:
    """rows: doc_id, label.  Distinct rows, at most per_label of each label and about ``most`` in all: those of the least hash of doc_id.  Every label has one."""
    counts = rows.groupBy("label").agg(F.count("*").alias("_c"))
    values = max(1, counts.count())
    per = max(1, min(per_label, most // values))
    counts = F.broadcast(counts) if values <= most else counts  # else all rows would be dealt by label
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    # about twice as many are ordered as are taken; with repeated ids fewer may be left
    near = rows.join(counts, "label").where(h / F.lit(float(1 << 30)) < F.lit(2.0 * per + 50) / F.col("_c")).select("doc_id", "label").distinct()
    place = F.row_number().over(Window.partitionBy("label").orderBy(h, "doc_id"))
    return near.withColumn("_k", place).where(F.col("_k") <= per).drop("_k")


def texts_of(docs: DataFrame, chosen: DataFrame, *keys: str) -> DataFrame:
    """doc_id, label, text of the chosen rows (few: broadcast); of several texts of one the one of the least hash."""
    got = docs.where("text is not null and text <> ''").join(F.broadcast(chosen), list(keys))
    return got.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def _features(data, off):
    return subword.char_ngrams(data, off, subword.FOLD, ORDERS, LOG2)


_features.reach = 1


def learn(docs: DataFrame, per_label: int = PER_LABEL, lost: float = LOST, mod: int = 5, out: int = 0) -> dict | None:
    """docs: doc_id, text, lang.  The model: labels, table, bias, temperature, threshold."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (remainder(F.col("doc_id"), mod) != out)).withColumnRenamed("lang", "label")
    chosen = texts_of(rows, sample(rows.select("doc_id", "label"), per_label), "doc_id", "label")

    def finish(labels, table, bias, z, y):
        t = subword.temperature(z, y)
        p = subword.softmax(z * t)
        right = p.max(1)[p.argmax(1) == y] if len(y) else np.zeros(0)
        return {"labels": labels, "table": table, "bias": bias, "t": t, "threshold": max(0.0, float(np.quantile(right, lost)) - 1e-3) if len(right) else 0.0}

    return subword.fit(subword.sampled(chosen, _features, 1 << LOG2), 1 << LOG2, finish)


def _verdicts(m: dict | None, text: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, rejected) of each text."""
    k = len(text)
    letters = np.array(pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False))
    if m is None:
        return ["und"] * k, np.zeros(k), np.ones(k, bool)
    data, off = words.text_buffers(text)
    p = subword.softmax((subword.text_scores(m["table"], _features, data, off) + m["bias"]) * m["t"])
    names = [m["labels"][i] if a else "und" for i, a in zip(p.argmax(1), letters, strict=True)]
    score = np.where(letters, p.max(1), 0.0)
    return names, score, ~letters | (score < m["threshold"])


def predict(docs: DataFrame, model: dict | None, mod: int = 5, out: int = 0) -> DataFrame:
    """docs: doc_id, text.  One row per document: doc_id, held_out, lang_pred, score, rejected."""
    common.bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^15 buckets x labels

    def run(batches):
        for b in words.chunks(batches, 1 << 20):
            name, score, rejected = _verdicts(shared.value, b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(name, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select("doc_id", F.coalesce(remainder(F.col("doc_id"), mod) == out, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that the model doesn't reject."""
    common.bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in words.chunks(batches, 1 << 20, text_col):
            yield b.filter(pa.array(~_verdicts(shared.value, b.column(text_col))[2]))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **learning) -> DataFrame:
    """Learn from the documents' labels and predict every document."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return predict(docs.select("doc_id", "text"), learn(docs, **learning))
