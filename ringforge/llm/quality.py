"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its hashed words, word pairs, word n-grams without the words (which of them are equal) and character n-grams (case
and punctuation kept); a softmax over two classes gives the score.  Trained in numpy by stochastic gradient descent on a bounded
sample: at most ``per_label`` labelled rows of each class, those of the least hash of their id, whatever their length (a text counts by its distinct
features: 2^16 at most).  Features are taken where the texts are, training runs in one task.  A fifth of the sample calibrates the score (temperature).

Labels with null id or null quality are left out; of several labels of one id the largest counts.  Every whole text is
scored: null or empty ones get the share of class 1 that the model's bias holds.  If there are no labels, every
score is 0.5.  Rows without id are scored, and count as not held out.  Extra columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, subword, words
from .langid import remainder, sample, texts_of

LOG2 = 16
ORDERS = (1, 2, 3)
PER_LABEL = 2500


def _features(data, off):
    a, x = subword.char_ngrams(data, off, subword.PLAIN, ORDERS, LOG2)
    b, y = subword.word_ngrams(data, off, LOG2)
    c, z = subword.pattern_ngrams(data, off, LOG2)
    return np.concatenate([a, b, c]), np.concatenate([x, y, z])


_features.reach = 3


def learn(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, mod: int = 3, out: int = 1) -> dict | None:
    """docs: doc_id, text; labels: doc_id, label."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (remainder(F.col("doc_id"), mod) != out)).groupBy("doc_id").agg(F.max("label").alias("label"))
    # labels may have ids that no document has
    chosen = texts_of(docs, sample(rows.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), per_label), "doc_id")

    def finish(labels, table, bias, z, y):
        t = subword.temperature(z, y)
        if len(labels) < 2:  # one class only: it is all that is known
            return {"table": np.zeros((len(table), 2), np.float32), "bias": np.array([0.0, 1.0] if labels == ["1"] else [1.0, 0.0]), "t": 1.0}
        return {"table": table, "bias": bias, "t": t}

    return subword.fit(subword.sampled(chosen, _features, 1 << LOG2), 1 << LOG2, finish)


def predict(docs: DataFrame, model: dict | None, mod: int = 3, out: int = 1) -> DataFrame:
    """docs: doc_id, text.  One row per document: doc_id, held_out, score, predicted."""
    common.bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^16 buckets x 2

    def run(batches):
        m = shared.value
        for b in words.chunks(batches, 1 << 20):
            if m is None:
                score = np.full(b.num_rows, 0.5)
            else:
                data, off = words.text_buffers(b.column("text"))
                z = subword.text_scores(m["table"], _features, data, off) + m["bias"]
                score = subword.softmax(z * m["t"])[:, 1]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", F.coalesce(remainder(F.col("doc_id"), mod) == out, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **learning) -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    return predict(docs, learn(docs, labels, **learning))
