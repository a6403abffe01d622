"""Averaged hashed n-gram embeddings with a linear softmax, trained by stochastic gradient descent in numpy.

A text is the mean of the vectors of its hashed features; class scores are linear in that mean.  So once trained,
vectors and output weights fold into one table (bucket x class), and a text's scores are the mean of table rows."""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from . import words

_C = [np.uint32(x) for x in (0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0x9E3779B1, 0x2C1B3C6D)]
_PUNCT = [i for i in range(128) if not chr(i).isalnum()]
FOLD = np.arange(256, dtype=np.uint32) + 1
FOLD[65:91] = FOLD[97:123]
FOLD[_PUNCT] = 0
FOLD[48:58] = 0
#: Bytes as they are: case and punctuation tell; white space is the boundary.
PLAIN = np.arange(256, dtype=np.uint32) + 1
PLAIN[[9, 10, 11, 12, 13, 32]] = 0


def _bucket(h: np.ndarray, log2: int) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * _C[1]
    h = (h ^ (h >> np.uint32(13))) * _C[2]
    return (h >> np.uint32(32 - log2)).astype(np.int32)


def char_ngrams(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, orders, log2: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, text numbers) of all byte n-grams that lie in one word, its boundaries included."""
    code = table[data]
    n = len(code)
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    ids, who = [], []
    for k in orders:
        if n < k:
            continue
        m = n - k + 1
        h = np.full(m, k, np.uint32)
        ok = owner[:m] == owner[k - 1 :]
        for j in range(k):
            h = h * _C[0] + code[j : j + m] * _C[3] + np.uint32(j)
            if 0 < j < k - 1:
                ok &= code[j : j + m] != 0
        if k == 2:
            ok &= (code[:m] != 0) | (code[1:] != 0)
        at = np.flatnonzero(ok)
        ids.append(_bucket(h[at], log2))
        who.append(owner[at])
    if not ids:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(ids), np.concatenate(who)


def word_ngrams(data: np.ndarray, offsets: np.ndarray, log2: int, orders=(1, 2)) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, text numbers) of word n-grams, ASCII letters lower-cased."""
    w, wo = words.word_hashes(data, offsets)
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(wo))
    ids, who = [], []
    for k in orders:
        if len(w) >= k:
            g = words.ngram_hashes(w, k)
            same = owner[k - 1 :] == owner[: len(g)]
            ids.append(_bucket((g >> np.uint64(32)).astype(np.uint32), log2)[same])
            who.append(owner[: len(g)][same])
    if not ids:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(ids), np.concatenate(who)


def pattern_ngrams(data: np.ndarray, offsets: np.ndarray, log2: int, orders=(2, 3, 4)) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, text numbers) of word n-grams without the words: which of the n are equal ("x x", "x y x", ..)."""
    w, wo = words.word_hashes(data, offsets)
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(wo))
    ids, who = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for k in orders:
        if len(w) < k:
            continue
        m = len(w) - k + 1
        code = np.full(m, k, np.uint32)
        for j in range(1, k):
            # the first place that holds the same word as place j
            same = np.full(m, j, np.uint32)
            for i in range(j - 1, -1, -1):
                same = np.where(w[j : j + m] == w[i : i + m], np.uint32(i), same)
            code = code * np.uint32(k) + same
        inside = owner[k - 1 :] == owner[:m]
        ids.append(_bucket(code * _C[5], log2)[inside])
        who.append(owner[:m][inside])
    return np.concatenate(ids), np.concatenate(who)


def scores(table: np.ndarray, ids: np.ndarray, who: np.ndarray, n: int) -> np.ndarray:
    """The mean of table rows for each of n texts (zeros for a text without features)."""
    count = np.bincount(who, minlength=n)
    out = np.empty((n, table.shape[1]))
    for c in range(table.shape[1]):
        out[:, c] = np.bincount(who, weights=table[:, c][ids], minlength=n)
    return out / np.maximum(count, 1)[:, None]


def sums(table: np.ndarray, ids: np.ndarray, who: np.ndarray, n: int) -> np.ndarray:
    """The sum of table rows for each of n texts, and their number in the last column."""
    out = np.empty((n, table.shape[1] + 1))
    for c in range(table.shape[1]):
        out[:, c] = np.bincount(who, weights=table[:, c][ids], minlength=n)
    out[:, -1] = np.bincount(who, minlength=n)
    return out


#: White space that ends a word.
_SPACES = (9, 10, 11, 12, 13, 32)


def _pieces(data: np.ndarray, lo: int, hi: int, block: int, reach: int):
    """Cuts of data[lo:hi] at white space, of about ``block`` bytes (a longer word is one piece): (start with the ``reach`` words before, start, end).

    Each piece begins with a white space; so n-grams of bytes within one word lie in one piece, and n-grams of words are those of the piece with the
    words before it (and the byte before these), less those of these words alone."""
    at = lo
    starts: list[int] = []  # where the last words before ``at`` begin
    while at < hi:
        end = min(at + block, hi)
        while end < hi:
            space = np.flatnonzero(np.isin(data[end : min(end + block, hi)], _SPACES))
            if len(space):
                end += int(space[0])
                break
            end = min(end + block, hi)
        yield max(lo, (starts[-reach] if len(starts) >= reach else starts[0] if starts else at + 1) - 1), at, end
        inside = ~np.isin(data[max(lo, at) : end], _SPACES)
        begin = np.flatnonzero(inside & ~np.append(False, inside[:-1]))[-reach:] + at
        starts = (starts + begin.tolist())[-reach:]
        at = end


def text_scores(table: np.ndarray, features, data: np.ndarray, offsets: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """scores() of whole texts.  A text longer than two blocks is summed piece by piece, so that memory is bounded, to the same sums: pieces are cut
    at white space and words before a cut are carried over (``features.reach`` words)."""
    n = len(offsets) - 1
    if len(data) <= 2 * block:
        return scores(table, *features(data, offsets), n)
    out = np.empty((n, table.shape[1]))
    small = np.flatnonzero(np.diff(offsets) <= block)
    for k in small:
        part = data[offsets[k] : offsets[k + 1]]
        out[k] = scores(table, *features(part, np.array([0, len(part)])), 1)[0]
    for k in np.flatnonzero(np.diff(offsets) > block):
        total = np.zeros(table.shape[1] + 1)
        for before, lo, hi in _pieces(data, offsets[k], offsets[k + 1], block, features.reach):
            part = data[before:hi]
            total += sums(table, *features(part, np.array([0, len(part)])), 1)[0]
            if before < lo:
                total -= sums(table, *features(data[before:lo], np.array([0, lo - before])), 1)[0]
        out[k] = total[:-1] / max(1, total[-1])
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


#: Texts that training looks at, if need be again and again.
LEAST_SEEN = 8000


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, buckets: int, dim: int = 12, epochs: int = 4, batch: int = 16, rate: float = 0.5, seed: int = 7, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """rows: (distinct buckets, their shares of the text) of each text.  Returns (table, bias).

    Step sizes are divided by the root of summed squared gradients (Adagrad); weights: of classes."""
    rng = np.random.Generator(np.random.PCG64(seed))
    emb = rng.uniform(-1 / dim, 1 / dim, (buckets, dim))
    out = np.zeros((dim, classes))
    bias = np.zeros(classes)
    g_emb, g_out, g_bias = np.full(buckets, 1e-6), np.full((dim, classes), 1e-2), np.full(classes, 1.0)
    cw = np.ones(classes) if weights is None else weights
    n = len(rows)
    for _ in range(max(epochs, LEAST_SEEN // max(1, n))):  # few rows are gone through more often
        order = rng.permutation(n)
        for k in range(0, n, batch):
            take = order[k : k + batch]
            ids = np.concatenate([rows[i][0] for i in take])
            val = np.concatenate([rows[i][1] for i in take]).astype(float)
            who = np.repeat(np.arange(len(take)), [len(rows[i][0]) for i in take])
            e = emb[ids]
            h = np.zeros((len(take), dim))
            for d in range(dim):
                h[:, d] = np.bincount(who, weights=e[:, d] * val, minlength=len(take))
            p = softmax(h @ out + bias)
            y = labels[take]
            p[np.arange(len(take)), y] -= 1
            p *= cw[y][:, None] / len(take)
            dh = p @ out.T
            dout, dbias = h.T @ p, p.sum(0)
            g_out += dout**2
            g_bias += dbias**2
            out -= rate * dout / np.sqrt(g_out)
            bias -= rate * dbias / np.sqrt(g_bias)
            if len(ids):
                uniq, inv = np.unique(ids, return_inverse=True)
                step = np.empty((len(uniq), dim))
                for d in range(dim):
                    step[:, d] = np.bincount(inv, weights=val * dh[who, d], minlength=len(uniq))
                g_emb[uniq] += (step**2).mean(1)
                emb[uniq] -= rate * 0.2 * step / np.sqrt(g_emb[uniq])[:, None]
    return (emb @ out).astype(np.float32), bias


def shares(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct buckets, their shares of the text), in 6 bytes each."""
    u, c = np.unique(ids, return_counts=True)
    return u.astype(np.uint16), (c / max(1, c.sum())).astype(np.float32)


def text_shares(features, text: bytes, buckets: int, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """shares() of a whole text, however long."""
    data = np.frombuffer(text, np.uint8)
    if len(data) <= 2 * block:
        return shares(features(data, np.array([0, len(data)]))[0])
    count = np.zeros(buckets)
    for before, lo, hi in _pieces(data, 0, len(data), block, features.reach):
        count += np.bincount(features(data[before:hi], np.array([0, hi - before]))[0], minlength=buckets)
        if before < lo:
            count -= np.bincount(features(data[before:lo], np.array([0, lo - before]))[0], minlength=buckets)
    u = np.flatnonzero(count)
    return u.astype(np.uint16), (count[u] / max(1, count.sum())).astype(np.float32)


def sampled(docs, features, buckets: int):
    """docs: doc_id, label, text.  (doc_id, label, held, ids, shares): features of each row, so that no text leaves its executor."""

    def run(batches):
        for b in words.chunks(batches, 1 << 20):
            ids, part = [], []
            for t in b.column("text").cast(pa.binary()).to_pylist():
                u, c = text_shares(features, t, buckets)
                ids.append(u.tobytes()), part.append(c.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(ids, pa.binary()), pa.array(part, pa.binary())], names=["doc_id", "label", "ids", "shares"])

    return docs.select("doc_id", F.col("label").cast("string").alias("label"), "text").mapInArrow(run, "doc_id long, label string, ids binary, shares binary")


def fit(samples, buckets: int, finish) -> dict | None:
    """Trains in one task of an executor on the rows of sampled() (their number is bounded by the caller) and gives what finish(labels, table, bias, scores and
    places of the calibration rows) makes of it; None without rows.  A fifth of the rows, by a hash of their id, calibrates."""

    def run(batches):
        got = []
        for b in batches:
            got += zip(*(b.column(k).to_pylist() for k in range(4)), strict=True)
        if not got:
            return
        got.sort()
        labels = sorted({x[1] for x in got})
        y = np.array([labels.index(x[1]) for x in got])
        held = np.array([zlib.crc32(b"cal%d" % x[0]) % 5 == 0 for x in got])
        rows = [(np.frombuffer(x[2], np.uint16), np.frombuffer(x[3], np.float32)) for x in got]
        use = np.flatnonzero(~held) if (~held).any() else np.arange(len(got))
        table, bias = train([rows[i] for i in use], y[use], len(labels), buckets)
        cal = np.flatnonzero(held)
        z = np.array([(table[rows[i][0]] * rows[i][1][:, None]).sum(0) + bias for i in cal]).reshape(len(cal), len(labels))
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(finish(labels, table, bias, z, y[cal]))], pa.binary())})
        del got, rows
        words.release()

    row = samples.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(row[0]["model"]) if row else None


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The factor of z under which softmax fits y best (log loss on rows that training did not see)."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.1), np.log(20), 60))
    loss = [-np.log(np.maximum(softmax(z * t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])
