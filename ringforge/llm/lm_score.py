"""Stupid-backoff scores of documents under the corpus's own word n-gram tables.

With c() counting over all documents, N the number of tokens, and n-grams seen fewer than ``min_count`` times left out of the tables
(by default none is: every n-gram of the corpus is scored by its count):

    S(w | u .. v) = c(u .. v w) / c(u .. v)   if c(u .. v w) >= min_count,   else   backoff * S(w | .. v);   S(w) = c(w) / N.

The context has ``order`` - 1 words, at the start of a text as many as there are.  log_prob is the sum of log S over a text's words, score
its mean.  Words are runs of characters other than white space, ASCII letters lower-cased.

With ``min_count`` 1 no n-gram of the corpus itself is backed off, and the sum telescopes: with k = order, a text of n >= k words has

    log_prob = sum over i = k .. n of log c(k-gram that ends at i) - sum over i = k .. n - 1 of log c((k-1)-gram that ends at i) - log N

and a shorter one log c(the whole text) - log N.  So each document's distinct k-grams are sent out once, packed in binary and dealt by the
hash of their last k - 1 words: that bucket has the count table of both, and the n-grams meet their counts there.  What comes back is one
packed row of sums for each chunk of documents and task, dealt by chunk.  Texts of fewer than k - 1 words are few words each: the counts of
their n-grams are taken by an aggregate over all documents and joined.

The few (k-1)-grams and k-grams with at least 1 / ``heavy`` of all tokens (a fixed number at most) are counted beforehand and broadcast, so that
no bucket holds an n-gram of a great part of the corpus: k-grams that end with a heavy (k-1)-gram are dealt by all their words, heavy k-grams are
settled where they are read.  All counts cover all documents and grow with them.

For a greater ``min_count`` the general form is used, joins of n-gram tables throughout (see ``_by_joins``).

(k-1)-grams are told apart by 64 bits of their hash, the words before each by 40 bits more.  Null or empty texts, or texts without words: 0 tokens,
log_prob 0, score null.  Rows of one id (or without id) are parts of one document and give one row.  Extra columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words
from .words import U

COUNTERS_LOG2 = 20
ORDER = 3
BACKOFF = 0.4
MIN_COUNT = 1
HEAVY = 100_000
#: Hash buckets of each task of the second step: it holds one of them at a time.
BUCKETS = 4
#: Stands for "no word before" and for a null id.
START = U(0)
#: Stands for "no word after".
END = U((1 << 40) - 1)
NO_ID = -(2**63)


def _pair(u: np.ndarray, g: np.ndarray) -> np.ndarray:
    return words.mix(u * U(0xA24BAED4963EE407) + g * U(0x9FB21C651E98DF25) + U(0x51))


class _Grams:
    """A batch's (order - 1)-grams: g, the word before each (40 bits, or START), the row it is in, and which of them are a row's last."""

    def __init__(self, b: pa.RecordBatch, order: int):
        data, off = words.text_buffers(b.column("text"))
        w, wo = words.word_hashes(data, off)
        self.words, self.offsets, self.sizes = w, wo, np.diff(wo).astype(np.int64)
        owner = np.repeat(np.arange(b.num_rows, dtype=np.int32), self.sizes)
        span = order - 1
        g = words.ngram_hashes(w, span)
        at = np.flatnonzero(owner[: len(g)] == owner[span - 1 :]) if len(g) else np.zeros(0, np.int64)
        self.g, self.owner = g[at], owner[at]
        before = np.clip(w >> U(24), U(1), END - U(1))
        self.u = np.where(at == wo[self.owner], START, before[at - 1]) if len(at) else np.zeros(0, U)
        self.last = np.flatnonzero(at + span == wo[self.owner + 1]) if len(at) else np.zeros(0, np.int64)


def _slots(h: np.ndarray) -> np.ndarray:
    return (words.mix(h) >> U(64 - COUNTERS_LOG2)).astype(np.int64)


def _counters(docs: DataFrame, order: int) -> DataFrame:
    """Counts of (order - 1)-grams and of order-grams in tables of fixed size; in the last places those of tokens and of texts too short for either."""

    def run(batches):
        c = np.zeros((1 << COUNTERS_LOG2) + 2, np.int64)
        for b in words.chunks(batches):
            x = _Grams(b, order)
            np.add.at(c, _slots(x.g), 1)
            np.add.at(c, _slots(_pair(x.u, x.g)[x.u != START]), 1)
            c[-2] += len(x.words)
            c[-1] += int(((x.sizes > 0) & (x.sizes < order - 1)).sum())
        yield common.vector_batch(c)

    return docs.mapInArrow(run, "part int, vec binary")


def _heavy(docs: DataFrame, flagged_b, order: int) -> DataFrame:
    """Exact counts, by task, of what falls in flagged counters."""

    def run(batches):
        flagged = np.unpackbits(np.frombuffer(flagged_b.value, np.uint8)).astype(bool)
        got: list = [[], []]
        n = 0
        for b in words.chunks(batches):
            x = _Grams(b, order)
            for k, h in enumerate((x.g, _pair(x.u, x.g)[x.u != START])):
                u, c = np.unique(h[flagged[_slots(h)]], return_counts=True)
                got[k].append((u, c))
                n += len(u)
            if n > 1_000_000:
                got = [[_summed(x)] for x in got]
                n = sum(len(x[0][0]) for x in got)
        for k, x in enumerate(got):
            if x:
                u, c = _summed(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), k, np.int32)), pa.array(u.view(np.int64)), pa.array(c.astype(np.int64))], names=["k", "h", "c"])

    return docs.mapInArrow(run, "k int, h long, c long")


def _summed(parts):
    u, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return u, np.bincount(inv, weights=np.concatenate([p[1] for p in parts]), minlength=len(u)).astype(np.int64)


def _look(keys: np.ndarray, counts: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The count of each x, 0 if it isn't among the sorted keys."""
    if not len(keys):
        return np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, counts[at], 0)


def _planes(a: np.ndarray) -> np.ndarray:
    """The first bytes of all values, then the second ones, and so on: those that are mostly 0 compress to little."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).ravel()


def _whole(planes: np.ndarray, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(dtype).ravel()


def _postings(docs: DataFrame, heavy_b, parts: int, order: int) -> DataFrame:
    """Packed rows (part, chunk, blob): the (order - 1)-grams in order, as differences, and their runs; the words before them, whose they are and how
    often; and in one row of each chunk its documents with their settled sums and sizes.  Last (order - 1)-grams go too, as if END stood before them."""

    def run(batches):
        grams_k, grams_c, pairs_k, pairs_c, total = heavy_b.value
        chunk = TaskContext.get().partitionId() << 32
        for b in words.chunks(batches, 1 << 22):
            x = _Grams(b, order)
            n = b.num_rows
            ids = np.array(b.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False), np.int64)
            local = np.where(x.sizes > 0, -np.log(total), 0.0)
            c1 = _look(grams_k, grams_c, x.g)
            c2 = np.where(x.u == START, 0, _look(pairs_k, pairs_c, _pair(x.u, x.g)))
            done = (c2 > 0) | (x.u == START) & (c1 > 0)
            terms = np.where(c2 > 0, np.log(np.maximum(c2, 1)) - np.log(np.maximum(c1, 1)), 0.0)
            local += np.bincount(x.owner, weights=np.where(done, terms, 0.0), minlength=n)
            last_done = x.last[c1[x.last] > 0]
            local += np.bincount(x.owner[last_done], weights=np.log(c1[last_done]), minlength=n)
            rest, last = np.flatnonzero(~done), x.last[c1[x.last] == 0]
            u = np.concatenate([x.u[rest], np.full(len(last), END)])
            take = np.concatenate([rest, last])
            g, o, often = x.g[take], x.owner[take], c1[take] > 0
            sizes = x.sizes
            del x, c1, c2, done, terms, rest, last, take
            by = np.where(often, words.mix(_pair(u, g)), words.mix(g))
            part = ((by >> U(32)) * U(parts) >> U(32)).astype(np.int32)
            del by, often
            order_ = np.lexsort((o, u, g, part))
            u, g, o, part = u[order_], g[order_], o[order_], part[order_]
            first = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (g[1:] != g[:-1]) | (o[1:] != o[:-1]) | (part[1:] != part[:-1]))) if len(u) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(u)))
            u, g, o, part = u[first], g[first], o[first], part[first]
            cuts = np.searchsorted(part, np.arange(parts + 1))
            mine = chunk * 7919 % parts
            out_p, out_b = [], []
            for p in range(parts):
                lo, hi = cuts[p], cuts[p + 1]
                if lo == hi and p != mine:
                    continue
                gg, uu = g[lo:hi], u[lo:hi]
                starts = np.flatnonzero(np.append(True, gg[1:] != gg[:-1])) if hi > lo else np.zeros(0, np.int64)
                runs = np.diff(np.append(starts, hi - lo)).astype(np.uint32)
                own = (ids, local, sizes) if p == mine else (ids[:0], local[:0], sizes[:0])
                out_p.append(p)
                out_b.append(common.pack([_planes(np.diff(gg[starts], prepend=U(0))), _planes(runs), (uu & U(0xFFFFFFFF)).astype(np.uint32), (uu >> U(32)).astype(np.uint8), o[lo:hi].astype(np.uint16), _planes(times[lo:hi].astype(np.uint32)), *own]))
            del u, g, o, part, order_, times
            yield pa.RecordBatch.from_arrays([pa.array(out_p, pa.int32()), pa.array([chunk] * len(out_p), pa.int64()), pa.array(out_b, pa.binary())], names=["part", "chunk", "blob"])
            chunk += 1

    return docs.mapInArrow(run, "part int, chunk long, blob binary")


_KINDS = (np.uint8, np.uint8, np.uint32, np.uint8, np.uint16, np.uint8, np.int64, np.float64, np.int64)


def _bucket(blobs: list[bytes], heavy_k: np.ndarray, heavy_c: np.ndarray):
    """One bucket's n-grams with their counts: for each blob (rows of its chunk, their sums, and the chunk's own ids, sums and sizes if they came with it)."""
    got = [common.unpack(x, _KINDS) for x in blobs]
    runs = [_whole(x[1], np.uint32) for x in got]
    g = np.concatenate([np.repeat(np.cumsum(_whole(x[0], U), dtype=U), r) for x, r in zip(got, runs, strict=True)])
    u = np.concatenate([x[2].astype(U) | (x[3].astype(U) << U(32)) for x in got])
    whose = np.concatenate([x[4].astype(np.int64) + (k << 16) for k, x in enumerate(got)])
    t = np.concatenate([_whole(x[5], np.uint32) for x in got]).astype(np.int64)
    own = [x[6:9] for x in got]
    del got, runs
    if not len(g):
        return [(np.zeros(0, np.uint16), np.zeros(0), x) for x in own]
    order = np.lexsort((u, g))
    g, u, whose, t = g[order], u[order], whose[order], t[order]
    del order
    new_g = np.append(True, g[1:] != g[:-1])
    at = np.flatnonzero(new_g | np.append(True, u[1:] != u[:-1]))
    c2 = np.repeat(np.add.reduceat(t, at), np.diff(np.append(at, len(g))))
    first = np.flatnonzero(new_g)
    heavy = _look(heavy_k, heavy_c, g[first])
    c1 = np.where(heavy > 0, heavy, np.add.reduceat(np.where(u == END, 0, t), first))
    log1 = np.repeat(np.log(np.maximum(c1, 1)), np.diff(np.append(first, len(g))))
    term = np.where(u == START, 0.0, np.where(u == END, log1, np.log(c2) - log1)) * t
    del c1, c2, log1, new_g, at, g, u
    docs, inv = np.unique(whose, return_inverse=True)
    sums = np.bincount(inv, weights=term, minlength=len(docs))
    cuts = np.searchsorted(docs, np.arange(len(own) + 1) << 16)
    return [((docs[lo:hi] & 0xFFFF).astype(np.uint16), sums[lo:hi], x) for lo, hi, x in zip(cuts[:-1], cuts[1:], own, strict=True)]


def _settled(postings: DataFrame, heavy_b, parts: int) -> DataFrame:
    """(chunk, blob): what a task's buckets give for each chunk: rows and sums, and the chunk's own documents if they came here."""

    def run(batches):
        grams_k, grams_c = heavy_b.value[:2]
        # chunk -> its rows' sums so far, and its own documents
        sums: dict[int, list] = {}

        def settle(chunks, blobs):
            for c, (rows, s, own) in zip(chunks, _bucket(blobs, grams_k, grams_c), strict=True):
                held = sums.setdefault(c, [[], None])
                held[0].append((rows, s))
                if len(own[0]):
                    held[1] = own
                if len(held[0]) >= BUCKETS:
                    held[0] = [_added(held[0])]

        now, chunks, blobs = None, [], []
        for b in batches:
            for p, c, blob in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if p != now and blobs:
                    settle(chunks, blobs)
                    chunks, blobs = [], []
                now = p
                chunks.append(c), blobs.append(blob)
        if blobs:
            settle(chunks, blobs)
        keys = sorted(sums)
        for k in range(0, len(keys), 256):
            out = []
            for c in keys[k : k + 256]:
                got, own = sums.pop(c)
                out.append(common.pack([*_added(got), *(own if own is not None else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)))]))
            yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 256], pa.int64()), pa.array(out, pa.binary())], names=["chunk", "blob"])
        words.release()

    # sorted by the JVM, which spills: a task of Python has one bucket at a time
    dealt = postings.repartitionById(parts, F.floor(F.col("part") / BUCKETS).cast("int")).sortWithinPartitions("part", "chunk")
    return dealt.mapInArrow(run, "chunk long, blob binary")


def _added(parts: list) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    rows, inv = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
    return rows, np.bincount(inv, weights=np.concatenate([x[1] for x in parts]), minlength=len(rows))


def _rows(settled: DataFrame, parts: int) -> DataFrame:
    """(doc_id, x, n): each document row's sum and size, from its chunk's blobs."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        own: dict[int, tuple] = {}
        for b in batches:
            for c, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, s, ids, local, sizes = common.unpack(blob, (np.uint16, np.float64, np.int64, np.float64, np.int64))
                got = sums.setdefault(c, np.zeros(words.CHUNK_ROWS))
                got[rows] += s
                if len(ids):
                    own[c] = (ids, local, sizes)
        for c, (ids, local, sizes) in own.items():
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(local + sums[c][: len(ids)]), pa.array(sizes)], names=["doc_id", "x", "n"])

    return settled.repartition(parts, "chunk").mapInArrow(run, "doc_id long, x double, n long")


def _short(docs: DataFrame, order: int, about: int) -> DataFrame:
    """(doc_id, x, n): log counts of whole texts that have fewer than order - 1 words, counted over all documents."""

    def texts(batches):
        for b in words.chunks(batches):
            x = _Grams(b, order)
            some = np.flatnonzero((x.sizes > 0) & (x.sizes < order - 1))
            h = [int(words.ngram_hashes(x.words[x.offsets[k] : x.offsets[k + 1]], int(x.sizes[k]))[0]) for k in some]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(some)), pa.array(x.sizes[some]), pa.array(np.array(h, U).view(np.int64))], names=["doc_id", "k", "h"])

    short = docs.mapInArrow(texts, "doc_id long, k long, h long")
    wanted_b = common.bloom(common.Workspace(docs.sparkSession, "lm-score"), short.select("h"), about)

    def count(batches):
        for b in words.chunks(batches):
            x = _Grams(b, order)
            owner = np.repeat(np.arange(b.num_rows, dtype=np.int32), x.sizes)
            for k in range(1, order - 1):
                h = words.ngram_hashes(x.words, k)
                h = h[owner[: len(h)] == owner[k - 1 :]] if len(h) else h
                h, c = np.unique(h[common.bloom_has(wanted_b.value, h)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k, np.int64)), pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["k", "h", "c"])

    counts = docs.mapInArrow(count, "k long, h long, c long").groupBy("k", "h").agg(F.sum("c").alias("c"))
    return short.join(counts, ["k", "h"]).select("doc_id", F.log("c").alias("x"), F.lit(0).cast("long").alias("n"))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF, min_count: int = MIN_COUNT, heavy: int = HEAVY) -> DataFrame:
    """One row per document: doc_id, n_tokens, log_prob, score."""
    if order < 2:
        raise ValueError("order is 2 at least")
    spark = docs.sparkSession
    common.bounded_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if min_count > 1:
        return _scores(_by_joins(docs, order, backoff, min_count))
    parts = common.partitions(spark)
    counters = common.sum_vectors(_counters(docs, order), (1 << COUNTERS_LOG2) + 2)
    total, short = int(counters[-2]), int(counters[-1])
    least = max(64, total // heavy)
    flagged_b = spark.sparkContext.broadcast(np.packbits(counters[:-2] >= least).tobytes())
    # at most 2 * heavy rows: no more n-grams of one length can have this many tokens
    rows = _heavy(docs, flagged_b, order).groupBy("k", "h").agg(F.sum("c").alias("c")).where(F.col("c") >= least).collect()
    flagged_b.unpersist()
    tables = []
    for k in (0, 1):
        got = sorted((r["h"] % 2**64, r["c"]) for r in rows if r["k"] == k)
        tables += [np.array([g[0] for g in got], U), np.array([g[1] for g in got], np.int64)]
    heavy_b = spark.sparkContext.broadcast((*tables, max(1, total)))
    found = _rows(_settled(_postings(docs, heavy_b, parts * BUCKETS, order), heavy_b, parts), parts)
    return _scores(found.union(_short(docs, order, short)) if short else found)


def _scores(parts: DataFrame) -> DataFrame:
    sums = parts.groupBy("doc_id").agg(F.sum("x").alias("log_prob"), F.sum("n").alias("n_tokens"))
    return sums.select("doc_id", "n_tokens", "log_prob", F.try_divide("log_prob", "n_tokens").alias("score"))


def _by_joins(docs: DataFrame, order: int, backoff: float, min_count: int) -> DataFrame:
    """(doc_id, x, n): the general form.  Each document's distinct places (all its n-grams that end there, and their contexts) are rows; tables of
    counts by length and hash are joined to them from the longest n-gram down.  Hot n-grams are split by adaptive execution."""
    names = [f"h{k}" for k in range(1, order + 1)] + [f"p{k}" for k in range(2, order + 1)]

    def places(batches):
        for b in words.chunks(batches):
            data, off = words.text_buffers(b.column("text"))
            w, wo = words.word_hashes(data, off)
            sizes = np.diff(wo).astype(np.int64)
            owner = np.repeat(np.arange(b.num_rows, dtype=np.int64), sizes)
            place = np.arange(len(w)) - np.repeat(wo[:-1], sizes)
            cols = [pa.array(np.concatenate([owner, np.flatnonzero(sizes == 0)]))]
            blank = np.zeros(int((sizes == 0).sum()), np.int64)
            for k in [*range(1, order + 1), *range(-2, -order - 1, -1)]:
                # the n-gram of k words that ends here, or (below 0) the words before it
                span, back = (k, 0) if k > 0 else (-k - 1, 1)
                g = words.ngram_hashes(w, span)
                h = np.zeros(len(w), U)
                h[span - 1 + back :] = g[: max(0, len(w) - span + 1 - back)]
                ok = place >= abs(k) - 1
                cols.append(pa.array(np.concatenate([h.view(np.int64), blank]), mask=np.concatenate([~ok, blank == 0])))
            t = pa.table([*cols, pa.array(np.concatenate([np.ones(len(w), np.int64), blank]))], names=["row", *names, "times"])
            t = t.group_by(["row", *names]).aggregate([("times", "sum")])
            ids = b.column("doc_id").take(t.column("row").combine_chunks())
            yield from pa.table([ids, *[t.column(n) for n in names], t.column("times_sum")], names=["doc_id", *names, "times"]).combine_chunks().to_batches()

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", times long"
    rows = common.Workspace(docs.sparkSession, "lm-score").table(docs.mapInArrow(places, schema))
    tables = {k: rows.where(f"h{k} is not null").groupBy(f"h{k}").agg(F.sum("times").alias(f"c{k}")).where(F.col(f"c{k}") >= min_count) for k in range(2, order + 1)}
    one = rows.where("h1 is not null").groupBy("h1").agg(F.sum("times").alias("c1"))
    total = rows.agg(F.sum("times").alias("total"))
    all_counts = {1: one} | {k: rows.where(f"h{k} is not null").groupBy(f"h{k}").agg(F.sum("times").alias(f"c{k}")) for k in range(2, order)}
    df = rows.join(one, "h1", "left").crossJoin(F.broadcast(total))
    for k in range(2, order + 1):
        df = df.join(tables[k], f"h{k}", "left")
        df = df.join(all_counts[k - 1].select(F.col(f"h{k - 1}").alias(f"p{k}"), F.col(f"c{k - 1}").alias(f"d{k}")), f"p{k}", "left")
    best = F.log(F.col("c1") / F.col("total"))
    for k in range(2, order + 1):
        shorter = F.when(F.col(f"h{k}").isNull(), best).otherwise(best + float(np.log(backoff)))
        best = F.when(F.col(f"c{k}").isNotNull(), F.log(F.col(f"c{k}") / F.col(f"d{k}"))).otherwise(shorter)
    return df.select("doc_id", F.when(F.col("times") > 0, best * F.col("times")).otherwise(0.0).alias("x"), F.col("times").alias("n"))
