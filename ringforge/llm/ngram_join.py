"""Near-duplicate documents: an exact Jaccard self-join over word n-grams.

Two documents link when 100 * |A & B| >= percent * |A | B| for their sets of distinct n-word shingles.

Method (prefix filtering as in AllPairs / PPJoin+):

1. One pass gives every document's set size and a 128-bit fingerprint of its set, and counts shingles in a
   table of fixed size.  Equal sets form classes, by an aggregate with map-side combine.
2. Shingles are ordered rare first (by that count, then by hash; any total order gives the same result).  Of each
   set only the first |A| - ceil(t|A|) + 1 are sent out, packed in binary and dealt by hash.
3. Per shingle, shared by at least two sets: all pairs of a list of up to SMALL sets become candidates if the
   length and positional filters let them pass; of longer lists at first only neighbours in the order of set size and HUBS sets with all others.
   So candidates grow with the number of postings, not with its square.
4. Suffix filter: parities of the counts of hash ranges bound the Hamming distance of two sets from below; candidates
   beyond what the threshold allows go.  Of the others the whole sets meet; pivots split them in parts, whose sizes bound the distance
   once more, as in PPJoin+, before a pair is verified, once: first each set's
   closest candidate, then those that lie between the components these give.
   A shingle that very many sets have is dealt in blocks of sets; the hubs of its blocks meet in the same way.
5. Links give components.  What is left are pairs of documents of a long list that aren't yet connected: all of
   them pass through the same filters (as conditions of one join, so that what fails is never a row), are verified, and
   components are taken again.  Pairs inside a component need no further look: they can't change it.

So a large group of near copies costs in proportion to its size, and no link between components is lost.

Null or empty texts, or texts without words: n_shingles 0, linked with nothing.  Rows without id are kept,
unlinked, with a null component.  Rows with the same id count as one node.  Extra columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, words
from .words import U

#: The table that orders shingles: one-byte counters on the driver and each worker, 16 for each document from 4 MB to 64 MB.
COUNTERS_LOG2 = (22, 26)
#: Documents after which a task gives up its counts, so that two bytes hold them.
COUNTED = 60_000
#: Hash ranges whose parities the suffix filter compares.
SKETCH = 512
#: Lists of up to so many sets give all their pairs at once; longer ones first give neighbours.
SMALL = 32
#: How many sets of a longer list meet all others at first.
HUBS = 4
#: A shingle that about so many sets have is dealt to several tasks, in blocks of sets.
HOT = 1 << 16
#: Marks the numbers of such shingles.
HOT_BIT = 1 << 62


def _fingerprints(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a = words.mix(s + U(0x243F6A8885A308D3)).sum(dtype=U) if len(s) else U(0)
        b = words.mix(s ^ U(0x13198A2E03707344)).sum(dtype=U) if len(s) else U(0)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _sets(batch: pa.RecordBatch, n: int):
    data, off = words.text_buffers(batch.column("text"))
    w, wo = words.word_hashes(data, off)
    return words.shingle_sets(w, wo, n)


def _rank(counts: np.ndarray) -> np.ndarray:
    """Counts to one byte, in order: exact up to 127, then by their logarithm, four steps to a doubling."""
    big = 128 + 4 * (np.log2(np.maximum(counts, 128)) - 7)
    return np.where(counts < 128, counts, np.minimum(big, 255)).astype(np.uint8)


def _blocks(freq: np.ndarray) -> np.ndarray:
    """Into how many blocks a shingle of this rank is dealt (1: none), so that each has about HOT sets or fewer."""
    over = freq.astype(np.int64) - int(_rank(np.array([HOT]))[0])
    return np.where(over >= 0, 2 << np.maximum(over, 0) // 4, 1)


def describe(docs: DataFrame, n: int, log2: int) -> DataFrame:
    """One row per document (kind 0: doc_id, n, f1, f2), and each task's counts of shingles (kind 1: part, vec)."""

    def flush(counts):
        rows = common.vector_rows(counts)
        k = len(rows)
        none = pa.nulls(k, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([1] * k, pa.int32()), none, none, none, none, pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=NAMES)

    def run(batches):
        counts, seen = np.zeros(1 << log2, np.uint16), 0
        shift = U(64 - log2)
        for b in words.chunks(batches):
            size, f1, f2, all_ = [], [], [], []
            for s in _sets(b, n):
                x, y = _fingerprints(s)
                size.append(len(s)), f1.append(x), f2.append(y), all_.append(s)
            k = len(size)
            if seen + k > COUNTED:
                yield flush(counts)
                counts[:], seen = 0, 0
            seen += k
            np.add.at(counts, (np.concatenate(all_) >> shift).astype(np.int64), np.uint16(1))
            yield pa.RecordBatch.from_arrays([pa.array([0] * k, pa.int32()), b.column("doc_id"), pa.array(size, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=NAMES)
        yield flush(counts)
        del counts
        words.release()

    NAMES = ["kind", "doc_id", "n", "f1", "f2", "part", "vec"]
    return docs.mapInArrow(run, "kind int, doc_id long, n long, f1 long, f2 long, part int, vec binary")


def _prefix_postings(docs: DataFrame, counts_b, twins_b, n: int, percent: int, parts: int) -> DataFrame:
    """Packed prefixes (part, blob): documents with size, fingerprints of those that have twins (equal sets), 40 bits of each
    shingle, whose it is and its place; and in one row of each chunk the documents' sizes and sketches.  A task sends each set once."""

    def run(batches):
        counts = np.frombuffer(counts_b.value, np.uint8)
        shift = U(64 - (len(counts) - 1).bit_length())
        sent: set = set()
        chunk = 0
        for b in words.chunks(batches, 1 << 22):
            ids = b.column("doc_id").to_pylist()
            docs_, sizes, prints, toks, who, pos, ranks, sketches = [], [], [], [], [], [], [], []
            for d, s in zip(ids, _sets(b, n), strict=True):
                m = len(s)
                if not m or d is None:
                    continue
                f1, f2 = _fingerprints(s)
                key = (m, f1, f2)
                if key in sent:
                    continue
                if len(sent) >= 50_000:
                    sent.clear()
                sent.add(key)
                k = m - -(-percent * m // 100) + 1
                freq = counts[(s >> shift).astype(np.int64)]
                if k < m:
                    lim = np.partition(freq, k - 1)[k - 1]
                    keep = np.flatnonzero(freq <= lim)  # the k least are among these; s is sorted, so ties go by hash
                    order = keep[np.argsort(freq[keep], kind="stable")][:k]
                else:
                    order = np.argsort(freq, kind="stable")[:k]
                toks.append(s[order])
                who.append(np.full(k, len(docs_), np.uint16))
                pos.append(np.arange(k, dtype=np.uint32))
                ranks.append(freq[order])
                docs_.append(d), sizes.append(m), prints.append(f1 ^ (f2 << 1 & 0x7FFFFFFFFFFFFFFF))
                sketches.append(_sketch(s))
            if not docs_:
                continue
            t, w, p = np.concatenate(toks), np.concatenate(who), np.concatenate(pos)
            blocks = _blocks(np.concatenate(ranks))
            hot = blocks > 1
            # equal sets, wherever they are, fall into one block
            block = words.mix(np.array(prints, np.int64).view(U)[w]) % blocks.astype(U)
            part = ((np.where(hot, words.mix(t + block), t) >> U(32)) * U(parts) >> U(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            t, w, p, hot = t[order], w[order], p[order], hot[order]
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            da, sa, fa = np.array(docs_, np.int64), np.array(sizes, np.uint32), np.array(prints, np.int64)
            twin = common.bloom_has(twins_b.value, da)
            mine = chunk * 7919 % parts
            chunk += 1
            out_p, out_b = [], []
            for j in range(parts):
                lo, hi = cuts[j], cuts[j + 1]
                if lo < hi or j == mine:
                    used, local = np.unique(w[lo:hi], return_inverse=True)
                    own = (da, sa, np.frombuffer(b"".join(sketches), np.uint8)) if j == mine else (da[:0], sa[:0], np.zeros(0, np.uint8))
                    tt = t[lo:hi]
                    out_p.append(j)
                    out_b.append(common.pack([da[used], sa[used], twin[used], fa[used][twin[used]], (tt & U(0xFFFFFFFF)).astype(np.uint32), (tt >> U(32) & U(0xFF)).astype(np.uint8), local.astype(np.uint16), p[lo:hi], hot[lo:hi], *own]))
            yield pa.RecordBatch.from_arrays([pa.array(out_p, pa.int32()), pa.array(out_b, pa.binary())], names=["part", "blob"])

    return docs.mapInArrow(run, "part int, blob binary")


_KINDS = (np.int64, np.uint32, np.bool_, np.int64, np.uint32, np.uint8, np.uint16, np.uint32, np.bool_, np.int64, np.uint32, np.uint8)


def _sketch(s: np.ndarray) -> bytes:
    """Parities of the counts of SKETCH hash ranges.  Ranges whose parities differ are at most as many as elements that only one of two sets has."""
    return np.packbits((np.bincount((s >> U(20)).astype(np.int64) & (SKETCH - 1), minlength=SKETCH) & 1).astype(np.uint8)).tobytes()


def passes(na, nb, pa_, pb, percent: int):
    """Length filter and positional filter: can sets of these sizes, whose first common prefix shingle stands at these places, still reach the threshold?"""
    enough = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    need = -(-percent * (na + nb) // (100 + percent))
    return enough & (1 + np.minimum(na - pa_ - 1, nb - pb - 1) >= need)


def _shared(postings: DataFrame, percent: int, parts: int) -> DataFrame:
    """kind 0: postings (tok, doc, n, pos) of shingles that more than SMALL sets share; kind 1: pairs (doc, other) that pass the
    filters, all of shorter lists, neighbours and hubs of the longer; kind 2: (doc, n, sketch).  Of a hot shingle's block all postings are kind 0, and its hubs are
    kind 3 too, by which blocks meet."""

    def run(batches):
        toks, ids, sizes, prints, poss, sks = [], [], [], [], [], []
        for b in batches:
            for part, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                d, s, twin, some, t0, t1, w, p, hot, sd, ss, sk = common.unpack(blob, _KINDS)
                f = d.copy()  # a set without twins is told apart by its document
                f[twin] = some
                # 40 bits tell the shingles of one part apart: a coincidence makes a candidate more, never one less
                toks.append(t0.astype(U) | (t1.astype(U) << U(32)) | np.where(hot, U(HOT_BIT), U(part << 40)))
                ids.append(d[w]), sizes.append(s[w]), prints.append(f[w]), poss.append(p)
                if len(sd):
                    sks.append((sd, ss.astype(np.int64), sk.reshape(len(sd), -1)))
        words.release()
        if not toks:
            return
        for x, size, k in sks:
            v = np.ascontiguousarray(k).view(np.int64)
            m = len(x)
            none = pa.nulls(m, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, 2, np.int32)), none, pa.array(x), none, pa.array(size), none, pa.array(list(v), pa.list_(pa.int64()))], names=NAMES)
        t = np.concatenate(toks)
        order = np.argsort(t, kind="stable")
        t = t[order]
        keep = _in_lists(t, 2) | (t >= U(HOT_BIT))
        order, t = order[keep], t[keep]
        del toks
        d, s, f, p = (np.concatenate(x)[order] for x in (ids, sizes, prints, poss))
        del ids, sizes, prints, poss
        s, p = s.astype(np.int64), p.astype(np.int64)
        # equal sets are one class already: the least id stands for the copies that other tasks sent
        order = np.lexsort((d, f, s, t))
        t, d, s, f, p = t[order], d[order], s[order], f[order], p[order]
        first = np.ones(len(t), bool)
        first[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1]) | (f[1:] != f[:-1])
        t, d, s, p = t[first], d[first], s[first], p[first]
        long_ = _in_lists(t, SMALL + 1)
        listed = np.flatnonzero(long_ | (t >= U(HOT_BIT)))
        for k in range(0, len(listed), 100_000):
            e = listed[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(e), np.int32)), pa.array(t[e].astype(np.int64)), pa.array(d[e]), pa.nulls(len(e), pa.int64()), pa.array(s[e]), pa.array(p[e]), pa.nulls(len(e), LONGS)], names=NAMES)
        pairs = [np.zeros((0, 2), np.int64)]
        for step in range(1, SMALL):
            if len(t) <= step:
                break
            ok = (t[step:] == t[:-step]) & passes(s[step:], s[:-step], p[step:], p[:-step], percent)
            if step > 1:
                ok &= ~long_[step:]
            at = np.flatnonzero(ok)
            x, y = d[at], d[at + step]
            pairs.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
        # of long lists, the sets with the rarest shingles least in number meet all others: where a list is a group of near copies,
        # they are the ones nearest to its middle
        reps = []
        if len(listed):
            cuts = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            for lo, hi in zip(cuts, np.append(cuts[1:], len(t)), strict=True):
                if not long_[lo] and t[lo] < U(HOT_BIT):
                    continue
                hubs = lo + np.lexsort((d[lo:hi], p[lo:hi]))[:HUBS]
                if t[lo] >= U(HOT_BIT):
                    reps.append(hubs)
                for h in hubs:
                    at = lo + np.flatnonzero(passes(s[lo:hi], s[h], p[lo:hi], p[h], percent))
                    pairs.append(np.stack([np.minimum(d[at], d[h]), np.maximum(d[at], d[h])], 1))
        if reps:
            e = np.concatenate(reps)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(e), 3, np.int32)), pa.array(t[e].astype(np.int64)), pa.array(d[e]), pa.nulls(len(e), pa.int64()), pa.array(s[e]), pa.array(p[e]), pa.nulls(len(e), LONGS)], names=NAMES)
        pairs = np.unique(np.concatenate(pairs), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        for k in range(0, len(pairs), 100_000):
            e = pairs[k : k + 100_000]
            none = pa.nulls(len(e), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(e), np.int32)), none, pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy()), none, none, pa.nulls(len(e), LONGS)], names=NAMES)
        del t, d, s, f, p, pairs
        words.release()

    LONGS = pa.list_(pa.int64())
    NAMES = ["kind", "tok", "doc", "other", "n", "pos", "sketch"]
    return postings.repartitionById(parts, F.col("part")).mapInArrow(run, "kind int, tok long, doc long, other long, n long, pos long, sketch array<long>")


def _in_lists(t: np.ndarray, least: int) -> np.ndarray:
    """Which of the sorted values occur at least ``least`` times."""
    if len(t) < least:
        return np.zeros(len(t), bool)
    cuts = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
    size = np.diff(np.append(cuts, len(t)))
    return np.repeat(size >= least, size)


def _set_rows(docs: DataFrame, wanted_b, n: int) -> DataFrame:
    """(doc_id, toks) of the documents that may be wanted."""

    def run(batches):
        for b in words.chunks(b.filter(pa.array(common.bloom_has(wanted_b.value, b.column("doc_id").to_numpy(zero_copy_only=False)))) for b in batches):
            ids, tok = [], []
            for d, s in zip(b.column("doc_id").to_pylist(), _sets(b, n), strict=True):
                if len(s):
                    ids.append(d), tok.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tok, pa.binary())], names=["doc_id", "toks"])

    return docs.where("doc_id is not null").mapInArrow(run, "doc_id long, toks binary")


def _met_reps(reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets that stand for the blocks of hot shingles: each with the HUBS sets nearest to the shingle's front, and with the next in size."""
    order = Window.partitionBy("tok")
    x = reps.select("tok", "doc", "n", "pos", F.row_number().over(order.orderBy("pos", "doc")).alias("place"), F.lead(F.struct("doc", "n", "pos")).over(order.orderBy("n", "doc")).alias("next"))
    hubs = x.where(F.col("place") <= HUBS).select(F.col("tok").alias("t"), F.struct("doc", "n", "pos").alias("o"))
    met = x.join(hubs, F.col("tok") == F.col("t")).select("doc", "n", "pos", "o").union(x.where("next is not null").select("doc", "n", "pos", "next"))
    met = met.select("doc", "n", "pos", F.col("o.doc").alias("doc_b"), F.col("o.n").alias("n_b"), F.col("o.pos").alias("pos_b"))
    ok = (F.col("doc") != F.col("doc_b")) & _passes("n", "n_b", "pos", "pos_b", percent)
    return met.where(ok).select(F.least("doc", "doc_b").alias("a"), F.greatest("doc", "doc_b").alias("b"))


def _passes(na: str, nb: str, pa_: str, pb: str, percent: int):
    """passes() on columns."""
    length = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    return length & (1 + F.least(F.col(na) - F.col(pa_) - 1, F.col(nb) - F.col(pb) - 1) >= _need(na, nb, percent))


def _need(a: str, b: str, percent: int):
    return F.ceil(F.lit(percent) * (F.col(a) + F.col(b)) / F.lit(100 + percent))


def _apart():
    """The least Hamming distance that the sketches k0_a .. and k0_b .. allow."""
    return sum((F.bit_count(F.col(f"k{i}_a").bitwiseXOR(F.col(f"k{i}_b"))) for i in range(SKETCH // 64)), F.lit(0))


def _close(percent: int):
    """Suffix filter on columns n_a, n_b, k0_a .. k0_b ..: that distance leaves room for the threshold."""
    return F.col("n_a") + F.col("n_b") - 2 * _need("n_a", "n_b", percent) >= _apart()


def sets_of(ws: common.Workspace, docs: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """(doc_id, toks) of all documents in pairs (a, b)."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    return ws.keep(_set_rows(docs, common.bloom(ws, ids, 2 * pairs.count()), n).join(ids, "doc_id", "left_semi"))


#: Pivots of the suffix filter: 32 parts of the range of hashes.
PIVOTS = np.arange(33, dtype=np.float64) * 2.0**59


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """The least Hamming distance of two sorted sets, as the suffix filter bounds it: pivots split both in parts, and parts differ by their sizes at least."""
    p = PIVOTS[1:-1].astype(U)
    cx, cy = (np.diff(np.concatenate([[0], np.searchsorted(z, p), [len(z)]])) for z in (x, y))
    return int(np.abs(cx - cy).sum())


def verify(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose whole sets reach the threshold."""
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("toks").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("toks").alias("y")), "b").select("a", "b", "x", "y")

    def check(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = len(x) + len(y)
                if apart(x, y) > both - 2 * -(-percent * both // (100 + percent)):
                    ok.append(False)
                    continue
                common_ = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common_ >= percent * (both - common_))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))
        words.release()

    return both.mapInArrow(check, "a long, b long").distinct()


def _few(ws: common.Workspace) -> int:
    """Files for tables that are small beside the documents."""
    return 1 + common.partitions(ws.spark) // 8


def _joined(ws: common.Workspace, labels: DataFrame, sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Components after those of the pairs that lie between components are verified."""
    of = {x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab"}
    between = pairs.join(of["a"], "a", "left").join(of["b"], "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    between = ws.table(between, files=_few(ws))  # few: the sets are then not dealt again for them
    more = ws.table(verify(sets, between, percent), files=_few(ws))
    if not more.limit(1).count():
        return labels
    return ws.table(common.components(ws, labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)), files=_few(ws))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    ws = common.Workspace(spark, "ngram-join")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = common.partitions(spark)

    log2 = min(COUNTERS_LOG2[1], max(COUNTERS_LOG2[0], (16 * docs.count()).bit_length()))
    first = ws.keep(describe(docs, n, log2))
    counts_b = ws.share(common.sum_vectors(first.where("kind = 1"), 1 << log2, "uint16", _rank, "uint8").tobytes())
    size = first.where("kind = 0").select("doc_id", "n", "f1", "f2")
    known = size.where("doc_id is not null and n > 0")
    classes = ws.table(known.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("top")).where("b <> top"), files=_few(ws))
    # each document of a class of equal sets, with the least of them; in a stage of its own, whose hot classes can be split
    twins = ws.table(known.join(classes.select("n", "f1", "f2", "b"), ["n", "f1", "f2"]).select(F.col("doc_id").alias("a"), "b"), files=_few(ws))
    twins_b = common.bloom(ws, twins.select("a"), twins.count())

    found = ws.keep(_shared(_prefix_postings(docs.where("doc_id is not null"), counts_b, twins_b, n, percent, parts), percent, parts))
    sketch = found.where("kind = 2").select("doc", "n", *[F.col("sketch")[i].alias(f"k{i}") for i in range(SKETCH // 64)])
    side = {x: sketch.select(*[F.col(c).alias({"doc": x}.get(c, f"{c}_{x}")) for c in sketch.columns]) for x in "ab"}
    near = found.where("kind = 1").select(F.col("doc").alias("a"), F.col("other").alias("b")).union(_met_reps(found.where("kind = 3"), percent)).distinct()
    near = ws.table(near.join(side["a"], "a").join(side["b"], "b").where(_close(percent)).select("a", "b", _apart().alias("apart")), files=_few(ws))
    sets = sets_of(ws, docs, near, n)
    # first each document with its closest partner, by the sketches: most groups are connected by that
    closest = near.select(F.col("a").alias("d"), F.struct("apart", F.col("b").alias("o")).alias("m")).union(near.select("b", F.struct("apart", F.col("a").alias("o"))))
    closest = closest.groupBy("d").agg(F.min("m").alias("m")).select(F.least("d", "m.o").alias("a"), F.greatest("d", "m.o").alias("b")).distinct()
    links = verify(sets, closest, percent).union(twins.where("a <> b"))
    labels = ws.table(common.components(ws, links), files=_few(ws))
    labels = _joined(ws, labels, sets, near.select("a", "b").join(closest, ["a", "b"], "left_anti"), percent)

    # of the long lists: candidates between different components.  One side is what stands outside the list's main component
    lists = found.where("kind = 0").select("tok", "doc", "n", "pos")
    if lists.limit(1).count():
        lists = lists.join(labels.select(F.col("node").alias("doc"), "component"), "doc", "left").select("tok", "doc", "n", "pos", F.coalesce("component", "doc").alias("comp"))
        several = lists.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("tok")
        several = several.select(common.spread("tok").alias("key"))
        lists = ws.table(lists.join(several, common.spread("tok") == F.col("key"), "left_semi").join(sketch.drop("n"), "doc"), files=_few(ws))
        main = lists.groupBy("tok", "comp").agg(F.count("*").alias("c")).groupBy("tok").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"))
        main = main.select(common.spread("tok").alias("key"), "main")
        mixed = lists.join(main, common.spread("tok") == F.col("key")).drop("key").withColumn("in_main", F.col("comp") == F.col("main"))
        side = {x: mixed.select(*[F.col(c).alias({"tok": "tok"}.get(c, f"{c}_{x}")) for c in mixed.columns]) for x in "ab"}
        order = (F.col("comp_a") != F.col("comp_b")) & (F.col("in_main_b") | (F.col("doc_a") < F.col("doc_b")))
        x, y = side["a"].where("not in_main_a"), side["b"].withColumnRenamed("tok", "tok_b")
        met = x.join(y, (F.col("tok") == F.col("tok_b")) & order & _passes("n_a", "n_b", "pos_a", "pos_b", percent) & _close(percent))
        rest = ws.table(met.select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b")).distinct().join(near, ["a", "b"], "left_anti"), files=_few(ws))
        if rest.limit(1).count():
            labels = _joined(ws, labels, sets_of(ws, docs, rest, n), rest, percent)
    size = ws.table(size.select("doc_id", "n"), files=_few(ws))
    ws.release()
    ws.drop_all_but(size, labels)
    return size.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """The rows, with all their columns, of one document of each component (the smallest id); rows without id stay.

    Of rows with equal id and text one stays, the one of the least hash of all columns; rows of one id with different texts all stay (they are one node, so
    all of them go if their id does).  An empty table gives an empty one.  Only rows that may go are dealt by id: a filter of bounded size lets all
    others through as they are read."""
    spark = docs.sparkSession
    ws = common.Workspace(spark, "one-of-each")
    got = ws.table(near_duplicates(docs, id_col, text_col, n, percent), files=_few(ws))
    ids = got.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count("*").alias("k"))
    odd = ws.table(ids.where("c <> doc_id or k > 1").select("doc_id", (F.col("c") != F.col("doc_id")).alias("goes")), files=_few(ws))
    maybe_b = common.bloom(ws, odd.select("doc_id"), odd.count())
    key = F.col(id_col).cast("long")
    maybe = common.in_bloom(maybe_b, F.coalesce(key, F.lit(0))) & key.isNotNull()
    certain = docs.where(~maybe)
    whole = F.struct(*docs.columns)
    named = docs.where(maybe).select(whole.alias("row"), key.alias("key"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))
    named = named.join(odd.withColumnRenamed("doc_id", "key"), "key", "left").where(~F.coalesce("goes", F.lit(False)))
    once = named.where("goes is null").select("row.*")
    again = named.where("goes is not null").groupBy("key", "text_hash").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row.*")
    return certain.union(once).union(again)
