"""Benchmark decontamination by greedy string tiling.

Tokens are runs of characters other than white space and ASCII punctuation, ASCII letters lower-cased.  Each document is
joined with the benchmark items on shared seeds (token n-grams of the shortest tile's length).  For each pair that the seeds
could lift to the threshold, tiles are found as in running Karp-Rabin greedy string tiling: rolling hashes of the
present search length find matches of unmarked tokens, the longest are marked first
so that tiles don't overlap, and the search length falls to the shortest tile's.  A document leaks an item if tiles cover
at least ``threshold`` of the item's tokens, in whatever order the passages stand.  An item with fewer tokens than the shortest tile is leaked where all
of them stand in a row.

The benchmark's seeds are broadcast in blocks of at most ``block_bytes`` of text (most benchmarks are one block), each
block against all documents; so what is broadcast has a fixed bound for any benchmark.  Documents are never shuffled.

Null or empty texts leak nothing, and items without tokens aren't leaked.  Rows without id
are not reported.  Repeated document rows give one row for each; items with equal texts each give a row.  Extra columns
are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words
from .words import U

MIN_TILE = 4
THRESHOLD = 0.6


def tokens(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return words.word_hashes(data, np.array([0, len(data)]), words.PUNCTUATION)[0]


class _Rolling:
    """A token sequence: which tokens are unmarked, and the hash of any number of tokens from running sums."""

    def __init__(self, tokens: np.ndarray):
        n = len(tokens)
        self.tokens, self.free = tokens, np.ones(n, bool)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(words.mix(tokens) * _power(_MUL, n), out=self.sums[1:])

    def hashes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(places of ``length`` unmarked tokens in a row, their hashes)."""
        n = len(self.tokens) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        marked = np.concatenate([[0], np.cumsum(~self.free)])
        at = np.flatnonzero(marked[length:] == marked[:-length])
        return at, (self.sums[at + length] - self.sums[at]) * _power(_INV, n)[at]


_MUL = 0xD1342543DE82EF95
_INV = pow(_MUL, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    got = _powers.get(base, np.ones(1, U))
    if len(got) < n:
        while len(got) < n:
            got = np.concatenate([got, got * U(pow(base, len(got), 2**64))])
        if len(got) <= 1 << 20:  # longer ones are made for the text alone
            _powers[base] = got
    return got[:n]


def tiles(item: np.ndarray, doc: np.ndarray, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in doc, length), longest first, none overlapping another; of equal ones the first in the item, then in the doc.

    The length of the longest match of unmarked tokens is found by halving (if n tokens match, so do n - 1), then all matches of that length are
    marked: their places are looked up by hash, and places that are marked meanwhile are passed over for good.  So time grows with the lengths, also where one word
    is repeated all over."""
    x, y = _Rolling(item), _Rolling(doc)
    out: list[tuple[int, int, int]] = []
    top = min(len(item), len(doc))
    while True:
        low, high = least - 1, top
        while low < high:
            mid = (low + high + 1) // 2
            if np.isin(x.hashes(mid)[1], y.hashes(mid)[1]).any():
                low = mid
            else:
                high = mid - 1
        if low < least:
            return out
        at_x, hx = x.hashes(low)
        at_y, hy = y.hashes(low)
        order = np.argsort(hy, kind="stable")
        at_y, hy = at_y[order], hy[order]
        lo, hi = np.searchsorted(hy, hx, "left"), np.searchsorted(hy, hx, "right")
        next_: dict[int, int] = {}  # of each hash, its first place in the doc that may still be unmarked
        for i, p, q in zip(*(v[hi > lo].tolist() for v in (at_x, lo, hi)), strict=True):
            if not x.free[i : i + low].all():
                continue
            k = next_.get(p, p)
            while k < q and not y.free[at_y[k] : at_y[k] + low].all():
                k += 1
            next_[p] = k
            if k < q:
                d = int(at_y[k])
                out.append((i, d, low))
                x.free[i : i + low] = False
                y.free[d : d + low] = False
        top = low - 1


def _near(doc: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """The document's tokens at seeds, and a token that matches nothing between stretches: no tile reaches beyond."""
    keep = np.zeros(len(doc) + 1, np.int32)
    np.add.at(keep, places, 1)
    np.add.at(keep, places + n, -1)
    inside = np.cumsum(keep[:-1]) > 0
    at = np.flatnonzero(inside)
    out = np.insert(doc[at], np.flatnonzero(np.diff(at) > 1) + 1, U(0))
    return out


def _items(benchmark: DataFrame, item_col: str, item_text_col: str, block_bytes: int):
    """The benchmark in blocks of about block_bytes (one item at least): lists of (item, text).  With several blocks it is dealt to them once."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-int(size) // block_bytes) or 1
    if blocks > 1:
        path = f"{common.Workspace(benchmark.sparkSession, 'decontaminate').root}/items"
        items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))).repartition("block").write.partitionBy("block").parquet(path)
        dealt = benchmark.sparkSession.read.schema("item_id long, text string, block long").parquet(path)
    for k in range(blocks):
        rows = (dealt.where(F.col("block") == k).select("item_id", "text") if blocks > 1 else items).collect()
        yield sorted(((r["item_id"], r["text"]) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = MIN_TILE, threshold: float = THRESHOLD, block_bytes: int = 8 << 20) -> DataFrame:
    """One row for each document and item that it leaks: doc_id, item_id, coverage, matched_tokens, item_tokens, n_tiles."""
    common.bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    out = None
    for items in _items(benchmark, item_col, item_text_col, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(_seeds(items, least))

        def run(batches, shared=shared):
            for b in words.chunks(batches):
                ids = b.column("doc_id").to_pylist()
                rows = [(ids[d], *x) for d, *x in _found(shared.value, b.column("text"), least, threshold)]
                cols = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "coverage", "matched_tokens", "item_tokens", "n_tiles"])

        got = docs.mapInArrow(run, "doc_id long, item_id long, coverage double, matched_tokens long, item_tokens long, n_tiles long")
        out = got if out is None else out.union(got)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = MIN_TILE, threshold: float = THRESHOLD, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows, with all their columns, that leak no item."""
    common.bounded_batches(docs.sparkSession)
    for items in _items(benchmark, item_col, item_text_col, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(_seeds(items, least))

        def run(batches, shared=shared):
            for b in words.chunks(batches, column=text_col):
                bad = {r[0] for r in _found(shared.value, b.column(text_col), least, threshold)}
                yield b.filter(pa.array([k not in bad for k in range(b.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def _seeds(items: list[tuple[int, str]], least: int):
    """(item ids, their tokens, {seed length: (distinct seeds, where each one's items begin, the items, seeds by place)}).  Items shorter than ``least`` are one seed as a whole."""
    toks = [tokens(t) for _, t in items]
    by: dict[int, tuple[list, list]] = {}
    for k, t in enumerate(toks):
        if len(t):
            n = min(least, len(t))
            g = np.unique(words.ngram_hashes(t, n))
            seed, owner = by.setdefault(n, ([], []))
            seed.append(g), owner.append(np.full(len(g), k, np.int32))
    out = {}
    for n, (seed, owner) in by.items():
        seed, owner = np.concatenate(seed), np.concatenate(owner)
        order = np.argsort(seed, kind="stable")
        distinct, first = np.unique(seed[order], return_index=True)
        # of each item, which seed stands at each place
        places = {int(k): np.searchsorted(distinct, words.ngram_hashes(toks[k], n)) for k in np.unique(owner)}
        out[n] = (distinct, np.append(first, len(seed)), owner[order], places)
    return [i for i, _ in items], toks, out


def _found(shared, text: pa.Array, least: int, threshold: float):
    """(row number, item, coverage, matched tokens, item's tokens, tiles) of the leaks in a batch of texts."""
    ids, toks, by_length = shared
    data, off = words.text_buffers(text)
    w, wo = words.word_hashes(data, off, words.PUNCTUATION)
    got = []
    for n, (seed, starts, owner, places) in sorted(by_length.items()):
        # a first look at 16 bits of the hash spares most searches
        may = np.zeros(1 << 16, bool)
        may[(seed >> U(48)).astype(np.int64)] = True
        g = words.ngram_hashes(w, n)
        hit = np.flatnonzero(may[(g >> U(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(seed, g[hit]), len(seed) - 1)
        ok = seed[at] == g[hit]
        hit, at = hit[ok], at[ok]
        doc = np.searchsorted(wo, hit, "right") - 1
        inside = hit + n <= wo[doc + 1]
        hit, at, doc = hit[inside], at[inside], doc[inside]
        # pairs of document and item, by the distinct seeds that they share: n tokens for each at most
        pair = np.unique(doc * len(seed) + at)
        d, k = pair // len(seed), pair % len(seed)
        count = starts[k + 1] - starts[k]
        place = np.repeat(starts[k] - np.cumsum(count) + count, count) + np.arange(count.sum())
        both, shares = np.unique(np.repeat(d, count) * len(toks) + owner[place], return_counts=True)
        size = np.array([len(t) for t in toks])
        both = both[shares * n >= threshold * size[both % len(toks)]] if len(both) else both
        now, there = -1, np.zeros(len(seed), bool)
        for x in both.tolist():
            d, j = divmod(x, len(toks))
            if d != now:
                lo, hi = np.searchsorted(doc, [d, d + 1])
                there[:] = False
                there[at[lo:hi]] = True
                now = d
            # tiles only cover what shared seeds cover
            some = np.concatenate([[0], np.cumsum(np.append(there[places[j]], np.zeros(n - 1, bool)))])
            if (some[1:] > some[np.maximum(0, np.arange(1, len(some)) - n)]).sum() < threshold * len(toks[j]):
                continue
            own = np.isin(at[lo:hi], places[j])
            near = _near(w[wo[d] : wo[d + 1]], hit[lo:hi][own] - wo[d], n)
            found = tiles(toks[j], near, n)
            covered = sum(x[2] for x in found)
            if covered >= threshold * len(toks[j]):
                got.append((d, j, covered, len(found)))
    for d, j, covered, k in sorted(got):
        yield d, ids[j], covered / len(toks[j]), covered, len(toks[j]), k
