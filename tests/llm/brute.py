"""Plain versions of the operators, for small tables."""

import collections
import random
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text):
    return WORD.findall((text or "").translate(LOW))


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def near_duplicates(rows, n=5, percent=75):
    """{id: (set size, component)} by comparing all pairs."""
    sets = {d: shingles(t, n) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), root(d)) for d in sets}


def lm_scores(rows, order=3, backoff=0.4, min_count=1):
    """{id: (words, sum of log S)} by counting every n-gram and going down from the longest."""
    import math

    toks = {d: words(t) for d, t in rows}
    counts = collections.Counter()
    for w in toks.values():
        for k in range(1, order + 1):
            counts.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    total = sum(len(w) for w in toks.values())
    out = {}
    for d, w in toks.items():
        s = 0.0
        for i in range(len(w)):
            part, k = 0.0, min(order, i + 1)
            while k > 1 and counts[tuple(w[i - k + 1 : i + 1])] < min_count:
                part, k = part + math.log(backoff), k - 1
            c = counts[tuple(w[i - k + 1 : i + 1])]
            s += part + math.log(c / (counts[tuple(w[i - k + 1 : i])] if k > 1 else total))
        out[d] = (len(w), s)
    return out


def base_spans(text):
    """The fixed patterns, as given."""
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c in "0123456789"]
        if 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def crc(doc_id, mod):
    return zlib.crc32(str(doc_id).encode()) % mod


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by sharing out again and again until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        per = left / sum(w[s] for s in open_)
        full = {s for s in open_ if per * w[s] > most * sizes[s]}
        if not full:
            return out | {s: per * w[s] for s in open_}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= full
    return out


VOCAB = ["".join(random.Random(k).choices("abcdeimnorst", k=random.Random(k + 99).randint(2, 8))) for k in range(400)]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCAB) for _ in range(n))
