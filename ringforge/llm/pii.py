"""Personal data: fixed patterns, and spans that weak supervision adds.

Base spans (kinds email, ip, card, phone) come from patterns and checks alone and always stay.  Beyond them, candidates
are looked for: telephone numbers without a plus, e-mail addresses that are written out or bracketed, identity numbers, bank account
numbers, names after a form of address or with a known given name, and secrets (keys and tokens).  Labelers vote on each candidate (1 personal, 0 not, or no vote): regular
expressions on its shape, gazetteers of words, and labelers on the words around it.  Expectation-maximisation over the
counts of vote patterns of all candidates of the corpus estimates for each kind the prior, each labeler's reliability and the posterior of each
pattern; a logistic span classifier on hashed features of span and context is trained on these posteriors (by numpy, on at most
``sample`` candidates, those of the least hash) and decides.  Votes are counted over all documents: the counts are as
many as there are patterns, not candidates.

Null or empty texts have no spans.  Offsets are code points, ends exclusive.  Rows are handled one by one, so repeated
rows or rows without id are no special case; extra columns are ignored."""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words

KINDS = ("email", "ip", "card", "phone")
MORE = ("phone_local", "email_spelt", "national_id", "iban", "name", "secret")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits begins, which keeps the search linear
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in order."""
    out = []
    pos = 0
    while (at := text.find("@", pos)) >= 0:
        head = text[pos:at]
        lo = at - (len(head) - len(head.rstrip(_LOCAL)))
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            out.append((lo, 0, m.end()))
            pos = m.end()
        else:
            pos = at + 1
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    out.sort()
    return out


# --- candidates beyond the base ---

_TITLE = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|M|Mme|Mlle|Sr|Sra|Srta|Don|Doña"
_CANDIDATES = (
    ("phone_local", re.compile(r"(?<![\w+])(?:\([0-9]{2,4}\)[ -]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![\w])")),
    ("email_spelt", re.compile(r"(?<!\w)[A-Za-z0-9._-]{2,40} ?(?:\[at\]|\(at\)|<at>| at ) ?[A-Za-z0-9-]{2,40} ?(?:\[dot\]|\(dot\)|<dot>| dot |\.) ?[A-Za-z]{2,8}(?!\w)")),
    ("national_id", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("name", re.compile(rf"(?<!\w)(?:{_TITLE})\.? [A-Z][^\W\d_]+(?: [A-Z][^\W\d_]+)?")),
    ("name", re.compile(r"(?<!\w)[A-Z][^\W\d_]{2,11} [A-Z][^\W\d_]{2,20}(?!\w)")),
    ("secret", re.compile(r"(?<![\w/+=-])[A-Za-z0-9_-]{20,200}(?![\w/+=-])")),
)

#: Gazetteers: short by design, as defaults of a parameter (see find()).
GAZETTEERS = {
    "call": "call phone tel telephone mobile cell fax ring telefon anrufen anruf handy telefono teléfono móvil téléphone portable appelez appeler llame llamar contact kontakt reach dial sms whatsapp hotline",
    "mail": "mail email e-mail mailto write contact reach courriel courrier adresse correo escribe escribir schreiben schreib kontakt address inbox newsletter reply send",
    "identity": "ssn social security identity id passport tax insurance number nummer numéro número ausweis pass steuer sozialversicherung dni nif nie identité sécurité sociale seguridad licence license national citizen",
    "bank": "iban account bank konto compte cuenta transfer bic swift pay payment überweisung virement transferencia banque banco sepa kontonummer",
    "secret": "token key secret password passwd pwd api apikey bearer authorization auth credential credentials private access access_key api_key secret_key passwort schlüssel clave contraseña clé",
    "person": "wrote said says told met married born died author director president minister dear sincerely regards by from named called signed contact doctor teacher son daughter wife husband mother father",
    "given": "james john robert michael william david mary patricia jennifer linda elizabeth susan anna maria peter thomas paul hans marie jean pierre jose juan carlos luis richard joseph charles christopher daniel matthew anthony "
    "mark steven andrew kenneth george kevin brian edward ronald timothy jason jeffrey ryan jacob barbara jessica sarah karen nancy lisa betty margaret sandra ashley emily donna michelle carol amanda melissa deborah stephanie "
    "wolfgang klaus jürgen günter dieter manfred ursula monika petra sabine heike stefan andreas markus michel philippe alain bernard jacques françois nathalie isabelle sylvie catherine antonio manuel francisco javier miguel "
    "carmen josefa isabel dolores pilar laura",
    "against": "version release isbn issn order invoice ref page chapter section article line item sku model part build serial total price usd eur commit sha md5 checksum hash digest uuid revision figure table",
}
_WORD = re.compile(r"[^\W_]+(?:[-_][^\W_]+)*")
_BEFORE = {"phone_local": ("call",), "email_spelt": ("mail",), "national_id": ("identity",), "iban": ("bank",), "name": ("person",), "secret": ("secret",)}
_SPELT = re.compile(r"[\[(<](?:at|dot)[\])>]")
_TLD = re.compile(r"(?:com|org|net|info|io|de|fr|es|it|nl|edu|gov|uk|eu)$")


def _sets(gazetteers: dict[str, str] | None) -> dict[str, frozenset]:
    return {k: frozenset(v.split()) for k, v in (GAZETTEERS | (gazetteers or {})).items()}


def _entropy(s: str) -> float:
    n = np.bincount(np.frombuffer(s.encode(), np.uint8))
    p = n[n > 0] / len(s)
    return float(-(p * np.log2(p)).sum())


def _votes(kind: str, span: str, before: list[str], after: list[str], edge: str, g: dict[str, frozenset]) -> list[int]:
    """1, 0 or -1 (no vote) of each labeler."""
    near, around = set(before[-4:]), set(before[-4:]) | set(after[:3])
    own = frozenset().union(*(g[x] for x in _BEFORE[kind]))
    low, digits = span.lower(), re.sub(r"[^0-9]", "", span)
    parts = low.replace(".", "").split()
    titled = parts[0] in _TITLES
    return [
        # shape: what the kind is written like
        {"phone_local": 1 if span[0] == "(" or "-" in span and 9 <= len(digits) <= 11 else -1, "email_spelt": 1 if _SPELT.search(low) else -1, "national_id": 1, "iban": 1 if " " in span else -1,
         "name": 1 if titled else -1, "secret": 1 if re.fullmatch(r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_\w{30,}|sk-[\w-]{20,}|xox[abp]-[\w-]+", span) else -1}[kind],
        # a known word inside the span
        1 if kind == "name" and parts[int(titled) : int(titled) + 1] and parts[int(titled)] in g["given"] or kind == "email_spelt" and _TLD.search(low) else -1,
        # words of the kind before it, and around it
        1 if near & own else -1,
        1 if around & (own | g["call"] | g["mail"] | g["identity"] | g["bank"] | g["secret"]) - g["against"] else -1,
        # words that speak against it
        0 if around & g["against"] else -1,
        # checksums and reserved numbers
        int(_iban_ok(span)) if kind == "iban" else int(_ssn_ok(digits)) if kind == "national_id" else -1,
        # plain counting groups: 100 200 300, 111-11-1111
        0 if digits and kind != "secret" and (len(set(digits)) <= 2 or digits.startswith("000") or digits in "01234567890123456789") else -1,
        # numbers that are made up have few equal digits
        1 if kind in ("phone_local", "national_id") and len(set(digits)) >= 6 else -1,
        # a sign of a label stands before
        1 if edge[:1] in (":", "=") or edge[:1] in ("'", '"') and edge[1:2] in (":", "=", " ") else -1,
        # an amount or a measure
        0 if kind in ("phone_local", "national_id") and edge[:1] in ("$", "€", "£", "%", "#") else -1,
        # a spelt address in running text: "look at home. it"
        0 if kind == "email_spelt" and not _SPELT.search(low) and " dot " not in low and not near & g["mail"] else -1,
        # few different signs are no key; and a capital begins each sentence
        (0 if _entropy(span) < 3 else -1) if kind == "secret" else 0 if kind == "name" and not titled and parts[0] not in g["given"] else -1,
    ]


_TITLES = frozenset(_TITLE.lower().split("|"))


def _ssn_ok(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def _iban_ok(span: str) -> bool:
    s = span.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


class _Taken:
    """Spans that don't overlap, in order: whether another one does is found by halving."""

    def __init__(self, spans=()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s), self.ends.append(e)

    def overlaps(self, lo: int, hi: int) -> bool:
        k = bisect.bisect_left(self.starts, hi) - 1
        return k >= 0 and self.ends[k] > lo

    def add(self, lo: int, hi: int) -> None:
        k = bisect.bisect_left(self.starts, lo)
        self.starts.insert(k, lo), self.ends.insert(k, hi)


def candidates(text: str, base: list[tuple[int, int, int]], g: dict[str, frozenset] | None = None) -> list[tuple[int, int, int, str, list[int]]]:
    """(start, kind number, end, votes as text, features) of spans that touch no base span."""
    g = g or _sets(None)
    out = []
    taken = _Taken((s, e) for s, _, e in base)
    for kind, pattern in _CANDIDATES:
        for m in pattern.finditer(text):
            lo, hi = m.span()
            if kind == "secret" and not (any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])):
                continue
            if kind == "name" and m[0].split(" ")[0].rstrip(".").lower() not in _TITLES | g["given"]:
                continue
            if taken.overlaps(lo, hi):
                continue
            taken.add(lo, hi)
            before = [w.lower() for w in _WORD.findall(text[max(0, lo - 60) : lo])]
            after = [w.lower() for w in _WORD.findall(text[hi : hi + 40])]
            edge = text[max(0, lo - 4) : lo].rstrip()[::-1]
            votes = _votes(kind, m[0], before, after, edge, g)
            out.append((lo, MORE.index(kind), hi, kind + ":" + "".join("-01"[v + 1] for v in votes), _span_features(kind, m[0], before, after)))
    out.sort()
    return out


FEATURES = 1 << 12


def _span_features(kind: str, span: str, before: list[str], after: list[str]) -> list[int]:
    shape = re.sub(r"[0-9]", "9", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", span)))
    names = [f"k {kind}", f"s {kind} {shape}", f"n {kind} {min(len(span), 30) // 3}"]
    names += [f"b {kind} {w}" for w in before[-4:]] + [f"a {kind} {w}" for w in after[:3]]
    names += [f"c {kind} {shape[i : i + 3]}" for i in range(len(shape) - 2)]
    return sorted({zlib.crc32(x.encode()) % FEATURES for x in names})


# --- label model and span classifier ---

#: Votes that smoothing adds to each outcome's count, and how they are dealt between (no vote, 0, 1) for a candidate that is not personal and one that is.
SMOOTHING = 20.0
EXPECTED = np.array([[0.5, 0.4, 0.1], [0.5, 0.1, 0.4]])
#: How far a labeler's silence may count for or against.
SILENCE = 0.7


def reliabilities(patterns: list[tuple[str, int]], rounds: int = 200) -> dict[str, float]:
    """The posterior of each vote pattern ("kind:votes", count), by expectation-maximisation over pattern counts, for each kind by itself.

    A kind has a prior, and each of its labelers a distribution of outcomes (no vote, 0, 1) for candidates that are personal and for those that are
    not, all of them learned (Dawid and Skene, 1979).  They are smoothed towards votes that are right four times in five; a vote for never counts
    against and the other way round, so that the two classes can't change names."""
    out: dict[str, float] = {}
    for kind in sorted({p.split(":")[0] for p, _ in patterns}):
        own = [(p, n) for p, n in patterns if p.split(":")[0] == kind]
        votes = np.array([["-01".index(c) for c in p.split(":")[1]] for p, _ in own])
        counts = np.array([float(n) for _, n in own])
        seen = np.stack([votes == v for v in range(3)], 2).astype(float)  # pattern, labeler, outcome
        share = np.stack([np.tile(e, (votes.shape[1], 1)) for e in EXPECTED])  # class, labeler, outcome
        prior, post = 0.5, np.full(len(own), 0.5)
        for _ in range(rounds):
            ratio = np.log(share[1]) - np.log(share[0])
            ratio[:, 0] = np.clip(ratio[:, 0], -SILENCE, SILENCE)
            ratio[:, 1], ratio[:, 2] = np.minimum(ratio[:, 1], 0), np.maximum(ratio[:, 2], 0)
            new = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + (seen * ratio).sum((1, 2)), -30, 30)))
            done = np.abs(new - post).max() < 1e-9
            post = new
            if done:
                break
            for y, p in ((0, 1 - post), (1, post)):
                got = np.einsum("i,ilv->lv", counts * p, seen) + SMOOTHING * EXPECTED[y]
                share[y] = got / got.sum(1, keepdims=True)
            prior = float(np.clip(((counts * post).sum() + SMOOTHING / 2) / (counts.sum() + SMOOTHING), 0.01, 0.99))
        out |= {p: float(x) for (p, _), x in zip(own, post, strict=True)}
    return out


def train_spans(rows: list[list[int]], target: np.ndarray, epochs: int = 12, rate: float = 0.3) -> np.ndarray:
    """Logistic regression on sparse 0/1 features and soft targets; the last weight is the bias."""
    w, g = np.zeros(FEATURES + 1), np.full(FEATURES + 1, 1e-2)
    rng = np.random.Generator(np.random.PCG64(11))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            at = rows[i] + [FEATURES]
            p = 1 / (1 + np.exp(-np.clip(w[at].sum(), -30, 30)))
            step = p - target[i]
            g[at] += step * step
            w[at] -= rate * (step + 1e-4 * w[at]) / np.sqrt(g[at])
    return w


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 4000, threshold: float = 0.5, gazetteers: dict[str, str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added, n_spans.

    gazetteers: words, separated by spaces, that take the place of those in GAZETTEERS of the same name."""
    spark = docs.sparkSession
    known = _sets(gazetteers)
    ws = common.Workspace(spark, "pii")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def scan(batches):
        for b in words.chunks(batches):
            base_col, cand_col = [], []
            for text in b.column("text").to_pylist():
                base = base_spans(text) if text else []
                base_col.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
                cand_col.append([{"start": s, "kind": k, "end": e, "votes": v, "features": f} for s, k, e, v, f in candidates(text, base, known)] if text else [])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(base_col, BASE), pa.array(cand_col, CAND)], names=["doc_id", "base", "cand"])

    BASE = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    CAND = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))]))
    found = ws.table(rows.mapInArrow(scan, "doc_id long, base array<struct<start:long,kind:int,end:long>>, cand array<struct<start:long,kind:int,end:long,votes:string,features:array<int>>>"))

    spans = found.select("doc_id", F.explode("cand").alias("c"))
    patterns = [(r["votes"], r["n"]) for r in spans.groupBy(F.col("c.votes").alias("votes")).agg(F.count("*").alias("n")).collect()]  # as many as patterns occur: most labelers only vote one way, so under kinds * 2^labelers
    patterns.sort()
    posterior = reliabilities(patterns)
    total = sum(n for _, n in patterns)
    h = F.pmod(F.xxhash64("doc_id", "c.start"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = spans.where(h < min(1.0, sample / max(1, total))).select("doc_id", "c.start", "c.votes", "c.features").limit(4 * sample).collect() if total else []  # about ``sample`` rows
    chosen.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["start"]))
    weights = train_spans([list(r["features"]) for r in chosen], np.array([posterior[r["votes"]] for r in chosen])) if chosen else np.zeros(FEATURES + 1)
    shared = spark.sparkContext.broadcast(weights)

    def decide(batches):
        w = shared.value
        for b in batches:
            cols = [[] for _ in range(8)]
            for base, cand in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                own = [(x["start"], x["kind"], x["end"]) for x in base]
                added = [(x["start"], x["kind"] + len(KINDS), x["end"]) for x in cand if 1 / (1 + np.exp(-w[[*x["features"], FEATURES]].sum())) >= threshold]
                kinds = [k for _, k, _ in own]
                for k in range(4):
                    cols[k].append(kinds.count(k))
                cols[4].append(hashlib.sha256(_joined(own).encode()).hexdigest())
                cols[5].append(_joined(sorted(own + added)))
                cols[6].append(len(added))
                cols[7].append(len(own) + len(added))
            types = (pa.int64(),) * 4 + (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans"])

    return found.mapInArrow(decide, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")


def _joined(spans: list[tuple[int, int, int]]) -> str:
    names = KINDS + MORE
    return ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)
