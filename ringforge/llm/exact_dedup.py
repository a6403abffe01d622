"""Exact duplicates by composable polynomial fingerprints.

A text's UTF-8 bytes are cut into chunks.  Each chunk has a polynomial hash modulo 2^31 - 1 to two bases, all
chunks at once as one matrix product, and hashes of neighbours combine by length-shifted arithmetic:
H(xy) = H(x) * B^len(y) + H(y).  So chunks are hashed independently, whatever a document's length.

Documents of equal (length, fingerprints) are then compared for real: each with the one of the largest id, chunk by
chunk, as an equi-join on (leader, chunk number).  Any that differ are compared among themselves in the same way,
until none is left; so a collision of fingerprints costs another round and never a wrong result.

Null counts as empty.  Of equal texts the row with the largest doc_id stays; rows without id come last and
stay only if the whole group has none (then keep_id is null).  Rows with the same id and equal texts are copies too:
all get keep_id, and kept is true for one of them.  Extra columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words

P = (1 << 31) - 1
BASES = (1_000_003_571, 798_342_119)
CHUNK = 1024
#: Bytes that the comparison holds at a time of one document.
COMPARE = 1 << 16
#: Copies that are compared with one copy of their leader's pieces: larger groups are split and get the leader several times.
SALT = 500
#: Repeated rows that one step puts out.
REPEATED = 4096
_tables: dict = {}


def _power(base: int, n: int) -> int:
    return pow(base, n, P)


def _weights() -> np.ndarray:
    """CHUNK x 4 doubles: both bases' powers, split in halves of 16 bits, so that sums of products stay exact."""
    if "w" not in _tables:
        out = []
        for b in BASES:
            p = np.array([_power(b, CHUNK - 1 - i) for i in range(CHUNK)], np.int64)
            out += [(p >> 16).astype(float), (p & 0xFFFF).astype(float)]
        _tables["w"] = np.stack(out, 1)
    return _tables["w"]


def combine(left: tuple[int, int, int], right: tuple[int, int, int]) -> tuple[int, int, int]:
    """The fingerprint (length, h1, h2) of two texts put together."""
    n = right[0]
    return (left[0] + n, *[(x * _power(b, n) + y) % P for x, y, b in zip(left[1:], right[1:], BASES, strict=True)])


def fingerprint(data: np.ndarray) -> tuple[int, int, int]:
    """(length, h1, h2) of bytes.  Leading zeros in front of the first chunk change nothing: length tells them apart."""
    n = len(data)
    out = (0, 0, 0)
    step = CHUNK * 1024
    for k in range(0, n, step):
        part = data[k : k + step]
        m = len(part)
        rows = -(-m // CHUNK)
        grid = np.zeros(rows * CHUNK)
        grid[rows * CHUNK - m :] = part
        h = (grid.reshape(rows, CHUNK) @ _weights()).astype(np.int64) % P
        chunk = [((h[:, 2 * j] << 16) + h[:, 2 * j + 1]) % P for j in range(2)]
        if rows == 1:
            got = (m, int(chunk[0][0]), int(chunk[1][0]))
        else:
            if "s" not in _tables:
                _tables["s"] = [np.array([_power(b, CHUNK * i) for i in range(1024)], np.int64) for b in BASES]
            got = (m, *[int((c * s[rows - 1 :: -1] % P).sum() % P) for c, s in zip(chunk, _tables["s"], strict=True)])
        out = combine(out, got) if k else got
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs: unit, doc_id, sha, text.  Gives unit, doc_id, sha, n_bytes, f1, f2."""

    def run(batches):
        for b in words.chunks(batches):
            data, off = words.text_buffers(b.column("text"))
            got = [fingerprint(data[lo:hi]) for lo, hi in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("unit"), b.column("doc_id"), b.column("sha"), *[pa.array([g[i] for g in got], pa.int64()) for i in range(3)]], names=["unit", "doc_id", "sha", "n_bytes", "f1", "f2"])

    return docs.select("unit", "doc_id", "sha", "text").mapInArrow(run, "unit string, doc_id long, sha string, n_bytes long, f1 long, f2 long")


def _differing(docs: DataFrame, pairs: DataFrame, wanted_b) -> DataFrame:
    """Those units of pairs (unit, leader, c: units of the group) whose texts are not the same, by an equi-join of their chunks.  Each SALT followers
    have their own copy of the leader's chunks, so that no key is hot."""
    cut = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("bin") - 1) / COMPARE)).cast("int")))
    bins = docs.where(common.in_bloom(wanted_b, F.xxhash64("unit"))).select("unit", F.encode("text", "UTF-8").alias("bin"))
    chunk = F.substring("bin", F.col("n") * COMPARE + 1, F.lit(COMPARE))
    salts = F.ceil(F.col("c") / F.lit(SALT)).cast("int")
    followers = bins.join(pairs.withColumn("salt", F.pmod(F.xxhash64("unit"), salts)), "unit").select("unit", "leader", "salt", "bin", cut.alias("n")).select("unit", "leader", "salt", "n", chunk.alias("piece"))
    # a leader's repeated rows are one
    one = pairs.select(F.col("leader").alias("unit"), salts.alias("salts")).distinct()
    leaders = bins.join(one, "unit").select(F.col("unit").alias("leader"), "salts", "bin", cut.alias("n")).select("leader", "salts", "n", chunk.alias("lead")).distinct()
    leaders = leaders.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1)).alias("salt"), "n", "lead")
    return followers.join(leaders, ["leader", "salt", "n"], "left").where("lead is null or piece <> lead").select("unit").distinct()


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    ws = common.Workspace(spark, "exact-dedup")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("sha", F.sha2("text", 256))
    # rows of one id and text are one unit
    docs = docs.withColumn("unit", F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "sha"))
    key = ["n_bytes", "f1", "f2"]
    units = ws.table(fingerprints(docs).groupBy("unit", "doc_id", "sha", *key).agg(F.count("*").alias("rows")))
    left, done = units, []
    for _ in range(64):
        groups = left.groupBy(*key).agg(F.count("*").alias("c"), F.max_by("unit", F.struct(F.col("doc_id").isNotNull(), "doc_id", "unit")).alias("leader")).where("c > 1")
        groups = groups.select(F.concat_ws(" ", *key).alias("key"), "leader", "c")
        pairs = ws.table(left.join(groups, F.concat_ws(" ", *key) == F.col("key")).select("unit", "leader", "c").where("unit <> leader"))
        wanted = common.bloom(ws, pairs.select(F.xxhash64("unit")).union(pairs.select("leader").distinct().select(F.xxhash64("leader"))), 2 * pairs.count())
        odd = ws.table(_differing(docs, pairs, wanted))
        done.append(pairs.join(odd, "unit", "left_anti"))
        if not odd.limit(1).count():
            break
        left = ws.table(units.join(odd, "unit", "left_semi"))
    else:
        raise RuntimeError("more than 64 different texts share one fingerprint")
    ws.release()
    copies = done[0]
    for x in done[1:]:
        copies = copies.union(x)
    members = units.join(copies.select("unit", F.col("leader").alias("of")), "unit", "left").withColumn("leader", F.coalesce("of", "unit"))
    groups = members.groupBy("leader").agg(F.sum("rows").alias("group_size"), F.max(F.when(F.col("unit") == F.col("leader"), F.col("doc_id"))).alias("keep_id"))
    groups = groups.select(common.spread("leader").alias("key"), "group_size", "keep_id")
    # repeated rows come out in two steps, so that no array is as long as they are many
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(REPEATED).cast("long"))).alias("start")
    rows = members.join(groups, common.spread("leader") == F.col("key")).select("doc_id", "keep_id", "group_size", "sha", "unit", "leader", "rows", step)
    rows = rows.select("*", F.explode(F.sequence(F.col("start"), F.least(F.col("rows"), F.col("start") + REPEATED) - 1)).alias("copy"))
    return rows.select("doc_id", "keep_id", "group_size", ((F.col("unit") == F.col("leader")) & (F.col("copy") == 0)).alias("kept"), F.col("sha").alias("text_sha256"))
