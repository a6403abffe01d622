"""What the corpus operators share: shared-folder tables, fixed-size filters, connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def spread(col: str) -> Column:
    """A key for joins on a long or string column that no partitioning already has: both sides are dealt anew, so that adaptive execution can split
    a hot one (it leaves a side alone that comes straight out of an aggregate)."""
    return F.concat(F.col(col).cast("string"), F.lit(" "))


#: White space as the operators define it: space and \t \n \v \f \r.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; a temporary one only in local mode, where there is one machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not hasattr(spark, "_ringforge_dir"):
        spark._ringforge_dir = "file://" + tempfile.mkdtemp(prefix="ringforge-")
    return spark._ringforge_dir


#: Rows of a small table's file.
FILE_ROWS = 1_000_000


class Workspace:
    """Tables written to the shared folder, so that no lineage and no executor-local block is needed later."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        bounded_batches(spark)
        self.root = f"{shared_dir(spark)}/ringforge-{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.tables: list[DataFrame] = []
        self.kept: list[DataFrame] = []
        self.shared: list = []

    def table(self, df: DataFrame, rows: int | None = None, files: int | None = None) -> DataFrame:
        """``rows``: about how many there are, if that is known; ``files``: at most so many, so that a small table is few files."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        files = files if rows is None else 1 + rows // FILE_ROWS
        (df if files is None else df.coalesce(files)).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._ringforge_path = path
        self.tables.append(out)
        return out

    def keep(self, df: DataFrame) -> DataFrame:
        """Kept by the executors until release(), on disk where memory ends; what a lost executor had is computed again from its input."""
        self.kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    def share(self, value):
        """A broadcast that ends with release()."""
        self.shared.append(self.spark.sparkContext.broadcast(value))
        return self.shared[-1]

    def release(self) -> None:
        """Frees what executors and the driver keep; only written tables may be read after it."""
        for df in self.kept:
            df.unpersist()
        for b in self.shared:
            b.destroy()
        self.kept, self.shared = [], []

    def drop_all_but(self, *tables: DataFrame) -> None:
        """Delete all tables but those that a result still reads."""
        self.drop(*[t for t in self.tables if all(t is not x for x in tables)])

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later read needs."""
        jvm = self.spark._jvm
        self.tables = [t for t in self.tables if all(t is not x for x in tables)]
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._ringforge_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Batches that go to Python by their bytes: whole texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def partitions(spark: SparkSession) -> int:
    """How many parts a shuffle has: the cluster sets it to the size of its input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


# --- a Bloom filter of bounded size: what it lets through wrongly, the join after it drops ---

#: 1 MB to 64 MB: 16 bits for each id, as far as that goes.
BLOOM_LOG2 = (23, 29)


def _bloom_slots(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    x = ids.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    m = np.uint64(bits - 1)
    return (x & m).astype(np.int64), ((x >> np.uint64(32)) & m).astype(np.int64)


VECTOR_PART = 1 << 14


def vector_rows(vec: np.ndarray) -> list[tuple[int, bytes]]:
    """A vector as compressed rows for sum_vectors; parts that are all zero are left out."""
    codec, out = pa.Codec("zstd", 1), []
    for k in range(0, len(vec), VECTOR_PART):
        v = vec[k : k + VECTOR_PART]
        if v.any():
            out.append((k // VECTOR_PART, codec.compress(v.tobytes(), asbytes=True)))
    return out


def vector_batch(vec: np.ndarray) -> pa.RecordBatch:
    rows = vector_rows(vec)
    return pa.RecordBatch.from_pydict({"part": pa.array([r[0] for r in rows], pa.int32()), "vec": pa.array([r[1] for r in rows], pa.binary())})


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays as one compressed blob."""
    raw = np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack(blob: bytes, kinds: tuple) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    sizes = np.frombuffer(raw, np.int64, len(kinds))
    out, at = [], 8 * len(kinds)
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _vector(blob: bytes, dtype, width: int, part: int) -> np.ndarray:
    n = min(VECTOR_PART, width - part * VECTOR_PART)
    return np.frombuffer(pa.Codec("zstd").decompress(blob, n * np.dtype(dtype).itemsize, asbytes=True), dtype)


def _merged(rows: DataFrame, width: int, dtype: str, add, finish, out_dtype: str) -> np.ndarray:
    """Vectors that tasks have given as rows (part int, vec binary), joined part by part as rows stream in.  ``width`` is fixed,
    so what comes to the driver is as large for any input."""

    def merge(batches):
        got: dict[int, np.ndarray] = {}
        for b in batches:
            for p, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = _vector(v, dtype, width, p)
                got[p] = add(got[p], v) if p in got else add(np.zeros(len(v), out_dtype if finish is None else np.int64), v)
        codec = pa.Codec("zstd", 1)
        done = [codec.compress((v if finish is None else finish(v)).astype(out_dtype).tobytes(), asbytes=True) for v in got.values()]
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(got), pa.int32()), "vec": pa.array(done, pa.binary())})

    parts = rows.select("part", "vec").repartition(16, "part").mapInArrow(merge, "part int, vec binary").collect()
    out = np.zeros(width, out_dtype)
    for r in parts:
        v = _vector(r["vec"], out_dtype, width, r["part"])
        out[r["part"] * VECTOR_PART : r["part"] * VECTOR_PART + len(v)] = v
    return out


def sum_vectors(rows: DataFrame, width: int, dtype: str = "int64", finish=None, out_dtype: str = "int64") -> np.ndarray:
    """The sum of the tasks' vectors; ``finish`` maps sums to what the driver gets."""
    return _merged(rows, width, dtype, lambda a, b: a + b, finish, out_dtype)


def bloom(ws: Workspace, ids: DataFrame, about: int):
    """A broadcast bit map of a one-column DataFrame of ``about`` longs: 16 bits for each, 64 MB at most."""
    bits = 1 << min(BLOOM_LOG2[1], max(BLOOM_LOG2[0], (16 * about).bit_length()))

    def fill(batches):
        got = np.zeros(bits, bool)
        for b in batches:
            for s in _bloom_slots(b.column(0).to_numpy(zero_copy_only=False), bits):
                got[s] = True
        yield vector_batch(np.packbits(got))

    return ws.share(_merged(ids.mapInArrow(fill, "part int, vec binary"), bits // 8, "uint8", np.bitwise_or, None, "uint8").tobytes())


def bloom_has(filter_bytes: bytes, ids: np.ndarray) -> np.ndarray:
    bits = np.frombuffer(filter_bytes, np.uint8)
    ok = np.ones(len(ids), bool)
    for s in _bloom_slots(ids, 8 * len(bits)):
        ok &= (bits[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1 == 1
    return ok


def in_bloom(filter_b, col: Column) -> Column:
    @F.pandas_udf("boolean")
    def has(ids: pd.Series) -> pd.Series:
        return pd.Series(bloom_has(filter_b.value, ids.to_numpy(np.int64)))

    return has(col)


# --- connected components over an edge list (large-star / small-star) ---


#: Edges that one step of contract() takes at a time.
CONTRACTED = 1_000_000


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of these edges, and the least node that they connect it with."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b):
            np.minimum.at(new, side, least)
            np.minimum.at(new, label[side], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def contract(edges: DataFrame) -> DataFrame:
    """Edges (u > v) with the same components, by what each partition can tell by itself: paths become stars before anything is dealt."""

    def run(batches):
        held, n = [], 0

        def flush():
            x, y = _stars(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
            keep = x != y
            return pa.RecordBatch.from_pydict({"u": pa.array(x[keep]), "v": pa.array(y[keep])})

        for b in batches:
            held.append([b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])
            n += b.num_rows
            if n >= CONTRACTED:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def components(ws: Workspace, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable.  ``edges``: columns a, b (long).

    Partitions contract their edges by themselves; then the large-star and small-star steps of Kiveris et al. (2014) follow, each an
    aggregate with map-side combine and one equi-join.  Both sides of a join are dealt anew, by a key of its own, so that adaptive execution
    can split a node with very many neighbours.  Every round is written to the shared folder; the last is the one that leaves only stars.  Nodes without
    edges aren't in the result.  A graph that is not settled after ``max_rounds`` rounds (their number grows with the logarithm) is an error."""
    few = 1 + partitions(ws.spark) // 8
    e = contract(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    for _ in range(max_rounds):
        e = ws.table(e.distinct(), files=few)
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.bitwise_not("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.bitwise_not("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # each node's smaller neighbours now include the least of its neighbourhood
        step = ws.table(large.where("u <> v").distinct(), files=few)
        low2 = step.groupBy("u").agg(F.min("v").alias("m"))
        joined = step.join(low2.select(F.bitwise_not("u").alias("k"), "m"), F.bitwise_not("u") == F.col("k"))
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low2.select("u", F.col("m").alias("v")))
        new = ws.table(contract(small), files=few)
        ws.drop(e, step)
        e = new
        # stars: no node is both a member and a centre (a member of two stars shows as a centre after the next step, or has two rows)
        centres = e.select(F.col("v").alias("u")).distinct()
        twice = e.distinct().groupBy("u").agg(F.count("*").alias("c")).where("c > 1").select("u")
        if not e.select("u").join(centres, "u", "left_semi").union(twice).limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    labels = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels.union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
