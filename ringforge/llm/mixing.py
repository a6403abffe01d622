"""Mixing sources to target weights, with built-in functions only.

A document's size is its number of words.  Sources share ``share`` times all sizes by weight; a source gives at most
``most`` times its own size, and what it can't give is shared by weight among the others until none is above its
limit.  (That is water filling: target = min(limit, level * weight), and the level follows from sources in the order
of limit / weight.)

A source takes each document floor(target / size) times, and once more those whose hash lies below a threshold.
Thresholds come from nested histograms: words by source and leading hash bits, the bucket in which the budget ends,
then only that bucket by its next bits, and so on, until all hash bits are used.  No sort, and no group larger than a
histogram.  At the last level, the documents of the one hash at the boundary are taken if that is nearer to
the target than leaving them.

Hashes are of the id (of the text where it is null), so that reruns agree; rows of equal id share their fate.
Windows over all sources (one row each, numbered in code point order and by limit) are one task's sort, which spills; histograms have 4,096 rows a source at most and
level; the rule of each source is joined by key, and broadcast only where Spark's own size check allows it.

Sources go by code point and null is the last.  Null or empty texts have size 0 and take 0 words.  A source of
no words has target 0.  An empty table gives an empty result.  Extra columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Hash bits of each level of the histograms: 4,096 buckets for each source.
LEVELS = (12, 12, 12, 12, 12)


def n_words(text: Column) -> Column:
    """The number of runs of characters other than space and \\t \\n \\v \\f \\r."""
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.array_remove(F.split(spaced, " "), "")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes: source, source_size, one row per source.  Adds weight and target."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = (
        s.withColumn("pool", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("w_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("pool") - F.col("cap_before")) / F.col("w_left"))
        # the first source that the level doesn't fill, and all after it, lie at its level
        .withColumn("open_level", F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct("cap_before", "level"))).over(everything)["level"])
    )
    return s.select("source", "source_size", "weight", F.coalesce(F.least("cap", F.col("open_level") * F.col("weight")), "cap").alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST, keep: list[str] = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, and the columns named in ``keep`` as kept_<name>."""
    spark = docs.sparkSession
    ws = common.Workspace(spark, "mixing")
    text = F.col(text_col).cast("string")
    hashed = F.md5(F.coalesce(F.col(id_col).cast("string"), text, F.lit("")).cast("binary"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(text).alias("size"), F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long").alias("h"), *[F.col(c).alias(f"kept_{c}") for c in keep])
    light = ws.table(rows.select("doc_id", "source", "size", "h"))

    sources = light.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sources, weights, share, most)
    plan = ws.table(
        plan.withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("budget", F.col("target") - F.col("times") * F.col("source_size"))
        .withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    )
    small = light.where("size > 0").select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("key"), "h", "size")
    edge = plan.select("key", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("below"))
    used = 0
    for bits in LEVELS:
        used += bits
        inside = F.shiftright("h", 60 - used + bits) == F.col("prefix")
        hist = small.join(edge, "key").where(inside & (F.col("budget") > 0)).groupBy("key", "budget", "below", F.shiftright("h", 60 - used).alias("bucket")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("key").orderBy("bucket"))
        edge = ws.table(
            hist.withColumn("above", F.col("below") + upto)
            .where("above > budget")
            .groupBy("key", "budget")
            .agg(F.min(F.struct("bucket", (F.col("above") - F.col("words")).alias("before"))).alias("x"))
            .select("key", "budget", F.col("x.bucket").alias("prefix"), F.col("x.before").alias("below"))
        )
    # prefix is now one whole hash; below is what all smaller ones give
    last = small.join(edge, "key").where("h = prefix").groupBy("key", "budget", "prefix", "below").agg(F.sum("size").alias("at"))
    bound = last.select("key", F.when(F.col("below") + F.col("at") - F.col("budget") < F.col("budget") - F.col("below"), F.col("prefix") + 1).otherwise(F.col("prefix")).alias("limit"))
    rule = ws.table(plan.join(bound, "key", "left").select("key", "source_size", "target", "times", F.coalesce("limit", F.when(F.col("budget") > 0, F.lit(1 << 60)).otherwise(F.lit(0))).alias("limit")))
    # with further columns the documents are read again, so that texts are never written or dealt anew here
    rows = (rows if keep else light).withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    rows = rows.join(rule, "key").withColumn("copies", F.col("times") + (F.col("h") < F.col("limit")).cast("long"))
    return rows.select(F.col("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", *[f"kept_{c}" for c in keep])
