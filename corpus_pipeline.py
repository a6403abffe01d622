"""A corpus pipeline: language ID, near duplicates, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, to be written as Parquet
and read again for the next.  All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringforge.llm import common, decontaminate, langid, mixing, ngram_join, sharding


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model is sure enough of; null texts and texts without letters go, and all if no row names a language.  Repeated rows and rows
    without id are judged by their text like others."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    return langid.accepted(docs, langid.learn(named))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates.  Texts without words and rows without id stay; rows of one id are one document, and of those with equal
    text one stays.  Extra columns pass on; an empty table gives an empty one (so in every stage)."""
    return ngram_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item.  Null and empty texts stay; repeated rows and rows without id are judged by their text like others."""
    return decontaminate.clean(docs, common.read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it (twice at most).  Null is a source like others; rows without id go by their text, rows of one id share their
    fate; documents without words are taken as often as their source's share says, for nothing."""
    mixed = mixing.mix(docs, keep=docs.columns)
    times = mixed.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return times.select(*[F.col(f"kept_{c}").alias(c) for c in docs.columns])


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard and place in it; null texts count as empty, equal texts stay together, and rows without id or with a repeated one are rows like others."""
    return sharding.shard(docs)


STAGES = [("language_id", language_id), ("ngram_jaccard_join", near_duplicates), ("benchmark_decontamination", decontamination), ("mix_sources", mix_sources), ("sharding", shards)]

#: A trained classifier and greedy packing can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = common.Workspace(spark, "pipeline")
    docs = common.read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = ws.table(docs)
    return docs
