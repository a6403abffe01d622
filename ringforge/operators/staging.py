"""Cutting lineage where a result is read several times."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """The checkpoint folder that the session names (a temporary one only in local mode, where there is one machine)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return path or "file://" + tempfile.mkdtemp(prefix="ringforge-")


def settle(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()
