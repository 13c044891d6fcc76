"""Where a plan is cut: a table computed once and kept in the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: that of ``spark.checkpoint.dir``; a temporary one only on a local master."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        wanted = spark.conf.get("spark.checkpoint.dir", None)
        if not wanted and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="tickloom-checkpoint-"))
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once, in ``shared_folder``."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
