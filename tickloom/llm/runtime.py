"""Checkpointing shared by the corpus operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spaces of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    It is the folder named in ``spark.checkpoint.dir``. Only where that is unset, as in tests on a
    local master, a temporary folder is taken; on a cluster that is an error, since executors do
    not see each other's disks.
    """
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return known
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        wanted = tempfile.mkdtemp(prefix="tickloom-checkpoint-")
    sc.setCheckpointDir(wanted)
    return wanted


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def row_key(text) -> "F.Column":
    """A 64-bit key that tells apart rows with the same doc_id but other texts."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


#: Rows of texts that travel to Python at once. Ten times as many, Spark's default, take some hundred MB on either side.
BATCH_ROWS = 1000


def packed(docs: DataFrame) -> DataFrame:
    """tl_row (all columns of ``docs``, so that no name can clash), tl_doc, tl_key: what a join on documents needs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("tl_row"), F.col("doc_id").cast("long").alias("tl_doc"), row_key(F.col("text")).alias("tl_key"))


def unpacked(rows: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of ``docs`` again, some of them changed; ``n_chars``, where there is one, follows a changed text."""
    if "text" in changed and "n_chars" in docs.columns:
        rows = rows.withColumn("tl_text", changed["text"])
        changed = changed | {"text": F.col("tl_text"), "n_chars": F.char_length("tl_text").cast(docs.schema["n_chars"].dataType)}
    return rows.select(*[(changed[c] if c in changed else F.col(f"tl_row.`{c}`")).alias(c) for c in docs.columns])


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with its session's Arrow batches set to BATCH_ROWS at most: texts are long rows. The setting stays, since plans run later."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def released() -> None:
    """Gives back what Arrow's pool keeps for later: at the end of a task the worker may wait for other work."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
