"""Exact deduplication by deterministic block naming.

The normalised text is cut into fixed-size blocks. Sorting the different blocks gives each an
integer name; then the names of adjacent blocks are paired and the pairs named in the same way,
until each document has one name. Equal names of a level mean equal content, without any trust in
hashes: hashes only choose the bucket in which blocks are sorted.

Buckets would not split a block that a third of all documents share. So the ``FREQUENT`` most
frequent hashes are found first (a count with partial sums); any other hash covers at most one row
in ``FREQUENT``. The blocks of frequent hashes, at most ``FREQUENT`` of them unless hashes collide,
are named in a small table of their own, and their rows travel without text.

All of it is DataFrame operations.

Defined results: null text counts as empty. Rows are told apart by doc_id and content; repeated
rows each give a row, of which one at most stays. Null doc_ids come last: they stay only where no
equal text has a doc_id. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import checkpointed

#: Rows of one of the other hashes are fewer than one in FREQUENT of all rows.
FREQUENT = 1000
#: Buckets in which blocks are sorted; at 100 TB of text a bucket holds some hundred MB, which Spark's sort spills.
BUCKETS = 1 << 16


def normalised(text: Column) -> Column:
    """Null as empty; each run of spaces as one space. Single spaces, nearly all, are not matched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def named(rows: DataFrame, parts: list[str], frequent: int = FREQUENT, buckets: int = BUCKETS) -> DataFrame:
    """``rows`` with ``parts`` replaced by ``name``, a long that is equal where, and only where, all parts are equal.

    Nulls in parts are equal to each other.
    """
    rows = rows.withColumn("tl_h", F.xxhash64(*parts))
    counts = rows.groupBy("tl_h").agg(F.count(F.lit(1)).alias("tl_n"))
    # the bound of this broadcast is the limit itself
    top = F.broadcast(counts.orderBy(F.desc("tl_n"), "tl_h").limit(frequent).select(F.col("tl_h").alias("tl_top")))
    flagged = rows.join(top, F.col("tl_h") == F.col("tl_top"), "left")
    few = flagged.where(F.col("tl_top").isNotNull()).groupBy("tl_h", *parts).agg(F.count(F.lit(1)).alias("tl_n"))
    few = few.withColumn("tl_name", -F.row_number().over(Window.orderBy("tl_h", *parts)).cast("long"))
    few = few.select(F.col("tl_h").alias("tl_few"), *[F.col(p).alias(f"tl_{p}") for p in parts], "tl_name")
    same = reduce(lambda a, p: a & F.col(p).eqNullSafe(F.col(f"tl_{p}")), parts, F.col("tl_top") == F.col("tl_few"))
    out = flagged.join(F.broadcast(few), same, "left")
    is_few = F.col("tl_name").isNotNull()
    spread = F.xxhash64("tl_h", *[c for c in rows.columns if c not in (*parts, "tl_h")])
    out = out.withColumn("tl_bucket", F.pmod(F.when(is_few, spread).otherwise(F.col("tl_h")), F.lit(buckets)))
    sent = [F.when(~is_few, F.col(p)).alias(p) for p in parts]
    keep = [c for c in rows.columns if c not in (*parts, "tl_h")]
    out = out.select(*keep, "tl_bucket", "tl_name", *sent)
    rank = F.dense_rank().over(Window.partitionBy("tl_bucket").orderBy(*parts)).cast("long")
    return out.select(*keep, F.coalesce("tl_name", F.col("tl_bucket") * (1 << 40) + rank).alias("name"))


def document_names(docs: DataFrame, block_chars: int = 2048, frequent: int = FREQUENT, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, text_sha256, level, name for each different pair of doc_id and content: equal (level, name) mean equal normalised text."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("text"))
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{int(block_chars)}}}"), F.lit(0))
    text = text.select("doc_id", F.sha2("text", 256).alias("sha"), cut.alias("blocks"))
    blocks = text.select("doc_id", F.unhex(F.substring("sha", 1, 32)).alias("sha"), F.posexplode_outer("blocks").alias("pos", "block"))
    blocks = blocks.select("doc_id", "sha", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("block", F.lit("")).alias("block"))
    left = checkpointed(named(blocks, ["block"], frequent, buckets).dropDuplicates(["doc_id", "sha", "pos"]))
    done, level = [], 0
    while True:
        sizes = left.groupBy("doc_id", "sha").agg(F.max("pos").alias("last"))
        # a document with one block is ready; all its rows have pos 0
        long_ = sizes.where(F.col("last") > 0).select(F.col("doc_id").alias("d"), F.col("sha").alias("s"))
        same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("sha") == F.col("s"))
        done.append(left.join(long_, same, "left_anti").select("doc_id", "sha", F.lit(level).alias("level"), "name"))
        pairs = left.join(long_, same, "left_semi").groupBy("doc_id", "sha", F.shiftright("pos", 1).alias("half")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("first"), F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("second")
        )
        level += 1
        left = checkpointed(named(pairs.withColumnRenamed("half", "pos"), ["first", "second"], frequent, buckets))
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done)


def exact_duplicates(docs: DataFrame, block_chars: int = 2048, frequent: int = FREQUENT, buckets: int = BUCKETS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``kept`` is true for one row with the smallest doc_id of its group.
    """
    names = document_names(docs, block_chars, frequent, buckets)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(normalised(F.col("text")), 256).alias("text_sha256"))
    rows = rows.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n"))
    names = names.select(F.col("doc_id").alias("d"), F.col("sha"), "level", "name")
    rows = rows.join(names, rows.doc_id.eqNullSafe(F.col("d")) & (F.unhex(F.substring("text_sha256", 1, 32)) == F.col("sha"))).select("doc_id", "text_sha256", "n", "level", "name")
    rows = checkpointed(rows)
    groups = rows.groupBy("level", "name").agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    # rows of a large group are split by the skew join; a group is one row of the other side
    out = rows.join(groups, ["level", "name"])
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")
