"""Importance resampling towards a target distribution, on a stored sparse count matrix.

Each document is a row of counts over hashed features: runs of 1 to ``longest`` consecutive words, each in the bucket that its CRC-32
gives. The matrix is computed once and stored as Parquet, a row a block of documents, each block in compressed sparse row form:
doc_ids, the features and words of each document, where its entries start, and the bucket and count of each entry. Blocks and Parquet's
row groups are small, since Spark's reader decodes up to 4096 rows of a row group at once: a task holds some megabytes of the matrix, however
large its files. Both passes after that read blocks, not texts:

* column sums give the corpus's distribution over buckets, and the same sums over the target's texts the target's;
* a bucket's gain is the logarithm of the ratio of both, smoothed, as an integer; the product of the matrix with the vector of
  gains, over the number of features, is a document's weight.

A document's score is its weight plus Gumbel noise drawn from its doc_id, so the highest scores are a sample without replacement whose chances
follow the weights. Ranks need no task that sees all documents: scores are integers, so one row a score is counted, a running
sum over those gives what lies above each score, and documents are numbered within their score only, from the score that holds the last drawn one upwards.

Vectors have one entry a bucket, and counts by score one row an integer score, which is a few ten thousand whatever the corpus, since a gain is a
thousand times the logarithm of a ratio of counts; both are bounded and go by the driver.

Defined results: a null text has no words, no features and the weight 0. A-Z are lower-cased, other letters are not. A word is a run of letters, digits and
anything beyond ASCII, however long. A null doc_id draws its noise from an empty one and ranks after others of its score. Repeated rows are rows of
their own with equal scores; rows of one score and doc_id are ranked by features. An empty corpus gives an empty result; an empty target has a
flat distribution. Other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import checkpointed, ensure_checkpoint_dir, released, small_batches
from .wordvec import Words, text_chunks

#: Entries of a block; a document with more, up to one a bucket, has a block of its own.
_CELLS = 2048
#: Blocks that are decoded at once: those of a row group of the stored matrix, and of a step in a task. Arrow batches have ``BATCH_ROWS`` at most.
_GROUP = 64
#: Features longer than this many bytes a word are hashed one by one.
_LONG_WORD = 64
_BLOCK = "doc_ids array<bigint>, n_features array<bigint>, n_words array<bigint>, starts array<int>, buckets array<int>, counts array<int>"
#: Bytes of words: digits, small letters (capitals are lower-cased before) and everything beyond ASCII.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def _fed(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 states after the bytes start .. end of each word; all words advance one byte at a time together."""
    state, length = state.copy(), end - start
    order = np.argsort(-length, kind="stable")
    longest, sizes = int(length.max(initial=0)), length[order]
    for k in range(min(longest, _LONG_WORD)):
        on = order[: np.searchsorted(-sizes, -k, "left")]  # those with more than k bytes
        state[on] = _CRC[(state[on] ^ data[start[on] + k]) & np.uint32(0xFF)] ^ (state[on] >> np.uint32(8))
    for i in order[: np.searchsorted(-sizes, -_LONG_WORD, "left")]:
        rest = data[start[i] + _LONG_WORD : end[i]].tobytes()
        state[i] = zlib.crc32(rest, int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return state


def feature_buckets(words: Words, buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every run of 1 to ``longest`` words within a row; the words of a run are joined by one space."""
    row = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    state = np.full(len(words.start), 0xFFFFFFFF, np.uint32)
    rows, found = [], []
    for k in range(longest):
        n = len(words.start) - k
        if n <= 0:
            break
        state = state[:n]
        if k:
            state = _CRC[(state ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (state >> np.uint32(8))
        state = _fed(state, words.data, words.start[k:], words.end[k:])
        inside = row[:n] == row[k:]
        rows.append(row[:n][inside])
        found.append((state[inside] ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(found).astype(np.int64)


def _cuts(starts: np.ndarray, most: int) -> np.ndarray:
    """Where blocks of documents begin and end, each of ``most`` entries at most, or one document."""
    cuts = [0]
    while cuts[-1] < len(starts) - 1:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(starts, starts[cuts[-1]] + most, "right")) - 1))
    return np.array(cuts)


def _blocks(buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for low, high, data, offsets in text_chunks(batch.column(1)):
                words = Words(data, offsets, lower=True, word=WORD_BYTES)
                row, bucket = feature_buckets(words, buckets, longest)
                cells, counts = np.unique(row * buckets + bucket, return_counts=True)
                starts = np.searchsorted(cells, np.arange(high - low + 1) * buckets)
                cuts = _cuts(starts, _CELLS)
                block = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts) + 1)  # of each start; a block has one more than documents
                within = starts[np.arange(len(block)) - block] - starts[cuts[:-1]][block]
                lists = lambda at, values, kind: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), ids.slice(low, high - low)), lists(cuts, np.bincount(row, minlength=high - low), pa.int64()), lists(cuts, np.diff(words.first), pa.int64()),
                        lists(cuts + np.arange(len(cuts)), within, pa.int32()), lists(starts[cuts], cells % buckets, pa.int32()), lists(starts[cuts], counts, pa.int32()),
                    ],
                    ["doc_ids", "n_features", "n_words", "starts", "buckets", "counts"],
                )
        released()

    return run


def count_blocks(docs: DataFrame, id_column: str = "doc_id", buckets: int = 10_000, longest: int = 1) -> DataFrame:
    """The count matrix of ``docs`` (an id column and text), a row a block: ``_CELLS`` entries at most, or one document where that has more."""
    texts = small_batches(docs).select(F.col(id_column).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_blocks(buckets, longest), _BLOCK)


def stored_blocks(docs: DataFrame, folder: str, **parameters) -> DataFrame:
    """``count_blocks``, written to ``folder`` in row groups of ``_GROUP`` blocks and read from there."""
    count_blocks(docs, **parameters).write.option("parquet.block.row.count.limit", _GROUP).parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, dict[str, pa.Array]]]:
    """``_GROUP`` blocks at a time, and their lists by the columns' names, one after the other as one array."""
    for k in range(0, batch.num_rows, _GROUP):
        piece = batch.slice(k, _GROUP)
        yield piece, {name: piece.column(i).flatten() for i, name in enumerate(batch.schema.names)}


def _sums(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, flat in _pieces(batch):
                total += np.bincount(flat["buckets"].to_numpy(), flat["counts"].to_numpy(), buckets).astype(np.int64)  # sums of a piece are exact in doubles
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])
        released()

    return run


def column_sums(blocks: DataFrame, buckets: int = 10_000) -> DataFrame:
    """bucket, n: the features of all documents by bucket; a task sends at most one row a bucket."""
    return blocks.select("buckets", "counts").mapInArrow(_sums(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """bucket, gain, for every bucket, from the column sums of both: floor(1000 * ln(share of the target / share of the corpus)), one added to each count."""
    spark = corpus.sparkSession
    sums = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    sums = sums.unionByName(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    total = sums.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = f"((t + 1D) * (all_s + {buckets}D)) / ((s + 1D) * (all_t + {buckets}D))"
    return sums.join(F.broadcast(total)).select("bucket", F.expr(f"cast(floor(1000D * ln({ratio})) as long)").alias("gain"))  # one row of totals


def _products(gains: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, flat in _pieces(batch):
                docs, cells = (pc.list_value_length(piece.column(name)).to_numpy().astype(np.int64) for name in ("doc_ids", "buckets"))  # of each block
                starts = flat["starts"].to_numpy() + np.repeat(np.cumsum(cells) - cells, docs + 1)
                after = np.cumsum(docs + 1)  # of the starts of each block
                begin, end = np.delete(starts, after - 1), np.delete(starts, after - docs - 1)
                # running sums, so that empty rows are nought
                run_sum = np.concatenate([[0], np.cumsum(gains[flat["buckets"].to_numpy()] * flat["counts"].to_numpy())]).astype(np.int64)
                weight = (run_sum[end] - run_sum[begin]) // np.maximum(flat["n_features"].to_numpy(), 1)
                yield pa.RecordBatch.from_arrays([flat["doc_ids"], flat["n_features"], flat["n_words"], pa.array(weight, pa.int64())], ["doc_id", "n_features", "n_words", "weight"])
        released()

    return run


def document_weights(blocks: DataFrame, gains: DataFrame, buckets: int = 10_000) -> DataFrame:
    """doc_id, n_features, n_words, weight: the matrix times ``gains`` (bucket, gain), over the features of each document, rounded down."""
    vector = np.zeros(buckets, np.int64)  # one entry a bucket
    for r in gains.collect():
        vector[r.bucket] = r.gain
    return blocks.mapInArrow(_products(vector), "doc_id long, n_features long, n_words long, weight long")


def gumbel_noise(doc_id: Column, seed: str) -> Column:
    """floor(-1000 * ln(-ln(u))), where u in (0, 1) comes from the first 32 bits of the SHA-256 of 'seed:doc_id'."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, share_percent: int, eligible: Column) -> DataFrame:
    """``scored`` (doc_id, n_features, weight, score) with rank: 1, 2, 3 ... for the highest scores among the eligible, as many as ``share_percent`` of them; null for others."""
    counts = scored.where(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()  # one row an integer score
    drawn = share_percent * sum(r.n for r in counts) // 100
    above, total = [], 0
    for r in sorted(counts, key=lambda r: -r.score):
        if total >= drawn:
            break
        above.append((r.score, total))
        total += r.n
    least = above[-1][0] if above else None
    chosen = eligible & (F.col("score") >= least) if above else F.lit(False)
    chosen = F.coalesce(chosen, F.lit(False))
    names = ["doc_id", "n_features", "weight", "score"]
    rest = scored.where(~chosen).select(*names, F.lit(None).cast("long").alias("rank"))
    if not above:
        return rest
    before = scored.sparkSession.createDataFrame(above, "score long, before long")
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight")
    top = scored.where(chosen).join(F.broadcast(before), "score").withColumn("place", F.col("before") + F.row_number().over(order))
    return rest.unionByName(top.select(*names, F.when(F.col("place") <= drawn, F.col("place")).cast("long").alias("rank")))


def resampled(docs: DataFrame, target: DataFrame, folder: str | None = None, buckets: int = 10_000, longest: int = 1, seed: str = "2024", share_percent: int = 10, least_words: int = 20) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_features, weight, score, rank (null where not drawn).

    ``target`` has texts of the wanted distribution in a column text. The matrix is stored in ``folder`` (one of its own in the checkpoint
    folder by default). Of the documents with ``least_words`` words, ``share_percent`` are drawn.
    """
    folder = folder or f"{ensure_checkpoint_dir(docs.sparkSession)}/counts-{uuid.uuid4().hex}"
    blocks = stored_blocks(docs, folder, buckets=buckets, longest=longest)
    wanted = count_blocks(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets=buckets, longest=longest)
    gains = bucket_gains(column_sums(blocks, buckets), column_sums(wanted, buckets), buckets)
    weights = document_weights(blocks, gains, buckets)
    scored = checkpointed(weights.withColumn("score", F.col("weight") + gumbel_noise(F.col("doc_id"), seed)))
    return ranked(scored, share_percent, F.col("n_words") >= least_words)


def drawn_documents(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` (with unique doc_ids) that are drawn, with their columns as they are."""
    ids = resampled(docs, target, **parameters).where("rank is not null").select(F.col("doc_id").alias("tl_drawn")).distinct()
    return docs.join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col("tl_drawn")), "left_semi")
