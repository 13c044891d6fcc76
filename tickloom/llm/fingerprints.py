"""Document fingerprints from improbable features, compared by the overlap of Bloom filters.

A feature is a window of 32 bytes. Its rarity is that of its entropy: one scan counts the entropies, in thousandths, of all windows of the
corpus, and the less often an entropy comes, the better a window's rank. Of each 64 windows in a row the best one (the first of
equals) gets a point, and windows with 16 points or more are selected, about one in thirty bytes. What is selected depends on a
hundred bytes around it only, so texts with a passage in common share its features wherever it stands. Selected windows are hashed to five of
2048 bits. A filter takes 160 different features, then the next one of the chain begins.

Two fingerprints are compared filter by filter, from the one with fewer features. A filter's likeness to another is the number of bits in common beyond what
chance gives, over what equal filters would have beyond chance, and nought within four standard deviations of chance. Its likenesses to the filters
of the other chain add up to 1 at most, since its features can be dealt over several there. The likeness of the fingerprints is the mean over
filters by their features: about the share of the smaller text that the larger one has too. Of fingerprints with equally many features
the greater of both directions counts.

Neighbours are found without a task that sees the whole table: doc_ids are cut at quantiles into buckets, each bucket is sorted and streamed, and the first
row of each bucket is sent to the bucket before it as well. What the driver sees is two numbers a bucket and 1001 counts of entropies.

Defined results: a null text counts as empty; an empty text has no feature and is like an empty one only. A text shorter than a
window, or with no window of any entropy worth ranking, has its whole text as one feature. Neighbours go by descending doc_id, null last, then by
text (its 64-bit hash, then itself), so ties and repeated rows have one order; a lone row is its own neighbour. An empty table gives
an empty result. Texts of any length are worked through in pieces of a megabyte. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import released, row_key, small_batches
from .wordvec import mix, sliding_min, text_chunks

#: Bytes of a window, windows that compete, points that select one, bits of a filter, bits a feature sets, features a filter takes.
WINDOW, SPAN, POINTS, BITS, HASHES, MOST = 32, 64, 16, 2048, 5, 160
#: Entropies are in thousandths of the greatest; windows below WEAK (runs of one or two characters) are never selected.
LEVELS, WEAK = 1000, 100
#: Standard deviations from chance within which an overlap counts as chance.
CHANCE = 4.0
_PIECE = 1 << 20
_GAP = bytes(SPAN)
_POWER = np.round(np.arange(WINDOW + 1) * np.log2(np.maximum(np.arange(WINDOW + 1), 1)) * (1 << 20)).astype(np.int64)
_STEP = np.diff(_POWER)
_NONE = np.int64(1) << np.int64(40)


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """The entropy of the bytes of each window, in thousandths of the greatest, by exact integer sums."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)  # equal bytes among the 31 before, after
    for k in range(1, WINDOW):
        same = (data[k:] == data[:-k]).view(np.uint8)
        before[k:] += same
        after[:-k] += same
    total = np.empty(n - WINDOW + 1, np.int64)
    total[0] = _POWER[np.bincount(data[:WINDOW])].sum()
    np.cumsum(_STEP[before[WINDOW:]] - _STEP[after[: n - WINDOW]], out=total[1:])
    total[1:] += total[0]
    return (LEVELS * (_POWER[WINDOW] - total)) // _POWER[WINDOW]


def _entropy_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(LEVELS + 1, np.int64)
    for batch in batches:
        for _, _, data, offsets in text_chunks(batch.column(0)):
            for low in range(0, max(len(data) - WINDOW + 1, 0), _PIECE):
                levels = entropy_levels(data[low : low + _PIECE + WINDOW - 1])
                # windows that reach over the end of a text are none
                ends = offsets[1:][(offsets[1:] > low) & (offsets[1:] < low + len(levels) + WINDOW - 1)] - low
                over = np.zeros(len(levels) + WINDOW, np.int32)
                np.add.at(over, np.maximum(ends - WINDOW + 1, 0), 1)
                np.add.at(over, np.minimum(ends, len(levels)), -1)
                counts += np.bincount(levels[np.cumsum(over)[: len(levels)] == 0], minlength=LEVELS + 1)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["level", "n"])
    released()


def entropy_counts(docs: DataFrame) -> DataFrame:
    """level, n: how many windows of all texts have each entropy."""
    texts = small_batches(docs).select(F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_entropy_counts, "level int, n long").groupBy("level").agg(F.sum("n").alias("n"))


def rarity_ranks(counts: DataFrame) -> np.ndarray:
    """From ``entropy_counts``: the place of each of 1001 entropies, from those that never come to the most frequent one."""
    seen = np.zeros(LEVELS + 1, np.int64)
    for r in counts.collect():
        seen[r.level] = r.n
    ranks = np.empty(LEVELS + 1, np.int64)
    ranks[np.lexsort((np.arange(LEVELS + 1), seen))] = np.arange(LEVELS + 1)
    return ranks


@dataclass
class Fingerprint:
    """The number of features and the chain of filters, a row of 256 bytes each."""

    features: int
    filters: np.ndarray

    def __str__(self) -> str:
        return f"{self.features}:{base64.b64encode(self.filters.tobytes()).decode()}"

    @classmethod
    def read(cls, written: str) -> Fingerprint:
        n, _, body = written.partition(":")
        return cls(int(n), np.frombuffer(base64.b64decode(body), np.uint8).reshape(-1, BITS // 8))


def _window_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    lanes = np.ascontiguousarray(data[at[:, None] + np.arange(WINDOW)]).view("<u8")
    h = np.zeros(len(at), np.uint64)
    for k in range(lanes.shape[1]):
        h = mix((h + lanes[:, k]) * np.uint64(0x9FB21C651E98DF25))
    return h


def selected(data: np.ndarray, valid: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the selected windows. ``valid`` tells where a window may start; texts lie SPAN bytes apart."""
    places, hashes, margin = [], [], SPAN - 1
    for low in range(0, len(data), _PIECE):
        high = min(low + _PIECE, len(data))
        left, right = max(low - margin, 0), min(high + margin, len(data))
        levels = entropy_levels(data[left : right + WINDOW - 1])
        levels = np.pad(levels, (0, right - left - len(levels)))
        fit = valid[left:right] & (levels >= WEAK)
        key = np.where(fit, ranks[levels], _NONE) * (1 << 22) + np.arange(len(levels))
        best = sliding_min(np.pad(key, margin, constant_values=_NONE << 22), SPAN)
        best = best[best < _NONE << 22] & ((1 << 22) - 1)
        at = np.flatnonzero(np.bincount(best, minlength=right - left)[low - left : high - left] >= POINTS) + low
        if len(at):
            places.append(at)
            hashes.append(_window_hashes(data, at))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(places), np.concatenate(hashes)


def _bloom(hashes: np.ndarray) -> Fingerprint:
    chain = np.zeros((-(-len(hashes) // MOST), BITS), bool)
    which = np.arange(len(hashes)) // MOST
    for k in range(HASHES):
        chain[which, (hashes >> np.uint64(11 * k)).astype(np.int64) % BITS] = True
    return Fingerprint(len(hashes), np.packbits(chain, axis=1))


def fingerprints_of(texts: list[bytes], ranks: np.ndarray) -> list[Fingerprint]:
    """The fingerprint of each text, all texts worked through together."""
    start, at = [], 0
    for t in texts:
        start.append(at)
        at += len(t) + SPAN
    data = np.frombuffer(_GAP.join(texts) + _GAP, np.uint8)
    valid = np.zeros(len(data), bool)
    for s, t in zip(start, texts):
        valid[s : s + max(len(t) - WINDOW + 1, 0)] = True
    places, hashes = selected(data, valid, ranks)
    edges, out = np.searchsorted(places, [*start, len(data)]), []
    for k, t in enumerate(texts):
        own = hashes[edges[k] : edges[k + 1]]
        if not len(own) and t:
            own = np.frombuffer(hashlib.blake2b(t, digest_size=8).digest(), "<u8")
        _, first = np.unique(own, return_index=True)
        out.append(_bloom(own[np.sort(first)]))
    return out


def _contained(a: Fingerprint, b: Fingerprint) -> float:
    """How much of a's features b has, from the bits."""
    x, y = np.unpackbits(a.filters, axis=1).astype(np.float32), np.unpackbits(b.filters, axis=1).astype(np.float32)
    weights = np.full(len(x), float(MOST))
    weights[-1] = a.features - MOST * (len(x) - 1)
    m, total = y.sum(axis=1), 0.0
    for low in range(0, len(x), 256):
        part = x[low : low + 256]
        n = part.sum(axis=1)[:, None]
        chance = n * m / BITS
        beyond = part @ y.T - chance
        beyond[beyond <= CHANCE * np.sqrt(chance * (1 - n / BITS) * (1 - m / BITS))] = 0
        # a filter within another has at most its own bits in common with it
        total += float((np.minimum((beyond / (n - n * m / BITS)).sum(axis=1), 1.0) * weights[low : low + 256]).sum())
    return total / a.features


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """From 0 to 1; 1 for equal fingerprints."""
    if a.features == b.features and np.array_equal(a.filters, b.filters):
        return 1.0
    if not a.features or not b.features:
        return 0.0
    if a.features == b.features:
        return max(_contained(a, b), _contained(b, a))
    return _contained(*sorted((a, b), key=lambda f: f.features))


def edited(text: str, following: str) -> str:
    """``text``, its last half (rounded down) replaced by as many first characters of the next text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of (bucket, guest, doc_id, text) by about half a megabyte."""
    rows, size = [], 0
    for batch in batches:
        for row in zip(*[batch.column(k).to_pylist() for k in range(4)]):
            rows.append(row)
            size += len(row[3])
            if size >= _PIECE // 2:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(ranks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the row before, with its fingerprint
        for rows in _chunks(batches):
            line = [before[0], *rows] if before else rows
            pairs = [(k, edited(line[k][3], line[k + 1][3]).encode("utf-8", "surrogatepass")) for k in range(len(line) - 1) if not line[k][1] and line[k][0] == line[k + 1][0]]
            found = fingerprints_of([r[3].encode("utf-8", "surrogatepass") for r in rows] + [t for _, t in pairs], ranks)
            own, changed = ([before[1]] if before else []) + found[: len(rows)], found[len(rows) :]
            out = [(line[k][2], len(line[k][3]), hashlib.sha256(t).hexdigest(), str(own[k]), str(f), likeness(own[k], f), likeness(own[k], own[k + 1])) for (k, t), f in zip(pairs, changed)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], [c.split()[0] for c in _OUT.split(", ")])
            before = (line[-1], own[-1])
        released()

    return run


def _with_bucket(rows: DataFrame, bounds: list[float]) -> DataFrame:
    """``rows`` (at long) with bucket, by binary search in at most as many bounds as there are buckets."""
    cut = Bucketizer(splits=[float("-inf"), *(bounds or [0.0]), float("inf")], inputCol="tl_at", outputCol="tl_bucket")
    return cut.transform(rows.withColumn("tl_at", F.col("at").cast("double"))).withColumn("bucket", F.col("tl_bucket").cast("int")).drop("tl_at", "tl_bucket")


def neighbours_streamed(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows (bucket, guest, doc_id, text), sorted by descending doc_id within each bucket; a bucket's last rows are guests, copies of the first row that follows in the table.

    ``buckets`` is four for each shuffle partition by default, so that tasks have equal shares; it changes no result.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or 4 * tasks
    # a null doc_id is last of all
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("at", F.coalesce("doc_id", F.lit(-(1 << 63))))
    quantiles = [k / buckets for k in range(1, buckets)] or [0.5]
    bounds = rows.agg(F.percentile_approx("at", quantiles, max(10_000, 10 * buckets)).alias("q")).first().q or []
    bounds = sorted({float(x) for x in bounds if x > -(1 << 63)})
    first = {r.bucket: r.at for r in _with_bucket(rows.select("at"), bounds).groupBy("bucket").agg(F.max("at").alias("at")).collect()}  # one row a bucket
    order = sorted(first, reverse=True)
    heads = [(b, first[b], order[k - 1]) for k, b in enumerate(order)]  # the head of a bucket follows the bucket before, that of the first the last
    heads = spark.createDataFrame(heads, "bucket int, head long, host int")
    placed = _with_bucket(rows, bounds).join(F.broadcast(heads), "bucket")
    home, away = F.struct(F.col("bucket"), F.lit(0).alias("guest")), F.struct(F.col("host").alias("bucket"), F.lit(1).alias("guest"))
    placed = placed.withColumn("to", F.explode(F.when(F.col("at") == F.col("head"), F.array(home, away)).otherwise(F.array(home))))
    placed = placed.select("to.bucket", "to.guest", "doc_id", "text", "at", row_key(F.col("text")).alias("key"))
    line = ["bucket", "guest", F.col("at").desc(), F.col("doc_id").desc_nulls_last(), "key", "text"]
    return placed.repartition(tasks, "bucket").sortWithinPartitions(*line).select("bucket", "guest", "doc_id", "text")


def document_fingerprints(docs: DataFrame, ranks: np.ndarray | None = None) -> DataFrame:
    """doc_id, fingerprint for each row of ``docs``, without a shuffle. ``ranks``: those of ``docs`` itself unless given; keep them to compare with texts that come later."""
    ranks = rarity_ranks(entropy_counts(docs)) if ranks is None else ranks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_chunks(batch.column(1)):
                texts = [data[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array([str(f) for f in fingerprints_of(texts, ranks)], pa.string())], ["doc_id", "fingerprint"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def fingerprint_digests(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    ranks = rarity_ranks(entropy_counts(docs))
    return neighbours_streamed(small_batches(docs), buckets).mapInArrow(_compared(ranks), _OUT)
