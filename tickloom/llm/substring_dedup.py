"""Substring deduplication with super-k-mers.

A window is ``window`` consecutive words. Its minimiser is the least hash of its runs of ``run``
words; consecutive windows that share one travel as one packed string, a super-k-mer, to the bucket
of the minimiser, so equal windows always meet. A task first packs what it holds: equal strings of a
bucket go once, with a list of their places, and a bucket's strings travel as one compressed block.
In a bucket, windows are sorted; equal neighbours are compared word by word, so a count is exact
whatever the hashes. Places, not texts, come back to the documents.

The number of buckets follows the bytes of text. A minimiser is a run of few words, so a frequent run can
gather more windows than a task holds: minimisers of more than ``most`` windows are counted first, and
their windows go one by one, each by a 128-bit digest of its own words. Spark's aggregates take the least
doc_id of each digest before anything is shuffled, and a join that streams brings it back to the places, so
neither the contexts of a frequent run nor the places of a passage that very many documents share are held
in one task's memory. The counts only choose the way that windows go; results are the same by either.

Defined results: null text has no words. A null doc_id counts as larger than all others. Repeated rows
have equal doc_ids, and so are no earlier documents for each other. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import released, row_key, small_batches
from .wordvec import SPACE, Words, mix, sliding_min, text_chunks, window_hashes

#: Stands for a null doc_id.
LAST = (1 << 63) - 1
_PACK_BYTES = 12 << 20


def super_kmers(words: Words, window: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end word, row, minimiser) of each super-k-mer."""
    none = np.zeros(0, np.int64)
    n = len(words.start) - window + 1
    if n <= 0:
        return none, none, none, none.astype(np.uint64)
    least = sliding_min(window_hashes(words.hashes(), run), window - run + 1)
    row = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    at = np.flatnonzero(np.arange(n) + window <= words.first[row[:n] + 1])
    if not len(at):
        return none, none, none, none.astype(np.uint64)
    begins = np.ones(len(at), bool)
    begins[1:] = (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]])
    first = np.flatnonzero(begins)
    last = np.append(first[1:], len(at)) - 1
    return at[first], at[last] + window, row[at[first]], least[at[first]]


def spaced(words: Words) -> tuple[bytes, np.ndarray]:
    """The words, each followed by one space, and the offset of each (one more at the end)."""
    offsets = np.zeros(len(words.start) + 1, np.int64)
    np.cumsum(words.end - words.start + 1, out=offsets[1:])
    out = np.full(offsets[-1], 0x20, np.uint8)
    inside = np.ones(offsets[-1], bool)
    inside[offsets[1:] - 1] = False
    out[inside] = words.data[~SPACE[words.data]]
    return out.tobytes(), offsets


class _Pack:
    """Super-k-mers of one task that wait to be packed."""

    def __init__(self):
        self.columns: list[tuple] = []
        self.texts: list[bytes] = []
        self.held = 0

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        if self.texts:
            bucket, doc, key, start, n_words = (np.concatenate(c) for c in zip(*self.columns))
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            packer = zstandard.ZstdCompressor(level=6)
            for part in np.split(order, cuts):
                seen: dict[bytes, int] = {}
                ids = np.array([seen.setdefault(self.texts[i], len(seen)) for i in part.tolist()], np.uint32)
                firsts = part[np.unique(ids, return_index=True)[1]]
                raw = b"".join(
                    (struct.pack("<II", len(ids), len(seen)), np.diff(ids.astype(np.int64), prepend=0).astype(np.int32).tobytes(), np.diff(doc[part], prepend=0).tobytes(), key[part].tobytes(), start[part].tobytes(), n_words[firsts].tobytes(), *seen)
                )
                yield int(bucket[part[0]]), packer.compress(raw)
        self.__init__()


def _heavy(window: int, run: int, least_count: int):
    """How many windows a task has for each minimiser; those of fewer than ``least_count`` are left to the buckets."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, waiting, held = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            for low, high, data, offsets in text_chunks(batch.column(0)):
                start, end, row, least = super_kmers(Words(data, offsets), window, run)
                waiting.append((least, end - start - window + 1))
                held += len(least)
                if held > len(known) + (1 << 19):
                    known, counts, waiting, held = *_added(known, counts, waiting), [], 0
        known, counts = _added(known, counts, waiting)
        of = counts >= least_count
        if of.any():
            yield pa.RecordBatch.from_arrays([pa.array(known[of].view(np.int64)), pa.array(counts[of])], ["minimiser", "n"])
        released()

    return each


def _added(known: np.ndarray, counts: np.ndarray, more: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    every, which = np.unique(np.concatenate([known, *[m[0] for m in more]]), return_inverse=True)
    total = np.zeros(len(every), np.int64)
    np.add.at(total, which.reshape(-1), np.concatenate([counts, *[m[1] for m in more]]))
    return every, total


def _single(window: int, run: int, hot: np.ndarray):
    """digest, doc, key, begin of each window whose minimiser is hot."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for low, high, data, offsets in text_chunks(batch.column(2)):
                words = Words(data, offsets)
                start, end, row, least = super_kmers(words, window, run)
                of = np.isin(least, hot)
                if not of.any():
                    continue
                start, n, row = start[of], (end - start)[of] - window + 1, row[of]
                text, at = spaced(words)
                which = np.repeat(np.arange(len(n)), n)
                first = start[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                digests = [hashlib.blake2b(text[a:b], digest_size=16).digest() for a, b in zip(at[first].tolist(), at[first + window].tolist())]
                row = row[which]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(docs[low + row].astype(np.int64)), pa.array(keys[low + row].astype(np.int64)), pa.array((first - words.first[row]).astype(np.int32))], ["digest", "doc", "key", "begin"])
        released()

    return each


def _packed(window: int, run: int, buckets: int, hot: np.ndarray):
    def batch_of(pack: _Pack) -> pa.RecordBatch | None:
        rows = list(pack.blocks())
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "block"]) if rows else None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = _Pack()
        for batch in batches:
            docs, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for low, high, data, offsets in text_chunks(batch.column(2)):
                words = Words(data, offsets)
                start, end, row, least = super_kmers(words, window, run)
                if len(hot):
                    cold = ~np.isin(least, hot)
                    start, end, row, least = start[cold], end[cold], row[cold], least[cold]
                if not len(start):
                    continue
                text, at = spaced(words)
                pack.texts += [text[a:b] for a, b in zip(at[start].tolist(), at[end].tolist())]
                bucket = (mix(least ^ np.uint64(0x5DEECE66D)) % np.uint64(buckets)).astype(np.int64)
                pack.columns.append((bucket, docs[low + row].astype(np.int64), keys[low + row].astype(np.uint32), (start - words.first[row]).astype(np.uint32), (end - start).astype(np.uint32)))
                pack.held += len(data)
                if pack.held >= _PACK_BYTES and (out := batch_of(pack)) is not None:
                    yield out
        if (out := batch_of(pack)) is not None:
            yield out
        released()

    return each


def _unpacked(blocks: list[bytes]):
    """ids, doc, key, start of the places; n_words of the strings; the bytes of all strings."""
    columns: tuple[list, ...] = ([], [], [], [], [], [])
    base, reader = 0, zstandard.ZstdDecompressor()
    for block in blocks:
        raw = reader.decompress(block)
        n, u = struct.unpack_from("<II", raw)
        at = 8
        got = []
        for count, kind in ((n, np.int32), (n, np.int64), (n, np.uint32), (n, np.uint32), (u, np.uint32)):
            got.append(np.frombuffer(raw, kind, count, at))
            at += count * np.dtype(kind).itemsize
        for column, x in zip(columns, (np.cumsum(got[0].astype(np.int64)) + base, np.cumsum(got[1]), got[2], got[3], got[4].astype(np.int64), np.frombuffer(raw, np.uint8, offset=at))):
            column.append(x)
        base += u
    return [np.concatenate(c) for c in columns]


def _equal_groups(ids: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """A group number for each window, equal where all words are: windows are sorted by a hash and neighbours compared word by word."""
    digest = window_hashes(mix(ids.astype(np.uint64) + np.uint64(1)), window, 7)[at]
    order = np.argsort(digest, kind="stable")
    same = digest[order[1:]] == digest[order[:-1]]
    pairs = np.flatnonzero(same)
    a, b = at[order[pairs]], at[order[pairs + 1]]
    unlike = np.zeros(len(pairs), bool)
    for k in range(window):
        unlike |= ids[a + k] != ids[b + k]
    group = np.zeros(len(at), np.int64)
    group[order] = np.concatenate(([0], np.cumsum(~same)))
    if unlike.any():  # windows whose hash isn't theirs alone are sorted by their words
        mixed = np.isin(group, group[order[pairs[unlike]]])
        rows = ids[at[mixed][:, None] + np.arange(window)]
        group[mixed] = group.max() + 1 + np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1)
        group = np.unique(group, return_inverse=True)[1]
    return group


def _repeats(blocks: list[bytes], window: int) -> list[np.ndarray]:
    """doc, key, begin, stop (words) of the windows of one bucket that a smaller doc_id has too."""
    place, doc, key, start, n_words, data = _unpacked(blocks)
    ends = np.flatnonzero(data == 0x20) + 1
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    ids = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    n_windows = n_words - window + 1
    first_word = np.cumsum(n_words) - n_words
    first_window = np.cumsum(n_windows) - n_windows
    of = np.repeat(np.arange(len(n_words)), n_windows)
    at = np.arange(len(of)) - first_window[of] + first_word[of]
    group = _equal_groups(ids, at, window)
    earliest = np.full(len(n_words), LAST, np.int64)
    np.minimum.at(earliest, place, doc)
    least = np.full(int(group.max()) + 1, LAST, np.int64)
    np.minimum.at(least, group, earliest[of])
    n = n_windows[place]
    which = np.repeat(np.arange(len(place)), n)
    step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    repeated = least[group[first_window[place[which]] + step]] < doc[which]
    hit = np.flatnonzero(repeated)
    if not len(hit):
        return [doc[:0], key[:0], start[:0], start[:0]]
    begins = np.ones(len(hit), bool)
    begins[1:] = (np.diff(hit) != 1) | (which[hit[1:]] != which[hit[:-1]])
    first = np.flatnonzero(begins)
    last = np.append(first[1:], len(hit)) - 1
    w = which[hit[first]]
    return [doc[w], key[w], start[w] + step[hit[first]], start[w] + step[hit[last]] + window]


def _bucket_reader(window: int):
    def out(blocks: list[bytes]) -> pa.RecordBatch:
        doc, key, begin, stop = _repeats(blocks, window)
        return pa.RecordBatch.from_arrays([pa.array(x.astype(k)) for x, k in ((doc, np.int64), (key, np.int64), (begin, np.int32), (stop, np.int32))], ["doc", "key", "begin", "stop"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for bucket, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                if held and bucket != at:
                    yield out(held)
                    held = []
                at = bucket
                held.append(block.as_py())
        if held:
            yield out(held)

    return each


def repeated_spans(docs: DataFrame, window: int = 13, run: int = 3, bucket_bytes: int = 4 << 20, most: int = 500_000) -> DataFrame:
    """doc, key, spans (begin, stop in words): what of each document is in a window that a smaller doc_id has too.

    ``doc`` is the doc_id, LAST for null; ``key`` tells apart rows with one doc_id, and is 0 where no doc_id comes twice.
    """
    texts = _keyed(docs)
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    if texts.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        texts = texts.withColumn("key", F.lit(0).cast("long"))  # doc_ids suffice, and zeros take no room in a block
    buckets = max(16, int(size // bucket_bytes))
    # what all tasks leave out of a minimiser's count comes to most / 2 at the worst; at most two minimisers for ``most`` windows reach the driver
    heavy = texts.select("text")
    heavy = heavy.mapInArrow(_heavy(window, run, max(1, most // (2 * max(1, heavy.rdd.getNumPartitions())))), "minimiser long, n long")
    hot = np.array([r.minimiser for r in heavy.groupBy("minimiser").agg(F.sum("n").alias("n")).where(F.col("n") > most // 2).collect()], np.int64).view(np.uint64)
    blocks = texts.select("doc", "key", "text").mapInArrow(_packed(window, run, buckets, hot), "bucket long, block binary")
    dealt = blocks.repartition("bucket").sortWithinPartitions("bucket")
    found = dealt.mapInArrow(_bucket_reader(window), "doc long, key long, begin int, stop int")
    if len(hot):
        single = texts.select("doc", "key", "text").mapInArrow(_single(window, run, hot), "digest binary, doc long, key long, begin int")
        least = single.groupBy(F.col("digest").alias("d")).agg(F.min("doc").alias("least"), F.max("doc").alias("last")).where("least < last").select("d", "least").hint("merge")
        again = single.join(least, F.col("digest") == F.col("d")).where("least < doc")
        found = found.unionByName(again.select("doc", "key", "begin", (F.col("begin") + window).cast("int").alias("stop")))
    return found.groupBy("doc", "key").agg(F.collect_list(F.struct("begin", "stop")).alias("spans"))


def _keyed(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"),
        F.greatest(row_key(F.col("text")).bitwiseAND(F.lit((1 << 32) - 1)), F.lit(1).cast("long")).alias("key"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def kept_words(text: str | bytes, spans: list | None) -> tuple[bytes, int, int]:
    """The words that stay, joined by one space; the number of words; the number removed."""
    words = (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).split()
    if not spans:
        return b" ".join(words), len(words), 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, [s["begin"] for s in spans], 1)
    np.add.at(edge, [s["stop"] for s in spans], -1)
    gone = np.cumsum(edge)[:-1] > 0
    return b" ".join([w for w, g in zip(words, gone.tolist()) if not g]), len(words), int(gone.sum())


def _cleaned(with_text: bool):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [kept_words(t, s) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            told = pa.array([r[0].decode("utf-8", "replace") if with_text else hashlib.sha256(r[0]).hexdigest() for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), told], ["doc_id", "n_words", "n_removed", "text" if with_text else "kept_sha256"])

    return each


def _joined(docs: DataFrame, window: int) -> DataFrame:
    spans = repeated_spans(docs, window).select(F.col("doc").alias("d"), F.col("key").alias("k"), "spans").hint("shuffle_hash")
    texts = _keyed(docs)
    return texts.join(spans, (texts.doc == F.col("d")) & ((F.col("k") == 0) | (texts.key == F.col("k"))), "left").select("doc_id", "text", "spans")


def without_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, text: one row for each row of ``docs``, its text the words that stay, joined by one space."""
    return _joined(docs, window).mapInArrow(_cleaned(True), "doc_id long, n_words long, n_removed long, text string")


def substring_dedup_digests(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row for each row of ``docs``."""
    return _joined(docs, window).mapInArrow(_cleaned(False), "doc_id long, n_words long, n_removed long, kept_sha256 string")
