"""Line deduplication over range-partitioned line hashes.

Every document gives one row for each of its different line keys. The rows are range-partitioned
by (hash, document), so a line that a third of all documents share is spread over many tasks, and
sorted by hash, document and position within each task. A task streams its rows with a buffer of
fewer than ``min_docs`` rows, and returns positions only. Runs that reach over the border of a
task are settled by adding up at most two summaries for each task. What comes back to the
documents is a compressed keep bitmap, never text.

Defined results: null text is one empty line; empty lines (keys of fewer than ``min_chars`` code
points) always stay. A document is a distinct pair of doc_id and text, so repeated rows count once
and lose the same lines. A null doc_id is a value like any other and sorts first. An empty table
gives an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import checkpointed, packed, released, row_key, small_batches, unpacked

SPACES = b" \t\n\x0b\x0c\r"
_DROP, _PENDING, _SUMMARY = 0, 1, 2
_OCCURRENCE = "digest binary, doc_id long, text_key long, n_lines int, positions array<int>"
_SETTLED = _OCCURRENCE + ", kind int, run_docs long"


def line_key(line: bytes) -> bytes:
    """The line without spaces at both ends, A-Z lower-cased."""
    return line.strip(SPACES).lower()  # bytes.lower changes A-Z only


def _occurrences(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                lines = text.encode("utf-8", "surrogatepass").split(b"\n")
                where: dict[bytes, list[int]] = {}
                for i, line in enumerate(lines):
                    k = line_key(line)
                    if len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode("utf-8", "replace")) >= min_chars):
                        where.setdefault(k, []).append(i)
                for k, at in where.items():
                    for column, value in zip(out, (hashlib.blake2b(k, digest_size=16).digest(), doc_id, key, len(lines), at)):
                        column.append(value)
            yield _batch(out, _OCCURRENCE_ARROW)
        released()

    return run


_OCCURRENCE_ARROW = pa.schema([("digest", pa.binary()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_lines", pa.int32()), ("positions", pa.list_(pa.int32()))])
_SETTLED_ARROW = pa.schema([*_OCCURRENCE_ARROW, ("kind", pa.int32()), ("run_docs", pa.int64())])


def _batch(columns, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


class _Run:
    """The rows of one hash in one task."""

    def __init__(self, digest: bytes, at_border: bool):
        self.digest, self.at_border, self.docs, self.last, self.head, self.waiting = digest, at_border, 0, None, None, []


def _settle(min_docs: int, keep_first: bool):
    """Streams sorted rows. Drops are final; pending rows, fewer than min_docs of a border run, wait for the sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_: _Run | None = None
        out: list[tuple] = []

        def close(r: _Run, border: bool) -> None:
            if r.at_border or border:
                doc, key = r.head[1], r.head[2]
                out.append((r.digest, doc, key, r.head[3], [], _SUMMARY, r.docs))
                out.extend((*row, _PENDING, r.docs) for row in r.waiting)

        def drop(row: tuple, r: _Run) -> None:
            if keep_first and row is r.head:
                if r.at_border:  # an earlier task may hold the first occurrence
                    out.append((*row, _PENDING, 0))
                elif len(row[4]) > 1:
                    out.append((None, row[1], row[2], row[3], row[4][1:], _DROP, 0))
            else:
                out.append((None, *row[1:], _DROP, 0))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if run_ is None or row[0] != run_.digest:
                    if run_ is not None:
                        close(run_, False)
                    run_ = _Run(row[0], run_ is None)
                if run_.docs and row[1:3] == run_.last:
                    continue  # a repeated row
                run_.docs += 1
                run_.last = row[1:3]
                if run_.head is None:
                    run_.head = row
                run_.waiting.append(row)
                if run_.docs >= min_docs:
                    for waiting in run_.waiting:
                        drop(waiting, run_)
                    run_.waiting = []
            if len(out) > 20_000:
                yield _batch(list(zip(*out)), _SETTLED_ARROW)
                out.clear()
        if run_ is not None:
            close(run_, True)
        if out:
            yield _batch(list(zip(*out)), _SETTLED_ARROW)

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc_id, key, n_lines, positions = (c.to_pylist() for c in batch.columns)
        maps = []
        for n, at in zip(n_lines, positions):
            keep = np.ones(n, np.uint8)
            keep[[i for part in at for i in part]] = 0
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(key, pa.int64()), pa.array(n_lines, pa.int32()), pa.array(maps, pa.binary())], ["doc_id", "text_key", "n_lines", "keep_bitmap"])


def read_bitmap(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """One boolean for each line; no bitmap: all lines stay."""
    if bitmap is None:
        return np.ones(n_lines, bool)
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def line_keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """doc_id, text_key, n_lines, keep_bitmap of each document that loses a line.

    A line is a repeat when its key is in at least ``min_docs`` documents (``min_docs`` 1: in any).
    Repeats go in every document, or, with ``keep_first``, everywhere but at the first position in
    the document with the smallest (doc_id, text_key).
    """
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("text")).alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.mapInArrow(_occurrences(min_chars), _OCCURRENCE)
    dealt = found.repartitionByRange("digest", "doc_id", "text_key").sortWithinPartitions("digest", "doc_id", "text_key")
    settled = checkpointed(dealt.mapInArrow(_settle(min_docs, keep_first), _SETTLED))
    keys = ["doc_id", "text_key", "n_lines", "positions"]
    # at most two summaries for each task of the sort: this is what bounds the broadcast
    sums = settled.where(F.col("kind") == _SUMMARY).groupBy("digest").agg(F.sum("run_docs").alias("docs"), F.min(F.struct("doc_id", "text_key")).alias("head")).where(F.col("docs") >= min_docs)
    pending = settled.where(F.col("kind") == _PENDING).select("digest", *keys).join(F.broadcast(sums), "digest")
    if keep_first:
        is_head = F.struct("doc_id", "text_key").eqNullSafe(F.col("head"))
        pending = pending.withColumn("positions", F.when(is_head, F.slice("positions", 2, F.greatest(F.size("positions") - 1, F.lit(0)))).otherwise(F.col("positions")))
    dropped = settled.where(F.col("kind") == _DROP).select(keys).unionByName(pending.select(keys))
    lists = dropped.where(F.size("positions") > 0).groupBy("doc_id", "text_key").agg(F.first("n_lines").alias("n_lines"), F.collect_list("positions").alias("positions"))
    return lists.mapInArrow(_bitmaps, "doc_id long, text_key long, n_lines int, keep_bitmap binary")


def with_keep_bitmap(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """tl_row (the columns of ``docs``) and keep_bitmap, null where all lines stay. The bitmaps, not the texts, are what the join hashes."""
    right = bitmaps.select(F.col("doc_id").cast("long").alias("d"), F.col("text_key").alias("k"), "keep_bitmap").hint("shuffle_hash")
    joined = packed(docs).join(right, F.col("tl_doc").eqNullSafe(F.col("d")) & (F.col("tl_key") == F.col("k")), "left")
    return joined.select("tl_row", "keep_bitmap")


def kept_lines(text: str | None, bitmap: bytes | None) -> tuple[str, int, int]:
    """The text of the lines that stay, the number of lines, the number dropped."""
    text = text or ""
    if bitmap is None:
        return text, text.count("\n") + 1, 0
    lines = text.split("\n")
    keep = read_bitmap(bitmap, len(lines))
    return "\n".join([x for x, k in zip(lines, keep) if k]), len(lines), int(len(lines) - keep.sum())


def _drop_lines(texts: pd.Series, bitmaps: pd.Series) -> pd.Series:
    return pd.Series([t if b is None else kept_lines(t, b)[0] for t, b in zip(texts, bitmaps)], dtype=object)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [kept_lines(t, b) for t, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[0].encode("utf-8", "surrogatepass")).hexdigest() for r in rows], pa.string()), batch.column(2)],
            ["doc_id", "n_lines", "n_dropped", "kept_sha256", "keep_bitmap"],
        )


def line_dedup_digests(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_lines, n_dropped, kept_sha256, keep_bitmap (null: all lines stay)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = with_keep_bitmap(docs, line_keep_bitmaps(docs, min_docs, min_chars, keep_first))
    return marked.select("tl_row.doc_id", "tl_row.text", "keep_bitmap").mapInArrow(_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string, keep_bitmap binary")


def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """``docs`` with repeated lines gone from ``text`` (and ``n_chars``, where there is one, counted anew)."""
    marked = with_keep_bitmap(docs, line_keep_bitmaps(docs, min_docs, min_chars, keep_first))
    text = F.col("tl_row.text")
    return unpacked(marked, docs, text=F.when(F.col("keep_bitmap").isNull(), text).otherwise(F.pandas_udf(_drop_lines, "string")(text, "keep_bitmap")))
