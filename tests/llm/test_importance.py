"""Importance resampling against plain counting."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tickloom.llm import importance
from tickloom.llm.wordvec import Words, text_chunks

DOCS = "doc_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text, longest):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, buckets=10_000, longest=1, percent=10, least=20, seed="2024"):
    code = lambda f: zlib.crc32(f.encode()) % buckets
    each = [(i, *features(t, longest)) for i, t in docs]
    s, t = Counter(code(f) for *_, fs in each for f in fs), Counter(code(f) for _, x in target for f in features(x, longest)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets))))
    rows = []
    for i, words, fs in each:
        weight = sum(gain(code(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(fs), weight, score, len(words) >= least))
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    ranks = {}
    for k, r in enumerate(order[: percent * len(order) // 100], 1):
        ranks.setdefault(r, []).append(k)
    return Counter((*r[:4], ranks[r].pop(0) if ranks.get(r) else None) for r in rows)


def drawn(seed: int, n: int = 300):
    rng = random.Random(seed)
    pool = [f"w{k}" for k in range(60)] + ["É", "é", "日本", "straße", "Don't", "a_b", "42", "Ünï", "x" * 64, "y" * 65, "É" * 200]
    say = lambda k: rng.choice([" ", "  ", "\n", ", "]).join(rng.choice(pool).upper() if rng.random() < 0.1 else rng.choice(pool) for _ in range(k))
    docs = [(i, say(rng.choice([0, 1, 19, 20, 21, 60, 200])) + rng.choice(["", "\x00", "~", "!"])) for i in range(n)]
    return docs, [(i, say(30)) for i in range(20)]


@pytest.mark.parametrize("seed, parameters", [(0, {}), (1, {"longest": 2}), (2, {"longest": 3, "buckets": 97}), (3, {"share_percent": 100, "least_words": 1, "buckets": 10}), (4, {"share_percent": 0})])
def test_against_counting(spark, seed, parameters):
    docs, target = drawn(seed)
    got = importance.resampled(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(target, DOCS), **parameters)
    names = {"share_percent": "percent", "least_words": "least"}
    assert Counter(map(tuple, got.collect())) == brute(docs, target, **{names.get(k, k): v for k, v in parameters.items()})


def test_crc_of_runs():
    docs, _ = drawn(7)
    texts = [t for _, t in docs] + ["z" * 3_000_000, "", "a " * 100_000]
    for _, _, data, offsets in text_chunks(pa.array(texts)):
        rows, codes = importance.feature_buckets(Words(data, offsets, lower=True, word=importance.WORD_BYTES), 10_000, 2)
        for k in range(len(offsets) - 1):
            text = bytes(data[offsets[k] : offsets[k + 1]]).decode()
            assert codes[rows == k].tolist() == [zlib.crc32(f.encode()) % 10_000 for f in features(text, 2)[1]]


def test_the_matrix_is_what_was_counted(spark, tmp_path):
    docs, _ = drawn(3, 80)
    blocks = importance.stored_blocks(spark.createDataFrame(docs, DOCS).repartition(3), f"{tmp_path}/m", buckets=50)
    got = {}
    for r in blocks.collect():
        assert len(r.starts) == len(r.doc_ids) + 1 and r.starts[-1] == len(r.buckets) == len(r.counts)
        for k, i in enumerate(r.doc_ids):
            span = slice(r.starts[k], r.starts[k + 1])
            got[i] = Counter(dict(zip(r.buckets[span], r.counts[span])))
            assert r.n_features[k] == sum(got[i].values())
    want = {i: Counter(zlib.crc32(f.encode()) % 50 for f in features(t, 1)[1]) for i, t in docs}
    assert got == want
    sums = {r.bucket: r.n for r in importance.column_sums(blocks, 50).collect()}
    assert sums == sum(want.values(), Counter())


def test_blocks_and_row_groups_are_small(spark, tmp_path):
    """Spark's reader decodes up to 4096 rows of a row group at once, so a task's memory follows blocks and row groups, and not the size of a file."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(20_000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 40, 300, 900, 6000 if i % 50 == 0 else 20])))) for i in range(1500)]
    blocks = importance.stored_blocks(spark.createDataFrame(docs, DOCS).coalesce(1), f"{tmp_path}/m")
    rows = blocks.collect()
    assert len(rows) > 2 * 64 and all(len(r.buckets) <= 2048 or len(r.doc_ids) == 1 for r in rows)
    assert max(len(r.buckets) for r in rows) > 2048
    files = [pq.ParquetFile(f).metadata for f in tmp_path.glob("m/*.parquet")]
    assert max(f.row_group(k).num_rows for f in files for k in range(f.num_row_groups)) == 64
    codes = [(i, [zlib.crc32(w.encode()) % 10_000 for w in text.split()]) for i, text in docs]
    assert {r.bucket: r.n for r in importance.column_sums(blocks).collect()} == Counter(c for _, each in codes for c in each)
    weights = importance.document_weights(blocks, spark.range(10_000).select(F.col("id").cast("int").alias("bucket"), F.col("id").alias("gain")))
    assert sorted(map(tuple, weights.collect())) == [(i, len(each), len(each), sum(each) // max(len(each), 1)) for i, each in codes]


def test_odd_rows(spark):
    """Null and repeated doc_ids, repeated rows, ties of score, null and empty texts, a very long text, clashing names."""
    docs = [(1, "a b " * 20), (1, "a b " * 20), (1, "b a " * 20), (None, "a c " * 20), (None, None), (5, ""), (5, ""), (6, None), (7, "word " * 300_000), (8, "x" * 2_000_000)]
    target = [(0, None), (1, ""), (2, "a a a")]
    clashing = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("clash") for c in ("score", "rank", "weight", "bucket", "n", "s", "t", "counts", "n_words", "id", "place", "before")})
    for percent in (10, 50, 100):
        got = importance.resampled(clashing, spark.createDataFrame(target, DOCS), share_percent=percent)
        assert Counter(map(tuple, got.collect())) == brute(docs, target, percent=percent)


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], DOCS), [(1, "a b " * 20)]
    assert importance.resampled(none, none).count() == 0
    got = importance.resampled(spark.createDataFrame(one, DOCS), none, share_percent=100)
    assert Counter(map(tuple, got.collect())) == brute(one, [], percent=100)


def test_drawn_documents_lean_to_the_target(spark):
    """A tenth of the corpus is like the target: nearly all that is drawn is of it, and no document twice."""
    rng = np.random.default_rng(0)
    say = lambda base: " ".join(f"t{base + int(k)}" for k in rng.integers(0, 50, 60))
    docs = spark.createDataFrame([(i, say(0 if i % 10 == 0 else 200)) for i in range(1000)], DOCS)
    target = spark.createDataFrame([(i, say(0)) for i in range(50)], DOCS)
    ids = [r.doc_id for r in importance.drawn_documents(docs, target).collect()]
    assert len(ids) == len(set(ids)) == 100 and sum(i % 10 == 0 for i in ids) >= 95
