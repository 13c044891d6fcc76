"""Fingerprints against a window-by-window version, and neighbours against a plain sort."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import fingerprints as fp

DOCS = "doc_id long, text string"
POWER = [round(n * math.log2(max(n, 1)) * (1 << 20)) for n in range(33)]


def level(window: bytes) -> int:
    return 1000 * (POWER[32] - sum(POWER[n] for n in Counter(window).values())) // POWER[32]


def windows(text: bytes) -> list[bytes]:
    return [text[i : i + 32] for i in range(len(text) - 31)]


def brute_ranks(texts) -> list[int]:
    seen = Counter(level(w) for t in texts for w in windows(t))
    order = sorted(range(1001), key=lambda k: (seen[k], k))
    return [order.index(k) for k in range(1001)]


def brute_fingerprint(text: bytes, ranks) -> fp.Fingerprint:
    levels = [level(w) for w in windows(text)]
    points = Counter()
    for low in range(-63, len(levels)):
        inside = [(ranks[levels[i]], i) for i in range(max(low, 0), min(low + 64, len(levels))) if levels[i] >= 100]
        if inside:
            points[min(inside)[1]] += 1
    chosen = sorted(i for i, n in points.items() if n >= 16)
    data = np.frombuffer(text, np.uint8)
    hashes = [int(h) for h in fp._window_hashes(data, np.array(chosen))] if chosen else []
    if not hashes and text:
        hashes = [int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")]
    hashes = list(dict.fromkeys(hashes))
    chain = [np.zeros(2048, bool) for _ in range(-(-len(hashes) // 160))]
    for k, h in enumerate(hashes):
        for j in range(5):
            chain[k // 160][(h >> 11 * j) % 2048] = True
    return fp.Fingerprint(len(hashes), np.packbits(np.array(chain, bool).reshape(-1, 2048), axis=1))


def drawn(seed: int, n: int = 40) -> list[tuple]:
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdefghijklmnoprstuvwyz") for _ in range(rng.randint(2, 9))) for _ in range(300)] + ["É", "日本語", "straße", "😀"]
    say = lambda k: " ".join(rng.choice(pool) for _ in range(k))
    texts = [say(rng.choice([1, 4, 6, 7, 20, 80, 300])) for _ in range(n)] + ["a" * 500, "ab" * 300, "x", "É" * 31, say(1500)]
    texts += [texts[0], texts[20], texts[20] + " more", None, ""]
    rng.shuffle(texts)
    ids = rng.sample(range(-50, 10_000), len(texts))
    return list(zip(ids, texts))


def brute_rows(docs) -> Counter:
    texts = [(t or "").encode() for _, t in docs]
    ranks = brute_ranks(texts)
    order = sorted(docs, key=lambda d: -d[0])
    out = Counter()
    for k, (i, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        a, b, c = (brute_fingerprint(t.encode(), ranks) for t in (text, changed, following))
        out[(i, len(text), hashlib.sha256(changed.encode()).hexdigest(), str(a), str(b), round(fp.likeness(a, b), 9), round(fp.likeness(a, c), 9))] += 1
    return out


def said(df) -> Counter:
    return Counter((*r[:5], round(r[5], 9), round(r[6], 9)) for r in df.collect())


@pytest.mark.parametrize("seed, buckets", [(0, None), (1, 1), (2, 40)])
def test_rows_against_brute_force(spark, seed, buckets):
    docs = drawn(seed)
    assert said(fp.fingerprint_digests(spark.createDataFrame(docs, DOCS).repartition(5), buckets)) == brute_rows(docs)


def test_pieces_do_not_show(monkeypatch):
    rng = np.random.default_rng(0)
    text = rng.integers(97, 123, 60_000).astype(np.uint8).tobytes()
    ranks = rng.permutation(1001)
    whole = fp.fingerprints_of([text[:70], text, b"", text[5:900]], ranks)
    monkeypatch.setattr(fp, "_PIECE", 1000)
    assert list(map(str, whole)) == list(map(str, fp.fingerprints_of([text[:70], text, b"", text[5:900]], ranks)))


def test_entropies_are_counted_within_texts(spark, monkeypatch):
    docs = drawn(5)
    monkeypatch.setattr(fp, "_PIECE", 100)
    got = {r.level: r.n for r in fp.entropy_counts(spark.createDataFrame(docs, DOCS).coalesce(1)).collect()}
    assert got == Counter(level(w) for _, t in docs for w in windows((t or "").encode()))


def test_likeness():
    rng = random.Random(3)
    pool = ["".join(rng.choice("abcdefghijklmnoprstuvwyz") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    say = lambda k: " ".join(rng.choice(pool) for _ in range(k))
    ranks = np.array(brute_ranks([say(2000).encode()]))
    one = lambda t: fp.fingerprints_of([t.encode()], ranks)[0]
    for size in (60, 400, 3000, 9000):
        a, b = say(size), say(size)
        words = a.split(" ")
        for k in range(0, size, 50):
            words[k] = "changed"
        assert fp.likeness(one(a), one(a)) == 1.0 and fp.likeness(one(a), one(b)) < 0.02
        assert fp.likeness(one(a), one(" ".join(words))) > 0.6
        assert 0.35 < fp.likeness(one(a), one(a[: len(a) // 2] + b[len(b) // 2 :])) < 0.65
        assert fp.likeness(one(a), one(b + " " + a)) > 0.85  # the place of a passage does not matter
    empty = one("")
    assert fp.likeness(empty, empty) == 1.0 and fp.likeness(empty, one("a")) == 0.0 and fp.likeness(one("a" * 99), one("b" * 99)) == 0.0
    written = one(say(5000))
    assert fp.likeness(fp.Fingerprint.read(str(written)), written) == 1.0 and len(written.filters) > 1


def test_odd_rows(spark):
    """Null and repeated doc_ids, repeated rows, null and empty texts, a very long text, clashing names."""
    docs = [(1, "x y z " * 20), (1, "x y z " * 20), (1, "other"), (None, "x  y"), (None, None), (None, "x  y"), (5, ""), (5, ""), (7, "lorem ipsum " * 200_000), (-(1 << 63), "least")]
    df = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("clash") for c in ("bucket", "guest", "at", "key", "to", "host", "head", "level", "n", "tl_at", "tl_bucket")})
    for buckets in (1, 3, 16):
        got = fp.fingerprint_digests(df, buckets).collect()
        assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((i, len(t or "")) for i, t in docs)
        seven = next(r for r in got if r.doc_id == 7)
        assert seven.edited_sha256 == hashlib.sha256(("lorem ipsum " * 100_000).encode()).hexdigest()  # the next text is empty
        fives = [r for r in got if r.doc_id == 5]
        assert len({r.fingerprint for r in fives}) == 1 and sorted(r.near_next for r in fives) == [0.0, 1.0]


def test_empty_and_lone(spark):
    assert fp.fingerprint_digests(spark.createDataFrame([], DOCS)).count() == 0
    text = "one lone row is its own neighbour, so its first half comes twice"
    assert said(fp.fingerprint_digests(spark.createDataFrame([(3, text)], DOCS))) == brute_rows([(3, text)])


def test_fingerprints_alone(spark):
    docs = drawn(9)
    df = spark.createDataFrame(docs, DOCS)
    ranks = fp.rarity_ranks(fp.entropy_counts(df))
    got = {r.doc_id: r.fingerprint for r in fp.document_fingerprints(df, ranks).collect()}
    assert got == {i: str(brute_fingerprint((t or "").encode(), ranks)) for i, t in docs}
    assert got == {r.doc_id: r.fingerprint for r in fp.fingerprint_digests(df).collect()}


def test_every_document_of_the_table(spark):
    """Neighbours, texts and likenesses over a whole table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in fp.fingerprint_digests(docs).collect()}
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        changed = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        a, b, c = got[i].fingerprint, got[i].edited_fingerprint, got[rows[(k + 1) % len(rows)][0]].fingerprint
        assert got[i].near_edited == fp.likeness(fp.Fingerprint.read(a), fp.Fingerprint.read(b)) and got[i].near_next == fp.likeness(fp.Fingerprint.read(a), fp.Fingerprint.read(c))
    apart = [r for r in got.values() if r.n_chars > 200 and r.near_next < 0.5]
    assert sum(r.near_edited > r.near_next for r in apart) > 0.99 * len(apart)
