"""The transducers against the tokenizers library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from tickloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as file:
        return Library.from_file(PATH), bpe.Tokenizer(file.read())


def texts(seed: int = 0) -> list[str]:
    rng = random.Random(seed)
    letters = "abcdeilnorstuthe'’ÉéÀß中文字🙂́ \n\t01٣Σςσ<|endoftext|>#$İ\x1c\x85\xa0​"
    out = ["", " ", "x<|endoftext|>Y<|startoftext|>", "ΑΣ Σ", "it's we'll 'string", "a" * 3000, "ab" * 2000, "!" * 700, "é" * 900]
    out += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    out += ["".join(rng.choice(a) for _ in range(4000)) for a in ("abcdefghijklmnopqrstuvwxyz", "lo", "=-_*", "eé")]
    return out


def test_ids_and_decoded(both):
    library, own = both
    for text in texts():
        want = library.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(own.encode(text), "<u4").tolist()
        assert got == want, text[:50]
        decoder = own.joined_decoder()
        assert "".join(decoder.feed([i]) for i in got) == library.decode(want, skip_special_tokens=False)


def test_segments_and_forgetting_change_nothing(both):
    library = both[0]
    with open(PATH, "rb") as file:
        own = bpe.Tokenizer(file.read(), most_remembered=5)
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdeé日'1<|>") for _ in range(rng.randint(1, 9))) + rng.choice(["", "\n", "\t<|endoftext|>"]) for _ in range(40_000)) + "x" * 200_000 + " end"
    parts = list(bpe.segments(text))
    assert "".join(parts) == text and len(parts) > 3 and max(map(len, parts[:-2])) <= 1 << 16
    want, decoder = library.encode(text, add_special_tokens=False).ids, own.joined_decoder()
    got = [np.frombuffer(x, "<u4").tolist() for x in own.stream(text)]
    assert sum(got, []) == want and "".join(map(decoder.feed, got)) == library.decode(want, skip_special_tokens=False)
    assert len(own._young) <= 5 and len(own._old) <= 5


def test_digests_of_the_whole_table(spark, both):
    """Each column of the query against the library, text by text."""
    library = both[0]
    rows = [(i, t) for i, t in enumerate(texts(1)[:300])] + [(1000, None)]
    rows += [(r.doc_id + 2000, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in bpe.bpe_digests(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        r = got[i]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_stable_tokens_leave_early(both):
    merges = both[1].merges
    held, out = 0, []

    def symbols():
        nonlocal held
        for i in range(20_000):
            held = i
            yield "abcdefgh"[i * i % 8]

    seen = []
    for part in merges.stream_piece(symbols()):
        out += part
        seen.append(held - sum(merges._length(t) for t in out))
    assert out == merges.encode_piece("".join("abcdefgh"[i * i % 8] for i in range(20_000)))
    assert max(seen) < 20 * merges.lookahead and len(seen) > 10  # what is held does not grow


def test_decoder_holds_unfinished_characters(both):
    own = both[1]
    for text in ("日本 été", "🙂 ok", "naïve café"):
        ids = np.frombuffer(own.encode(text), "<u4").tolist()
        d = own.text_decoder()
        assert ("".join(map(d.feed, ids)) + d.finish()).split() == text.lower().split()


def test_over_tables(spark, both):
    rows = [(1, "Hello world"), (1, "Hello world"), (None, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as n_tokens")
    got = bpe.bpe_digests(df, PATH).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == 4 and [(r.n_tokens, r.ids_sha256) for r in got if r.doc_id != 1] == [(0, empty)] * 2
    encoded = bpe.bpe_encode(df, PATH)
    assert sorted((str(r.doc_id), r.n_tokens, len(r.ids)) for r in encoded.collect()) == [("1", 2, 2), ("1", 2, 2), ("3", 0, 0), ("None", 0, 0)]
    assert {r.text for r in bpe.bpe_decode(encoded, PATH).collect()} == {"hello world ", ""}
    assert bpe.bpe_digests(df.limit(0), PATH).count() == 0
