"""Byte-pair encoding and decoding as streaming transducers.

Encoding goes once over a piece of text, symbol by symbol. For each prefix it keeps one number, the
last token of that prefix's encoding: the tokens before it are the encoding of a shorter prefix,
since a sequence of tokens is what the merge list makes of a text exactly when every two neighbours
are what it makes of the two. Whether two tokens can be neighbours follows from undoing their merges,
latest first. The longest token of the merge list bounds how far back a later token can begin; that is
the sufficient lookahead. As soon as the encodings of all prefixes that a later token can follow have
their first tokens in common, those tokens are stable and leave the transducer, so its memory does not
grow with the piece.

Decoding is a state machine as well, fed id by id. What a file without a decoder asks for is the tokens with
a space between each two: the machine's state is whether a token went before. For readable text the bytes of
tokens go through an incremental UTF-8 decoder, which holds an unfinished character until its last byte comes.

A text is cut at spaces into segments, since no piece holds one, and each segment's tokens go straight on to
the decoder and the digests: beside the text itself, what is held is one segment, or one run without spaces.

The tokenizer file's path is a parameter; the driver reads it and broadcasts it (about 2 MB).

Defined results: null text counts as empty, and empty texts have no tokens. Each row gives a row,
whatever its doc_id. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import released, small_batches

SUFFIX = "</w>"
#: Contractions, runs of letters, single digits, runs of other marks (fixed values of the tokenizer file).
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_NEVER = 1 << 30
#: Pieces of more characters are not remembered.
_SHORT = 48


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others for 256, 257 ..."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class MergeList:
    """A vocabulary with its merges, and what follows from them."""

    def __init__(self, content: bytes):
        file = json.loads(content)
        vocab: dict[str, int] = file["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.tokens: list[str] = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in (vocab | self.special).items():
            self.tokens[i] = token
        self.spaced = [" " + token for token in self.tokens]
        self.pairs: dict[tuple[int, int], int] = {}
        self.rank, self.left, self.right = {}, {}, {}
        for rank, pair in enumerate(file["model"]["merges"]):
            a, b = (pair.split(" ") if isinstance(pair, str) else pair)
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self.pairs.setdefault((i, j), rank)
            if k not in self.rank:
                self.rank[k], self.left[k], self.right[k] = rank, i, j
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        for token, i in vocab.items():
            if i not in self.rank or self._can_stand(self.left[i], self.right[i], self.rank[i]):
                (self.final if token.endswith(SUFFIX) and token != SUFFIX else self.inner)[token.removesuffix(SUFFIX)] = i
        self.inner_lookahead = max(map(len, self.inner))
        self.final_lookahead = max(map(len, self.final))
        #: No token is longer, so nothing before this many symbols can change what a next token follows.
        self.lookahead = max(self.inner_lookahead, self.final_lookahead)

    def _can_stand(self, a: int, b: int, limit: int = _NEVER) -> bool:
        """Whether a and b stay apart until the merge of rank ``limit``: their merges are undone, latest first, and none of the pairs at the border merges earlier."""
        rank = self.rank
        while True:
            if self.pairs.get((a, b), _NEVER) < limit:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, self.right[a]
            else:  # of two equal merges the left one comes first
                limit, b = rb + 1, self.left[b]

    def fits(self, a: int, b: int) -> bool:
        """Whether the merge list makes tokens a, b of their joint text."""
        key = (a, b)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 200_000:
                self._fits.clear()
            known = self._fits[key] = self._can_stand(a, b)
        return known

    def encode_piece(self, symbols: str) -> list[int]:
        """The tokens of one piece, given as byte symbols. A short piece goes through the transducer's steps without leaving any token early."""
        n = len(symbols)
        if n >= 8 * self.lookahead:
            return [token for stable in self.stream_piece(symbols) for token in stable]
        whole = self.final.get(symbols)
        if whole is not None:
            return [whole]
        seen, last, reach = self._fits.get, [-1], self.inner_lookahead
        find = self.inner.get
        for end in range(1, n + 1):
            if end == n:
                find, reach = self.final.get, self.final_lookahead
            for begin in range(max(0, end - reach), end):
                token = find(symbols[begin:end])
                if token is not None:
                    if not begin:
                        break
                    known = seen((last[begin], token))
                    if self.fits(last[begin], token) if known is None else known:
                        break
            else:
                raise ValueError(f"the vocabulary has no token for {symbols!r}")
            last.append(token)
        return self._back(last, n)

    def stream_piece(self, symbols: Iterable[str]) -> Iterator[list[int]]:
        """Yields tokens once they are stable. ``symbols`` can be any iterator of single symbols; what is held does not grow with it."""
        inner, final, fits, reach = self.inner, self.final, self.fits, self.inner_lookahead
        held, last = "", [-1]  # held: the symbols since the last stable border; last[i]: the last token of held[:i]
        before = -1  # the last token that has left
        source = iter(symbols)
        symbol = next(source, None)
        while symbol is not None:
            following = next(source, None)
            held += symbol
            n = len(held)
            table, most = (inner, reach) if following is not None else (final, self.final_lookahead)
            for begin in range(max(0, n - most), n):
                token = table.get(held[begin:])
                if token is not None and (fits(last[begin], token) if begin else before < 0 or fits(before, token)):
                    last.append(token)
                    break
            else:
                raise ValueError(f"the vocabulary has no token for {held!r}")
            symbol = following
            if n >= 8 * self.lookahead:
                border, stable = self._stable(last, n)
                if border:
                    yield stable
                    before, held = stable[-1], held[border:]
                    last = [-1, *last[border + 1 :]]
        if held:
            yield self._back(last, len(held))

    def _length(self, token: int) -> int:
        return len(self.tokens[token].removesuffix(SUFFIX))

    def _back(self, last: list[int], at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(last[at])
            at -= self._length(last[at])
        return out[::-1]

    def _stable(self, last: list[int], n: int) -> tuple[int, list[int]]:
        """The last border that the encodings of all prefixes that a later token can follow have in common, and the tokens up to it."""
        common: set[int] | None = None
        for at in range(n - self.lookahead + 1, n + 1):
            borders = {at}
            while at > 0:
                at -= self._length(last[at])
                borders.add(at)
            common = borders if common is None else common & borders
        border = max(common)
        return border, self._back(last, border)


class Tokenizer:
    """A merge list with the normalisation, the pieces and the special tokens of its file.

    Short pieces are remembered in two generations of at most ``most_remembered``, so what is held is bounded in bytes too.
    """

    def __init__(self, content: bytes, most_remembered: int = 300_000):
        self.merges = MergeList(content)
        self._symbols = dict(enumerate(byte_symbols()))
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.merges.special, key=len, reverse=True))) + ")") if self.merges.special else None
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._most = most_remembered

    def _pieces(self, text: str) -> list[str]:
        if text.isascii():
            return _ASCII_PIECES.findall(text.lower())
        return _PIECES.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _ids(self, piece: str) -> bytes:
        """The ids of a piece that is not among the young ones."""
        ids = self._old.get(piece)
        if ids is None:
            symbols = piece if piece.isascii() and piece.isalnum() else piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self._symbols)
            ids = array("I", self.merges.encode_piece(symbols)).tobytes()
        if len(piece) <= _SHORT:
            if len(self._young) >= self._most:
                self._old, self._young = self._young, {}
            self._young[piece] = ids
        return ids

    def stream(self, text: str) -> Iterator[bytes]:
        """The ids as little-endian unsigned 32-bit integers, segment by segment."""
        for segment in segments(text):
            if self._special is None or "<|" not in segment:
                yield self._plain(segment)
                continue
            for i, part in enumerate(self._special.split(segment)):
                yield array("I", [self.merges.special[part]]).tobytes() if i % 2 else self._plain(part)

    def encode(self, text: str) -> bytes:
        """All ids of a text."""
        return b"".join(self.stream(text))

    def _plain(self, text: str) -> bytes:
        young, ids = self._young, self._ids
        return b"".join([young.get(p) or ids(p) for p in self._pieces(text)])

    def joined_decoder(self) -> "JoinedDecoder":
        return JoinedDecoder(self.merges)

    def text_decoder(self) -> "TextDecoder":
        return TextDecoder(self.merges)


def segments(text: str, size: int = 1 << 16) -> Iterator[str]:
    """The text in parts of about ``size`` characters, each ended by a space or line feed or by the text's end."""
    start = 0
    while len(text) - start > size:
        end = max(text.rfind(" ", start, start + size), text.rfind("\n", start, start + size))
        if end < 0:  # a long run without spaces stays whole
            later = [x for x in (text.find(" ", start + size), text.find("\n", start + size)) if x >= 0]
            end = min(later, default=len(text) - 1)
        yield text[start : end + 1]
        start = end + 1
    if start < len(text):
        yield text[start:]


class JoinedDecoder:
    """Ids to the tokens with a space between each two. The state is whether a token went before; each id is one step through a table."""

    def __init__(self, merges: MergeList):
        self._begun, self._first, self._later = False, merges.tokens, merges.spaced

    def feed(self, ids: Iterable[int]) -> str:
        """What the ids add to the text."""
        out = ""
        if not self._begun:
            ids = iter(ids)
            for token_id in ids:
                self._begun, out = True, self._first[token_id]
                break
        return out + "".join(map(self._later.__getitem__, ids))


class TextDecoder:
    """Ids to text, one by one: token bytes go through an incremental UTF-8 decoder, a word's end gives a space, special tokens stand for themselves."""

    def __init__(self, merges: MergeList):
        self._merges, self._utf8 = merges, codecs.getincrementaldecoder("utf-8")("replace")
        self._bytes = {s: b for b, s in enumerate(byte_symbols())}
        self._special = set(merges.special.values())

    def feed(self, token_id: int) -> str:
        token = self._merges.tokens[token_id]
        if token_id in self._special:
            return self._utf8.decode(b"", True) + token
        body = token.removesuffix(SUFFIX)
        ended = len(body) < len(token)
        return self._utf8.decode(bytes(self._bytes[c] for c in body), False) + (" " if ended else "")

    def finish(self) -> str:
        return self._utf8.decode(b"", True)


_loaded: dict[str, Tokenizer] = {}


def _tokenizer(content) -> Tokenizer:
    """One for each worker process and file."""
    key = hashlib.sha256(content.value).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Tokenizer(content.value)
    return _loaded[key]


def _broadcast(df: DataFrame, path: str):
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` rows as doc_id, n_tokens, ids (array of int)."""
    content = _broadcast(small_batches(docs), path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(content)
        for batch in batches:
            ids = [np.frombuffer(tokenizer.encode(t or ""), "<u4").astype(np.int32) for t in batch.column(1).to_pylist()]
            sizes = np.array([len(x) for x in ids], np.int64)
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), lists], ["doc_id", "n_tokens", "ids"])
        released()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows with ids: letters in lower case, a space after each piece, as the vocabulary keeps them."""
    content = _broadcast(small_batches(encoded), path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(content)
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                decoder = tokenizer.text_decoder()
                texts.append("".join([decoder.feed(i) for i in ids or []]) + decoder.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row for each row of ``docs``, decoded from its ids."""
    content = _broadcast(small_batches(docs), path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(content)
        for batch in batches:
            sizes, shas, texts = [], [], []
            for text in batch.column(1):
                size, of_ids, of_text, decoder = 0, hashlib.sha256(), hashlib.sha256(), tokenizer.joined_decoder()
                for ids in tokenizer.stream(text.as_py() or ""):
                    size += len(ids) // 4
                    of_ids.update(ids)
                    of_text.update(decoder.feed(memoryview(ids).cast("I")).encode())
                sizes.append(size)
                shas.append(of_ids.hexdigest())
                texts.append(of_text.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        released()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
