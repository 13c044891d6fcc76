"""Language identification with bit-sliced Bloom filters of n-grams.

Learning counts the n-grams (runs of ``size`` bytes of lower-cased text) of each language over all
learning rows: each task adds up what it reads, so a language or source that holds a third of the
rows adds no more rows to the shuffle than another. A language contains the n-grams that make up at
least ``least_share`` of its own, so it has at most 1 / ``least_share`` of them, whatever the corpus; that
is what bounds the model, and a rare language loses nothing to a frequent one. The filters lie side by side: each
slot has a bit for each language, in as many 64-bit words as there are languages for, and the AND of an n-gram's
slots is the set of all languages that contain it.

A text's languages are told by popcounts: the share of its n-grams that a language's filter contains,
corrected for the share that the filter would show by chance, (hits - false) / (1 - false), and what
remains is weighed by how many languages have the n-gram: one that all have tells nothing.

Defined results: null texts, and texts without a letter, are ``und`` with score 0. Rows without a
language, or with a null text, are not learned from; a null doc_id is never held out. Without any learning row
all texts are ``und``. Equal scores go to the language first by code points. Repeated rows each get the same result. Other
columns are not read, and only doc_id, text and lang of learning rows reach the model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import checkpointed, released, small_batches
from .wordvec import SPACE, mix, text_chunks

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_HASHES = 3
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[SPACE] = 0x20
_LETTER_BYTE = np.zeros(256, bool)
_LETTER_BYTE[[*range(65, 91), *range(97, 123)]] = True


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id as text is 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def row_grams(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams as numbers, the row of each); none reaches over two rows, and those of spaces alone count like others."""
    folded = _FOLD[data].astype(np.uint64)
    n = len(folded) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = np.zeros(n, np.uint64)
    for k in range(size):
        grams |= folded[k : k + n] << np.uint64(8 * k)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[:n] == row[size - 1 :]
    return grams[inside], row[:n][inside]


def _counter(size: int):
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        grams, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return grams, np.bincount(which, np.concatenate([p[1] for p in parts]), len(grams)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for low, high, data, offsets in text_chunks(batch.column(1)):
                grams, row = row_grams(data, offsets, size)
                names, which = np.unique(langs[low:high].astype(str), return_inverse=True)
                for k, name in enumerate(names):
                    parts = held.setdefault(str(name), [])
                    parts.append(np.unique(grams[which[row] == k], return_counts=True))
                    if len(parts) > 8:
                        held[str(name)] = [merged(parts)]
        for name, parts in held.items():
            grams, counts = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(counts)], schema=schema)

    return run


class GramFilters:
    """Bit-sliced Bloom filters: ``slots[i]`` has bit l, in word l // 64, where an n-gram of language l goes to slot i."""

    def __init__(self, languages: list[str], grams: list[np.ndarray], slots_log2: int = 20):
        self.languages, self.shift = languages, np.uint64(64 - slots_log2)
        self.slots = np.zeros((1 << slots_log2, max(1, -(-len(languages) // 64))), np.uint64)
        for k, of in enumerate(grams):
            for at in self._slots(of):
                np.bitwise_or.at(self.slots[:, k // 64], at, np.uint64(1 << k % 64))
        #: The share of n-grams that a language's filter would contain by chance.
        self.false = np.array([float(self._bit(self.slots, k).mean()) ** _HASHES for k in range(len(languages))])

    @staticmethod
    def _bit(masks: np.ndarray, k: int) -> np.ndarray:
        return (masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)

    def _slots(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        h = mix(grams.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        for k in range(_HASHES):
            yield (h >> self.shift).astype(np.int64)
            h = h * np.uint64(0xD6E8FEB86659FD93 + 2 * k) + np.uint64(k + 1)

    def members(self, grams: np.ndarray) -> np.ndarray:
        """For each n-gram the bit masks of all languages that contain it."""
        out = np.full((len(grams), self.slots.shape[1]), np.uint64(0xFFFFFFFFFFFFFFFF))
        for at in self._slots(grams):
            out &= self.slots[at]
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
        """A row for each text, a column for each language; 0 to 1, and 0 to 1 in sum."""
        rows, langs = len(offsets) - 1, len(self.languages)
        grams, row = row_grams(data, offsets, size)
        masks = self.members(grams)
        known = np.bitwise_count(masks).sum(axis=1, dtype=np.float64)
        # an n-gram that w of L languages contain counts as 1 - (w - 1) / L
        weight = np.where(known > 0, 1 - (known - 1) / max(langs, 2), 0)
        total = np.maximum(np.bincount(row, minlength=rows), 1).astype(np.float64)
        hits = np.zeros((rows, langs))
        for k in range(langs):
            hits[:, k] = np.bincount(row, self._bit(masks, k) * weight, rows)
        return np.clip((hits / total[:, None] - self.false) / (1 - self.false), 0, 1)


def learn_filters(docs: DataFrame, size: int = 4, least_share: float = 2e-5, slots_log2: int = 20) -> GramFilters:
    """Filters from the text and lang of all rows of ``docs`` that have both and are not held out."""
    rows = small_batches(docs).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(_counter(size), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # totals per language come with the counts: one pass over the texts, and the join's small side has a row a language
    counts = checkpointed(counts)
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return GramFilters([], [], slots_log2)
    languages = sorted(totals)
    # a row a language beside the counts
    sums = F.broadcast(docs.sparkSession.createDataFrame(list(totals.items()), "of string, total long"))
    each = counts.join(sums, F.col("lang") == F.col("of")).where(F.col("n") >= least_share * F.col("total"))
    kept = each.groupBy("lang").agg(F.collect_list("gram").alias("grams")).collect()  # at most 1 / least_share a language
    by = {r["lang"]: np.array(sorted(r["grams"]), np.int64).astype(np.uint64) for r in kept}
    return GramFilters(languages, [by.get(name, np.zeros(0, np.uint64)) for name in languages], slots_log2)


def _predictor(filters, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: GramFilters = filters.value
        for batch in batches:
            names, values = [], []
            for low, high, data, offsets in text_chunks(batch.column(2)):
                scores = model.scores(data, offsets, size)
                letters = np.concatenate(([0], np.cumsum(_LETTER_BYTE[data])))[offsets]
                texts = data.tobytes()
                for i in range(high - low):
                    lettered = letters[i + 1] > letters[i] or bool(_LETTER.search(texts[offsets[i] : offsets[i + 1]].decode("utf-8", "replace")))
                    if not lettered or not model.languages:
                        names.append(UNKNOWN)
                        values.append(0.0)
                    else:
                        best = int(np.argmax(scores[i]))
                        names.append(model.languages[best])
                        values.append(float(scores[i, best]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(values, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])
        released()

    return run


def predict_languages(docs: DataFrame, filters: GramFilters, size: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each row of ``docs``, from its text alone."""
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(filters)  # 8 bytes a slot
    return rows.mapInArrow(_predictor(model, size), "doc_id long, held_out boolean, lang_pred string, score double")


def identify_languages(docs: DataFrame, size: int = 4, least_share: float = 2e-5) -> DataFrame:
    """Learns from the rows that are not held out and predicts all."""
    return predict_languages(docs, learn_filters(docs, size, least_share), size)
