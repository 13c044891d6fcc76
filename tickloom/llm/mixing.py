"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The budget of words is cut into blocks of equal size. Highest quotients (votes / 1, / 3, / 5 ...) give
each source an integer number of blocks, and within the source each group of shards and each shard an integer
quota, so quotas add up exactly. A shard is a seeded hash bucket of a source's documents, about ``shard_words`` words.
Its documents stand in seeded order, and its blocks are numbered along that order. A quota takes all blocks as often
as it can, and of the rest a run of numbers that begins at a seeded block and goes on over the end. So a shard has at most
two documents of which blocks take a part; such a document goes whole or not at all, whichever is nearer, where that moves
the shard by ``border`` of its quota or less. Reruns agree, whatever the partitioning.

Blocks have ``block_words`` words, or fewer (a power of two, down to 1) where the smallest target has fewer than 64 such
blocks, so no source starves by rounding. What is collected to the driver is one row for each source and
each group of a thousand shards; the shards of a group are apportioned in a task. No text is shuffled.

Defined results: null text has size 0 and takes 0. A null source is a source and comes last. Sources
without words have target 0. Repeated rows are documents of their own; ties of the seeded hash go by
doc_id and size. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import WORD_PATTERN, checkpointed, packed, unpacked


def sainte_lague(votes: Sequence[float], seats: int, caps: Sequence[int] | None = None) -> list[int]:
    """Seats by highest quotients vote / (2 * seats so far + 1); ties go to the earlier party; no party goes above its cap.

    The common divisor is found by bisection, so time does not grow with the number of seats; the
    seats that it leaves open, fewer than parties, go by quotient.
    """
    v = np.asarray(votes, float)
    top = np.full(len(v), np.inf) if caps is None else np.asarray(caps, float)
    seats = int(min(seats, top[v > 0].sum())) if (v > 0).any() else 0
    if seats <= 0:
        return [0] * len(v)

    def filled(divisor: float) -> np.ndarray:
        return np.minimum(np.floor(v / divisor + 0.5), top)

    low, high = float(v.max() / (2 * seats + 2)) * 1e-9 + 1e-300, float(2 * v.max() + 1)  # filled(high) has no seats
    for _ in range(200):
        mid = (low * high) ** 0.5
        low, high = (mid, high) if filled(mid).sum() > seats else (low, mid)
    given = filled(high * (1 + 1e-9))
    queue = [(-x / (2 * g + 1), i) for i, (x, g, t) in enumerate(zip(v, given, top)) if g < t and x > 0]
    heapq.heapify(queue)
    for _ in range(int(seats - given.sum())):
        _, i = heapq.heappop(queue)
        given[i] += 1
        if given[i] < top[i]:
            heapq.heappush(queue, (-v[i] / (2 * given[i] + 1), i))
    return [int(x) for x in given]


def capped_targets(sizes: Sequence[int], weights: Sequence[float], most: float = 3.0) -> list[float]:
    """The sum of sizes shared by weight; a share stops at ``most`` times its size and the excess goes to the others by weight."""
    total, targets, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in sorted(open_) if unit * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = unit * weights[i]
            break
        for i in full:
            targets[i] = float(most * sizes[i])
            left -= targets[i]
            open_.discard(i)
    return targets


#: Shards whose quotas are found in one task.
GROUP = 1000


def block_size(targets: Sequence[float], most: int) -> int:
    """The largest power of two, ``most`` at most, of which the smallest target that is not 0 has 64."""
    least, size = min((t for t in targets if t > 0), default=0), 1
    while size * 2 <= most and size * 2 * 64 <= least:
        size *= 2
    return size


def _shard_quotas(most: int, block: int):
    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        n = pdf["shard_size"].tolist()
        seats = sainte_lague(n, int(pdf["blocks"].iloc[0]), [-(-most * x // block) for x in n])
        return pd.DataFrame({"src": pdf["source"], "shard": pdf["shard"], "shard_size": n, "quota": [min(q * block, most * x) for q, x in zip(seats, n)]})

    return each


def _within(begin: Column, size: Column, low: Column, high: Column) -> Column:
    """How many of the words begin .. begin + size are in low .. high."""
    return F.greatest(F.least(begin + size, high) - F.greatest(begin, low), F.lit(0))


def mixed(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: int = 3, block_words: int = 16, shard_words: int = 1_000_000, seed: int = 17, border: float = 0.01) -> DataFrame:
    """doc_id, source, tl_row, size, source_size, target, taken: one row for each row of ``docs``.

    ``weights`` go round over the sources in order of code points, null last. ``tl_row`` is a hash of the
    text that tells apart rows with one doc_id.
    """
    size = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD_PATTERN), F.lit(0))).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tl_row"), size.alias("size"))
    rows = checkpointed(rows.withColumn("tl_seeded", F.xxhash64(F.lit(seed), "doc_id", "tl_row")))
    by_source = rows.groupBy("source").agg(F.sum("size").alias("n")).collect()  # one row a source
    by_source.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["n"] or 0) for r in by_source]
    if not by_source:
        return rows.selectExpr("doc_id", "source", "tl_row", "size", "size as source_size", "0D as target", "0L as taken")
    targets = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], most)
    block = block_size(targets, block_words)
    # as many blocks as the targets make, so that no source exceeds its cap by more than rounding
    blocks = sainte_lague(targets, sum(sizes) // block, [-(-most * s // block) for s in sizes])
    spec = [(r["source"], s, t, max(1, -(-s // shard_words))) for r, s, t in zip(by_source, sizes, targets)]
    spark = docs.sparkSession
    # one row a source: this side's size is known here, on the driver
    sources = F.broadcast(spark.createDataFrame(spec, "src string, source_size long, target double, shards long"))
    rows = rows.join(sources, F.col("source").eqNullSafe(F.col("src"))).drop("src").withColumn("tl_shard", F.pmod(F.xxhash64("tl_seeded", F.lit(1)), F.col("shards")))
    shards = rows.groupBy("source", F.col("tl_shard").alias("shard")).agg(F.sum("size").alias("shard_size")).withColumn("group", F.floor(F.col("shard") / GROUP))
    shards = checkpointed(shards)
    held: dict = {}
    for r in shards.groupBy("source", "group").agg(F.sum("shard_size").alias("n")).collect():  # one row for a thousand shards
        held.setdefault(r["source"], []).append((r["group"], int(r["n"])))
    given = []
    for (source, *_), b in zip(spec, blocks):
        groups = sorted(held.get(source, []))
        given += [(source, k, q) for (k, _), q in zip(groups, sainte_lague([n for _, n in groups], b, [-(-most * n // block) for _, n in groups]))]
    given = F.broadcast(spark.createDataFrame(given, "s string, g long, blocks long"))
    quotas = shards.join(given, F.col("source").eqNullSafe(F.col("s")) & (F.col("group") == F.col("g")))
    quotas = quotas.groupBy("source", "group").applyInPandas(_shard_quotas(most, block), "src string, shard long, shard_size long, quota long")
    few = sum(x[3] for x in spec) <= 100_000
    rows = rows.join(F.broadcast(quotas) if few else quotas, F.col("source").eqNullSafe(F.col("src")) & (F.col("tl_shard") == F.col("shard")))
    order = Window.partitionBy("source", "tl_shard").orderBy("tl_seeded", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n, quota = F.col("shard_size"), F.col("quota")
    rows = rows.withColumns({"tl_at": F.sum("size").over(order) - F.col("size"), "tl_rounds": F.when(n > 0, F.floor(quota / n)).otherwise(F.lit(0)).cast("long")})
    numbered = F.greatest(F.ceil(n / block), F.lit(1))
    rows = rows.withColumns({"tl_low": F.pmod(F.xxhash64(F.lit(seed), "source", "tl_shard"), numbered) * block, "tl_rest": quota - F.col("tl_rounds") * n})
    at, s, high = F.col("tl_at"), F.col("size"), F.col("tl_low") + F.col("tl_rest")
    part = _within(at, s, F.col("tl_low"), F.least(high, n)) + _within(at, s, F.lit(0), high - n)
    rows = rows.withColumn("tl_part", part)
    part = F.col("tl_part")
    near = F.least(part, s - part) <= border * quota
    part = F.when(near, F.when(2 * part >= s, s).otherwise(F.lit(0))).otherwise(part)
    return rows.select("doc_id", "source", "tl_row", "size", "source_size", "target", (F.col("tl_rounds") * s + part).cast("long").alias("taken"))


def mix_digests(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return mixed(docs, **parameters).select("doc_id", "size", "source_size", "target", "taken")


def apply_mix(docs: DataFrame, **parameters) -> DataFrame:
    """The mixture itself, with the columns of ``docs``: a document comes as often as it was taken whole, and once more with its first words where a part is taken.

    The part keeps the text up to its last word; what was not taken goes. Rows with one doc_id, source and text are
    taken together: each comes equally often, and one of them for what that leaves over.
    """
    take = mixed(docs, **parameters).groupBy("doc_id", "source", "tl_row").agg(F.sum("taken").alias("taken"), F.max("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    take = take.where(F.col("taken") > 0).select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("tl_row").alias("k"), "taken", "size", "rows").hint("shuffle_hash")
    same = F.col("tl_doc").eqNullSafe(F.col("d")) & F.col("tl_row.source").cast("string").eqNullSafe(F.col("s")) & (F.col("tl_key") == F.col("k"))
    whole = F.floor(F.col("taken") / F.col("size"))
    rest = (F.col("taken") - whole * F.col("size")).cast("int")
    each, over = F.floor(whole / F.col("rows")).cast("int"), (whole % F.col("rows")).cast("int")
    left = F.concat(F.array_repeat(F.lit(-1), over), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    both = packed(docs).join(take, same).select("tl_row", "d", "s", "k", "rows", F.array_repeat(F.lit(-1), each).alias("each"), left.alias("left"))
    alone = both.select("tl_row", F.explode(F.when(F.col("rows") == 1, F.concat("each", "left")).otherwise(F.col("each"))).alias("part"))
    # of repeated rows one stands for what does not divide; first() is aggregated before anything moves
    shared = both.where((F.col("rows") > 1) & (F.size("left") > 0)).groupBy("d", "s", "k").agg(F.first("tl_row").alias("tl_row"), F.first("left").alias("left"))
    both = alone.unionByName(shared.select("tl_row", F.explode("left").alias("part")))
    # cut by the words' places: a bounded pattern would have to be compiled for each length
    text = F.col("tl_row.text")
    words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return unpacked(both, docs, text=F.when(F.col("part") < 0, text).otherwise(F.array_join(F.slice(words, 1, F.greatest("part", F.lit(0))), "")))
