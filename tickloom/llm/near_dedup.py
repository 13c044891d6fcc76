"""Near-duplicate detection by a chosen-path set similarity join, and the components of its links.

A document's set is its different shingles of ``shingle`` words. Documents with equal sets are one
class, found by a digest of the whole set, and only classes are joined. In each of ``trees``
independent trees a node chooses one of the classes' minwise tokens, with probability
1 / threshold - 1 a second one, and each class goes to the child named by its own token there. Two
sets that are as similar as the threshold share one child of a node on average, so however deep a tree
goes such a pair is not thinned out, while unlike sets part. Nodes of at most ``leaf`` classes are
compared exhaustively: a 128-bit sketch clears away pairs that are far below the threshold, and the
others are confirmed on their full sets, built anew from whole texts. Pairs that a node's links have
connected already are not compared again, so a group of near copies costs comparisons in proportion
to its size, and a node returns at most one link a class. Equal clusters of several trees are
compared once.

A larger node that has more than half of its parent's classes, or that is still larger at the deepest level,
holds classes that are like each other: a crowd, which going down would only repeat level by level. It is dealt
to parts of ``part`` classes, another deal in each tree, each part with the node's ``pivots`` in it,
so whatever is like a pivot is linked. What that leaves apart is then joined exactly, by prefix filters
over the full sets of all classes in such nodes: with shingles in order of rarity, the smaller set of a
linked pair has one of its first shingles among the first of the larger. Classes that meet at a shingle
are compared unless links connect them already; more than ``leaf`` of them go as pairs of blocks of about
``part``, each pair of blocks a group of its own, so none is left out and no task holds many more than
``2 * part``; shingles of one crowd are taken together, so its classes meet once and not at each. A crowd whose pairs lie below the threshold has its first shingles to itself, so it costs
few comparisons.

Recall: a pair at the threshold meets in a tree with probability 0.87 (one level) to 0.6 (five), so
ten trees lose at most one such pair in ten thousand; pairs above it are lost far less often.

Defined results: null and empty texts have no shingles and are linked with nothing. A null doc_id is
larger than any other; a component of null doc_ids alone has a null component_id. Rows with equal
doc_ids each give a row. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import checkpointed, packed, released, row_key, small_batches, unpacked
from .wordvec import Words, mix, text_chunks, window_hashes

_TOKENS = 64  # minwise tokens for a sketch; two bits of each
_BRANCH = 32  # of them, tokens that nodes can choose
_FILTER_BITS = 1 << 20, 1 << 27  # the least and most bits of a filter that is broadcast: 16 MB at most
_LOST = 1e-5  # share of the pairs at the threshold whose sketches may be taken for far ones
_SEEDS = mix(np.arange(1, 2 * _TOKENS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SKETCH = "doc_id long, key long, n_shingles long, digest binary, sk1 long, sk2 long, tokens array<int>"


def shingle_sets(words: Words, shingle: int) -> list[np.ndarray]:
    """The sorted different shingle hashes of each row."""
    h, out = words.hashes(), []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= shingle:
            out.append(np.unique(window_hashes(h[a:b], shingle)))
        else:  # the whole sequence is the one shingle
            out.append(window_hashes(h[a:b], b - a, 99) if b > a else h[:0])
    return out


def _sketched(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, parts = [], [], []
            for low, high, data, offsets in text_chunks(batch.column(2)):
                sets = shingle_sets(Words(data, offsets, lower=True), shingle)
                lengths = np.array([len(s) for s in sets], np.int64)
                least = np.full((_TOKENS, len(sets)), np.uint64(0xFFFFFFFFFFFFFFFF))
                full = np.flatnonzero(lengths)
                if len(full):
                    every = np.concatenate(sets)
                    begins = (np.cumsum(lengths) - lengths)[full]
                    for i in range(_TOKENS):
                        least[i, full] = np.minimum.reduceat((every ^ _SEEDS[2 * i]) * (_SEEDS[2 * i + 1] | np.uint64(1)), begins)
                parts.append(mix(least))
                sizes += lengths.tolist()
                digests += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            tokens = np.concatenate(parts, axis=1) if parts else np.zeros((_TOKENS, 0), np.uint64)
            bits = tokens & np.uint64(3)
            places = (np.arange(_TOKENS // 2, dtype=np.uint64) * np.uint64(2))[:, None]
            sk = [np.bitwise_or.reduce(half << places, axis=0).astype(np.int64) for half in (bits[: _TOKENS // 2], bits[_TOKENS // 2 :])]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, tokens.shape[1] * _BRANCH + 1, _BRANCH, dtype=np.int32)), pa.array((tokens[:_BRANCH] >> np.uint64(32)).T.astype(np.uint32).view(np.int32).reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sk[0]), pa.array(sk[1]), lists], ["doc_id", "key", "n_shingles", "digest", "sk1", "sk2", "tokens"])
        released()

    return run


def _children(threshold: float, trees: int, node: Column | None) -> Column:
    """The children of a node, or of all roots, that a class goes to. Which tokens a node chooses depends on the node alone."""

    def chosen(of: Column) -> list[Column]:
        def child(k: int) -> Column:
            at = F.pmod(F.xxhash64(of, F.lit(k)), F.lit(_BRANCH)).cast("int")
            return F.xxhash64(of, at, F.get("tokens", at))

        second = F.pmod(F.xxhash64(of, F.lit(-1)), F.lit(1_000_000)) < int((1 / threshold - 1) * 1_000_000)
        return [child(1), F.when(second, child(2))]

    if node is not None:
        return F.array_distinct(F.filter(F.array(*chosen(node)), lambda x: x.isNotNull()))
    # roots take each token in turn, so no two trees begin alike
    first = [F.xxhash64(F.lit(t), F.get("tokens", F.lit(t % _BRANCH))) for t in range(trees)]
    more = [F.xxhash64(F.lit(trees + t), F.get("tokens", F.lit((trees + t) % _BRANCH))) for t in range(int(trees * (1 / threshold - 1)) + 1)]
    return F.array(*first, *more)


def far_places(percent: int) -> int:
    """The most places in which sketches of a pair at the threshold differ, but for one pair in a hundred thousand: a place differs with probability 3/4 of what the sets do not share."""
    p, tail = 0.75 * (1 - percent / 100), 0.0
    for k in range(_TOKENS, 0, -1):
        tail += math.comb(_TOKENS, k) * p**k * (1 - p) ** (_TOKENS - k)
        if tail > _LOST:
            return k
    return 0


def _far(sk1: np.ndarray, sk2: np.ndarray, i: int) -> np.ndarray:
    """In how many of the sketch's places each row differs from row i."""
    odd = np.uint64(0x5555555555555555)
    out = np.zeros(len(sk1), np.int64)
    for sk in (sk1, sk2):
        x = sk ^ sk[i]
        out += np.bitwise_count((x | (x >> np.uint64(1))) & odd)
    return out


def _by_key(handle, schema: pa.Schema):
    """Streams rows sorted by their first column, and hands over the rows of each value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, out = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and row[0] != at:
                    out += handle(rows)
                    rows = []
                at = row[0]
                rows.append(row)
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if rows:
            out += handle(rows)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


_CLUSTER = pa.schema([("cluster", pa.binary()), ("digest", pa.binary()), ("sk1", pa.int64()), ("sk2", pa.int64())])
_LINK = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _clusters(percent: int):
    """Of a node's classes, the groups that sketches and sizes leave connected. Where rows tell their component and whether they are indexed, only pairs of two components with an indexed class count."""

    most = far_places(percent)

    def handle(rows: list[tuple]) -> list[tuple]:
        seen = {r[1]: r for r in rows}
        if len(seen) < 2:
            return []
        rows = list(seen.values())
        n = np.array([r[2] for r in rows], np.int64)
        sk1, sk2 = (np.array([r[k] for r in rows], np.int64).view(np.uint64) for k in (3, 4))
        label = np.arange(len(rows))
        exact = len(rows[0]) > 5
        if exact:
            component = np.unique(np.array([r[5].hex() for r in rows]), return_inverse=True)[1].reshape(-1)
            indexed = np.array([r[6] for r in rows], bool)
        for i in range(1, len(rows)):
            near = (_far(sk1, sk2, i) <= most) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
            near[i + 1 :] = False
            if exact:
                near &= (component != component[i]) & (indexed | indexed[i])
            near[i] = True
            for x in np.unique(label[near]):
                label[label == x] = i
        out = []
        for x in np.unique(label):
            of = np.flatnonzero(label == x)
            if len(of) > 1:
                name = hashlib.blake2b(b"".join(sorted(rows[i][1] for i in of)), digest_size=16).digest()
                out += [(name, rows[i][1], rows[i][3], rows[i][4]) for i in of]
        return out

    return handle


def intersections(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many shingles each two of the sets share: products of the incidence of shingles that more than one set has, some columns at a time."""
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shingles, which, often = np.unique(every, return_inverse=True, return_counts=True)
    which = which.reshape(-1)
    shared = often[which] > 1
    place = np.cumsum(often > 1) - 1
    owner, column = owner[shared], place[which[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        of = slice(*np.searchsorted(column, (low, low + columns)))
        there = np.zeros((len(sets), columns), np.float32)
        there[owner[of], column[of] - low] = 1
        out += (there @ there.T).astype(np.int64)  # at most ``columns``, so exact
    return out


def _linked(percent: int, shingle: int):
    """Links of a cluster, confirmed on full sets: at most one a class."""

    def handle(rows: list[tuple]) -> list[tuple]:
        rows = list({r[1]: r for r in rows}.values())
        sets = []
        for low, high, data, offsets in text_chunks(pa.array([r[4] for r in rows], pa.large_string())):
            sets += shingle_sets(Words(data, offsets, lower=True), shingle)
        n = np.array([len(s) for s in sets], np.int64)
        both = intersections(sets)
        like = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        label, links = np.arange(len(rows)), []
        for i in range(1, len(rows)):
            near = np.flatnonzero(like[i, :i])
            for j in near[np.unique(label[near], return_index=True)[1]].tolist():  # one of each component so far
                links.append((rows[j][1], rows[i][1]))
                label[label == label[j]] = i
        return links

    return handle


def _forest(most: int):
    """The links of one task as stars, each node to the least one it reaches there. After ``most`` nodes the task starts anew, so memory is bounded; stars that should be one meet later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        def stars(kinds: pa.Schema) -> pa.RecordBatch:
            pairs = [(x, r) for x in root if (r := find(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], kinds.field(k).type) for k in (0, 1)], ["u", "v"])

        kinds = None
        for batch in batches:
            kinds = batch.schema
            for a, b in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
            if len(root) > most:
                yield stars(kinds)
                root.clear()
        if root:
            yield stars(kinds)

    return run


def components(links: DataFrame, most_rounds: int = 60, task_links: int = 250_000) -> DataFrame:
    """node, root for each end of a link: the least node of its component.

    The links, about ``task_links`` a task, first become a forest of stars in each task; then large-star and small-star steps in turn, each kept in the
    checkpoint folder, until a round changes nothing. A node with very many neighbours is a group of rows that only minima and skew joins see.
    """
    links = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"))
    kind = links.schema["u"].dataType.simpleString()
    tasks = max(1, -(-links.count() // task_links))
    edges = checkpointed(links.coalesce(tasks).mapInArrow(_forest(2 * task_links), f"u {kind}, v {kind}"))

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    before = mark(edges)
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # one edge for each edge at most, so what is equal waits for the small step
        large = checkpointed(both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = checkpointed(small)
        now = mark(edges)
        if now == before:
            roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        before = now
    raise RuntimeError("components did not settle")


def _sifted(rows: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """The rows whose ``keys`` are a row of ``wanted``, all of them, and about one in nine others: what an exact join on the keys then has to shuffle.

    A filter of eight bits a wanted row, in bitmaps of 4 KB, is broadcast to the scan of ``rows``. It stops growing at 16 million wanted rows; with more, more
    others pass. ``wanted`` is read twice, so it should be checkpointed; its columns are those of ``keys`` in order.
    """
    least, most = _FILTER_BITS
    bits = min(most, max(least, 1 << (8 * wanted.count()).bit_length()))
    place = lambda names: F.pmod(F.xxhash64(*[F.col(n) for n in names]), F.lit(bits).cast("long"))
    # dealt by bitmap first, or each task would send every bitmap
    marks = wanted.select(place(wanted.columns).alias("place")).select("place", F.bitmap_bucket_number("place").alias("bitmap")).repartition("bitmap")
    bitmaps = marks.groupBy("bitmap").agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("marked"))
    at = F.bitmap_bit_position("place").cast("int")
    byte = F.conv(F.hex(F.substring("marked", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    placed = rows.withColumn("place", place(keys)).withColumn("bitmap", F.bitmap_bucket_number("place"))
    return placed.join(F.broadcast(bitmaps), "bitmap").where(F.getbit(byte, at % 8) == 1).select(*rows.columns)


def near_duplicate_links(classes: DataFrame, texts: DataFrame, percent: int, shingle: int, trees: int = 10, leaf: int = 1000, depth: int = 5, part: int = 800, pivots: int = 32) -> DataFrame:
    """a, b: digests of linked classes, enough of them to connect every component.

    ``classes``: digest, n_shingles, sk1, sk2, tokens, and doc, key of one document; ``texts``: doc, key, text.
    """
    if not 50 <= percent <= 100:
        raise ValueError("thresholds are from 50 to 100 percent: below, a node would have to choose more than two tokens")
    threshold, nodes, crowds = percent / 100, [], []
    columns = ["node", "digest", "n_shingles", "sk1", "sk2"]
    now = classes.select("digest", "n_shingles", "sk1", "sk2", F.explode(_children(threshold, trees, None)).alias("node")).select(*columns, F.lit(None).cast("long").alias("was"))
    for level in range(1, depth + 1):
        sizes = now.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        met = checkpointed(now.join(sizes, "node"))
        nodes.append(met.where(F.col("size") <= leaf).select(columns))
        large = met.where(F.col("size") > leaf)
        if large.isEmpty():
            break
        parts_not = F.lit(level == depth) | F.coalesce(2 * F.col("size") > F.col("was"), F.lit(False))
        crowds.append(large.where(parts_not))
        if level < depth:
            rest = large.where(~parts_not)
            tokens = _sifted(classes.select(F.col("digest").alias("c"), "tokens"), ["c"], rest.select("digest"))
            rest = rest.join(tokens, F.col("digest") == F.col("c"))
            now = rest.select(F.explode(_children(threshold, trees, F.col("node"))).alias("node"), *columns[1:], F.col("size").alias("was")).distinct()
    crowd = reduce(DataFrame.unionByName, crowds) if crowds else None
    if crowd is not None and not crowd.isEmpty():
        # which classes are a node's pivots is a matter of their rank by a hash, found with partial aggregates
        seeded = crowd.withColumn("h", F.xxhash64("node", "digest")).withColumn("parts", F.ceil(F.col("size") / part).cast("long"))
        cut = F.col("h").cast("double") < F.lit(-(2.0**63)) + F.lit(2.0**64) * pivots / F.col("size")
        copies = F.when(cut & (F.col("parts") > 1), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("h"), F.col("parts"))))
        nodes.append(seeded.withColumn("p", F.explode(copies)).withColumn("node", F.xxhash64("node", "p")).select(columns))
        crowded = checkpointed(crowd.select(F.col("digest").alias("crowded")).distinct())
    else:
        crowded = None

    def confirmed(nodes: DataFrame, classes: DataFrame) -> DataFrame:
        dealt = nodes.repartition("node").sortWithinPartitions("node")
        clusters = checkpointed(dealt.mapInArrow(_by_key(_clusters(percent), _CLUSTER), "cluster binary, digest binary, sk1 long, sk2 long").dropDuplicates(["cluster", "digest"]))
        places = classes.select(F.col("digest").alias("c"), F.col("doc").alias("d"), F.col("key").alias("k"))
        wanted = checkpointed(clusters.join(places, F.col("digest") == F.col("c")).select("cluster", "digest", "sk1", "sk2", "d", "k"))
        near = _sifted(texts, ["doc", "key"], wanted.select("d", "k"))
        held = near.join(wanted.hint("shuffle_hash"), F.col("doc").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))).select("cluster", "digest", "sk1", "sk2", "text")
        return held.repartition("cluster").sortWithinPartitions("cluster").mapInArrow(_by_key(_linked(percent, shingle), _LINK), "a binary, b binary")

    links = confirmed(reduce(DataFrame.unionByName, nodes), classes)
    if crowded is None:
        return links
    links = checkpointed(links)
    roots = checkpointed(components(links))
    # from here on the join costs what the crowds have, not what the table has
    inside = checkpointed(_sifted(classes.drop("tokens"), ["digest"], crowded).join(crowded, F.col("digest") == F.col("crowded")).drop("crowded"))
    members = _prefixed(inside, texts, roots, percent, shingle, part)
    return links.unionByName(confirmed(_met(_crowds(members), leaf, part), inside))


def _tokens(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_chunks(batch.column(1)):
                sets = shingle_sets(Words(data, offsets, lower=True), shingle)
                begins = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(begins), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), lists], ["digest", "tokens"])
        released()

    return run


def _prefixed(classes: DataFrame, texts: DataFrame, roots: DataFrame, percent: int, shingle: int, part: int) -> DataFrame:
    """token, digest, n_shingles, sk1, sk2, component, label, indexed: the first shingles of each class that another class has too, rarest first.

    Of a linked pair, the smaller set shares at least 2 p / (100 + p) of its shingles and the larger p / 100, so one of
    the first shingles of the smaller (``indexed``) is among the first of the larger. ``label`` is the component where
    that has more than ``part`` classes, else null.
    """
    at = classes.select("digest", F.col("doc").alias("d"), F.col("key").alias("k"))
    held = _sifted(texts, ["doc", "key"], at.select("d", "k")).join(at.hint("shuffle_hash"), F.col("doc").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))).select("digest", "text")
    tokens = checkpointed(held.mapInArrow(_tokens(shingle), "digest binary, tokens array<long>")).select("digest", F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    common = tokens.join(counts, "token").groupBy("digest").agg(F.array_sort(F.collect_set(F.struct("often", "token"))).alias("common"))
    about = classes.select(F.col("digest").alias("c"), "n_shingles", "sk1", "sk2").join(roots, F.col("c") == F.col("node"), "left").withColumn("component", F.coalesce("root", "c"))
    large = about.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > part).select(F.col("component").alias("label"))
    about = about.join(large, F.col("component") == F.col("label"), "left").select("c", "n_shingles", "sk1", "sk2", "component", "label")
    n = F.col("n_shingles")
    first = n - F.expr(f"(2 * {percent} * n_shingles + {99 + percent}) div {100 + percent}") + 1
    probe = n - F.expr(f"({percent} * n_shingles + 99) div 100") + 1
    own = n - F.size("common")  # shingles of no other class come first
    rows = common.join(about, F.col("digest") == F.col("c")).withColumns({"own": own, "first": first, "probe": probe})
    rows = rows.select("digest", "n_shingles", "sk1", "sk2", "component", "label", "own", "first", "probe", F.posexplode("common").alias("place", "of"))
    rows = rows.withColumn("rank", F.col("own") + F.col("place")).where("rank < probe")
    return checkpointed(rows.select(F.col("of.token").alias("token"), "digest", "n_shingles", "sk1", "sk2", "component", "label", (F.col("rank") < F.col("first")).alias("indexed")))


def _crowds(members: DataFrame, few: int = 30) -> DataFrame:
    """``members``, with the shingles of more than ``few`` classes that occur together named alike, where comparing all their classes once is less than doing so at each shingle."""
    sizes = members.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.max("indexed").alias("any")).where(F.col("any") & (F.col("size") > few))
    sizes = checkpointed(sizes.select(F.col("token").alias("hot"), "size"))
    if sizes.isEmpty():
        return members
    held = checkpointed(members.join(sizes, F.col("token") == F.col("hot")).select("digest", "token", "size"))
    first = held.groupBy(F.col("digest").alias("c")).agg(F.min("token").alias("a"))
    roots = components(held.join(first, F.col("digest") == F.col("c")).select("a", F.col("token").alias("b")).distinct())
    named = checkpointed(sizes.join(roots, F.col("hot") == F.col("node"), "left").select("hot", "size", F.xxhash64(F.lit("crowd"), F.coalesce("root", "hot")).alias("crowd")))
    once = held.join(named.select("hot", "crowd"), F.col("token") == F.col("hot")).select("crowd", "digest").distinct().groupBy("crowd").agg(F.count(F.lit(1)).cast("double").alias("all"))
    each = named.groupBy(F.col("crowd").alias("g")).agg(F.sum(F.pow("size", F.lit(2))).alias("each"))
    less = once.join(each, F.col("crowd") == F.col("g")).where("all * all < each").select("g")
    named = named.join(less, F.col("crowd") == F.col("g")).select("hot", "crowd")
    rows = members.join(named, F.col("token") == F.col("hot"), "left").withColumn("token", F.coalesce("crowd", "token"))
    return checkpointed(rows.groupBy("token", "digest").agg(*[F.first(c).alias(c) for c in ("n_shingles", "sk1", "sk2", "component", "label")], F.max("indexed").alias("indexed")))


def _met(members: DataFrame, leaf: int, part: int) -> DataFrame:
    """node, digest, n_shingles, sk1, sk2, component, indexed: classes that meet at a shingle, in pairs of blocks where they are many."""
    kinds = members.groupBy("token", "label", "indexed").agg(F.count(F.lit(1)).alias("size"))
    kinds = kinds.groupBy(F.col("token").alias("t")).agg(
        F.sum("size").alias("total"), F.max("indexed").alias("any"), F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("labels"), F.count("label").alias("labelled"),
        F.collect_list(F.struct("label", "indexed", F.ceil(F.col("size") / part).cast("long").alias("blocks"))).alias("kinds"),
    )
    kinds = kinds.where("any and total > 1 and not (labels = 1 and labelled = n)").select("t", "total", "kinds")
    rows = members.join(kinds, F.col("token") == F.col("t"))
    block = lambda label, indexed, p: F.xxhash64(label, indexed, p)
    mine = F.filter("kinds", lambda k: k["label"].eqNullSafe(F.col("label")) & (k["indexed"] == F.col("indexed")))[0]["blocks"]
    rows = rows.withColumn("block", block(F.col("label"), F.col("indexed"), F.pmod(F.xxhash64("digest"), mine)))
    others = F.filter("kinds", lambda k: (k["indexed"] | F.col("indexed")) & ~F.coalesce(k["label"] == F.col("label"), F.lit(False)))
    other = F.flatten(F.transform(others, lambda k: F.transform(F.sequence(F.lit(0).cast("long"), k["blocks"] - 1), lambda p: block(k["label"], k["indexed"], p))))
    pairs = F.transform(other, lambda b: F.xxhash64(F.col("token"), F.least(b, F.col("block")), F.greatest(b, F.col("block"))))
    nodes = F.when(F.col("total") <= leaf, F.array(F.xxhash64("token"))).otherwise(pairs)
    return rows.withColumn("node", F.explode(nodes)).select("node", "digest", "n_shingles", "sk1", "sk2", "component", "indexed")


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = 5, **parameters) -> DataFrame:
    """doc_id, key, n_shingles, component_id, kept: one row for each row of ``docs``.

    Documents are linked when 100 * intersection >= ``percent`` * union; ``component_id`` is the least
    doc_id reachable over links, ``kept`` whether it is the row's own. ``key`` tells apart rows with one doc_id.
    """
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc"), row_key(F.col("text")).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = checkpointed(texts.select("doc", "key", "text").mapInArrow(_sketched(shingle), _SKETCH))
    one = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc"), "key"))
    classes = rows.where(F.col("digest").isNotNull()).groupBy("digest").agg(one.alias("one"), F.min_by(F.struct("n_shingles", "sk1", "sk2", "tokens"), F.struct("doc_id", "key")).alias("of"))
    classes = checkpointed(classes.select("digest", F.col("one.doc").alias("doc"), F.col("one.key").alias("key"), "of.*"))
    links = checkpointed(near_duplicate_links(classes, texts, percent, shingle, **parameters))
    roots = components(links)
    groups = classes.select("digest", "doc").join(roots, F.col("digest") == F.col("node"), "left").withColumn("root", F.coalesce("root", "digest")).drop("node")
    least = groups.groupBy("root").agg(F.min("doc").alias("component_id"))
    groups = groups.join(least, "root").select(F.col("digest").alias("c"), "component_id")
    out = rows.select("doc_id", "key", "n_shingles", "digest").join(groups, F.col("digest") == F.col("c"), "left")
    out = out.withColumn("component_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "key", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_dedup_digests(docs: DataFrame, percent: int = 85, **parameters) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    return near_duplicates(docs, percent, **parameters).drop("key")


def without_near_duplicates(docs: DataFrame, percent: int = 80, **parameters) -> DataFrame:
    """``docs`` with one document of each component: the one with the least doc_id. Rows with equal doc_ids and texts are one document and stay or go together."""
    keep = near_duplicates(docs, percent, **parameters).where("kept").select(F.col("doc_id").alias("d"), F.col("key").alias("k")).distinct().hint("shuffle_hash")
    return unpacked(packed(docs).join(keep, F.col("tl_doc").eqNullSafe(F.col("d")) & (F.col("tl_key") == F.col("k")), "left_semi"), docs)
