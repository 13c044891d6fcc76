"""Quality rules with robust multivariate outliers.

Plain rules come first (few words, much repetition). Of what they keep, five transformed statistics
(mean word length, symbols, words like the one before, lines like an earlier one, words in repeated windows; of the last two what goes
beyond one repeated line and one repeated window, since one line that comes again is no fault) go to
minimum-covariance-determinant estimates for each language and source, and for each language. Concentration steps take the
mean and covariance of the ``share`` of documents with the least Mahalanobis distances, from three starts: medians and median
deviations; the same with correlations of hyperbolic tangents of robust scores; mean and covariance of all. Steps go on while
the logarithm of the determinant falls by more than ``settled``, and of the starts the one that ends with the least determinant is the estimate.
A source's estimate leans on its language's as if that were ``prior`` more documents, so a small source has an estimate like
any other. A document whose squared distance is over ``cutoff`` is rejected. The default is what one in a million has under
chi-square with five degrees, since a corpus has many millions of clean documents. Deviations have floors, so a statistic
that hardly varies rejects nothing near.

Statistics are rounded to integers and documents with equal ones are counted together before
anything is shuffled: a hot source is a few thousand counted cells, all sums are exact, and reruns agree.
All of it is DataFrame operations.

Defined results: null and empty texts have no words and fail the base rules. A null language or source
is a group of its own. Repeated rows each get the same result. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import WORD_PATTERN, checkpointed, packed, row_key, unpacked

#: n_words below this fail.
LEAST_WORDS = 20
#: The floor of the standard deviations of all transformed statistics, in their units: six of it are the cutoff. For a share that is nought
#: elsewhere, half a percent is far within and twenty percent beyond; for the mean word length, a factor of 1.83 is.
FLOOR = 10
#: What makes the covariance of the nearest 75 % of a five-dimensional normal distribution that of the whole (fixed value).
CONSISTENCY = 1.412
#: What chi-square with five degrees exceeds once in a million (fixed value).
CUTOFF = 35.89
#: Distances are compared in tenths, up to this many.
_BINS = 5000
_LONG = "long"


def statistics(docs: DataFrame, window: int = 8) -> DataFrame:
    """``window`` is a power of two. Gives doc_id, key, lang, source, n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words, n_doubled, base_failed for each row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast(_LONG).alias("doc_id"), row_key(F.col("text")).alias("key"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    words = F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0))
    rows = rows.select(
        "doc_id", "key", "lang", "source",
        F.transform(words, lambda w: F.xxhash64(w)).alias("words"),
        lines.alias("lines"),
        F.char_length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast(_LONG).alias("word_chars"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast(_LONG).alias("n_symbols"),
    )
    # a window's hash is one of two halves' hashes: windows of 2, 4 and 8 words, one pass each
    rows = rows.withColumn("windows", F.col("words"))
    for half in (window >> k for k in range(window.bit_length() - 1, 0, -1)):
        left = F.greatest(F.size("windows") - half, F.lit(0))
        rows = rows.withColumn("windows", F.zip_with(F.slice("windows", 1, left), F.slice("windows", half + 1, left), lambda a, b: F.xxhash64(a, b)))
    # most texts have no window twice: only the others are sorted
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("sorted", F.when(twice, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    like = lambda x, j: (F.get(F.col("sorted"), j - 1)["h"] == x["h"]) | (F.get(F.col("sorted"), j + 1)["h"] == x["h"])
    found = F.array_sort(F.transform(F.filter("sorted", lambda x, j: F.coalesce(like(x, j), F.lit(False))), lambda x: x["i"]))
    start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(found, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(window), i - a["last"])).alias("n")))["n"]
    rows = rows.select(
        "doc_id", "key", "lang", "source",
        F.size("words").cast(_LONG).alias("n_words"),
        "word_chars", "n_symbols", F.size("lines").cast(_LONG).alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast(_LONG).alias("n_dup_lines"),
        F.when(F.col("sorted").isNull(), F.lit(0)).otherwise(covered).cast(_LONG).alias("n_repeat_words"),
        F.size(F.filter("words", lambda w, j: F.coalesce(F.get(F.col("words"), j - 1) == w, F.lit(False)))).cast(_LONG).alias("n_doubled"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def transformed(stats: DataFrame, window: int = 8) -> DataFrame:
    """``stats`` with q1 .. q5: logarithms in hundredths (q1) and twentieths. The first repeated line and the first repeated window do not count. Short texts lean on a few dozen words of five letters without symbols or repeats."""
    share = lambda x, of, more: F.round(20 * F.log1p(100 * (F.col(x) if isinstance(x, str) else x) / (F.col(of) + more))).cast("int")
    return stats.withColumns(
        {
            "q1": F.round(100 * F.log((F.col("word_chars") + 30 * 5) / (F.col("n_words") + 30))).cast("int"),
            "q2": share("n_symbols", "n_words", 20), "q3": share("n_doubled", "n_words", 20),
            "q4": share(F.greatest(F.col("n_dup_lines") - 1, F.lit(0)), "n_lines", 5), "q5": share(F.greatest(F.col("n_repeat_words") - 2 * window, F.lit(0)), "n_words", 20),
        }
    )


_Q = ("q1", "q2", "q3", "q4", "q5")
_P = len(_Q)
_PAIRS = tuple((i, j) for i in range(_P) for j in range(i, _P))
_M, _S = [f"m{i}" for i in range(_P)], [f"s{i}{j}" for i, j in _PAIRS]
_W = [f"w{i}{j}" for i in range(_P) for j in range(i + 1)]


def _whitened(estimates: DataFrame) -> DataFrame:
    """``estimates`` (m, s) with the inverse of the covariance's Cholesky factor (w) and the logarithm of its determinant, entry by entry."""
    df = estimates
    less = lambda terms: "".join(f" - {t}" for t in terms)
    for j in range(_P + 1):  # with column j of the factor, row j - 1 of its inverse
        new = {}
        if j < _P:
            corner = f"sqrt(s{j}{j}{less(f'c{j}{k} * c{j}{k}' for k in range(j))})"
            new[f"c{j}{j}"] = F.expr(corner)
            new |= {f"c{i}{j}": F.expr(f"(s{j}{i}{less(f'c{i}{k} * c{j}{k}' for k in range(j))}) / {corner}") for i in range(j + 1, _P)}
        if j:
            i = j - 1
            new[f"w{i}{i}"] = F.expr(f"1 / c{i}{i}")
            new |= {f"w{i}{k}": F.expr(f"(0D{less(f'c{i}{x} * w{x}{k}' for x in range(k, i))}) / c{i}{i}") for k in range(i)}
        df = df.withColumns(new)
    ends = [c for c in df.columns if not (len(c) == 3 and c[0] == "c" and c[1:].isdigit())]
    return df.select(*ends, F.expr(" + ".join(f"2 * ln(c{i}{i})" for i in range(_P))).alias("log_det"))


def _distance() -> Column:
    """The squared Mahalanobis distance of q1 .. q5 from m by w."""
    rows = (" + ".join(f"w{i}{j} * (q{j + 1} - m{j})" for j in range(i + 1)) for i in range(_P))
    return F.expr(" + ".join(f"({x}) * ({x})" for x in rows))


def _sums(weight: str, x: list[str]) -> list[Column]:
    """Weight, weighted sums (a) and sums of products (p) of integers: exact, whatever the order."""
    one = [F.expr(f"sum(cast({x[i]} as long) * {weight})").alias(f"a{i}") for i in range(_P)]
    return [F.sum(weight).alias("h"), *one, *[F.expr(f"sum(cast({x[i]} as long) * {x[j]} * {weight})").alias(f"p{i}{j}") for i, j in _PAIRS]]


def _moments(factor: float) -> list[Column]:
    """m and s, with floors, from the sums."""
    cov = [F.expr(f"{factor}D * (p{i}{j} / h - a{i} / h * (a{j} / h)) + {float(FLOOR**2) if i == j else 0.0}D").alias(n) for (i, j), n in zip(_PAIRS, _S)]
    return [*[F.expr(f"a{i} / h").alias(n) for i, n in enumerate(_M)], *cov]


def _beside(cells: DataFrame, small: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The join of cells with a table of ``n`` rows, which is broadcast up to 20,000 (about 400 bytes each)."""
    return cells.join(F.broadcast(small) if n <= 20_000 else small, keys)


def _group(lang: Column | str, source: Column | str, level: int) -> Column:
    source = F.lit(None).cast("string") if level else source
    return F.to_json(F.struct(F.lit(level).alias("level"), F.col(lang).alias("lang") if isinstance(lang, str) else lang, (F.col(source) if isinstance(source, str) else source).alias("source")))


def _starts(cells: DataFrame) -> DataFrame:
    """group, start, n, m, s: three estimates to begin from."""
    # exact percentiles of integers with counts: what they hold is bounded by the range of the statistics
    middle = checkpointed(cells.groupBy("group").agg(*[F.percentile(q, F.lit(0.5), F.col("w")).alias(m) for q, m in zip(_Q, _M)], F.sum("w").alias("n")))
    groups = middle.count()
    deviations = [F.expr(f"1.4826D * percentile(abs({q} - {m}), 0.5D, w)").alias(f"d{i}") for i, (q, m) in enumerate(zip(_Q, _M))]
    spread = _beside(cells, middle, ["group"], groups).groupBy("group").agg(F.max("n").alias("n"), *[F.max(m).alias(m) for m in _M], *deviations)
    spread = checkpointed(spread.withColumns({f"d{i}": F.expr(f"sqrt(d{i} * d{i} + {float(FLOOR**2)}D)") for i in range(_P)}))
    plain = spread.select("group", F.lit(0).alias("start"), "n", *_M, *[F.expr(f"d{i} * d{i}" if i == j else "0D").alias(f"s{i}{j}") for i, j in _PAIRS])
    scores = [F.expr(f"cast(round(1000 * tanh(({q} - {m}) / d{i})) as long)").alias(f"t{i}") for i, (q, m) in enumerate(zip(_Q, _M))]
    sums = _beside(cells, spread, ["group"], groups).select("group", "w", *scores).groupBy("group").agg(*_sums("w", [f"t{i}" for i in range(_P)]))
    sums = sums.withColumns({f"v{i}{j}": F.expr(f"p{i}{j} / h - a{i} / h * (a{j} / h)") for i, j in _PAIRS})
    rho = lambda i, j: f"coalesce(0.95D * d{i} * d{j} * v{i}{j} / nullif(sqrt(greatest(v{i}{i}, 0D) * greatest(v{j}{j}, 0D)), 0D), 0D)"
    bent = spread.join(sums, "group").select("group", F.lit(1).alias("start"), "n", *_M, *[F.expr(f"d{i} * d{i}" if i == j else rho(i, j)).alias(f"s{i}{j}") for i, j in _PAIRS])
    every = cells.groupBy("group").agg(*_sums("w", list(_Q))).select("group", F.lit(2).alias("start"), F.col("h").alias("n"), *_moments(1.0))
    return plain.unionByName(bent).unionByName(every)


def mcd_estimates(stats: DataFrame, share: float = 0.75, settled: float = 1e-3, most_steps: int = 40) -> DataFrame:
    """group, start, n, m, s, log_det: the estimate with the least determinant for each language and source (level 0) and each language (level 1)."""
    cells = stats.where("not base_failed").groupBy("lang", "source", *_Q).agg(F.count(F.lit(1)).alias("w"))
    cells = cells.withColumn("group", F.explode(F.array(_group("lang", "source", 0), _group("lang", "source", 1))))
    cells = checkpointed(cells.groupBy("group", *_Q).agg(F.sum("w").alias("w")))
    now = checkpointed(_whitened(_starts(cells)))
    keep = ["group", "start", "n", *_M, *_S, *_W, "log_det"]
    ended, n = [], now.count()
    for step in range(most_steps):
        if not n:
            break
        placed = _beside(cells, now.select("group", "start", "n", *_M, *_W), ["group"], n).withColumn("bin", F.least(F.floor(10 * _distance()), F.lit(_BINS)).cast("int"))
        bins = placed.groupBy("group", "start", "bin").agg(F.max("n").alias("n"), *_sums("w", list(_Q)))
        before = F.sum("h").over(Window.partitionBy("group", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("h")
        near = bins.withColumn("before", before).where(F.col("before") < share * F.col("n"))
        total = [c for c in near.columns if c[0] in "hap" and c not in ("before",)]
        new = near.groupBy("group", "start").agg(F.max("n").alias("n"), *[F.sum(c).alias(c) for c in total]).select("group", "start", "n", *_moments(CONSISTENCY))
        old = now.select("group", "start", F.col("log_det").alias("was"), F.struct(*keep).alias("old"))
        both = _whitened(new).join(old, ["group", "start"]).withColumn("falls", (F.col("log_det") < F.col("was") - settled) | F.lit(step == 0))
        both = checkpointed(both.select("falls", "old", F.struct(*keep).alias("new")))
        ended.append(both.where("not falls").select("old.*"))
        now = both.where("falls").select("new.*")
        n = now.count()
    every = reduce(DataFrame.unionByName, ended, now.select(keep))
    best = every.groupBy("group").agg(F.min_by(F.struct("start", "n", *_M, *_S, "log_det"), F.struct("log_det", "start")).alias("best"))
    return checkpointed(best.select("group", "best.*"))


def quality_verdicts(docs: DataFrame, cutoff: float = CUTOFF, share: float = 0.75, prior: float = 200.0) -> DataFrame:
    """One row for each row of ``docs``: doc_id, key, the statistics, base_failed, distance2 and kept."""
    stats = checkpointed(transformed(statistics(docs)))
    found = mcd_estimates(stats, share)
    names = [*_M, *_S]
    own = found.select("group", *[F.col(c).alias(f"own_{c}") for c in ("n", *names)])
    wide = found.select(F.col("group").alias("of"), *[F.col(c).alias(f"all_{c}") for c in names])
    groups = stats.where("not base_failed").select("lang", "source").distinct().select(_group("lang", "source", 0).alias("group"), _group("lang", "source", 1).alias("of"))
    lean = lambda c: F.expr(f"(own_n * own_{c} + {float(prior)}D * all_{c}) / (own_n + {float(prior)}D)")
    leant = groups.join(own, "group").join(wide, "of").select("group", *[lean(c).alias(c) for c in names])
    estimates = checkpointed(_whitened(leant).select(F.col("group").alias("g"), *_M, *_W))
    small = F.broadcast(estimates) if estimates.count() <= 20_000 else estimates
    rows = stats.withColumn("group", _group("lang", "source", 0)).join(small, F.col("group") == F.col("g"), "left").withColumn("distance2", _distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance2") <= cutoff, F.lit(False))
    return rows.select("doc_id", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance2", kept.alias("kept"))


def quality_digests(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    return quality_verdicts(docs, **parameters).drop("key", "distance2")


def good_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that are kept."""
    keep = quality_verdicts(docs, **parameters).where("kept").select(F.col("doc_id").alias("d"), F.col("key").alias("k")).hint("shuffle_hash")
    return unpacked(packed(docs).join(keep, F.col("tl_doc").eqNullSafe(F.col("d")) & (F.col("tl_key") == F.col("k")), "left_semi"), docs)
