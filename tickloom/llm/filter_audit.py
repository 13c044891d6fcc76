"""How filters interact: what each removes, alone and after others, in every order, by inclusion and exclusion.

Each document has one flag a filter, 1 where it fails. One aggregation counts, for every set of filters, the documents that fail
all of the set, as sums of products of flags: 32 joint-failure counts for five filters, for each part of the corpus and each
measure (documents, good ones, toxic ones). Everything else is arithmetic on these counts, with no further look at a document:

* what passes a set of filters is the alternating sum over its subsets, which is the Moebius inverse, so a chain of filters in any
  order has its survivors and removals at each step without being run;
* what fails one filter only is the alternating sum over the supersets of that filter;
* the Harsanyi dividend of a set is its joint count with alternating sign, and a filter's Shapley value the dividends of the sets
  that hold it, each shared equally among its members. Summed over all orders it is an integer.

A filter that looks at other documents ("identical to a smaller doc_id's text") is counted by digests: rows are counted by digest
and flags before they are shuffled, so a text that a third of all rows share is a few rows by the time digests meet.

Defined results: a null text counts as empty; equal texts are those with equal SHA-256 digests. A null lang is the part "" together with
an empty one. A null doc_id is neither smaller nor larger than another, has no labels, and never fails the filter of copies. Repeated rows count as
often as they come; rows with the same doc_id are not copies of one another. A doc_id with several labels is good or toxic if one of them says so.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import SPACE_CLASS

#: The filters of the audit, by name: what a document fails.
FILTERS = "ABCDE"
#: Filters have as many orders as their factorial, and as many joint counts as there are sets of them.
MOST_FILTERS = 7


def text_failures(text: Column) -> dict[str, Column]:
    """The four filters that look at one text: short (A), repetitive (B), shouting (C), with markup or symbols (D)."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, f"{SPACE_CLASS}+"), "")
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 80 * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > 10 * F.char_length(text).cast("long"),
        "D": F.rlike(text, F.lit(r"[#$%&*|]")),
    }


def flagged_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A .. E (0 or 1), n, good, toxic: documents counted by part and flags, at most 32 rows a part."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    flags = {f: x.cast("int").alias(f) for f, x in text_failures(F.col("text")).items()}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), *flags.values())
    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(said("quality"), said("toxic"))
    rows = rows.join(known, "doc_id", "left").select("doc_id", "part", "digest", *flags, F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    alike = ["digest", "part", *flags, "good", "toxic"]
    # repeated rows first, by doc_id as the join has left them; then each cell of a digest knows how many of its rows have its least doc_id
    rows = rows.groupBy("doc_id", *alike).agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    cells = rows.groupBy(alike).agg(F.sum("n").alias("n"), first, F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    cells = cells.withColumn("least", F.expr("min(first.doc_id) over (partition by digest)"))
    free = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    parts = F.explode(F.array(F.struct(F.lit(0).alias("E"), free.alias("n")), F.struct(F.lit(1).alias("E"), (F.col("n") - free).alias("n")))).alias("cell")
    cells = cells.select("part", *flags, "good", "toxic", parts).select("part", *flags, "cell.E", "good", "toxic", "cell.n")
    return cells.groupBy("part", *FILTERS).agg(F.sum("n").alias("n"), F.sum(F.col("good") * F.col("n")).alias("good"), F.sum(F.col("toxic") * F.col("n")).alias("toxic"))


def _members(mask: int, filters: str) -> str:
    return "".join(f for i, f in enumerate(filters) if mask >> i & 1)


def joint_failures(cells: DataFrame, filters: str = FILTERS, measures: tuple[str, ...] = ("n", "good", "toxic"), by: str = "part") -> DataFrame:
    """``by``, and an array a measure: at a set's number (bit i: filter i) the sum of the measure over what fails all of the set."""
    if not 1 <= len(filters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")
    sums = [F.sum(F.expr(" * ".join([m, *_members(mask, filters)]))).alias(f"{m}_{mask}") for m in measures for mask in range(1 << len(filters))]
    rows = cells.groupBy(by).agg(*sums)
    return rows.select(by, *[F.array(*[f"{m}_{mask}" for mask in range(1 << len(filters))]).alias(m) for m in measures])


def _signed(terms: list[tuple[int, int]], measure: str) -> Column:
    """The sum of factor * measure[mask]."""
    return F.expr(" + ".join(f"{factor}L * {measure}[{mask}]" for factor, mask in terms))


def survivors(measure: str, filters: str = FILTERS) -> Column:
    """From the joint failures of a measure: an array that has, at a set's number, what passes all filters of the set."""
    subsets = lambda mask: [t for t in range(mask + 1) if t & mask == t]
    return F.array(*[_signed([((-1) ** t.bit_count(), t) for t in subsets(mask)], measure) for mask in range(1 << len(filters))])


def unique_failures(measure: str, filters: str = FILTERS) -> Column:
    """From the joint failures: for each filter, what fails it and no other."""
    sets = range(1 << len(filters))
    return F.array(*[_signed([((-1) ** (t.bit_count() - 1), t) for t in sets if t >> i & 1], measure) for i in range(len(filters))])


def shapley_sums(measure: str, filters: str = FILTERS) -> Column:
    """From the joint failures: for each filter, what it removes, summed over all orders: dividends of the sets that hold it, by their size."""
    sets, orders = range(1 << len(filters)), factorial(len(filters))
    return F.array(*[_signed([((-1) ** (t.bit_count() - 1) * (orders // t.bit_count()), t) for t in sets if t >> i & 1], measure) for i in range(len(filters))])


def order_report(joint: DataFrame, filters: str = FILTERS, by: str = "part") -> DataFrame:
    """One row for each part, order of the filters and step; see ``filter_interactions``. ``joint`` has the measures n, good and toxic."""
    bit = {f: i for i, f in enumerate(filters)}
    steps = []
    for order in permutations(filters):
        masks = [sum(1 << bit[f] for f in order[:k]) for k in range(len(filters) + 1)]
        steps += [("".join(order), k + 1, bit[f], masks[k], masks[k + 1]) for k, f in enumerate(order)]
    every = [f"named_struct('filter_order', '{o}', 'step', {k}, 'i', {i}, 'before', {b}, 'after', {a})" for o, k, i, b, a in steps]
    passed = joint.select(
        by, F.array(*[F.expr(f"n[{1 << i}]") for i in range(len(filters))]).alias("fails"),
        *[survivors(m, filters).alias(m) for m in ("n", "good", "toxic")], unique_failures("n", filters).alias("alone"), shapley_sums("n", filters).alias("shares"),
    )
    rows = passed.withColumn("s", F.explode(F.expr(f"array({', '.join(every)})")))
    lost = lambda m: F.expr(f"{m}[s.before] - {m}[s.after]")
    return rows.select(
        by, "s.filter_order", "s.step",
        F.expr("n[s.after]").alias("kept"), lost("n").alias("removed"), (F.expr("fails[s.i]") - lost("n")).alias("redundant"), F.expr("alone[s.i]").alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.expr("shares[s.i]").alias("shapley"),
    )


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: the audit of five filters.

    kept: documents after this step. removed: by it, at this place. redundant: would fail it, but are gone. unique_fails: fail it and no
    other. good_lost, toxic_lost: labelled documents among the removed. shapley: its removed ones, summed over all 120 orders.
    """
    return order_report(joint_failures(flagged_cells(docs, labels)))
