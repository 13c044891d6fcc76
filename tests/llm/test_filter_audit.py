"""The filter audit against a run of every chain of filters, document by document."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tickloom.llm import filter_audit

DOCS = "doc_id long, text string, lang string, source string"
LABELS = "doc_id long, quality int, toxic int"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute(docs, labels):
    """Every chain is run: rows by part, order and step."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, *_ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    parts = {}
    for i, text, lang, *_ in docs:
        text = text or ""
        words = WORD.findall(text)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and least[text] < i,
        }
        parts.setdefault(lang or "", []).append((fails, i in good, i in toxic))
    out = []
    for part, rows in parts.items():
        lost = Counter()
        for order in map("".join, permutations("ABCDE")):
            left, gone = list(rows), []
            for step, f in enumerate(order, 1):
                removed = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                lost[f] += len(removed)
                alone = sum(r[0][f] and sum(r[0].values()) == 1 for r in rows)
                out.append([part, order, step, len(left), len(removed), sum(r[0][f] for r in gone), alone, sum(r[1] for r in removed), sum(r[2] for r in removed), f])
                gone += removed
        for r in out:
            if r[0] == part:
                r[-1] = lost[r[-1]]
    return Counter(map(tuple, out))


def said(df):
    return Counter(map(tuple, df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()))


def drawn(seed: int, n: int = 300):
    rng = random.Random(seed)
    pool = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(n):
        words = [rng.choice(pool[: rng.choice([20, 400])]) for _ in range(rng.choice([3, 80, 99, 100, 101, 300]))]
        words = [w.upper() if rng.random() < rng.choice([0, 0, 0.3]) else w for w in words]
        texts.append(rng.choice([" ", "\n", "\t \r\n"]).join(words) + rng.choice(["", "", " #", "|", " ", "\u00a0\u2003", "É"]))
    texts = [rng.choice(texts) if rng.random() < 0.3 else t for t in texts] + [None, "", None, "A", " \n"]
    ids = [rng.randrange(10_000) for _ in texts]
    docs = [(i, t, rng.choice(["en", "fr", "", None]), "s") for i, t in zip(ids, texts)]
    return docs, [(rng.choice(ids), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(n)] + [(None, 1, 1)]


@pytest.mark.parametrize("seed", [0, 1])
def test_every_order_against_running_it(spark, seed):
    docs, labels = drawn(seed)
    got = filter_audit.filter_interactions(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(labels, LABELS))
    assert said(got) == brute(docs, labels)


def test_odd_rows(spark):
    """Null and repeated doc_ids, repeated rows, null texts and langs, a doc_id with several labels, clashing names."""
    docs = [(1, "x y", "en", "a"), (1, "x y", "en", "a"), (1, "other", "en", "a"), (None, "x y", None, None), (None, None, None, None), (5, "", "fr", "b"), (5, "", "", "b"), (4, None, "fr", "b"), (7, "x y", "en", "a"), (9, "long " * 200_000, "en", "a")]
    labels = [(7, 0, 1), (7, 1, 0), (4, None, None), (None, 1, 1), (99, 1, 1)]
    clashing = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("clash") for c in ("part", "digest", "A", "E", "n", "good", "toxic", "quality", "first", "least", "s", "cell")})
    got = filter_audit.filter_interactions(clashing, spark.createDataFrame(labels, LABELS).withColumn("text", F.lit(1)))
    assert said(got) == brute(docs, labels)


def test_empty_tables(spark):
    none, docs = spark.createDataFrame([], DOCS), [(1, "a", "en", "s")]
    assert filter_audit.filter_interactions(none, spark.createDataFrame([], LABELS)).count() == 0
    assert said(filter_audit.filter_interactions(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS))) == brute(docs, [])


def test_other_filters_by_their_flags(spark):
    """Three filters over cells of one's own; survivors, unique failures and Shapley sums add up."""
    rows = [("p", a, b, c, 10 * a + 3 * b + c + 1, a, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    joint = filter_audit.joint_failures(spark.createDataFrame(rows, "part string, X int, Y int, Z int, n long, good long, toxic long"), "XYZ")
    got = filter_audit.order_report(joint, "XYZ").collect()
    total, clean = sum(r[4] for r in rows), next(r[4] for r in rows if not any(r[1:4]))
    assert len(got) == 18 and {r.kept for r in got if r.step == 3} == {clean}
    assert sum(r.shapley for r in got if r.filter_order == "XYZ") == 6 * (total - clean)
    for f in "XYZ":
        mine = [r for r in got if r.filter_order[r.step - 1] == f]
        assert {r.shapley for r in mine} == {sum(r.removed for r in mine)}
        assert {r.unique_fails for r in mine} == {r.removed for r in mine if r.step == 3}
