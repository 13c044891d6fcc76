"""The pipeline's stages against what their operators say, on the smallest table."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tickloom.llm import mixing, near_dedup, quality_rules, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def test_decisions_take_effect(stages):
    docs, good, lines, near, mixed, encoded = stages
    assert all(x.columns == docs.columns for x in (good, lines, near, mixed))
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(good) == ids(quality_rules.quality_digests(docs).where("kept"))
    assert ids(lines) == ids(good) and lines.where(F.col("n_chars") != F.char_length("text")).count() == 0
    assert ids(near) == ids(near_dedup.near_dedup_digests(lines, 80).where("kept"))
    taken = {r.doc_id: r.taken for r in mixing.mix_digests(near).where("taken > 0").collect()}
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id] += len(r.text.split())
    assert set(got) == set(taken) and sum(got.values()) == sum(taken.values())
    assert encoded.count() == mixed.count() and encoded.where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_run_is_the_stages(spark, stages):
    got = Counter((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens").collect())
    assert got == Counter((r.doc_id, r.n_tokens) for r in stages[-1].select("doc_id", "n_tokens").collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(want.columns)
    assert Counter(map(tuple, df.select(want.columns).collect())) == Counter(want.fetchall())
