"""Secret scans with an incremental ledger of blobs.

Each historical version of a document is addressed by the SHA-256 of its content. The ledger holds
what was found for every pair of blob and rule version that was ever scanned; a scan reads only the
texts of pairs that it lacks, one text for each blob, and joins findings back to every path that
holds the blob. All of it is DataFrame operations. A stored ledger is a folder of Parquet files that each scan adds to
(``read_ledger``, ``append_ledger``).

Which pairs are unseen is settled by digests alone. Where they are at most ``FEW``, they go to the texts; where there is none,
no text is read again; else the texts of unseen blobs travel once, dealt by (blob, doc_id), so a blob that a third of all paths hold
does not meet in one task. Spans are found without a UDF: ``split`` gives what lies between the
matches of a pattern and ``regexp_extract_all`` the matches, so their running lengths are positions.

Defined results: null text counts as empty. A path is a row; repeated rows each get the findings.
Null doc_ids are paths like others. An empty table gives empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import checkpointed


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``min_group`` bounds the code points of ``group`` in a match of ``pattern``, 0 being the match."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    min_group: int = 1


#: Fixed values. The last two patterns carry their least length: such runs are maximal, so a shorter match hides no longer one.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)

#: Unseen blobs that may be broadcast; a row has about 100 bytes.
FEW = 10_000
_FINDINGS = "array<struct<begin:int,stop:int>>"


def spans(text: Column, rule: Rule) -> Column:
    """Leftmost non-overlapping matches that pass the rule, as an array of (begin, stop) in code points."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    pairs = F.zip_with(matches, gaps, lambda m, g: F.struct(m.alias("m"), F.char_length(g).alias("g")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_FINDINGS).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["g"]
        stop = begin + F.char_length(x["m"])
        passes = F.lit(True) if rule.min_group <= 1 else F.char_length(F.regexp_extract(x["m"], rule.pattern, rule.group)) >= rule.min_group
        one = F.array(F.struct(begin.cast("int").alias("begin"), stop.cast("int").alias("stop")))
        return F.struct(stop.alias("at"), F.when(passes, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    # the pair after the last match has no match in it
    found = F.aggregate(F.filter(pairs, lambda x: x["m"].isNotNull()), start, step)["found"]
    return F.when(F.rlike(text, F.lit(rule.pattern)), found).otherwise(F.array().cast(_FINDINGS))


def _paths(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ledger's new rows: blob, kind, version, found. Only blobs without a row for a rule's kind and version are scanned for it."""
    paths = _paths(docs)
    # one path for each blob; partial minima before the shuffle
    reps = paths.groupBy("blob").agg(F.min("doc_id").alias("rep"))
    kinds = [(r.kind, r.version) for r in rules]
    if ledger is None:
        wanted = reps.withColumn("wanted", F.array(*[F.lit(k) for k, _ in kinds]))
    else:
        current = ledger.where(" or ".join(f"(kind = '{k}' and version = {v})" for k, v in kinds) or "false").groupBy("blob").agg(F.collect_set("kind").alias("seen"))
        wanted = reps.join(current, "blob", "left").withColumn("wanted", F.array_except(F.array(*[F.lit(k) for k, _ in kinds]), F.coalesce("seen", F.array().cast("array<string>"))))
    wanted = checkpointed(wanted.where(F.size("wanted") > 0).select(F.col("blob").alias("b"), "rep", "wanted"))
    n = wanted.count()
    if not n:
        return docs.sparkSession.createDataFrame([], LEDGER)
    wanted = F.broadcast(wanted) if n <= FEW else wanted.hint("shuffle_hash")
    texts = paths.join(wanted, (paths.blob == F.col("b")) & paths.doc_id.eqNullSafe(F.col("rep"))).select("blob", "text", "wanted")
    none = F.array().cast(_FINDINGS)
    per_rule = [
        F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.when(F.array_contains("wanted", r.kind), spans(F.col("text"), r)).otherwise(none).alias("found"), F.array_contains("wanted", r.kind).alias("scanned"))
        for r in rules
    ]
    rows = texts.select("blob", F.array(*per_rule).alias("results")).dropDuplicates(["blob"])
    rows = rows.select("blob", F.inline("results")).where("scanned").drop("scanned")
    return checkpointed(rows)


LEDGER = f"blob string, kind string, version int, found {_FINDINGS}"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a stored ledger."""
    return spark.read.schema(LEDGER).parquet(path)


def append_ledger(rows: DataFrame, path: str) -> None:
    """Adds a scan's rows to a stored ledger."""
    rows.write.mode("append").parquet(path)


def secret_findings(docs: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings, new ledger rows). findings: doc_id, blob, kind, version, begin, stop for each path and span."""
    new = scan_unseen(docs, ledger, rules)
    known = new if ledger is None else ledger.select(new.columns).unionByName(new)
    current = F.array(*[F.concat_ws(":", F.lit(r.kind), F.lit(str(r.version))) for r in rules])
    hits = known.where((F.size("found") > 0) & F.array_contains(current, F.concat_ws(":", "kind", F.col("version").cast("string"))))
    found = _paths(docs).select("doc_id", "blob").join(hits, "blob")
    return found.select("doc_id", "blob", "kind", "version", F.inline("found")), new


def secret_digests(docs: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_<kind> for each rule, base_sha256, spans (kind:start:end by start, then rule)."""
    new = scan_unseen(docs, ledger, rules)
    known = new if ledger is None else ledger.select(new.columns).unionByName(new)
    return _digests(docs, known, rules)


def secret_digests_over_history(docs: DataFrame, path: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``secret_digests`` by two scans over the ledger stored at ``path``: the first commits the blobs in the lower
    half of digests, the second all of them, and so scans those of the upper half only."""
    spark = docs.sparkSession
    first = docs.where(F.substring(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256), 1, 1) < "8")
    append_ledger(scan_unseen(first, None, rules), path)
    append_ledger(scan_unseen(docs, read_ledger(spark, path), rules), path)
    return _digests(docs, read_ledger(spark, path), rules)


def _digests(docs: DataFrame, known: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    order = {r.kind: i for i, r in enumerate(rules)}
    versions = {r.kind: r.version for r in rules}
    known = known.where(F.size("found") > 0).where(" or ".join(f"(kind = '{k}' and version = {v})" for k, v in versions.items()))
    # a blob has one row for each rule, so what is gathered here is one text's findings
    place = F.create_map(*[x for k, i in order.items() for x in (F.lit(k), F.lit(i))])
    each = known.select("blob", "kind", F.inline("found")).groupBy("blob").agg(
        F.sort_array(F.collect_list(F.struct("begin", place[F.col("kind")].alias("place"), "stop", "kind"))).alias("all"), *[F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in order]
    )
    each = each.withColumn("spans", F.array_join(F.transform("all", lambda x: F.concat_ws(":", x["kind"], x["begin"].cast("string"), x["stop"].cast("string"))), ",")).drop("all")
    out = _paths(docs).select("doc_id", "blob").join(each, "blob", "left")
    said = F.coalesce("spans", F.lit(""))
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in order], F.sha2(said, 256).alias("base_sha256"), said.alias("spans"))
