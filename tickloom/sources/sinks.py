"""Writers and reports: tables, provenance, snapshot manifests, dashboard JSON."""

from __future__ import annotations

import datetime
import json
import platform

import pyspark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "error", by: list[str] | None = None) -> None:
    """Arrays and structs become JSON, NULL an empty field."""
    flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
    writer = flat.write.mode(mode).option("header", True)
    (writer.partitionBy(*by) if by else writer).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "error", by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def finite_or_null(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def dashboard_json(df: DataFrame) -> DataFrame:
    """One column ``value``: each row as JSON, with null for what is missing or not finite."""
    cols = [finite_or_null(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))


def file_digests(spark: SparkSession, pattern: str) -> DataFrame:
    """path, bytes, sha256 of each file."""
    files = spark.read.format("binaryFile").load(pattern)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def snapshot_manifest(bars: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """symbol, rows, first, last, and a digest over all rows of a symbol that does not depend on their order.

    Each row's hash is summed, so no symbol's rows are gathered; with ``digests`` (path, sha256) files are joined by stem.
    """
    row = F.xxhash64(*[F.col(c) for c in sorted(bars.columns)]).cast("decimal(38,0)")
    out = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first"), F.max("date").alias("last"), F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.sum(row).cast("string")), 256).alias("digest"))
    if digests is None:
        return out
    return out.join(digests.select(F.regexp_extract("path", r"([^/.]+)\.", 1).alias("symbol"), "sha256"), "symbol", "left")


def digest_of_digests(manifest: DataFrame) -> DataFrame:
    """One row: symbols, rows, digest of all symbols' digests in order of symbol (a row a symbol)."""
    return manifest.agg(
        F.count(F.lit(1)).alias("symbols"), F.sum("rows").alias("rows"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("symbol", "digest"))), lambda x: x["digest"]), "\n"), 256).alias("digest"),
    )


def provenance(spark: SparkSession, inputs: str | None = None, commit: str | None = None) -> dict:
    """What a report was made from: digests of the inputs, versions, the commit or a digest in its stead."""
    files = {} if inputs is None else {r["path"]: r["sha256"] for r in file_digests(spark, inputs).collect()}
    made = datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="seconds")
    return {"made_at": made, "commit": commit or "none", "inputs": files, "versions": {"python": platform.python_version(), "pyspark": pyspark.__version__}}


def report_text(title: str, header: dict, body: str) -> str:
    """Markdown with the provenance as a JSON block."""
    return f"# {title}\n\n```json\n{json.dumps(header, indent=2, sort_keys=True)}\n```\n\n{body}\n"


def scan_report(rows: DataFrame) -> DataFrame:
    """One column ``line``: a Markdown table row for each signal of a scan, newest first."""
    text = F.format_string("| %s | %s | %s | %s | %s |", F.col("date").cast("string"), "pattern", F.when(F.col("dir") > 0, "up").otherwise("down"), "status", F.coalesce(F.format_number(100 * F.col("ret"), 2), F.lit("-")))
    return rows.orderBy(F.desc("date"), "pattern").select(text.alias("line"))
