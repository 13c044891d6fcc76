"""Queries of sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.lineage import kept, shared_folder
from ..sources import sinks
from ..sources.bars import table, trade_bars
from ..streaming import bars as st
from .base import ORACLE_SQL, query, rounded, with_bars
from .strategy import rsi_panel


@query("snk04_manifest", with_bars("SELECT symbol, count(*) AS rows, min(date) AS first, max(date) AS last FROM bars GROUP BY symbol"))
def _(spark, d):
    return sinks.snapshot_manifest(trade_bars(spark, d)).select("symbol", "rows", "first", "last")


@query("snk04_digest_of_digests")
def _(spark, d):
    return sinks.digest_of_digests(sinks.snapshot_manifest(table(spark, d, "orders").select(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date"), "o_totalprice")))


@query("snk05_dashboard_json")
def _(spark, d):
    return sinks.dashboard_json(rounded(trade_bars(spark, d), ["symbol", "date", "open", "close", "volume"]))


@query("snk03_input_digests")
def _(spark, d):
    return sinks.file_digests(spark, f"{d}/nation.parquet")


@query("str_event_bars", """SELECT event_type AS symbol, date_trunc('hour', ts) AS start, round(max(value), 6) AS high, round(min(value), 6) AS low, count(*) AS n FROM events GROUP BY event_type, date_trunc('hour', ts)""")
def _(spark, d):
    """The stream drained into a Parquet sink as windows close: the rows of the batch query. A tick far ahead of all others lets the last windows close."""
    folder = f"{shared_folder(spark)}/event-bars-{uuid.uuid4().hex}"
    events = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("symbol"), F.col("value").cast("double").alias("value"), F.col("event_id").cast("long").alias("event_id"))
    events.write.parquet(f"{folder}/in")
    st.drained(st.windowed_bars(st.event_stream(spark, f"{folder}/in", events.schema), late="1 hour"), folder)
    events.agg((F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"), F.lit("").alias("symbol"), F.lit(0.0).alias("value"), F.lit(-1).cast("long").alias("event_id")).where("ts IS NOT NULL").write.mode("append").parquet(f"{folder}/in")
    st.drained(st.windowed_bars(st.event_stream(spark, f"{folder}/in", events.schema), late="1 hour"), folder)
    out = spark.read.schema("symbol string, start timestamp, open double, high double, low double, close double, n long").parquet(f"{folder}/rows")
    return rounded(out.withColumn("start", F.col("start").cast("timestamp_ntz")), ["symbol", "start", "high", "low", "n"])


@query("str_backtest", ORACLE_SQL["bkt01_positions"])
def _(spark, d):
    """The flagship's rule over a stream: bars and signals arrive in five batches by date, each taken up by a new run from the state that the last one left."""
    folder = f"{shared_folder(spark)}/backtest-{uuid.uuid4().hex}"
    bars = kept(rsi_panel(spark, d).select("symbol", F.col("date").cast("timestamp").alias("date"), "open", "high", "low", "close", "volume", "signal"))
    first, last = bars.agg(F.min("date"), F.max("date")).first()
    step = (last - first) / 5 if last else None
    for k in range(5 if last else 0):
        part = bars.where((F.col("date") >= F.lit(first + k * step)) & ((F.col("date") < F.lit(first + (k + 1) * step)) if k < 4 else F.lit(True)))
        part.write.mode("append").parquet(f"{folder}/in")
        st.drained(st.backtest_stream(st.event_stream(spark, f"{folder}/in", bars.schema), ends_after="3650 days"), folder)
    # a bar ten years on ends all series
    bars.agg((F.max("date") + F.expr("INTERVAL 3660 DAYS")).alias("date")).where("date IS NOT NULL").write.mode("append").parquet(f"{folder}/in")
    st.drained(st.backtest_stream(st.event_stream(spark, f"{folder}/in", bars.schema), ends_after="3650 days"), folder)
    rows = spark.read.schema("symbol string, date timestamp, position int, gross_ret double, net_ret double, exit boolean").parquet(f"{folder}/rows")
    return rounded(rows.withColumn("date", F.to_date("date")), ["symbol", "date", "position", "gross_ret", "net_ret", "exit"])


@query("str_sessions", """WITH g AS (SELECT event_type AS symbol, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)), r AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT symbol, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM r GROUP BY symbol, k""")
def _(spark, d):
    return st.sessions(table(spark, d, "events").select("ts", F.col("event_type").alias("symbol"), "event_id"))
