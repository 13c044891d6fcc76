"""Bars and state machines over streams; each also runs on a static table, with the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.bars import tradeable


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def windowed_bars(ticks: DataFrame, width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """symbol, start, open, high, low, close, n of ticks (ts, symbol, value, event_id). Ticks later than ``late`` are left out of a stream."""
    at = F.struct("ts", "event_id")
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        ticks.withWatermark("ts", late)
        .groupBy("symbol", window.alias("w"))
        .agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).alias("n"))
        .select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "n")
    )


def sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """symbol, start, stop, n: runs of ticks without a gap."""
    w = F.session_window("ts", gap).alias("w")
    return ticks.withWatermark("ts", late).groupBy("symbol", w).agg(F.count(F.lit(1)).alias("n")).select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def distinct_ticks(ticks: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event once; state older than the watermark goes."""
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def hysteresis_stream(bars: DataFrame, value: str, enter_below: float, exit_above: float) -> DataFrame:
    """symbol, start, state: the 0/1 machine of a rule over a stream of bars, one number of state a symbol. Bars of a batch go by their start."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("start")
        out = []
        for x in rows[value]:
            now = 0 if pd.isna(x) else 1 if x < enter_below else 0 if x > exit_above else now
            out.append(now)
        state.update((now,))
        yield pd.DataFrame({"symbol": key[0], "start": rows["start"], "state": out})

    return bars.groupBy("symbol").applyInPandasWithState(step, "symbol string, start timestamp, state int", "now int", "append", GroupStateTimeout.NoTimeout)


class _Held(StatefulProcessor):
    """One symbol's position, mark and equity between batches, and the last bar, whose row waits for the next one."""

    def __init__(self, cost: float, late_ms: int):
        self.cost, self.late_ms = cost, late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # wanted: the last bar's signal, filled at the next bar that can be traded
        self.now = handle.getValueState("now", "held int, wanted int, mark double, gross double, net double, bars long")
        self.last = handle.getValueState("last", "at long, position int, gross_ret double, leaves boolean, entry boolean")

    def _row(self, key: str, bar: tuple, held: list, forced: bool) -> tuple:
        """The finished row of ``bar``, whose returns enter the equity here."""
        at, position, gross, leaves, entry = bar
        leaves = bool(leaves or (forced and position == 1))
        net = (1 + gross) * (1 - self.cost) - 1 if leaves else gross
        held[3], held[4] = held[3] * (1 + gross), held[4] * (1 + net)
        return key, at, int(position), float(gross), float(net), held[3], held[4], bool(entry), leaves

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        bars = pd.concat(list(rows), ignore_index=True).sort_values("at", kind="stable")
        held = list(self.now.get()) if self.now.exists() else [0, 0, None, 1.0, 1.0, 0]
        waits = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for at, first, close, trades, signal in zip(bars["at"], bars["open"], bars["close"], bars["can"], bars["signal"]):
            if waits is not None:
                if at <= waits[0]:
                    continue  # comes after a bar that has been decided: late, as a watermark would say
                out.append(self._row(key[0], waits, held, False))
            position, mark, gross = held[1] if trades else held[0], held[2], 0.0
            enters, leaves = position == 1 and held[0] == 0, position == 0 and held[0] == 1
            if enters:
                gross, mark = close / first - 1, close
            elif position == 1 and not pd.isna(close):
                gross, mark = close / mark - 1, close
            elif leaves:
                gross = first / mark - 1
            waits = (int(at), position, 0.0 if pd.isna(gross) else float(gross), leaves, enters)
            held[0], held[1], held[2], held[5] = position, 0 if pd.isna(signal) else int(signal), None if mark is None else float(mark), held[5] + 1
        self.now.update(tuple(held))
        if waits is not None:
            self.last.update(waits)
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer(waits[0] // 1000 + self.late_ms)
        if out:
            yield pd.DataFrame(out, columns=_RUN_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """No bar came for so long: the last one ends the series, and an open position is closed on it by force."""
        held = list(self.now.get())
        yield pd.DataFrame([self._row(key[0], tuple(self.last.get()), held, True)], columns=_RUN_NAMES)
        self.now.clear()
        self.last.clear()

    def close(self) -> None:
        pass


_RUN = "symbol string, at long, position int, gross_ret double, net_ret double, gross_equity double, net_equity double, entry boolean, exit boolean"
_RUN_NAMES = [c.split()[0] for c in _RUN.split(", ")]


def backtest_stream(bars: DataFrame, signal: str = "signal", cost: float = 0.0035, ends_after: str = "30 days", late: str = "0 seconds") -> DataFrame:
    """The rows of ``operators.backtest.backtest`` over a stream of bars (symbol, date as timestamp, open, high, low, close, volume, signal).

    State is six numbers and one bar a symbol. A bar's row comes out with the symbol's next bar, as only then is it known not to be the last one; a
    symbol without a bar for ``ends_after`` of event time ends, its open position is closed by force, and later bars of its name begin a new series.
    Bars of a batch go by date; a bar not after the last one seen is late and left out. Needs the RocksDB state store.
    """
    can = tradeable() & F.col("open").isNotNull() & F.col("close").isNotNull()
    shaped = bars.withWatermark("date", late).select("symbol", "date", F.unix_micros("date").alias("at"), F.col("open").cast("double").alias("open"), F.col("close").cast("double").alias("close"), F.coalesce(can, F.lit(False)).alias("can"), F.col(signal).cast("int").alias("signal"))
    wait = int(pd.Timedelta(ends_after).total_seconds() * 1000)
    rows = shaped.groupBy("symbol").transformWithStateInPandas(_Held(cost, wait), _RUN, "append", "eventTime")
    return rows.select("symbol", F.timestamp_micros("at").alias("date"), *_RUN_NAMES[2:])


def drained(stream: DataFrame, folder: str) -> None:
    """All there is now goes through ``stream`` once and is appended to ``folder``/rows; what it knows stays in ``folder``/state for the next time."""
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key)
    conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(key, before)
