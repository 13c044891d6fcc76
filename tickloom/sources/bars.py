"""Bar panels: the long table (symbol, sector, date, open, high, low, close, volume) and what goes with it.

One row per symbol and date; a missing value is NULL, never NaN. Everything downstream partitions by
``symbol`` for time series or by ``date`` for cross-sections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR_SCHEMA = T.StructType(
    [
        T.StructField("Date", T.StringType()),
        *[T.StructField(c, T.StringType()) for c in ("Open", "High", "Low", "Close", "Adj Close", "Volume")],
    ]
)
ACTION_COLUMNS = ("symbol", "ex_date", "action_type", "ratio", "dividend_amount", "source", "source_url", "confidence")
#: Rows from this date on stay sealed unless a caller asks for them.
HOLDOUT = "2001-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of line items: a symbol for each nation, its region the sector, price per unit the price.

    First and last trades of a day go by a full key, so ties cannot change a bar.
    """
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    nations = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    places = (
        table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("symbol"), "n_regionkey")
        .join(table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("sector")), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", "symbol", "sector")
    )
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    trades = items.join(nations, F.col("l_suppkey") == F.col("s_suppkey")).select("s_nationkey", F.to_date("l_shipdate").alias("date"), price.alias("price"), "l_quantity", key.alias("key"))
    # grouped by numbers; names come to the bars, which are far fewer than trades
    bars = trades.groupBy("s_nationkey", "date").agg(
        F.min_by("price", "key").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "key").alias("close"), F.sum("l_quantity").alias("volume")
    )
    return bars.join(places, F.col("s_nationkey") == F.col("n_nationkey")).select("symbol", "sector", "date", "open", "high", "low", "close", "volume")


def tick_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of events: a symbol for each event type."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("symbol"), "value")
    return hourly_bars(events, "ts", "symbol", "value", "event_id")


def hourly_bars(ticks: DataFrame, ts: str, symbol: str, value: str, tie: str) -> DataFrame:
    """symbol, start, open, high, low, close, n for each hour that has ticks."""
    at = F.struct(F.col(ts), F.col(tie))
    return ticks.groupBy(F.col(symbol).alias("symbol"), F.window(ts, "1 hour").alias("w")).agg(
        F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count(F.lit(1)).alias("n")
    ).select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "n")


def finite(column: str) -> F.Column:
    """The column as a double, NULL where it is not a finite number."""
    x = F.col(f"`{column}`").try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def read_bar_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Bars from one CSV file a symbol; the symbol is the file's stem. Unparsable numbers are NULL, of repeated dates the last row counts."""
    raw = spark.read.option("header", True).schema(BAR_SCHEMA).option("enforceSchema", False).csv(pattern)
    raw = raw.select("*", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv$", 1).alias("symbol"), F.col("_metadata.file_block_start").alias("block"))
    rows = raw.select("symbol", F.to_date(F.try_to_timestamp("Date")).alias("date"), *[finite(c).alias(c.lower().replace(" ", "_")) for c in ("Open", "High", "Low", "Close", "Adj Close", "Volume")], F.monotonically_increasing_id().alias("at"))
    last = Window.partitionBy("symbol", "date").orderBy(F.desc("at"))
    return rows.where("date is not null").withColumn("n", F.row_number().over(last)).where("n = 1").drop("n", "at")


def normalised_bars(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean bars, rejected keys): doubles only, no NaN; a (symbol, date) that is there twice is an error and reported."""
    twice = bars.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or symbol is null or date is null")
    numbers = [c for c in ("open", "high", "low", "close", "adj_close", "volume") if c in bars.columns]
    clean = bars.select("symbol", "date", *[finite(c).alias(c) for c in numbers])
    keys = twice.select(F.col("symbol").alias("s"), F.col("date").alias("d"))
    return clean.join(keys, F.col("symbol").eqNullSafe(F.col("s")) & F.col("date").eqNullSafe(F.col("d")), "left_anti"), twice


def normalised_actions(raw: DataFrame) -> DataFrame:
    """The action table from all-string columns: blanks are NULL, texts trimmed, types in lower case, symbols in upper case, bad numbers NULL."""
    text = {c: F.when(F.trim(F.col(c).cast("string")) != "", F.trim(F.col(c).cast("string"))) for c in ACTION_COLUMNS if c in raw.columns}
    text |= {c: F.lit(None).cast("string") for c in ACTION_COLUMNS if c not in raw.columns}
    rows = raw.select(
        F.upper(text["symbol"]).alias("symbol"), F.to_date(F.try_to_timestamp(text["ex_date"])).alias("ex_date"), F.lower(text["action_type"]).alias("action_type"),
        text["ratio"].try_cast("double").alias("ratio"), text["dividend_amount"].try_cast("double").alias("dividend_amount"),
        text["source"].alias("source"), text["source_url"].alias("source_url"), F.upper(text["confidence"]).alias("confidence"),
    )
    return rows.where("symbol is not null and ex_date is not null")


def actions_from_tags(bars: DataFrame, tags: str = "CorpActionTypes") -> DataFrame:
    """symbol, ex_date, action_type from ';'-joined tags of adjusted bars."""
    split = F.explode(F.filter(F.transform(F.split(F.col(tags), ";"), lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    kinds = ("split", "bonus", "demerger", "rights", "dividend")
    return bars.where(F.col(tags).isNotNull()).select("symbol", F.col("date").alias("ex_date"), split.alias("action_type")).where(F.col("action_type").isin(*kinds))


def sealed(bars: DataFrame, allow_holdout: bool = False, holdout: str = HOLDOUT) -> DataFrame:
    """Bars before the holdout, with ``tradeable``: a flat bar without volume, or one that later checks mark, is not."""
    rows = bars if allow_holdout else bars.where(F.col("date") < F.lit(holdout).cast("date"))
    return rows.withColumn("tradeable", tradeable())


def tradeable() -> F.Column:
    """Not a phantom bar: prices there, and not all four equal without volume."""
    flat = (F.col("open") == F.col("high")) & (F.col("high") == F.col("low")) & (F.col("low") == F.col("close"))
    return F.col("open").isNotNull() & F.col("close").isNotNull() & ~(F.coalesce(flat, F.lit(False)) & (F.coalesce(F.col("volume"), F.lit(0.0)) == 0))


def window_of(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars with start <= date <= end."""
    if start is not None:
        bars = bars.where(F.col("date") >= F.lit(start).cast("date"))
    return bars if end is None else bars.where(F.col("date") <= F.lit(end).cast("date"))


def first_success(attempts: DataFrame) -> DataFrame:
    """Of each name's attempts (name, rank, status, ...), the first with status OK."""
    ok = Window.partitionBy("name").orderBy("rank")
    return attempts.where("status = 'OK'").withColumn("n", F.row_number().over(ok)).where("n = 1").drop("n")


def finished_bars(bars: DataFrame, today: F.Column) -> DataFrame:
    """Bars of days that are over; the running day's bar is not one yet."""
    return bars.where(F.col("date") < today)


def with_date(df: DataFrame, order: str, start: str = "2000-01-03") -> DataFrame:
    """``df`` with a ``date``: a column that is named like one, or else business days from ``start`` in ``order``."""
    named = [c for c in df.columns if c.lower() in ("date", "datetime", "timestamp", "time")]
    if named:
        return df.withColumn("date", F.to_date(F.col(named[0])))
    n = F.row_number().over(Window.orderBy(order)) - 1
    day = F.expr(f"date_add(date'{start}', cast(tl_n + 2 * floor(tl_n / 5) as int))")
    return df.withColumn("tl_n", n).withColumn("date", day).drop("tl_n")
