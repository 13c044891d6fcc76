"""What queries and their SQL share: the bar panel in both forms, rounding, the registry."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query, with the SQL of the same rows where there is one."""

    def put(f):
        if name in QUERIES:
            raise ValueError(f"{name} is there already")
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


#: The bar panel in SQL: table ``bars``.
BARS = """bars AS (
  SELECT n_name AS symbol, r_name AS sector, CAST(l_shipdate AS DATE) AS date,
    arg_min(l_extendedprice / l_quantity, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS open,
    max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
    arg_max(l_extendedprice / l_quantity, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS close,
    sum(l_quantity) AS volume
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY n_name, r_name, CAST(l_shipdate AS DATE))"""


def with_bars(rest: str) -> str:
    """``rest`` after the bar panel: more tables and the final SELECT, or the SELECT alone. Rounded zeros lose their sign."""
    rest = re.sub(r"(?<![a-z_])round\(", "0e0 + round(", rest)
    return f"WITH {BARS}{' ' if rest.lstrip().upper().startswith('SELECT') else ', '}{rest}"


def recursive(sql: str) -> str:
    """``sql``, which begins with WITH, with tables that may refer to themselves."""
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """The columns of the result; doubles are rounded, since the order of a sum is not fixed."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in columns])


def sql_rounded(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def sql_ewm(x: str, alpha: float, order: str = "i", part: str = "symbol") -> str:
    """The recursive weighted mean of x over rows numbered from 0 without nulls, in closed form."""
    w = 1 - alpha
    return f"(pow({w!r}, {order}) * sum(CASE WHEN {order} = 0 THEN {x} ELSE {alpha!r} * {x} * pow({w!r}, -{order}) END) OVER (PARTITION BY {part} ORDER BY {order}))"


def sql_ewm_weighted(x: str, alpha: float, order: str = "i", part: str = "symbol") -> str:
    """The mean with weights of age over rows numbered from 0 without nulls."""
    w = 1 - alpha
    frame = f"OVER (PARTITION BY {part} ORDER BY {order})"
    return f"(sum({x} * pow({w!r}, -{order})) {frame} / sum(pow({w!r}, -{order})) {frame})"


def sql_ewm_seeded(x: str, alpha: float, n: int, order: str = "i", part: str = "symbol") -> str:
    """From row n - 1 on: the mean of the first n, then recursive."""
    w = 1 - alpha
    seed = f"CASE WHEN {order} < {n} THEN {x} / {n}.0 * pow({w!r}, {1 - n}) ELSE {alpha!r} * {x} * pow({w!r}, -{order}) END"
    return f"CASE WHEN {order} >= {n - 1} THEN pow({w!r}, {order}) * sum({seed}) OVER (PARTITION BY {part} ORDER BY {order}) END"


#: A small table of corporate actions on the panel's symbols (fixed values): symbol, ex_date, type, ratio, cash, confidence.
ACTION_ROWS = (
    ("NATION_1", "1997-03-10", "split", 2.0, None, "HIGH"),
    ("NATION_1", "1999-06-01", "bonus", 1.5, None, "HIGH"),
    ("NATION_2", "1998-05-05", "demerger", None, None, "UNVERIFIED"),
    ("NATION_3", "1996-07-01", "dividend", None, 5.0, "HIGH"),
    ("NATION_3", "2000-02-14", "dividend", None, 7.5, "HIGH"),
    ("NATION_4", "1999-09-09", "rights", 1.2, None, "RATIO_APPROX"),
    ("NATION_5", "2003-01-01", "split", 5.0, None, "HIGH"),
    ("NATION_6", "1997-11-11", "split", 4.0, None, "HIGH"),
    ("NATION_6", "1997-11-11", "bonus", 2.0, None, "HIGH"),
    ("NATION_7", "1998-08-08", "split", 1.1, None, "DERIVED_DATE"),
)


def actions(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(ACTION_ROWS), "symbol string, d string, action_type string, ratio double, dividend_amount double, confidence string")
    return rows.select("symbol", F.to_date("d").alias("ex_date"), "action_type", "ratio", "dividend_amount", F.lit("table").alias("source"), "confidence")


def _literal(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x!r}"


#: The same in SQL: table ``actions``.
ACTIONS = "actions AS (SELECT symbol, CAST(d AS DATE) AS ex_date, action_type, CAST(ratio AS DOUBLE) AS ratio, CAST(cash AS DOUBLE) AS dividend_amount, confidence FROM (VALUES " + ", ".join(
    "(" + ", ".join(map(_literal, r)) + ")" for r in ACTION_ROWS
) + ") AS v(symbol, d, action_type, ratio, cash, confidence))"
