"""Bars made from the driver's tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ZONE = "Asia/Shanghai"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _daily(df: DataFrame, symbol: Column, at: str, value: str, day: Column, dataset: str) -> DataFrame:
    """One partial-aggregated pass: first and last value by time, extremes, count."""
    first, last = F.min_by(value, at), F.max_by(value, at)
    bars = df.groupBy(symbol.cast("string").alias("symbol"), day.alias("trading_date")).agg(first.alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), last.alias("close"), F.count("*").cast("double").alias("volume"))
    at_ = lambda t: F.to_utc_timestamp(F.concat_ws(" ", F.col("trading_date").cast("string"), F.lit(t)), ZONE)
    return bars.select(F.lit(dataset).alias("dataset_id"), "symbol", F.lit("EVT").alias("exchange"), F.lit("EQUITY").alias("asset_class"), F.lit("1d").alias("freq"), "trading_date", at_("09:30:00").alias("bar_start_time"), at_("15:00:00").alias("bar_end_time"), at_("15:00:00").alias("as_of"), "open", "high", "low", "close", "volume", F.lit(None).cast("double").alias("turnover"), F.lit("NONE").alias("adjustment"), F.lit("run").alias("source_run_id"))


def by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """150 daily bars of the five event types."""
    return _daily(table(spark, sf_dir, "events"), F.col("event_type"), "ts", "value", F.to_date("ts"), "events")


def by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of every user, with gaps."""
    return _daily(table(spark, sf_dir, "events"), F.col("user_id"), "ts", "value", F.to_date("ts"), "users")


def by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars of every supplier: a dense panel; of one time the larger price counts last."""
    df = table(spark, sf_dir, "lineitem").select("l_suppkey", F.struct("l_shipdate", "l_extendedprice").alias("k"), "l_extendedprice", F.trunc("l_shipdate", "month").alias("m"))
    return _daily(df, F.col("l_suppkey"), "k", "l_extendedprice", F.col("m"), "suppliers")


def _sql(name: str, symbol: str, source: str, at: str, value: str, day: str) -> str:
    return f"{name} AS (SELECT CAST({symbol} AS varchar) AS symbol, CAST({day} AS date) AS trading_date, arg_min({value}, {at}) AS open, max({value}) AS high, min({value}) AS low, arg_max({value}, {at}) AS close, CAST(count(*) AS double) AS volume FROM {source} GROUP BY 1, 2)"


BY_TYPE = _sql("bars", "event_type", "events", "ts", "value", "ts")
BY_USER = _sql("bars", "user_id", "events", "ts", "value", "ts")
BY_SUPPLIER = _sql("bars", "l_suppkey", "lineitem", "{d: l_shipdate, p: l_extendedprice}", "l_extendedprice", "date_trunc('month', l_shipdate)")
W = "PARTITION BY symbol ORDER BY trading_date"


def div(n: str, d: str) -> str:
    return f"(CASE WHEN {d} = 0 THEN CASE WHEN {n} > 0 THEN 'inf'::double WHEN {n} < 0 THEN '-inf'::double WHEN {n} IS NOT NULL THEN 'nan'::double END ELSE {n} / {d} END)"


def full(x: str, n: int, f: str) -> str:
    frame = f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({x}) OVER {frame} = {n} THEN {f}({x}) OVER {frame} END)"


PREV = f"lag(close, 1) OVER ({W})"
RET = f"({div('close', PREV)} - 1)"
FACTORS = {
    "ret_1": RET,
    "ret_5": f"({div('close', f'lag(close, 5) OVER ({W})')} - 1)",
    "log_ret_1": f"(CASE WHEN close > 0 AND {PREV} > 0 THEN ln(close) - ln({PREV}) WHEN close IS NULL OR {PREV} IS NULL THEN NULL WHEN close = 0 AND {PREV} > 0 THEN '-inf'::double WHEN close > 0 AND {PREV} = 0 THEN 'inf'::double ELSE 'nan'::double END)",
    "ma_5": full("close", 5, "avg"),
    "ma_20": full("close", 20, "avg"),
    "close_over_ma20": div("close", full("close", 20, "avg")),
    "true_range": f"greatest(high - low, abs(high - {PREV}), abs(low - {PREV}))",
}


def factor_sql(bars: str = BY_TYPE) -> str:
    """CTEs bars, one (first factors, and r), f (all)."""
    cols = ", ".join(f"{e} AS {n}" for n, e in FACTORS.items())
    return f"{bars}, one AS (SELECT *, {cols} FROM bars), f AS (SELECT *, {full('ret_1', 20, 'stddev_samp')} AS volatility_20 FROM one)"


def rounded(c: str | Column, digits: int = 6) -> Column:
    """Rounded as SQL's round() of a double does it, so that halves fall alike: F.round() goes by the decimal digits, SQL by the
    product with the power of ten. What is infinite or NaN, there or before, stays as it is."""
    c = F.col(c) if isinstance(c, str) else c
    scaled = c * 10.0**digits
    return F.when(F.isnan(scaled) | (F.abs(scaled) == float("inf")), c).otherwise(F.round(scaled) / 10.0**digits)


def rounded_sql(e: str, digits: int = 6) -> str:
    return f"(CASE WHEN isnan({e}) OR isinf({e}) THEN {e} ELSE round({e}, {digits}) END)"
