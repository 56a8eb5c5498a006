"""Registered queries of the engine's own operators, with the SQL that each must match."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, time, timedelta
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import average_rank
from ..hashing import content_hash
from ..plans.research import cropped_input, cropped_output
from ..operators import coverage, datasets, evaluation, factors, features, labels, portfolio, quality
from ..sources import normalize

from . import runs
from .bars import BY_SUPPLIER, BY_TYPE, BY_USER, FACTORS, W, ZONE, by_supplier, by_type, by_user, div, factor_sql, full, rounded, rounded_sql, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NAMES = [*FACTORS, "volatility_20"]
CONFIG = factors.RunConfig("run-1", "set-1", "events", "1d", ("tessera://bars?dataset_id=events",))


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def _all() -> list[factors.Factor]:
    return [factors.builtin().get(n) for n in NAMES]


def _day(df: DataFrame) -> DataFrame:
    return df.withColumn("trading_date", F.col("trading_date").cast("string"))


# -- bars and factors
def _bars_sql(cte: str) -> str:
    return f"WITH {cte} SELECT symbol, CAST(trading_date AS varchar) AS trading_date, open, high, low, close, volume FROM bars"


for _name, _bars, _cte in (("bars_daily", by_type, BY_TYPE), ("bars_by_user", by_user, BY_USER), ("bars_by_supplier", by_supplier, BY_SUPPLIER)):
    query(_bars_sql(_cte), _name)(lambda spark, sf_dir, b=_bars: _day(b(spark, sf_dir).select("symbol", "trading_date", "open", "high", "low", "close", "volume")))


def _factor_query(names: list[str], bars) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = factors.run_factors(bars(spark, sf_dir), [factors.builtin().get(n) for n in names])
        return _day(out.select("symbol", "trading_date", *[rounded(n).alias(n) for n in names]))

    return run


def _factor_oracle(names: list[str], cte: str) -> str:
    return f"WITH {factor_sql(cte)} SELECT symbol, CAST(trading_date AS varchar) AS trading_date, {', '.join(f'{rounded_sql(n)} AS {n}' for n in names)} FROM f"


for _name in NAMES:
    query(_factor_oracle([_name], BY_TYPE), _name)(_factor_query([_name], by_type))
query(_factor_oracle(NAMES, BY_TYPE), "builtin_factors")(_factor_query(NAMES, by_type))
query(_factor_oracle(NAMES, BY_USER), "builtin_factors_by_user")(_factor_query(NAMES, by_user))
query(_factor_oracle(NAMES, BY_SUPPLIER), "builtin_factors_by_supplier")(_factor_query(NAMES, by_supplier))


@query(f"WITH {BY_TYPE}, r AS (SELECT *, {FACTORS['ret_1']} AS r FROM bars) SELECT symbol, CAST(trading_date AS varchar) AS trading_date, round({full('r', 3, 'avg')} * 2 + 1, 6) AS smooth FROM r")
def dsl_nested_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = factors.call("op.rolling_mean", factors.call("op.pct_change", factors.field_("close")), window=3) * 2 + 1
    f = factors.Factor(factors.Spec("smooth", mode=factors.Mode.OPERATOR_GRAPH), e)
    return _day(factors.run_factors(by_type(spark, sf_dir), [f]).select("symbol", "trading_date", rounded("smooth").alias("smooth")))


# -- features
_LONG = "long AS (" + " UNION ALL ".join(f"SELECT symbol, trading_date, '{n}' AS output_field, {n} AS v, row_number() OVER ({W}) - 1 >= {factors.builtin().get(n).spec.warmup_bars} AS warm FROM f" for n in NAMES) + ")"


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.long_values(factors.run_factors(by_type(spark, sf_dir), _all()), _all(), CONFIG)


@query(f"WITH {factor_sql()}, {_LONG} SELECT symbol, strftime(trading_date, '%Y-%m-%d') AS trading_date, output_field, {rounded_sql('v')} AS value_float, CASE WHEN v IS NULL THEN 'null' ELSE 'float' END AS value_kind, warm AS warmup_complete FROM long")
def feature_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(spark, sf_dir).select("symbol", F.date_format("as_of", "yyyy-MM-dd").alias("trading_date"), "output_field", rounded("value_float").alias("value_float"), "value_kind", "warmup_complete")


@query(f"WITH {factor_sql()}, {_LONG} SELECT output_field, count(*) FILTER (WHERE NOT warm) AS cold, count(*) FILTER (WHERE NOT warm AND v IS NULL) AS cold_null, count(*) AS n FROM long GROUP BY output_field")
def warmup_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(spark, sf_dir).groupBy("output_field").agg(F.count_if(~F.col("warmup_complete")).alias("cold"), F.count_if(~F.col("warmup_complete") & F.col("value_float").isNull()).alias("cold_null"), F.count("*").alias("n"))


@query(
    f"""WITH {factor_sql()}, {_LONG}, s AS (SELECT output_field, count(*)::double AS n, count(*) FILTER (WHERE v IS NULL)::double AS nulls, count(*) FILTER (WHERE NOT warm)::double AS cold, count(*) FILTER (WHERE NOT warm AND v IS NULL)::double AS dropped, count(DISTINCT symbol)::double AS symbols, count(DISTINCT symbol) FILTER (WHERE v IS NOT NULL)::double AS covered, count(*) FILTER (WHERE isnan(v) OR isinf(v))::double AS extreme FROM long GROUP BY 1)
SELECT output_field, m.metric, round(m.value, 6) AS value, CASE WHEN m.metric = 'extreme_value_count' AND m.value > 0 THEN 'ERROR' WHEN m.metric = 'null_ratio' AND m.value >= 1 THEN 'WARNING' ELSE 'INFO' END AS severity FROM (SELECT output_field, unnest([
{{metric: 'row_count', value: n}}, {{metric: 'null_ratio', value: nulls / n}}, {{metric: 'warmup_incomplete_count', value: cold}}, {{metric: 'symbol_count', value: symbols}}, {{metric: 'symbol_coverage_ratio', value: covered / symbols}}, {{metric: 'warmup_drop_count', value: dropped}}, {{metric: 'duplicate_key_count', value: 0::double}}, {{metric: 'extreme_value_count', value: extreme}}, {{metric: 'future_leakage_count', value: 0::double}}]) AS m FROM s)"""
)
def feature_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.quality(_long(spark, sf_dir)).select("output_field", "metric", rounded("value").alias("value"), "severity")


@query(
    f"WITH {factor_sql()}, {_LONG} SELECT symbol, strftime(trading_date, '%Y-%m-%d') AS trading_date, string_agg(output_field, ',' ORDER BY output_field) AS fields, count(v) AS n_values, round(max(v) FILTER (WHERE output_field = 'ma_5'), 6) AS ma_5, bool_and(warm) AS warmup_complete FROM long GROUP BY symbol, trading_date"
)
def snapshot_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.size(F.filter(F.map_values("features"), lambda v: v.isNotNull())).cast("long")
    return features.snapshots(_long(spark, sf_dir)).select(*_out(), F.array_join(F.array_sort(F.map_keys("features")), ",").alias("fields"), values.alias("n_values"), rounded(F.try_element_at("features", F.lit("ma_5"))).alias("ma_5"), "warmup_complete")


@query()
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = by_type(spark, sf_dir)
    return spark.createDataFrame([("bars", content_hash(bars)), ("bars_shuffled", content_hash(bars.repartition(7, "close")))], "name string, hash string")


_PROBE = [factors.Factor(factors.Spec("peek", forward_bars=1), lambda w: F.lead("close").over(w)), factors.builtin().get("ret_1")]


@query(
    f"""WITH {BY_TYPE}, days AS (SELECT trading_date, sum(count(*)) OVER (ORDER BY trading_date) AS upto FROM bars GROUP BY 1), usable AS (SELECT trading_date, row_number() OVER (ORDER BY trading_date) - 1 AS i, count(*) OVER () AS n FROM days WHERE upto >= 20 AND trading_date < (SELECT max(trading_date) FROM bars)),
cuts AS (SELECT trading_date AS cut FROM usable WHERE i IN (SELECT CAST(round_even(k * (n - 1) / 4.0, 0) AS bigint) FROM range(5) t(k))),
full_ AS (SELECT *, lead(close) OVER ({W}) AS peek, {FACTORS['ret_1']} AS ret_1 FROM bars),
tail AS (SELECT f.*, cut, row_number() OVER (PARTITION BY cut, symbol ORDER BY trading_date DESC) AS back FROM full_ f JOIN cuts ON trading_date <= cut),
pre AS (SELECT b.symbol, b.trading_date, cut, lead(close) OVER (PARTITION BY cut, symbol ORDER BY trading_date) AS peek, {div('close', 'lag(close) OVER (PARTITION BY cut, symbol ORDER BY trading_date)')} - 1 AS ret_1 FROM bars b JOIN cuts ON trading_date <= cut),
pair AS (SELECT t.cut, t.peek IS DISTINCT FROM p.peek AS a, t.ret_1 IS DISTINCT FROM p.ret_1 AS b FROM tail t JOIN pre p USING (symbol, trading_date, cut) WHERE back <= 20),
s AS (SELECT 'peek' AS output_field, count(*) FILTER (WHERE a)::double AS bad, count(DISTINCT cut)::double AS cuts, count(*)::double AS n FROM pair UNION ALL SELECT 'ret_1', count(*) FILTER (WHERE b)::double, count(DISTINCT cut)::double, count(*)::double FROM pair)
SELECT output_field, m.metric, round(m.value, 6) AS value FROM (SELECT output_field, unnest([{{metric: 'prefix_invariance_violation_count', value: bad}}, {{metric: 'prefix_probe_cutpoint_count', value: cuts}}, {{metric: 'prefix_probe_compared_value_count', value: n}}, {{metric: 'prefix_probe_warning_count', value: 0::double}}, {{metric: 'prefix_probe_changed_ratio', value: bad / n}}]) AS m FROM s)"""
)
def prefix_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics, _ = features.probe(by_type(spark, sf_dir), _PROBE)
    return metrics.select("output_field", "metric", rounded("value").alias("value"))


# -- labels and datasets
_LABEL = labels.ForwardReturn("labels", "fwd_1", 1)
_FWD = f"CASE WHEN close <> 0 THEN (lead(close) OVER ({W}) - close) / close END"
_LAB = f"lab AS (SELECT symbol, trading_date, {_FWD} AS y FROM bars)"


def _labels(spark: SparkSession, sf_dir: str, bars=by_user) -> DataFrame:
    return labels.forward_returns(bars(spark, sf_dir), _LABEL)


@query(f"WITH {BY_USER}, {_LAB} SELECT symbol, CAST(trading_date AS varchar) AS trading_date, round(y, 6) AS value_float FROM lab")
def forward_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).select("symbol", F.date_format("as_of", "yyyy-MM-dd").alias("trading_date"), rounded("value_float").alias("value_float"))


@query(
    f"""WITH {BY_USER}, {_LAB}, s AS (SELECT count(*) AS n, count(*) FILTER (WHERE y IS NULL) AS nulls, count(DISTINCT symbol) AS symbols, min(trading_date) AS lo, max(trading_date) AS hi FROM lab)
SELECT 'fwd_1' AS label_id, m.metric, m.value FROM (SELECT unnest([{{metric: 'row_count', value: n::double}}, {{metric: 'null_ratio', value: round(nulls / n, 6)}}, {{metric: 'symbol_count', value: symbols::double}}, {{metric: 'as_of_min', value: (lo - date '1970-01-01')::double}}, {{metric: 'as_of_max', value: (hi - date '1970-01-01')::double}}, {{metric: 'duplicate_key_count', value: 0::double}}]) AS m FROM s)"""
)
def label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = labels.quality(_labels(spark, sf_dir))
    days = F.unix_date(F.to_date(F.substring("value", 1, 10))).cast("double")
    return m.select("label_id", "metric", F.when(F.col("metric").startswith("as_of"), days).otherwise(F.col("value").try_cast("double")).alias("value"))


def _snapshots(spark: SparkSession, sf_dir: str, names: list[str], bars=by_user) -> DataFrame:
    found = [factors.builtin().get(n) for n in names]
    return features.snapshots(features.long_values(factors.run_factors(bars(spark, sf_dir), found), found, CONFIG))


def _matrices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Features and labels of all users' bars."""
    return datasets.feature_matrix(_snapshots(spark, sf_dir, ["ret_1", "ma_5"]), ["ma_5", "ret_1"]), datasets.label_matrix(_labels(spark, sf_dir), ["fwd_1"])


def _ready(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Features that are warm and labels that are there: a user's first bars have only a label, the last one only features."""
    x, y = _matrices(spark, sf_dir)
    return x.where("warmup_complete"), y.where("fwd_1 IS NOT NULL")


_XY = f"{BY_USER}, {_LAB}, x AS (SELECT symbol, trading_date, {FACTORS['ret_1']} AS ret_1, {FACTORS['ma_5']} AS ma_5, row_number() OVER ({W}) > 4 AS warm FROM bars), xf AS (SELECT * FROM x WHERE warm), yl AS (SELECT * FROM lab WHERE y IS NOT NULL)"


def _out() -> list:
    return [F.col("symbol"), F.date_format("as_of", "yyyy-MM-dd").alias("trading_date")]



@query(f"WITH {_XY} SELECT symbol, CAST(trading_date AS varchar) AS trading_date, {rounded_sql('ret_1')} AS ret_1, round(ma_5, 6) AS ma_5, round(y, 6) AS fwd_1 FROM xf JOIN yl USING (symbol, trading_date)")
def train_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.join(*_ready(spark, sf_dir)).select(*_out(), rounded("ret_1").alias("ret_1"), rounded("ma_5").alias("ma_5"), rounded("fwd_1").alias("fwd_1"))


@query(f"WITH {_XY} SELECT symbol, CAST(trading_date AS varchar) AS trading_date FROM xf ANTI JOIN yl USING (symbol, trading_date)")
def train_feature_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.only_features(*_ready(spark, sf_dir)).select(*_out())


@query(f"WITH {_XY} SELECT symbol, CAST(trading_date AS varchar) AS trading_date FROM yl ANTI JOIN xf USING (symbol, trading_date)")
def train_label_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.only_labels(*_ready(spark, sf_dir)).select(*_out())


@query(f"WITH {_XY} SELECT symbol, CAST(trading_date AS varchar) AS trading_date, round(y, 6) AS fwd_1 FROM x JOIN lab USING (symbol, trading_date) WHERE warm AND y IS NOT NULL")
def matrix_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = datasets.filtered(datasets.join(*_matrices(spark, sf_dir)), ["fwd_1"])
    return kept.select(*_out(), rounded("fwd_1").alias("fwd_1"))


@query(
    f"WITH {BY_USER}, days AS (SELECT trading_date AS t, row_number() OVER (ORDER BY trading_date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT trading_date FROM bars)), k AS (SELECT k, 10 + 2 + 3 * k AS test FROM range(100) r(k) WHERE 12 + 3 * k + 3 <= (SELECT max(n) FROM days)), "
    "parts AS (SELECT k, 'train' AS part, test - 12 AS a, test - 2 AS b FROM k UNION ALL SELECT k, 'purge', test - 2, test - 1 FROM k UNION ALL SELECT k, 'embargo', test - 1, test FROM k UNION ALL SELECT k, 'test', test, test + 3 FROM k) "
    "SELECT printf('fold-%03d', k) AS fold_id, part, strftime(min(t), '%Y-%m-%d') AS first, strftime(max(t), '%Y-%m-%d') AS last, count(*) AS n_periods FROM parts JOIN days ON i >= a AND i < b GROUP BY k, part"
)
def walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = datasets.folds(by_user(spark, sf_dir).select("as_of"), datasets.SplitPlan(10, 3, purge=1, embargo=1))
    return found.select("fold_id", "part", F.date_format("first", "yyyy-MM-dd").alias("first"), F.date_format("last", "yyyy-MM-dd").alias("last"), "n_periods")


# -- evaluation
_REQUEST = evaluation.Request(("ret_1",), "fwd_1")
_CROSS = f"""{BY_USER}, {_LAB}, x AS (SELECT symbol, trading_date, {FACTORS['ret_1']} AS x FROM bars), p AS (SELECT symbol, trading_date, x, y, x IS NOT NULL AND y IS NOT NULL AND isfinite(x) AND isfinite(y) AS ok FROM x JOIN lab USING (symbol, trading_date)),
g AS (SELECT trading_date, count(*) FILTER (WHERE ok) AS n, coalesce(min(x) FILTER (WHERE ok) < max(x) FILTER (WHERE ok) AND min(y) FILTER (WHERE ok) < max(y) FILTER (WHERE ok), false) AS varied FROM p GROUP BY 1),
r AS (SELECT *, rank() OVER (PARTITION BY trading_date ORDER BY x) + (count(*) OVER (PARTITION BY trading_date, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY trading_date ORDER BY y) + (count(*) OVER (PARTITION BY trading_date, y) - 1) / 2.0 AS ry, ((row_number() OVER (PARTITION BY trading_date ORDER BY x, symbol) - 1) * 5) // count(*) OVER (PARTITION BY trading_date) + 1 AS bucket, count(*) OVER (PARTITION BY trading_date) AS n FROM p WHERE ok),
status AS (SELECT trading_date, n, CASE WHEN n < 30 THEN 'INSUFFICIENT_SAMPLE' WHEN NOT varied THEN 'CONSTANT_INPUT' ELSE 'COMPUTED' END AS status FROM g),
b AS (SELECT trading_date, bucket, avg(y) AS mean, count(*) AS sample_count, any_value(n) AS n FROM r WHERE n >= 30 GROUP BY 1, 2)"""


def _ic_sql(x: str, y: str) -> str:
    return f"WITH {_CROSS}, c AS (SELECT trading_date, corr({x}, {y}) AS v FROM r GROUP BY 1) SELECT strftime(s.trading_date, '%Y-%m-%d') AS trading_date, round(CASE WHEN status = 'COMPUTED' THEN v END, 6) AS value, n AS sample_count, status FROM status s LEFT JOIN c USING (trading_date)"


def _evaluated(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    out = evaluation.evaluate(_REQUEST, _snapshots(spark, sf_dir, ["ret_1"]), _labels(spark, sf_dir), checked=True)
    return out.where(F.col("metric") == metric).select(F.date_format("as_of", "yyyy-MM-dd").alias("trading_date"), "bucket", rounded("value").alias("value"), "sample_count", "status")


@query(_ic_sql("x", "y"))
def pearson_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir, "PEARSON_IC").drop("bucket")


@query(_ic_sql("rx", "ry"))
def rank_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir, "SPEARMAN_RANK_IC").drop("bucket")


@query(f"WITH {_CROSS} SELECT strftime(trading_date, '%Y-%m-%d') AS trading_date, CAST(bucket AS bigint) AS bucket, round(mean, 6) AS value, sample_count, 'COMPUTED' AS status FROM b")
def quantile_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir, "QUANTILE_RETURN")


@query(f"WITH {_CROSS} SELECT strftime(trading_date, '%Y-%m-%d') AS trading_date, round(arg_max(mean, bucket) - arg_min(mean, bucket), 6) AS value, any_value(n) AS sample_count, 'COMPUTED' AS status FROM b GROUP BY trading_date")
def long_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir, "LONG_SHORT_RETURN").drop("bucket")


@query(f"WITH {BY_USER} SELECT symbol, CAST(trading_date AS varchar) AS trading_date, CAST(rank() OVER (PARTITION BY trading_date ORDER BY volume) + (count(*) OVER (PARTITION BY trading_date, volume) - 1) / 2.0 AS double) AS average_rank FROM bars")
def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = by_user(spark, sf_dir)
    return _day(bars.select("symbol", "trading_date", average_rank("volume", ["trading_date"]).cast("double").alias("average_rank")))


# -- portfolio and backtest
def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_user(spark, sf_dir).select("dataset_id", "freq", "as_of", "symbol", F.col("volume").alias("score"), F.col("as_of").alias("available_at"))


_POS = "SELECT symbol, trading_date, row_number() OVER (PARTITION BY trading_date ORDER BY volume DESC, symbol) - 1 AS pos, count(*) OVER (PARTITION BY trading_date) AS n FROM bars"


def _weights_sql(which: str) -> str:
    return f"WITH {BY_USER}, p AS ({_POS}), c AS (SELECT * FROM p WHERE {which}) SELECT symbol, strftime(trading_date, '%Y-%m-%d') AS trading_date, round(1.0 / count(*) OVER (PARTITION BY trading_date), 6) AS weight FROM c"


def _weights(spark: SparkSession, sf_dir: str, config: portfolio.PortfolioConfig) -> DataFrame:
    return portfolio.weights(_scores(spark, sf_dir), config, checked=True).select(*_out(), rounded("weight").alias("weight"))


@query(_weights_sql("pos < 10"))
def top_k_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir, portfolio.PortfolioConfig())


@query(_weights_sql("5 - (pos * 5) // n = 5"))
def top_quantile_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir, portfolio.PortfolioConfig(portfolio.Selection.TOP_QUANTILE))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the event types, each with a target for every tenth day."""
    bars = by_type(spark, sf_dir)
    every = F.dayofmonth("as_of") % 10 == 1
    goal = lambda run, weight: portfolio.weights(bars.where(every).select("dataset_id", "freq", "as_of", "symbol", F.col("close").alias("score"), F.col("as_of").alias("available_at")), portfolio.PortfolioConfig(k=2, gross=weight), checked=True).withColumn("backtest_run_id", F.lit(run))
    config = portfolio.BacktestConfig(costs=portfolio.Costs(Decimal("0.001"), Decimal("0.002")))
    return portfolio.backtest(bars, goal("full", 1.0).union(goal("half", 0.5)), config)


@query()
def backtest_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where("kind = 'FILL'")


@query()
def backtest_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where("kind = 'NAV'")


@query()
def backtest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.analytics(_events(spark, sf_dir), 1_000_000.0)


@query(f"WITH {BY_TYPE}, p AS (SELECT symbol, trading_date, close AS nav, max(close) OVER ({W}) AS peak FROM bars) SELECT symbol AS backtest_run_id, CAST(trading_date AS varchar) AS trading_date, round(peak, 6) AS peak, round(CASE WHEN peak > 0 THEN (peak - nav) / peak ELSE 0 END, 6) AS drawdown FROM p")
def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = by_type(spark, sf_dir).select(F.col("symbol").alias("backtest_run_id"), "trading_date", F.col("close").alias("nav"))
    return _day(portfolio.drawdowns(nav).select("backtest_run_id", "trading_date", rounded("peak").alias("peak"), rounded("drawdown").alias("drawdown")))


# -- scans, crops and ingestion
@query(f"WITH {factor_sql(BY_USER)}, m AS (SELECT DISTINCT symbol, trading_date FROM bars WHERE volume >= 2) SELECT symbol, CAST(trading_date AS varchar) AS trading_date, {rounded_sql('ret_1')} AS ret_1 FROM f SEMI JOIN m USING (symbol, trading_date) WHERE trading_date BETWEEN (SELECT min(trading_date) + 10 FROM bars) AND (SELECT min(trading_date) + 20 FROM bars)")
def universe_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each day are the users with two events on it; the look-back stays in, the crop comes after the windows."""
    bars = by_user(spark, sf_dir)
    first = bars.agg(F.min("trading_date")).first()[0]
    at = lambda n: datetime.combine(first or date(2024, 1, 1), time()) + timedelta(days=n)
    members = bars.where("volume >= 2").select("trading_date", "symbol")
    out = factors.run_factors(cropped_input(bars, members, (), at(21)), [factors.builtin().get("ret_1")])
    return _day(cropped_output(out, members, at(10)).select("symbol", "trading_date", rounded("ret_1").alias("ret_1")))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute bars of events as curated bars; every eight of them change places with the next eight: some are repeated, late, or broken."""
    ev = table(spark, sf_dir, "events")
    minute = F.date_trunc("minute", "ts").cast("timestamp")
    cents = F.round(F.col("value"), 2)
    return ev.select(F.lit("events").alias("dataset_id"), F.col("event_type").alias("symbol"), F.lit("1m").alias("freq"), F.lit("NONE").alias("adjustment"), F.to_date("ts").alias("trading_date"), minute.alias("bar_start_time"), (minute + F.expr("INTERVAL 1 MINUTE")).alias("bar_end_time"), cents.cast("string").alias("open"), F.when(F.col("user_id") % 7 == 0, F.lit("-1")).otherwise(cents.cast("string")).alias("high"), cents.cast("string").alias("low"), cents.cast("string").alias("close"), F.when(F.col("user_id") % 11 == 0, F.lit("x")).otherwise(F.lit("5")).alias("volume"), F.col("event_id").bitwiseXOR(F.lit(8)).alias("source_row_id"))


@query("SELECT xor(event_id, 8) AS source_row_id, event_type AS symbol FROM (SELECT *, row_number() OVER (PARTITION BY event_type, date_trunc('minute', ts) ORDER BY xor(event_id, 8)) AS n FROM events) WHERE n > 1")
def dup_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_bars(_raw(spark, sf_dir)).select("source_row_id", "symbol")


@query("SELECT xor(event_id, 8) AS source_row_id, event_type AS symbol FROM events WHERE user_id % 7 = 0 AND round(value, 2) > -1")
def invalid_ohlc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).where(~quality.valid_ohlc()).select("source_row_id", "symbol")


@query("SELECT xor(event_id, 8) AS source_row_id, event_type AS symbol FROM (SELECT *, lag(date_trunc('minute', ts)) OVER (PARTITION BY event_type ORDER BY xor(event_id, 8)) AS last FROM events) WHERE date_trunc('minute', ts) < last")
def out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.out_of_order(_raw(spark, sf_dir)).select("source_row_id", "symbol")


@query(
    "WITH m AS (SELECT event_id, event_type, CAST(ts AS date) AS d, date_trunc('minute', ts) AS s FROM events), g AS (SELECT *, epoch(s)::bigint - epoch(lag(s) OVER (PARTITION BY event_type, d ORDER BY s, xor(event_id, 8)) + INTERVAL 1 MINUTE)::bigint AS gap FROM m) "
    "SELECT event_type AS symbol, CAST(d AS varchar) AS trading_date, count(*) FILTER (WHERE gap < 0) AS overlaps, count(*) FILTER (WHERE gap > 0) AS gaps, CAST(coalesce(sum(greatest(1, gap // 60)) FILTER (WHERE gap > 0), 0) AS bigint) AS missing FROM g WHERE gap <> 0 GROUP BY 1, 2"
)
def window_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = quality.window_gaps(_raw(spark, sf_dir))
    return _day(g.groupBy("symbol", "trading_date").agg(F.count_if(F.col("gap_s") < 0).alias("overlaps"), F.count_if(F.col("gap_s") > 0).alias("gaps"), F.coalesce(F.sum(F.when(F.col("gap_s") > 0, F.col("missing"))), F.lit(0)).cast("long").alias("missing")))


@query(
    "SELECT code, count(*) AS n FROM (SELECT 'DUPLICATE_BAR' AS code FROM (SELECT row_number() OVER (PARTITION BY event_type, date_trunc('minute', ts) ORDER BY xor(event_id, 8)) AS n FROM events) WHERE n > 1 UNION ALL SELECT 'INVALID_OHLC' FROM events WHERE user_id % 7 = 0 AND round(value, 2) > -1 UNION ALL SELECT 'NEGATIVE_VOLUME' FROM events WHERE user_id % 11 = 0 "
    "UNION ALL SELECT 'OUT_OF_ORDER_BAR' FROM (SELECT date_trunc('minute', ts) AS s, lag(date_trunc('minute', ts)) OVER (PARTITION BY event_type ORDER BY xor(event_id, 8)) AS last FROM events) WHERE s < last UNION ALL SELECT CASE WHEN gap < 0 THEN 'OVERLAPPING_BAR_WINDOW' ELSE 'MISSING_BAR_WINDOW' END FROM (SELECT epoch(s)::bigint - epoch(lag(s) OVER (PARTITION BY event_type, d ORDER BY s, xor(event_id, 8)) + INTERVAL 1 MINUTE)::bigint AS gap FROM (SELECT event_id, event_type, CAST(ts AS date) AS d, date_trunc('minute', ts) AS s FROM events)) WHERE gap <> 0) GROUP BY 1"
)
def bar_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check_bars(_raw(spark, sf_dir)).groupBy("code").agg(F.count("*").alias("n"))


@query("SELECT upper(event_type) AS symbol, 'EVT' AS exchange, 'EQUITY' AS asset_class, CAST(CAST(ts AS date) AS varchar) AS trading_date, strftime(ts, '%Y-%m-%d %H:%M') AS bar_start, strftime(ts + INTERVAL 5 MINUTE, '%Y-%m-%d %H:%M') AS bar_end, 'raw://src/run/' || event_id AS raw_ref FROM events")
def normalize_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw text rows with aware times, through the bar normaliser."""
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit(" "), F.col("event_type")).alias("code"), F.lit("evt ").alias("exchange"), text.alias("time"), F.col("value").cast("string").alias("open"), F.col("event_id").alias("source_row_id"))
    out = normalize.bars(rows, normalize.BarSource("events", "src", "5m", mapping={"symbol": "code", "datetime": "time"}), "run")
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    return _day(out.select("symbol", "exchange", "asset_class", "trading_date", at("bar_start_time").alias("bar_start"), at("bar_end_time").alias("bar_end"), "raw_ref"))


# -- coverage
_SESSIONS = [("morning", "09:30", "11:30"), ("afternoon", "13:00", "15:00")]


def _coverage(spark: SparkSession, sf_dir: str, freq: str) -> tuple[coverage.Request, coverage.Generation, DataFrame]:
    """Every user is a member of every weekday from the first event on; users by remainder have no bars, custom hours or an unknown state."""
    bars = by_user(spark, sf_dir)
    span = bars.agg(F.min("trading_date").alias("lo"), F.max("trading_date").alias("hi"), F.max(F.col("symbol").cast("long")).alias("users")).first()
    lo, hi = span.lo or date(2024, 1, 1), span.hi or date(2024, 1, 2)
    days = spark.range(1).select(F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("calendar_date"))
    opened = F.weekday("calendar_date") < 5
    rows = days.select("calendar_date", opened.alias("o"), F.explode(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("i", "s", "e"), t, strict=True)]) for t in _SESSIONS])).alias("x"))
    raw = rows.select(F.col("calendar_date").cast("string"), F.col("o").cast("string").alias("is_trading_day"), *[F.when(F.col("o"), F.col(f"x.{k}")).otherwise("").alias(n) for k, n in (("i", "session_id"), ("s", "session_start"), ("e", "session_end"))]).distinct()
    calendar = normalize.calendar_days(raw)
    members = bars.select(F.col("symbol").alias("instrument_id")).distinct().withColumn("trading_date", F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    kind = F.col("instrument_id").cast("long") % 10
    state = members.select("trading_date", "instrument_id", F.lit("active").alias("market_state"), F.when(kind == 1, "no_bars").when(kind == 2, "custom_intervals").when(kind == 3, "unknown").otherwise("full_session").alias("bar_expectation"), F.when(kind == 2, "10:00-10:10").otherwise("").alias("custom_intervals"))
    request = coverage.Request(lo, hi, freq, timezone=ZONE)
    return request, coverage.expected_slots(request, calendar, members, normalize.statuses(state.withColumn("trading_date", F.col("trading_date").cast("string")))), bars


_MEMBERS = f"{BY_USER}, days AS (SELECT CAST(unnest(generate_series((SELECT min(trading_date) FROM bars), (SELECT max(trading_date) FROM bars), INTERVAL 1 DAY)) AS date) AS d), who AS (SELECT DISTINCT symbol, CAST(symbol AS bigint) % 10 AS k FROM bars), scope AS (SELECT symbol, k, d, isodow(d) < 6 AS opened FROM who, days)"


@query(f"WITH {_MEMBERS} SELECT symbol, CAST(d AS varchar) AS trading_date, CAST(CASE WHEN k = 2 THEN 2 ELSE 48 END AS bigint) AS slots FROM scope WHERE opened AND k NOT IN (1, 3)")
def expected_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, g, _ = _coverage(spark, sf_dir, "5m")
    return _day(g.slots.groupBy("symbol", "trading_date").agg(F.count("*").alias("slots")))


_COMPARED = f"{_MEMBERS}, c AS (SELECT s.symbol, d, opened AND k NOT IN (1, 3) AS e, b.symbol IS NOT NULL AS a, NOT opened OR k <> 3 AS r FROM scope s LEFT JOIN bars b ON s.symbol = b.symbol AND s.d = b.trading_date)"


def _analysis(spark: SparkSession, sf_dir: str) -> coverage.Analysis:
    request, g, bars = _coverage(spark, sf_dir, "1d")
    return coverage.compare(request, g, bars)


@query(f"WITH {_COMPARED} SELECT symbol, CAST(d AS varchar) AS trading_date FROM c WHERE e AND NOT a")
def coverage_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day(_analysis(spark, sf_dir).issues.where("code = 'MISSING_SLOT'").select("symbol", "trading_date"))


@query(f"WITH {_COMPARED} SELECT symbol, CAST(d AS varchar) AS trading_date FROM c WHERE a AND NOT e AND r")
def coverage_unexpected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day(_analysis(spark, sf_dir).issues.where("code = 'UNEXPECTED_SLOT'").select("symbol", "trading_date"))


@query(
    f"""WITH {_COMPARED}, m AS (SELECT CASE grouping(symbol, d) WHEN 0 THEN 'SYMBOL_DATE' WHEN 2 THEN 'DATE' ELSE 'RUN' END AS scope, CAST(d AS varchar) AS trading_date, symbol, count(*) FILTER (WHERE e) AS expected, count(*) FILTER (WHERE a) AS actual, count(*) FILTER (WHERE e AND a) AS matched, count(*) FILTER (WHERE e AND NOT a) AS missing, count(*) FILTER (WHERE a AND NOT e AND r) AS unexpected FROM c GROUP BY GROUPING SETS ((symbol, d), (d), ()))
SELECT *, round(CASE WHEN expected > 0 THEN matched / expected WHEN actual > 0 THEN 0.0 ELSE 1.0 END, 6) AS coverage_ratio FROM m"""
)
def coverage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day(_analysis(spark, sf_dir).metrics.withColumn("coverage_ratio", rounded("coverage_ratio")))


for _name, (_query, _sql) in runs.RUNS.items():
    query(_sql, _name)(_query)

del _name, _bars, _cte, _query, _sql
