"""Queries that go through the store: commits, pinned sets, gates and runs, each in a store of its own in the shared folder."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels
from ..plans import research
from ..refs import TableRef
from ..session import shared_dir
from ..store import Store, coverage_gate, feature_gate, label_gate
from ..types import CURATED_BAR, CodedError
from .bars import BY_TYPE, FACTORS, W, by_type, rounded, rounded_sql

RUNS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def _run(sql: str):
    def add(f):
        RUNS[f.__name__] = (f, sql)
        return f

    return add


def _store(spark: SparkSession) -> Store:
    return Store(spark, shared_dir(spark))


def _curated(bars: DataFrame) -> DataFrame:
    have = set(bars.columns)
    return bars.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in CURATED_BAR.fields])


def _code(act) -> str:
    try:
        act()
    except CodedError as e:
        return e.code
    return "OK"


@_run(f"WITH {BY_TYPE}, days AS (SELECT DISTINCT trading_date FROM bars ORDER BY 1 LIMIT 7) SELECT symbol, CAST(trading_date AS varchar) AS trading_date, round(open, 6) AS open, round(close, 6) AS close FROM bars SEMI JOIN days USING (trading_date)")
def pinned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of a pinned set: the first seven days are its items, and all days are partitions of the store."""
    store, bars = _store(spark), by_type(spark, sf_dir)
    days = [str(r[0]) for r in bars.select("trading_date").distinct().orderBy("trading_date").limit(10).collect()]
    hashed = store.register("market_data", "events", "v1", {"freq": "1d"})
    for day in days:
        store.put_partition("market_data", "events", "v1", day, _curated(bars.where(F.col("trading_date") == F.lit(day).cast("date"))), hashed)
    ref = TableRef.of("market_data", snapshot_set_id=store.pin("market_data", "events", "v1", days[:7])["run_id"]).uri
    return store.scan(ref, CURATED_BAR).select("symbol", F.col("trading_date").cast("string").alias("trading_date"), rounded(F.col("open").cast("double")).alias("open"), rounded(F.col("close").cast("double")).alias("close"))


def _ran(spark: SparkSession, sf_dir: str) -> tuple[Store, str, research.RunResult, research.RunResult]:
    """A store with committed bars, features from the eleventh day on, and labels."""
    store, bars = _store(spark), by_type(spark, sf_dir)
    store.commit("import", "events", {"bars": _curated(bars.withColumn("source_run_id", F.lit("events")))}, {"source": "events"})
    ref = TableRef.of("bars", source_run_id="events").uri
    first = bars.agg(F.min("trading_date")).first()[0]
    start = datetime(first.year, first.month, first.day) + timedelta(days=10)
    run = research.ResearchRun(store).run(research.ResearchRequest("features", "set", ref, ("ret_1", "ma_5"), as_of_start=start))
    return store, ref, run, research.label_run(store, "labels", ref, labels.ForwardReturn("set", "fwd_1"))


_FROM = f"{BY_TYPE}, x AS (SELECT symbol, trading_date, {FACTORS['ret_1']} AS ret_1, {FACTORS['ma_5']} AS ma_5, (lead(close) OVER ({W}) - close) / close AS fwd_1 FROM bars), late AS (SELECT *, row_number() OVER ({W}) > 4 AS warm FROM x WHERE trading_date >= (SELECT min(trading_date) + 10 FROM bars))"


@_run(f"WITH {_FROM} SELECT symbol, CAST(trading_date AS varchar) AS trading_date, {rounded_sql('ret_1')} AS ret_1, {rounded_sql('ma_5')} AS ma_5, round(fwd_1, 6) AS fwd_1 FROM late")
def training_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars, features and labels through their runs and gates to a training matrix."""
    store, _, run, made = _ran(spark, sf_dir)
    matrix = research.training_matrix(store, run.snapshot_ref, made.details["label_ref"])
    return matrix.select("symbol", F.date_format("as_of", "yyyy-MM-dd").alias("trading_date"), rounded("ret_1").alias("ret_1"), rounded("ma_5").alias("ma_5"), rounded("fwd_1").alias("fwd_1"))


@_run(f"WITH {_FROM} SELECT symbol, CAST(trading_date AS varchar) AS trading_date, round(fwd_1, 6) AS fwd_1 FROM late WHERE warm AND fwd_1 IS NOT NULL")
def materialized_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training matrix without cold and unlabelled rows, as its published file has it."""
    store, _, run, made = _ran(spark, sf_dir)
    matrix = research.training_matrix(store, run.snapshot_ref, made.details["label_ref"])
    m = research.materialize(store, "set", matrix, ["fwd_1"], f"{store.root}/artifacts")
    return spark.read.parquet(research.parquet_path(m["artifact"])).select("symbol", F.date_format("as_of", "yyyy-MM-dd").alias("trading_date"), rounded("fwd_1").alias("fwd_1"))


@_run(
    "SELECT * FROM (VALUES ('features again', 'FEATURE_RUN_ALREADY_COMMITTED'), ('features', 'OK'), ('labels', 'OK'), ('other table', 'UNSUPPORTED_REF'), ('no run', 'MISSING_FACTOR_RUN_ID'), ('unknown run', 'MISSING_MANIFEST'), ('failed run', 'RUN_NOT_COMMITTED'), ('unchecked run', 'QUALITY_NOT_PASSED'), "
    "('unknown coverage', 'UNKNOWN_COVERAGE_REPORT'), ('no coverage', 'INVALID_COVERAGE_REPORT_REF'), ('other universe', 'UNIVERSE_LINEAGE_MISMATCH')) AS t(act, code)"
)
def gate_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gates say before and after runs over the bars of all events."""
    store, ref, run, made = _ran(spark, sf_dir)
    again = research.ResearchRequest("features", "set", ref, ("ret_1",))
    found = {
        "features again": _code(lambda: research.ResearchRun(store).run(again)),
        "features": _code(lambda: feature_gate(store, run.snapshot_ref)),
        "labels": _code(lambda: label_gate(store, made.details["label_ref"])),
        "other table": _code(lambda: feature_gate(store, "tessera://labels")),
        "no run": _code(lambda: feature_gate(store, "tessera://snapshots")),
        "unknown run": _code(lambda: label_gate(store, "tessera://labels?source_run_id=none")),
    }
    store.fail("label", "broken", {})
    found["failed run"] = _code(lambda: label_gate(store, "tessera://labels?source_run_id=broken"))
    store.commit("label", "raw", {}, {})
    found["unchecked run"] = _code(lambda: label_gate(store, "tessera://labels?source_run_id=raw"))
    found["unknown coverage"] = _code(lambda: coverage_gate(store, "tessera://coverage?coverage_run_id=none"))
    found["no coverage"] = _code(lambda: coverage_gate(store, "tessera://bars"))
    store.put_manifest("label", "labels", store.manifest("label", "labels") | {"universe_hash": "other"})
    found["other universe"] = _code(lambda: research.training_matrix(store, run.snapshot_ref, made.details["label_ref"]))
    return spark.createDataFrame(list(found.items()), "act string, code string")


@_run(f"WITH {BY_TYPE}, n AS (SELECT count(*) AS n, count(*) FILTER (WHERE close > 50) AS m FROM bars) SELECT act, code, CAST(rows AS bigint) AS rows FROM n, LATERAL (VALUES ('replace', 'OK', m), ('refuse', 'CONFLICT', n), ('same config', 'OK', n), ('other config', 'CONFLICT', n), ('same content', 'OK', n), ('other content', 'CONFLICT', n), ('fail a committed run', 'RUN_ALREADY_COMMITTED', n)) AS t(act, code, rows)")
def commit_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second commits of a run under every rule, and how many bars the run then has."""
    store = _store(spark)
    bars = _curated(by_type(spark, sf_dir))
    other = bars.where(F.col("close").cast("double") > 50)
    cases = [("replace", "replace", {}, other), ("refuse", "refuse", {}, other), ("same config", "config", {}, other), ("other config", "config", {"x": 1}, other), ("same content", "content", {}, bars), ("other content", "content", {}, other)]
    rows = []
    for i, (name, rule, config, second) in enumerate(cases):
        store.commit("import", f"r{i}", {"bars": bars}, {}, rule)
        code = _code(lambda: store.commit("import", f"r{i}", {"bars": second}, config, rule, "CONFLICT"))
        rows.append((name, code, store.read("bars", [f"r{i}"]).count()))
    code = _code(lambda: store.fail("import", "r1", {}))
    rows.append(("fail a committed run", code, store.read("bars", ["r1"]).count()))
    return spark.createDataFrame(rows, "act string, code string, rows long")
