"""The research run: bars to features behind their gate; and the runs for labels, coverage, evaluation, training data and backtests."""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..hashing import content_hash, digest
from ..operators import coverage, datasets, evaluation, factors, features, labels, portfolio
from ..refs import TableRef, canonical, parquet_path, parquet_ref
from ..sources.normalize import factor_frame
from ..store import Store, coverage_gate, feature_gate, label_gate
from .ingest import file_hash
from ..types import CURATED_BAR, FEATURE_KEY, LABEL_KEY, CodedError, QualityStatus, RunStatus


@dataclass(frozen=True)
class RunResult:
    run_id: str
    status: str
    quality_status: str | None = None
    feature_ref: str | None = None
    snapshot_ref: str | None = None
    error: dict | None = None
    details: dict = field(default_factory=dict)

    @property
    def consumable(self) -> bool:
        return self.status == RunStatus.COMMITTED and self.quality_status == QualityStatus.PASSED


@dataclass(frozen=True)
class ResearchRequest:
    run_id: str
    feature_set_id: str
    input_ref: str
    factor_ids: tuple[str, ...]
    freq: str = "1d"
    symbols: tuple[str, ...] = ()
    as_of_start: datetime | None = None
    as_of_end: datetime | None = None
    universe_ref: str | None = None
    coverage_ref: str | None = None
    probe: features.ProbeConfig | None = None

    def __post_init__(self) -> None:
        if not self.factor_ids or not self.run_id or "/" in self.run_id:
            raise CodedError("INVALID_RESEARCH_REQUEST")
        if self.as_of_start and self.as_of_end and self.as_of_start > self.as_of_end:
            raise CodedError("INVALID_RESEARCH_REQUEST", "the range is empty")


class _Step:
    """Names the step and the code under which anything that fails in it is reported."""

    def __init__(self, step: str, code: str) -> None:
        self.step, self.code = step, code

    def __enter__(self) -> _Step:
        return self

    def __exit__(self, kind, e, _) -> None:
        if e is None or not isinstance(e, Exception):
            return
        if isinstance(e, CodedError):
            e.step = e.step or self.step
            return
        raise CodedError(self.code, str(e).splitlines()[0][:500] if str(e) else kind.__name__, self.step) from e


def cropped_input(bars: DataFrame, members: DataFrame | None, symbols: tuple[str, ...], end: datetime | None) -> DataFrame:
    """Bars that a run needs: of those who are members on any day, up to the end; earlier bars stay, as the look-back needs them."""
    if members is not None:
        bars = bars.join(members.select("symbol").distinct(), "symbol", "left_semi")
    if symbols:
        bars = bars.where(F.col("symbol").isin(*symbols))
    return bars if end is None else bars.where(F.col("bar_end_time") <= F.lit(end))


def cropped_output(values: DataFrame, members: DataFrame | None, start: datetime | None) -> DataFrame:
    """Values from the start on, on the days of membership."""
    if start is not None:
        values = values.where(F.col("as_of") >= F.lit(start))
    return values if members is None else values.join(members, ["trading_date", "symbol"], "left_semi")


@dataclass
class ResearchRun:
    store: Store
    registry: factors.Registry = field(default_factory=factors.builtin)
    operators: factors.Operators = field(default_factory=factors.default_operators)
    check_coverage: bool = True

    def compute(self, r: ResearchRequest) -> tuple[DataFrame, list[factors.Factor], factors.RunConfig]:
        """The cropped factor frame. The upper bound comes before the windows, the lower one and the membership after, so the look-back stays."""
        with _Step("validate_coverage", "COVERAGE_GATE_FAILED"):
            if r.coverage_ref:
                if not self.check_coverage:
                    raise CodedError("COVERAGE_GATE_NOT_CONFIGURED")
                coverage_gate(self.store, r.coverage_ref)
        with _Step("parse_input_ref", "UNSUPPORTED_REF"):
            ref = TableRef.parse(r.input_ref)
            if ref.table not in ("bars", "market_data"):
                raise CodedError("UNSUPPORTED_REF", r.input_ref)
        pinned = None
        with _Step("resolve_market_data", "RESOLVE_MARKET_DATA_FAILED"):
            if ref.get("snapshot_set_id"):
                pinned = self.store.pinned("market_data", ref.get("snapshot_set_id"))
        members = universe = None
        with _Step("resolve_universe", "RESOLVE_UNIVERSE_FAILED"):
            if r.universe_ref:
                universe = TableRef.parse(r.universe_ref)
                members = self.store.scan(universe).select("trading_date", F.col("instrument_id").alias("symbol")).distinct()
        with _Step("read_bars", "READ_BARS_FAILED"):
            bars = self.store.scan(ref, CURATED_BAR).where(F.col("freq") == r.freq)
            one = bars.agg(F.count_distinct("dataset_id").alias("n"), F.first("dataset_id").alias("d")).first()
            if one.n == 0:
                raise CodedError("EMPTY_BAR_INPUT", r.input_ref)
            if one.n > 1:
                raise CodedError("MULTIPLE_DATASETS", r.input_ref)
        lineage = _lineage(self.store, ref, universe)
        config = factors.RunConfig(r.run_id, r.feature_set_id, one.d, r.freq, (ref.uri,), lineage["definition_hash"], lineage["universe_ref"], lineage["universe_hash"])
        with _Step("build_factor_frame", "BUILD_FACTOR_FRAME_FAILED"):
            if members is not None:
                self._one_asset_class(ref if pinned else None, universe, bars, members)
                inside = bars if r.as_of_start is None else bars.where(F.col("bar_end_time") >= F.lit(r.as_of_start))
                inside = inside if r.as_of_end is None else inside.where(F.col("bar_end_time") <= F.lit(r.as_of_end))
                bare = inside.select("trading_date").distinct().join(members.select("trading_date").distinct(), "trading_date", "left_anti")
                if not bare.isEmpty():
                    raise CodedError("UNIVERSE_DATE_NOT_COVERED", str(bare.agg(F.min("trading_date")).first()[0]))
            frame = factor_frame(cropped_input(bars, members, r.symbols, r.as_of_end))
            if frame.isEmpty():
                raise CodedError("EMPTY_FACTOR_FRAME")
        with _Step("resolve_factors", "RESOLVE_FACTORS_FAILED"):
            found = [self.registry.get(i, freq=r.freq) for i in r.factor_ids]
        with _Step("compute_factors", "COMPUTE_FACTORS_FAILED"):
            out = cropped_output(factors.run_factors(frame, found, operators=self.operators), members, r.as_of_start)
        self._frame = frame
        return out, found, config

    def _one_asset_class(self, pinned: TableRef | None, universe: TableRef, bars: DataFrame, members: DataFrame) -> None:
        """The universe's class against that of the market data's definition, or else of its members' bars."""
        want = self.store.about(universe.uri).get("asset_class")
        if want is None:
            return
        if pinned is not None:
            wrong = self.store.about(pinned.uri).get("asset_class") not in (None, want)
        else:
            wrong = not bars.where(F.col("asset_class") != want).join(members.select("symbol").distinct(), "symbol", "left_semi").isEmpty()
        if wrong:
            raise CodedError("UNIVERSE_ASSET_CLASS_MISMATCH", str(want))

    def run(self, r: ResearchRequest) -> RunResult:
        old = self.store.manifest("feature", r.run_id)
        if old is not None and old["status"] != RunStatus.FAILED:
            raise CodedError("FEATURE_RUN_ALREADY_COMMITTED", r.run_id)
        if old is not None:
            raise CodedError("FEATURE_RUN_ALREADY_FAILED", r.run_id)
        lineage = {"request": {k: str(v) if isinstance(v, datetime) else v for k, v in asdict(r).items() if k != "probe"}}
        try:
            frame, found, config = self.compute(r)
            with _Step("transform_features", "TRANSFORM_FEATURES_FAILED"):
                values = features.long_values(frame, found, config)
                if values.isEmpty():
                    raise CodedError("EMPTY_FACTOR_FRAME")
                features.assert_unique(values, FEATURE_KEY, "DUPLICATE_FEATURE_KEY")
            with _Step("commit_features", "FEATURE_STORE_WRITE_FAILED"):
                span = frame.agg(F.min("as_of").alias("lo"), F.max("as_of").alias("hi")).first()
                self.store.commit("feature", r.run_id, {"features": values, "snapshots": features.snapshots(values)}, lineage, "refuse", "FEATURE_RUN_ALREADY_COMMITTED", dataset_id=config.dataset_id, freq=config.freq, definition_hash=config.definition_hash, universe_hash=config.universe_hash, start=str(span.lo), end=str(span.hi))
        except CodedError as e:
            self.store.fail("feature", r.run_id, lineage, code=e.code, message=e.message)
            return RunResult(r.run_id, str(RunStatus.FAILED), error={"step": e.step, "code": e.code, "message": e.message})
        committed = self.store.scan(TableRef.of("features", factor_run_id=r.run_id))
        base = features.quality(committed)
        metrics, examples = base, 0
        probed = None
        if r.probe is not None:
            probed, shown = features.probe(self._frame, found, r.probe)
            metrics, examples = base.unionByName(probed), shown.count()
        status = features.gate_status(base, probed)
        self.store.put_quality("feature", r.run_id, metrics, status, features.summary(metrics))
        final = RunStatus.COMMITTED if status is QualityStatus.PASSED else RunStatus.QUALITY_FAILED
        if final is RunStatus.QUALITY_FAILED:
            self.store.put_manifest("feature", r.run_id, self.store.manifest("feature", r.run_id) | {"status": str(final)})
        uri = lambda t: TableRef.of(t, factor_run_id=r.run_id).uri
        return RunResult(r.run_id, str(final), str(status), uri("features"), uri("snapshots"), details={"leak_examples": examples})


def _lineage(store: Store, ref: TableRef, universe: TableRef | None) -> dict:
    """Hashes of the market data's definition, if it is pinned, and of the universe, if there is one: its definition and its days."""
    pinned = store.about(ref.uri) if ref.get("snapshot_set_id") else None
    found = store.about(universe.uri) if universe else None
    return {
        "definition_hash": pinned and digest([pinned["definition_id"], pinned["version"], pinned["definition_hash"]]),
        "universe_ref": universe and universe.uri,
        "universe_hash": found and digest([found["definition_id"], found["version"], found["definition_hash"], universe.uri]),
    }


def label_run(store: Store, run_id: str, input_ref: str, config: labels.ForwardReturn, max_null_ratio: float = 1.0, universe_ref: str | None = None) -> RunResult:
    """Forward-return labels of bars, of the members of a universe if one is named; a second run of the id replaces the first."""
    ref, universe = TableRef.parse(input_ref), TableRef.parse(universe_ref) if universe_ref else None
    lineage = _lineage(store, ref, universe)
    bars = store.scan(ref, CURATED_BAR)
    if universe:
        bars = bars.join(store.scan(universe).select(F.col("instrument_id").alias("symbol")).distinct(), "symbol", "left_semi")
    if bars.isEmpty():
        raise CodedError("EMPTY_BAR_INPUT", input_ref)
    out = labels.forward_returns(bars, config, run_id)
    features.assert_unique(out, LABEL_KEY, "DUPLICATE_LABEL_KEY")
    span = labels.source_range(bars)
    store.commit("label", run_id, {"labels": out}, {"config": asdict(config), "input": ref.uri, "universe": universe_ref}, dataset_id=span["dataset_id"], freq=span["freq"], start=str(span["start"]), end=str(span["end"]), pinned=bool(ref.get("snapshot_set_id")), **lineage)
    metrics = labels.quality(store.read("labels", [run_id]), max_null_ratio)
    status = features.overall(metrics)
    store.put_quality("label", run_id, metrics, status, features.summary(metrics))
    return RunResult(run_id, str(RunStatus.COMMITTED), str(status), details={"label_ref": TableRef.of("labels", source_run_id=run_id).uri})


def coverage_run(store: Store, run_id: str, request: coverage.Request, calendar_ref: str, universe_ref: str, status_ref: str, market_ref: str) -> RunResult:
    """Expected against actual bars; a failure is kept as a failed run with its code."""
    config = {"request": {k: str(v) for k, v in asdict(request).items()}, "refs": [canonical(x) for x in (calendar_ref, universe_ref, status_ref, market_ref)]}
    try:
        days, members, state = (store.scan(x) for x in (calendar_ref, universe_ref, status_ref))
        bars = store.scan(market_ref, CURATED_BAR)
        if not bars.where(F.col("freq") != request.freq).isEmpty():
            raise CodedError("COVERAGE_FREQUENCY_MISMATCH", request.freq)
        coverage.check_definitions(*(store.about(x) for x in (market_ref, calendar_ref, universe_ref, status_ref)))
        market_days = store.spark.createDataFrame([(i["day"],) for i in store.pinned("market_data", TableRef.parse(market_ref).get("snapshot_set_id"))["items"]], "day string").select(F.to_date("day").alias("trading_date"))
        every = coverage.dates(store.spark, request.start, request.end)
        opened = every.join(days.where(F.array_contains("states", True)).select(F.col("calendar_date").alias("trading_date")), "trading_date", "left_semi")
        for want, have, code in ((every, days.select(F.col("calendar_date").alias("trading_date")), "COVERAGE_CALENDAR_DATE_NOT_COVERED"), (opened, members, "COVERAGE_UNIVERSE_DATE_NOT_COVERED"), (opened, state, "COVERAGE_STATUS_DATE_NOT_COVERED"), (opened, market_days, "COVERAGE_MARKET_DATE_NOT_COVERED")):
            lack = want.join(have.select("trading_date").distinct(), "trading_date", "left_anti").agg(F.min("trading_date")).first()[0]
            if lack is not None:
                raise CodedError(code, str(lack))
        analysis = coverage.compare(request, coverage.expected_slots(request, days, members, state), bars)
        good = coverage.consumable(request, analysis)
        m = store.commit("coverage", run_id, {"coverage_metrics": analysis.metrics, "coverage_issues": analysis.issues}, config, "config", "COVERAGE_RUN_CONFLICT", consumable=good)
    except CodedError as e:
        if e.code == "COVERAGE_RUN_CONFLICT":
            raise
        store.fail("coverage", run_id, config, code=e.code, message=e.message)
        return RunResult(run_id, str(RunStatus.FAILED), error={"step": "coverage", "code": e.code, "message": e.message})
    return RunResult(run_id, m["status"], details={"consumable": good, "coverage_ref": TableRef.of("coverage", coverage_run_id=run_id).uri, "reused": m["reused"]})


def coverage_metrics(store: Store, run_id: str) -> DataFrame:
    """Stored metrics: each symbol's day, then each day, then the run."""
    rank = F.when(F.col("scope") == "SYMBOL_DATE", 0).when(F.col("scope") == "DATE", 1).otherwise(2)
    return store.read("coverage_metrics", [run_id]).orderBy(rank, "trading_date", "symbol")


def coverage_issues(store: Store, run_id: str) -> DataFrame:
    return store.read("coverage_issues", [run_id]).orderBy("issue_id")


def evaluation_run(store: Store, run_id: str, request: evaluation.Request, snapshot_ref: str, label_ref: str) -> RunResult:
    """Behind both gates; the same request and content is reused, anything else under the id is a conflict."""
    f, y = feature_gate(store, snapshot_ref), label_gate(store, label_ref)
    for key, code in (("dataset_id", "DATASET_ID_MISMATCH"), ("freq", "FREQUENCY_MISMATCH")):
        if f.get(key) != y.get(key):
            raise CodedError(code)
    out = evaluation.evaluate(request, store.read("snapshots", [f["run_id"]]), store.read("labels", [y["run_id"]]))
    config = {"request": asdict(request), "refs": sorted([canonical(snapshot_ref), canonical(label_ref)])}
    rounded = out.withColumn("value", F.round("value", 12))
    m = store.commit("evaluation", run_id, {"evaluation_metrics": rounded}, config, "content", "EVALUATION_RUN_CONFLICT")
    counts = {r.status: r["count"] for r in rounded.groupBy("status").count().collect()}
    return RunResult(run_id, m["status"], details={"reused": m["reused"], "counts": counts})


def evaluation_metrics(store: Store, run_id: str) -> DataFrame:
    return store.read("evaluation_metrics", [run_id]).orderBy("factor_field", "as_of", "metric", "bucket")


def training_matrix(store: Store, snapshot_ref: str, label_ref: str, feature_fields: list[str] | None = None, label_fields: list[str] | None = None) -> DataFrame:
    """Features joined with labels, behind both gates and the compatibility rules."""
    f, y = feature_gate(store, snapshot_ref), label_gate(store, label_ref)
    datasets.check_compatible(f, y)
    x = datasets.feature_matrix(store.read("snapshots", [f["run_id"]]), feature_fields)
    return datasets.join(x, datasets.label_matrix(store.read("labels", [y["run_id"]]), label_fields))


def materialize(store: Store, dataset_id: str, matrix: DataFrame, label_fields: list[str], path: str, drop_cold: bool = True, drop_null_labels: bool = True, inputs: dict | None = None) -> dict:
    """A sorted, filtered matrix as zstd Parquet that is never overwritten, with the hashes of its definition, rows, schema and bytes.

    It is written under a temporary name and published by a rename; its name has the rows' hash. The same definition and content is
    reused after its rows have been checked against the stored hash. inputs: what the matrix was made of (see training_manifest), part of the definition.
    """
    if not dataset_id or "/" in dataset_id or dataset_id.startswith("."):
        raise CodedError("INVALID_DATASET_ID", dataset_id)
    kept, dropped = datasets.filtered(matrix, label_fields, drop_cold, drop_null_labels)
    definition = {"columns": matrix.columns, "labels": sorted(label_fields), "drop_cold": drop_cold, "drop_null_labels": drop_null_labels, "inputs": inputs or {}}
    hashes = {"definition_hash": digest(definition), "content_hash": content_hash(kept), "schema_hash": digest([list(x) for x in kept.dtypes])}
    old = store.manifest("dataset", dataset_id)
    if old is not None:
        if any(old[k] != v for k, v in hashes.items()):
            raise CodedError("TRAINING_DATASET_CONFLICT", dataset_id)
        if content_hash(store.spark.read.parquet(parquet_path(old["artifact"]))) != old["content_hash"]:
            raise CodedError("ARTIFACT_CONTENT_MISMATCH", dataset_id)
        return old | {"reused": True}
    if kept.isEmpty():
        raise CodedError("EMPTY_TRAINING_DATASET", dataset_id)
    rows = kept.repartitionByRange("dataset_id", "symbol", "freq", "as_of").sortWithinPartitions("dataset_id", "symbol", "freq", "as_of")
    folder = path.rstrip("/")
    target, temporary = f"{folder}/{dataset_id}-{hashes['content_hash'][:16]}", f"{folder}/.{dataset_id}-{uuid.uuid4().hex}.tmp"
    rows.write.option("compression", "zstd").parquet(temporary)
    artifact_hash = file_hash(store.spark, temporary)
    if not store.publish(temporary, target):
        raise CodedError("MATERIALIZED_ARTIFACT_CONFLICT", target)
    store.put_manifest("dataset", dataset_id, {"status": str(RunStatus.COMMITTED), "artifact": parquet_ref(target), "artifact_hash": artifact_hash, **hashes, **dropped})
    return store.manifest("dataset", dataset_id) | {"reused": False}


def training_manifest(store: Store, dataset_id: str, snapshot_ref: str, label_ref: str, feature_fields: list[str] | None = None, label_fields: list[str] | None = None) -> dict:
    """The manifest of a training set that is not materialised: its lineage, columns and the hash of its rows. The same content is reused."""
    f, y = feature_gate(store, snapshot_ref), label_gate(store, label_ref)
    matrix = training_matrix(store, snapshot_ref, label_ref, feature_fields, label_fields)
    value = {"features": canonical(snapshot_ref), "labels": canonical(label_ref), "columns": matrix.columns, "definition_hash": f.get("definition_hash"), "universe_hash": f.get("universe_hash"), "inputs": digest([f["config_hash"], y["config_hash"]]), "content_hash": content_hash(matrix)}
    old = store.manifest("training_set", dataset_id)
    if old is not None:
        if any(old[k] != v for k, v in value.items()):
            raise CodedError("TRAINING_DATASET_CONFLICT", dataset_id)
        return old | {"reused": True}
    store.put_manifest("training_set", dataset_id, {"status": str(RunStatus.COMMITTED), **value})
    return store.manifest("training_set", dataset_id) | {"reused": False}


def split(store: Store, dataset_id: str, plan: datasets.SplitPlan, period: str = "as_of") -> DataFrame:
    """Folds of a materialised dataset whose content still is what its manifest says."""
    m = store.manifest("dataset", dataset_id)
    if m is None or m["status"] != RunStatus.COMMITTED:
        raise CodedError("UNKNOWN_TRAINING_DATASET", dataset_id)
    rows = store.spark.read.parquet(parquet_path(m["artifact"]))
    if period not in rows.columns:
        raise CodedError("MISSING_PERIOD_FIELD", period)
    if content_hash(rows) != m["content_hash"]:
        raise CodedError("ARTIFACT_CONTENT_MISMATCH", dataset_id)
    return datasets.folds(rows, plan, period)


def backtest_run(store: Store, run_id: str, bars: DataFrame, targets: DataFrame, config: portfolio.BacktestConfig) -> RunResult:
    """One run's fills, positions, NAV and metrics; the same bars, targets and settings are reused."""
    portfolio.check_targets(targets)
    settings = {"cash": config.cash, "lot": config.lot, "costs": [config.costs.buy_rate, config.costs.sell_rate], "eligible": getattr(config.eligible, "__qualname__", str(config.eligible)), "bars": content_hash(bars), "targets": content_hash(targets)}
    old = store.manifest("backtest", run_id)
    if old is not None and old["status"] == RunStatus.COMMITTED:
        if old["config_hash"] != digest(settings):
            raise CodedError("BACKTEST_RUN_CONFLICT", run_id)
        return RunResult(run_id, old["status"], details={"reused": True})
    events = portfolio.backtest(bars, targets.withColumn("backtest_run_id", F.lit(run_id)), config).cache()
    try:
        fill_id = F.concat_ws(":", "backtest_run_id", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss"), "symbol", "side", "seq")
        tables = {"fills": events.where("kind = 'FILL'").withColumn("fill_id", fill_id).drop("kind"), "positions": events.where("kind = 'POSITION'").select("backtest_run_id", "trading_date", "at", "symbol", "quantity", "price", "amount"), "nav": events.where("kind = 'NAV'").select("backtest_run_id", "trading_date", "at", F.col("amount").alias("nav"), "cash"), "backtest_metrics": portfolio.analytics(events, float(config.cash))}
        m = store.commit("backtest", run_id, tables, settings, "config", "BACKTEST_RUN_CONFLICT")
    finally:
        events.unpersist()
    return RunResult(run_id, m["status"], details={"reused": False})


def read_fills(store: Store, run_id: str) -> DataFrame:
    return store.read("fills", [run_id]).orderBy("at", "fill_id")


def read_nav(store: Store, run_id: str) -> DataFrame:
    return store.read("nav", [run_id]).orderBy("trading_date")


def read_backtest_metrics(store: Store, run_id: str) -> DataFrame:
    return store.read("backtest_metrics", [run_id]).orderBy("metric")
