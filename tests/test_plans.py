from __future__ import annotations

import json
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.hashing import canonical_json, content_hash, digest
from tessera.operators import coverage, datasets, evaluation, features, labels, portfolio
from tessera.operators.factors import Factor, Registry, Spec, builtin
from tessera.plans import research as R
from tessera.plans.ingest import AssetIngestion, BarIngestion, Definition, validate
from tessera.refs import TableRef, canonical, parquet_path, parquet_ref
from tessera.sources.normalize import BarSource
from tessera.store import Store, coverage_gate, feature_gate, label_gate
from tessera.types import CodedError

HEAD = "symbol,exchange,date,open,high,low,close,volume,turnover\n"


def write(tmp_path, days=30, symbols="ABC", name="bars.csv", broken=False):
    rows = []
    for s in symbols:
        for i in range(days):
            c = 10 + (i * (3 + ord(s)) % 7) + ord(s) % 5
            rows.append(f"{s},SZSE,{date(2026, 1, 1) + timedelta(days=i)},{c},{c + 1 if not broken else 0},{c - 1},{c},100,\n")
    p = tmp_path / name
    p.write_text(HEAD + "".join(rows))
    return str(p)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def ingest(store, path, **how):
    return BarIngestion(store.spark, store).run(path, "CSV", BarSource("d", "src", **how))


def code(act):
    with pytest.raises(CodedError) as e:
        act()
    return e.value.code


def test_refs():
    uri = "tessera://bars?dataset_id=d&source_run_id=r"
    assert TableRef.parse(uri).uri == uri and canonical("tessera://bars?source_run_id=r&dataset_id=d") == uri
    for bad in ("http://bars", "tessera://none", "tessera://bars?volume=1", "tessera://universe", "tessera://universe?snapshot_set_id=a&x=1", "tessera://bars?symbol=a&symbol=b"):
        assert code(lambda b=bad: TableRef.parse(b)) == "UNSUPPORTED_REF"
    assert parquet_path(parquet_ref("/a b/c")) == "/a b/c" and code(lambda: parquet_ref("a")) == "INVALID_ARTIFACT_PATH"


def test_hashes(spark):
    assert canonical_json({"b": 1, "a": datetime(2026, 1, 1, 8, tzinfo=timezone(timedelta(hours=8)))}) == '{"a":"2026-01-01T00:00:00+00:00","b":1}'
    assert digest({"a": 1, "b": 2}) == digest({"b": 2, "a": 1})
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    assert content_hash(df) == content_hash(df.repartition(3).select("y", "x")) != content_hash(df.union(df))


def test_ingestion_replays_and_fails_strictly(store, tmp_path):
    path = write(tmp_path)
    one = ingest(store, path)
    again = ingest(store, path)
    assert one.status == "COMMITTED" and again.reused and again.ref == one.ref
    assert store.scan(one.ref).count() == 90 and validate(store, one.ref).count() == 0
    bad = ingest(store, write(tmp_path, 2, "A", "bad.csv", broken=True))
    assert bad.status == "FAILED" and bad.issues == 2 and store.quality_issues(bad.run_id).count() == 2
    assert code(lambda: store.read("bars", [bad.run_id])) == "UNKNOWN_RUN"
    lenient = ingest(store, write(tmp_path, 3, "A", "bad2.csv", broken=True), strict=False)
    assert lenient.status == "COMMITTED" and lenient.issues == 3


def test_research_labels_evaluation_and_training(store, tmp_path):
    ref = ingest(store, write(tmp_path, 40, "ABCDEF")).ref
    run = R.ResearchRun(store)
    request = R.ResearchRequest("r1", "set", ref, ("ret_1", "ma_5"), as_of_start=datetime(2026, 1, 11), probe=features.ProbeConfig(cutpoints=2))
    got = run.run(request)
    assert got.consumable and got.error is None, got
    long = store.scan(got.feature_ref)
    first = long.where("output_field = 'ret_1'").orderBy("as_of").first()
    assert first.as_of.day == 11 and first.value_float is not None and not first.warmup_complete  # warm-up is counted after the crop
    assert code(lambda: run.run(request)) == "FEATURE_RUN_ALREADY_COMMITTED"
    assert feature_gate(store, got.snapshot_ref)["run_id"] == "r1"
    y = R.label_run(store, "l1", ref, labels.ForwardReturn("ls", "fwd"))
    assert y.quality_status == "PASSED" and label_gate(store, y.details["label_ref"])
    ask = evaluation.Request(("ret_1",), "fwd", min_samples=3)
    e = R.evaluation_run(store, "e1", ask, got.snapshot_ref, y.details["label_ref"])
    assert not e.details["reused"] and R.evaluation_run(store, "e1", ask, got.snapshot_ref, y.details["label_ref"]).details["reused"]
    assert code(lambda: R.evaluation_run(store, "e1", evaluation.Request(("ma_5",), "fwd", min_samples=3), got.snapshot_ref, y.details["label_ref"])) == "EVALUATION_RUN_CONFLICT"
    assert R.evaluation_metrics(store, "e1").first().metric == "LONG_SHORT_RETURN"
    matrix = R.training_matrix(store, got.snapshot_ref, y.details["label_ref"])
    m = R.materialize(store, "ds", matrix, ["fwd"], str(tmp_path / "out"))
    assert not m["reused"] and m["dropped_warmup"] == 24 and m["dropped_null_labels"] == 6
    assert R.materialize(store, "ds", matrix, ["fwd"], str(tmp_path / "out"))["reused"]
    assert code(lambda: R.materialize(store, "ds", matrix.limit(100), ["fwd"], str(tmp_path / "out"))) == "TRAINING_DATASET_CONFLICT"
    assert R.split(store, "ds", datasets.SplitPlan(10, 5)).count() > 0 and code(lambda: R.split(store, "none", datasets.SplitPlan(1, 1))) == "UNKNOWN_TRAINING_DATASET"


def test_research_errors_name_step_and_code(store, tmp_path):
    ref = ingest(store, write(tmp_path, 5)).ref
    run = R.ResearchRun(store)
    for i, (change, step, want) in enumerate(
        [
            ({"input_ref": "tessera://labels"}, "parse_input_ref", "UNSUPPORTED_REF"),
            ({"factor_ids": ("none",)}, "resolve_factors", "UNKNOWN_FACTOR"),
            ({"symbols": ("Z",)}, "build_factor_frame", "EMPTY_FACTOR_FRAME"),
            ({"as_of_start": datetime(2030, 1, 1)}, "transform_features", "EMPTY_FACTOR_FRAME"),
            ({"coverage_ref": "tessera://coverage?coverage_run_id=x"}, "validate_coverage", "UNKNOWN_COVERAGE_REPORT"),
            ({"input_ref": "tessera://market_data?snapshot_set_id=x"}, "resolve_market_data", "UNKNOWN_SNAPSHOT_SET"),
        ]
    ):
        got = run.run(R.ResearchRequest(**{"run_id": f"x{i}", "feature_set_id": "s", "input_ref": ref, "factor_ids": ("ret_1",), **change}))
        assert got.status == "FAILED" and (got.error["step"], got.error["code"]) == (step, want), got
    assert store.manifest("feature", "x0")["code"] == "UNSUPPORTED_REF"
    assert code(lambda: run.run(R.ResearchRequest("x0", "s", ref, ("ret_1",)))) == "FEATURE_RUN_ALREADY_FAILED"


def test_leaky_factor_is_committed_but_blocked(store, tmp_path):
    ref = ingest(store, write(tmp_path, 30, "A")).ref
    leaky = Registry([Factor(Spec("peek"), lambda w: F.lead("close").over(w)), builtin().get("ret_1")])
    got = R.ResearchRun(store, leaky).run(R.ResearchRequest("r", "s", ref, ("peek",), probe=features.ProbeConfig(min_prefix_rows=5)))
    assert got.status == "QUALITY_FAILED" and not got.consumable and got.details["leak_examples"] > 0
    assert store.scan(got.feature_ref).count() == 30 and code(lambda: feature_gate(store, got.snapshot_ref)) == "RUN_NOT_COMMITTED"


def test_gates(store):
    assert code(lambda: feature_gate(store, "tessera://labels")) == "UNSUPPORTED_REF"
    assert code(lambda: feature_gate(store, "tessera://snapshots?dataset_id=d")) == "MISSING_FACTOR_RUN_ID"
    assert code(lambda: label_gate(store, "tessera://labels?source_run_id=x")) == "MISSING_MANIFEST"
    assert code(lambda: coverage_gate(store, "tessera://bars")) == "INVALID_COVERAGE_REPORT_REF"
    store.put_manifest("label", "x", {"status": "COMMITTED"})
    assert code(lambda: label_gate(store, "tessera://labels?source_run_id=x")) == "QUALITY_NOT_PASSED"
    store.put_manifest("coverage", "c", {"status": "COMMITTED", "consumable": False})
    assert code(lambda: coverage_gate(store, "tessera://coverage?coverage_run_id=c")) == "COVERAGE_REPORT_NOT_CONSUMABLE"


KNOWN = datetime(2026, 1, 1, 1, tzinfo=timezone.utc)


def asset(store, tmp_path, kind, text, day, mapping=None, definition=None, **meta):
    p = tmp_path / f"{kind}-{day}-{abs(hash(text))}.csv"
    p.write_text(text)
    d = definition or Definition(kind, f"{kind}-1", "v1", {"zone": "Asia/Shanghai"})
    source = BarSource("d", "s") if kind == "market_data" else None
    return AssetIngestion(store.spark, store).run(d, day, str(p), "CSV", {"known_at": KNOWN, "source_data_cutoff": KNOWN if kind != "market_data" else None or KNOWN + timedelta(0), **meta}, source, mapping)


def test_immutable_assets_and_coverage_run(store, tmp_path):
    day = date(2026, 1, 1)
    late = datetime(2026, 1, 2, tzinfo=timezone.utc)
    bars = HEAD + "A,SZSE,2026-01-01,10,11,9,10,100,\n"
    meta = {"known_at": late, "source_data_cutoff": late}
    one = asset(store, tmp_path, "market_data", bars, day, **meta)
    assert one.status == "COMMITTED", store.quality_issues(one.run_id).collect()
    assert asset(store, tmp_path, "market_data", bars, day, **meta).reused
    assert code(lambda: asset(store, tmp_path, "market_data", bars.replace("10,100", "11,100"), day, **meta)) == "IMMUTABLE_PARTITION_CONFLICT"
    assert code(lambda: asset(store, tmp_path, "market_data", bars, day, definition=Definition("market_data", "market_data-1", "v1", {"zone": "UTC"}), **meta)) == "DEFINITION_CONFLICT"
    assert asset(store, tmp_path, "universe", "symbol,trading_date,weight,rank,tags\nA,2026-01-01,1,1,x\nB,2026-01-01,,,\n", day).status == "COMMITTED"
    assert asset(store, tmp_path, "universe", "symbol,trading_date\n,2026-01-01\n", day, definition=Definition("universe", "u2", "v1", {})).status == "FAILED"
    assert asset(store, tmp_path, "calendar", "calendar_date,is_trading_day,session_id,session_start,session_end,session_kind\n2026-01-01,1,am,09:30,11:30,\n", day).status == "COMMITTED"
    assert asset(store, tmp_path, "daily_status", "trading_date,instrument_id,market_state,bar_expectation,custom_intervals\n2026-01-01,A,active,full_session,\n2026-01-01,B,suspended,no_bars,\n", day).status == "COMMITTED"
    assert code(lambda: store.pin("universe", "universe-1", "v1", ["2026-01-01", "2026-01-02"])) == "MISSING_PARTITION"
    refs = {k: f"tessera://{k}?snapshot_set_id={store.pin(k, f'{k}-1', 'v1', ['2026-01-01'])['run_id']}" for k in ("calendar", "universe", "daily_status", "market_data")}
    assert store.pin("universe", "universe-1", "v1", ["2026-01-01"])["reused"] and store.scan(refs["universe"]).count() == 2
    request = coverage.Request(day, day)
    ask = lambda r, run="c": R.coverage_run(store, run, r, refs["calendar"], refs["universe"], refs["daily_status"], refs["market_data"])
    got = ask(request)
    assert got.details["consumable"] and not got.details["reused"] and ask(request).details["reused"]
    assert R.coverage_metrics(store, "c").first().scope == "SYMBOL_DATE" and R.coverage_issues(store, "c").count() == 0
    assert code(lambda: ask(coverage.Request(day, day, min_ratio=0.5))) == "COVERAGE_RUN_CONFLICT"
    failed = ask(coverage.Request(day, day + timedelta(1)), "c2")
    assert failed.status == "FAILED" and failed.error["code"] == "COVERAGE_CALENDAR_DATE_NOT_COVERED"
    run = R.ResearchRun(store).run(R.ResearchRequest("p", "s", refs["market_data"], ("true_range",), universe_ref=refs["universe"], coverage_ref=got.details["coverage_ref"]))
    assert run.consumable and store.manifest("feature", "p")["universe_hash"]


def test_tampered_sets_are_found(store, tmp_path):
    asset(store, tmp_path, "universe", "symbol,trading_date\nA,2026-01-01\n", date(2026, 1, 1))
    pin = store.pin("universe", "universe-1", "v1", ["2026-01-01"])
    store.put_manifest("universe_set", pin["run_id"], {k: v for k, v in pin.items() if k not in ("run_id", "reused")} | {"version": "v9"})
    assert code(lambda: store.pinned("universe", pin["run_id"])) == "SNAPSHOT_SET_HASH_MISMATCH"


def test_lineage_of_labels_is_compared(store, tmp_path):
    ref = ingest(store, write(tmp_path, 2, "AB")).ref
    days = ["2026-01-01", "2026-01-02"]
    for name in ("one", "two"):
        for d in days:
            text = f"symbol,trading_date\nA,{d}\n" + (f"B,{d}\n" if name == "two" else "")
            assert asset(store, tmp_path, "universe", text, date.fromisoformat(d), definition=Definition("universe", name, "v1", {})).status == "COMMITTED"
    refs = {n: f"tessera://universe?snapshot_set_id={store.pin('universe', n, 'v1', days)['run_id']}" for n in ("one", "two")}
    x = R.ResearchRun(store).run(R.ResearchRequest("x", "s", ref, ("ret_1",), universe_ref=refs["one"]))
    y = {n: R.label_run(store, f"y{n}", ref, labels.ForwardReturn("ls", "fwd"), universe_ref=r).details["label_ref"] for n, r in [*refs.items(), ("none", None)]}
    assert R.training_matrix(store, x.snapshot_ref, y["one"]).count() == 2 and R.training_matrix(store, x.snapshot_ref, y["none"]).count() == 2
    assert code(lambda: R.training_matrix(store, x.snapshot_ref, y["two"])) == "UNIVERSE_LINEAGE_MISMATCH"
    one = R.training_manifest(store, "t", x.snapshot_ref, y["one"])
    assert not one["reused"] and one["universe_hash"] and R.training_manifest(store, "t", x.snapshot_ref, y["one"])["reused"]
    assert code(lambda: R.training_manifest(store, "t", x.snapshot_ref, y["none"])) == "TRAINING_DATASET_CONFLICT"
    wrong = store.manifest("universe_definition", "one@v1")
    store.put_manifest("universe_definition", "one@v1", wrong | {"content": {"asset_class": "FUTURE"}})
    got = R.ResearchRun(store).run(R.ResearchRequest("z", "s", ref, ("ret_1",), universe_ref=refs["one"]))
    assert got.error["code"] == "UNIVERSE_ASSET_CLASS_MISMATCH"


@pytest.mark.parametrize(
    ("change", "want"),
    [
        ({"market": {"calendar_id": "x"}, "status": {"calendar_id": "y"}}, "COVERAGE_CALENDAR_MISMATCH"),
        ({"status": {"calendar_version": "v2"}}, "COVERAGE_CALENDAR_VERSION_MISMATCH"),
        ({"market": {"zone": "UTC"}}, "COVERAGE_TIMEZONE_MISMATCH"),
        ({"universe": {"asset_class": "FUND"}, "market": {"asset_class": "EQUITY"}}, "COVERAGE_ASSET_CLASS_MISMATCH"),
        ({}, None),
    ],
)
def test_coverage_inputs_must_agree(change, want):
    base = {"version": "v1", "zone": "Asia/Shanghai"}
    inputs = [base | change.get(k, {}) for k in ("market", "calendar", "universe", "status")]
    if want:
        assert code(lambda: coverage.check_definitions(*inputs)) == want
    else:
        coverage.check_definitions(*inputs)


def test_coverage_needs_all_trading_days(store, tmp_path):
    """Dates without market data, members or states, through the run; a closed day needs none of them."""
    days = [date(2026, 1, d) for d in (1, 2, 3)]
    late = {"known_at": datetime(2026, 1, 4, tzinfo=timezone.utc), "source_data_cutoff": datetime(2026, 1, 4, tzinfo=timezone.utc)}
    texts = {
        "market_data": lambda d: HEAD + f"A,SZSE,{d},10,11,9,10,100,\n",
        "universe": lambda d: f"symbol,trading_date\nA,{d}\n",
        "calendar": lambda d: f"calendar_date,is_trading_day,session_id,session_start,session_end\n{d},{int(d.day < 3)},{'am,09:30,11:30' if d.day < 3 else ',,'}\n",
        "daily_status": lambda d: f"trading_date,instrument_id,market_state,bar_expectation\n{d},A,active,full_session\n",
    }
    for kind, text in texts.items():
        for d in days[: 3 if kind == "calendar" else 2]:
            assert asset(store, tmp_path, kind, text(d), d, **late).status == "COMMITTED"

    def refs(**upto):
        return [f"tessera://{k}?snapshot_set_id={store.pin(k, f'{k}-1', 'v1', [str(d) for d in days[: upto.get(k, 3 if k == 'calendar' else 2)]])['run_id']}" for k in ("calendar", "universe", "daily_status", "market_data")]

    ask = lambda run, **upto: R.coverage_run(store, run, coverage.Request(days[0], days[2]), *refs(**upto))
    assert ask("all").details["consumable"]
    for i, (kind, want) in enumerate([("calendar", "CALENDAR"), ("universe", "UNIVERSE"), ("daily_status", "STATUS"), ("market_data", "MARKET")]):
        got = ask(f"c{i}", **{kind: 2 if kind == "calendar" else 1})
        assert got.status == "FAILED" and got.error["code"] == f"COVERAGE_{want}_DATE_NOT_COVERED"


def test_unknown_states_are_refused(store, tmp_path):
    for line in ("active,sometimes", "asleep,full_session"):
        with pytest.raises(Exception, match="INVALID_(BAREXPECTATION|MARKETSTATE)"):
            asset(store, tmp_path, "daily_status", f"trading_date,instrument_id,market_state,bar_expectation\n2026-01-01,A,{line}\n", date(2026, 1, 1))


def test_prices_written_otherwise_are_the_same_partition(store, tmp_path):
    late = {"known_at": datetime(2026, 1, 2, tzinfo=timezone.utc), "source_data_cutoff": datetime(2026, 1, 2, tzinfo=timezone.utc)}
    for line in ("10,11,9,10,100,", "10.0,11,9.00,1e1,100,"):
        got = asset(store, tmp_path, "market_data", HEAD + f"A,SZSE,2026-01-01,{line}\n", date(2026, 1, 1), **late)
    assert got.reused


def test_a_commit_that_breaks_off_leaves_the_old_one(store, spark):
    store.commit("label", "r", {"labels": spark.range(3)}, {})
    before = store.manifest("label", "r")["folders"]["labels"]
    with pytest.raises(Exception):
        store.commit("label", "r", {"labels": spark.range(5), "broken": spark.range(1).selectExpr("raise_error('no') AS x")}, {})
    assert store.read("labels", ["r"]).count() == 3 and store.manifest("label", "r")["folders"]["labels"] == before
    gone = store.vacuum("label", "r")
    assert len(gone) == 1 and before not in gone and store.read("labels", ["r"]).count() == 3
    assert not [n for n in store._names("_manifests/label") if n.startswith(".")]


def test_lookups(store, tmp_path):
    for d in (1, 2):
        asset(store, tmp_path, "universe", f"symbol,trading_date\nA,2026-01-0{d}\n", date(2026, 1, d))
    assert [p["day"] for p in store.partitions("universe", "universe-1", "v1")] == ["2026-01-01", "2026-01-02"] and store.partition("universe", "universe-1", "v1", "2026-01-03") is None
    pin = store.pin("universe", "universe-1", "v1", ["2026-01-01", "2026-01-02"])
    m, parts = store.snapshot_set("universe", pin["run_id"])
    assert len(parts) == 2 and m["definition_hash"] == store.definition("universe", "universe-1", "v1")["hash"]
    store.verify_rows("universe", pin["run_id"])
    store.put_manifest("universe", parts[1]["run_id"], parts[1] | {"folders": parts[0]["folders"]})
    assert code(lambda: store.verify_rows("universe", pin["run_id"])) == "PARTITION_CONTENT_MISMATCH"
    store.put_manifest("universe", parts[0]["run_id"], parts[0] | {"day": "2026-01-05"})
    assert code(lambda: store.pinned("universe", pin["run_id"])) == "PARTITION_IDENTITY_MISMATCH"


def test_backtest_run_is_reused_or_conflicts(store, tmp_path):
    ref = ingest(store, write(tmp_path, 10, "AB")).ref
    bars = store.scan(ref)
    scores = bars.where("trading_date = '2026-01-02'").select("dataset_id", "freq", F.col("bar_end_time").alias("as_of"), "symbol", F.col("close").cast("double").alias("score"), F.col("bar_end_time").alias("available_at"))
    targets = portfolio.weights(scores, portfolio.PortfolioConfig(k=1))
    one = R.backtest_run(store, "b", bars, targets, portfolio.BacktestConfig())
    assert not one.details["reused"] and R.backtest_run(store, "b", bars, targets, portfolio.BacktestConfig()).details["reused"]
    assert code(lambda: R.backtest_run(store, "b", bars, targets, portfolio.BacktestConfig(lot=100))) == "BACKTEST_RUN_CONFLICT"
    assert R.read_fills(store, "b").count() >= 1 and R.read_nav(store, "b").count() == 10 and R.read_backtest_metrics(store, "b").count() == 5


def test_failed_runs_never_wipe_committed_ones(store, spark):
    rows = spark.range(3)
    store.commit("label", "r", {"labels": rows}, {"a": 1})
    assert code(lambda: store.fail("label", "r", {})) == "RUN_ALREADY_COMMITTED" and store.read("labels", ["r"]).count() == 3
    store.commit("label", "r", {"labels": spark.range(5)}, {"a": 2})
    assert store.read("labels", ["r"]).count() == 5
    assert code(lambda: store.put_manifest("label", "../x", {})) == "INVALID_RUN_ID"


def test_cli(spark, tmp_path, capsys):
    path = write(tmp_path, 25, "A")
    assert cli.main(["ingest-bars", "--store", str(tmp_path / "s"), "--path", path, "--dataset-id", "d", "--source-id", "x"]) == 0
    ref = json.loads(capsys.readouterr().out)["ref"]
    assert cli.main(["validate-bars", "--store", str(tmp_path / "s"), "--ref", ref]) == 0
    assert cli.main(["compute-factors", "--store", str(tmp_path / "s"), "--ref", ref, "--run-id", "r", "--factor", "ret_1"]) == 0
    assert cli.main(["compute-factors", "--store", str(tmp_path / "s"), "--ref", ref, "--run-id", "r", "--factor", "ret_1"]) == 1
    capsys.readouterr()
    (tmp_path / "c.yml").write_text("store: s2\nexport: out.parquet\nsource: {path: bars.csv, dataset_id: d, source_id: x}\nresearch: {run_id: r, factors: [ret_1, volatility_20]}\n")
    assert cli.main(["run-pipeline", "--config", str(tmp_path / "c.yml")]) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["exported_rows"] == 25 and out["research"]["consumable"]


def test_streaming_bars(spark, tmp_path):
    from tessera.streaming import bars

    rows = [("A", datetime(2026, 1, 1, 0, 0, s), float(s)) for s in (5, 1, 50)]
    spark.createDataFrame(rows, "symbol string, ts timestamp, value double").write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema("symbol string, ts timestamp, value double").parquet(str(tmp_path / "t"))
    q = bars(stream).writeStream.format("memory").queryName("rolled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = spark.table("rolled").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in got] == [(1.0, 50.0, 1.0, 50.0, 3)]
