from __future__ import annotations

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.functions import divide, log
from tessera.operators import factors as X
from tessera.operators import features
from tessera.types import CodedError, QualityStatus

START = datetime(2026, 7, 1, 7)
SCHEMA = "dataset_id string, symbol string, freq string, as_of timestamp, open double, high double, low double, close double, volume double"


def frame(spark, closes, symbol="A"):
    rows = [("d", symbol, "1d", START + timedelta(days=i), c, None if c is None else c + 0.5, None if c is None else c - 0.5, c, 100.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, SCHEMA)


def run(spark, closes, *names):
    out = X.run_factors(frame(spark, closes), [X.builtin().get(n) for n in names]).orderBy("as_of").collect()
    return {n: [r[n] for r in out] for n in names}


CONFIG = X.RunConfig("run", "set", "d", "1d", ("tessera://bars",))


def test_builtin_values(spark):
    got = run(spark, [float(10 + i) for i in range(25)], "ret_1", "ret_5", "ma_5", "ma_20", "close_over_ma20", "true_range", "volatility_20", "log_ret_1")
    assert got["ret_1"][0] is None and got["ret_1"][1] == pytest.approx(0.1)
    assert got["ret_5"][4] is None and got["ret_5"][5] == pytest.approx(0.5)
    assert got["ma_5"][3] is None and got["ma_5"][4] == 12
    assert got["ma_20"][18] is None and got["ma_20"][19] == 19.5
    assert got["close_over_ma20"][19] == pytest.approx(29 / 19.5)
    assert got["true_range"][0] == 1.0 and got["true_range"][1] == 1.5
    assert got["volatility_20"][19] is None and got["volatility_20"][20] is not None
    assert got["log_ret_1"][1] == pytest.approx(math.log(11 / 10))


def test_windows_are_null_until_full_and_with_a_null_inside(spark):
    got = run(spark, [1.0, 2.0, None, 4.0, 5.0, 6.0, 7.0, 8.0], "ma_5")["ma_5"]
    assert got[:7] == [None] * 7 and got[7] == 6.0


def test_division_and_logarithm_follow_ieee(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (6.0, 3.0), (1.0, None)], "n double, d double")
    got = [r.v for r in df.select(divide(F.col("n"), F.col("d")).alias("v")).collect()]
    assert got[:2] == [math.inf, -math.inf] and math.isnan(got[2]) and got[3:] == [None, 2.0, None]
    got = [r.v for r in spark.createDataFrame([(0.0,), (-1.0,), (1.0,), (None,)], "x double").select(log(F.col("x")).alias("v")).collect()]
    assert got[0] == -math.inf and math.isnan(got[1]) and got[2:] == [0.0, None]


def test_series_are_separate(spark):
    both = frame(spark, [1.0, 2.0]).union(frame(spark, [10.0, 30.0], "B"))
    got = {(r.symbol, r.as_of.day): r.ret_1 for r in X.run_factors(both, [X.builtin().get("ret_1")]).collect()}
    assert got == {("A", 1): None, ("A", 2): 1.0, ("B", 1): None, ("B", 2): 2.0}


def test_expressions_nest_and_later_factors_read_earlier_ones(spark):
    e = X.call("op.rolling_mean", X.call("op.pct_change", X.field_("close")), window=2)
    fs = [X.Factor(X.Spec("m", mode=X.Mode.OPERATOR_GRAPH), e), X.Factor(X.Spec("twice", mode=X.Mode.OPERATOR_GRAPH, inputs=("m",)), 1 - (2 * X.field_("m")).alias("x") / 1)]
    out = X.run_factors(frame(spark, [1.0, 2.0, 3.0]), fs).orderBy("as_of").collect()
    assert [r.m for r in out] == [None, None, 0.75] and out[2].twice == -0.5


@pytest.mark.parametrize(
    ("code", "act"),
    [
        ("DUPLICATE_OPERATOR", lambda: X.default_operators().register(X.default_operators().get("op.pct_change"))),
        ("UNKNOWN_OPERATOR", lambda: X.default_operators().get("op.none")),
        ("UNKNOWN_FACTOR", lambda: X.builtin().get("none")),
        ("UNSUPPORTED_FREQUENCY", lambda: X.Registry([X.Factor(X.Spec("a", frequencies=("1d",)), None)]).get("a", freq="1m")),
        ("AMBIGUOUS_FACTOR_VERSION", lambda: X.Registry([X.Factor(X.Spec("a"), None), X.Factor(X.Spec("a", "v2"), None)]).get("a")),
        ("DUPLICATE_FACTOR", lambda: X.Registry([X.Factor(X.Spec("a"), None)] * 2)),
        ("DUPLICATE_OUTPUT_FIELD", lambda: X.Spec("a", outputs=("x", "x"))),
        ("INVALID_FACTOR_SPEC", lambda: X.Spec("", "v1")),
        ("INCOMPLETE_LINEAGE", lambda: X.RunConfig("r", "s", "d", "1d", universe_ref="u")),
    ],
)
def test_codes(code, act):
    with pytest.raises(CodedError) as e:
        act()
    assert e.value.code == code


def test_runner_guards(spark):
    f = frame(spark, [1.0])
    for code, factor in (
        ("MISSING_INPUT_FIELD", X.Factor(X.Spec("a", inputs=("nope",)), lambda w: F.lit(1))),
        ("MISSING_FACTOR_OUTPUT", X.Factor(X.Spec("a", mode=X.Mode.FRAME_TRANSFORM), lambda df, keys: df)),
        ("UNSUPPORTED_COMPUTE_MODE", X.Factor(X.Spec("a", mode=X.Mode.PYTHON_UDF), None)),
        ("UNSUPPORTED_EXPRESSION", X.Factor(X.Spec("a", mode=X.Mode.OPERATOR_GRAPH), X.Expr("weird"))),
    ):
        with pytest.raises(CodedError) as e:
            X.run_factors(f, [factor])
        assert e.value.code == code


def test_factors_share_one_exchange(spark):
    plan = X.run_factors(frame(spark, [1.0]), [X.builtin().get(n) for n in ("ret_1", "ret_5", "ma_5", "ma_20", "true_range", "volatility_20")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_long_values_snapshots_and_quality(spark):
    fs = [X.builtin().get("ret_1"), X.Factor(X.Spec("up", outputs=("up",)), lambda w: F.col("close") > 10)]
    values = features.long_values(X.run_factors(frame(spark, [0.0, 11.0, 12.0]), fs), fs, CONFIG)
    rows = {(r.as_of.day, r.output_field): r for r in values.collect()}
    assert rows[1, "ret_1"].value_kind == "null" and not rows[1, "ret_1"].warmup_complete and rows[2, "ret_1"].value_float == math.inf
    assert rows[2, "up"].value_kind == "bool" and rows[2, "up"].value_string == "true" and rows[2, "up"].value_float is None
    snap = {r.as_of.day: r for r in features.snapshots(values).collect()}
    assert snap[3].features == {"ret_1": pytest.approx(1 / 11), "up": 1.0} and snap[3].factor_run_ids == ["run"] and not snap[1].warmup_complete and snap[2].warmup_complete
    m = {(r.output_field, r.metric): (r.value, r.severity) for r in features.quality(values).collect()}
    assert m["ret_1", "row_count"] == (3.0, "INFO") and m["ret_1", "extreme_value_count"] == (1.0, "ERROR") and m["ret_1", "null_ratio"][0] == pytest.approx(1 / 3)
    assert features.overall(features.quality(values)) is QualityStatus.FAILED
    twice = features.quality(values.union(values))
    assert {r.output_field: r.value for r in twice.where("metric = 'duplicate_key_count'").collect()} == {"ret_1": 3.0, "up": 3.0}
    assert features.duplicate_keys(values.union(values), features.FEATURE_KEY) == 6


def test_declared_leaks_count_every_row(spark):
    fs = [X.Factor(X.Spec("next", forward_bars=1), lambda w: F.lead("close").over(w))]
    m = features.quality(features.long_values(X.run_factors(frame(spark, [1.0, 2.0]), fs), fs, CONFIG))
    assert m.where("metric = 'future_leakage_count'").first().value == 2.0


def test_probe_flags_a_peek_once_and_a_causal_factor_never(spark):
    peek = X.Factor(X.Spec("peek"), lambda w: F.lead("close").over(w) / F.col("close") - 1)
    fs = [peek, X.builtin().get("ret_1"), X.builtin().get("volatility_20")]
    config = features.ProbeConfig(features.CutMode.EXPLICIT, min_prefix_rows=1, explicit=(START + timedelta(days=2),))
    metrics, shown = features.probe(frame(spark, [10.0, 11.0, 12.0, 13.0, 14.0]), fs, config)
    m = {(r.output_field, r.metric): r.value for r in metrics.collect()}
    assert m["peek", "prefix_invariance_violation_count"] == 1 and m["ret_1", "prefix_invariance_violation_count"] == 0 and m["volatility_20", "prefix_invariance_violation_count"] == 0
    assert m["peek", "prefix_probe_compared_value_count"] == 3 and m["peek", "prefix_probe_changed_ratio"] == pytest.approx(1 / 3)
    assert [r.as_of.day for r in shown.collect()] == [3]


def test_cutpoints(spark):
    f = frame(spark, [float(i) for i in range(60)])
    even, _ = features.cutpoints(f, features.ProbeConfig(cutpoints=3))
    assert [(t - START).days for t in even] == [19, 39, 58]  # round(19.5) is 20
    ends, _ = features.cutpoints(f, features.ProbeConfig(features.CutMode.PERIOD_END, min_prefix_rows=1))
    assert [(t - START).days for t in ends] == [30, 58]
    got, skipped = features.cutpoints(f, features.ProbeConfig(features.CutMode.EXPLICIT, explicit=(START, START + timedelta(days=59), START + timedelta(days=30))))
    assert got == [START + timedelta(days=30)] and skipped == 2
    assert features.cutpoints(frame(spark, [1.0]), features.ProbeConfig()) == ([], 0)
