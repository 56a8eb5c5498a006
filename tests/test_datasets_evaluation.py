from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import datasets, evaluation, labels
from tessera.types import CodedError

T0 = datetime(2026, 1, 5, 7)
KEY = "dataset_id string, symbol string, freq string, as_of timestamp"


def bars(spark, series):
    rows = [("d", s, "1d", T0 + timedelta(days=i), T0 + timedelta(days=i), str(c)) for s, cs in series.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "dataset_id string, symbol string, freq string, bar_start_time timestamp, bar_end_time timestamp, close string")


def test_returns_of_very_small_prices(spark):
    got = labels.forward_returns(bars(spark, {"A": ["0.0000014", "0.0000024"]}), labels.ForwardReturn("set", "fwd")).orderBy("as_of").first()
    assert got.value_float == pytest.approx(1.0 / 1.4, rel=1e-12)


def test_forward_returns_stay_in_their_series(spark):
    got = labels.forward_returns(bars(spark, {"A": ["10.0", "11.0", "12.1"], "B": ["20", "18"]}), labels.ForwardReturn("set", "fwd")).orderBy("symbol", "as_of").collect()
    assert [r.value_float for r in got] == [pytest.approx(0.1), pytest.approx(0.1), None, pytest.approx(-0.1), None]


def test_label_quality(spark):
    out = labels.forward_returns(bars(spark, {"A": ["10", "11"], "B": ["1", "2"]}), labels.ForwardReturn("set", "fwd"))
    m = {r.metric: (r.value, r.severity) for r in labels.quality(out, max_null_ratio=0.4).collect()}
    assert m["row_count"] == ("4", "INFO") and m["null_ratio"] == ("0.5", "ERROR") and m["symbol_count"][0] == "2" and m["as_of_min"][0] == "2026-01-05 07:00:00"
    with pytest.raises(CodedError):
        labels.ForwardReturn("s", "l", 0)


def cross(spark, x, y, day=T0):
    s = [("d", f"S{i:03d}", "1d", day, {"f": v}, ["r"], True, "set") for i, v in enumerate(x)]
    t = [("d", f"S{i:03d}", "1d", day, "y", "v1", "run", v) for i, v in enumerate(y)]
    return spark.createDataFrame(s, KEY + ", features map<string,double>, factor_run_ids array<string>, warmup_complete boolean, feature_set_id string"), spark.createDataFrame(t, KEY + ", label_id string, label_version string, source_run_id string, value_float double")


def values(spark, x, y, **how):
    how = {"min_samples": 2, **how}
    out = evaluation.evaluate(evaluation.Request(("f",), "y", **how), *cross(spark, x, y)).collect()
    return {(r.metric, r.bucket): r for r in out}


def test_perfect_and_inverted(spark):
    up = values(spark, [1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 5.0])
    assert up["SPEARMAN_RANK_IC", None].value == pytest.approx(1) and up["PEARSON_IC", None].value == pytest.approx(0.982708, abs=1e-6)
    assert values(spark, [1.0, 2.0, 3.0], [3.0, 2.0, 1.0])["PEARSON_IC", None].value == pytest.approx(-1)


def test_tied_ranks(spark):
    x, y = [1.0, 2.0, 2.0, 4.0], [2.0, 1.0, 3.0, 4.0]
    rx, ry = [1, 2.5, 2.5, 4], [2, 1, 3, 4]
    mx, my = sum(rx) / 4, sum(ry) / 4
    want = sum((a - mx) * (b - my) for a, b in zip(rx, ry)) / (sum((a - mx) ** 2 for a in rx) * sum((b - my) ** 2 for b in ry)) ** 0.5
    assert values(spark, x, y)["SPEARMAN_RANK_IC", None].value == pytest.approx(want)


def test_constant_input_keeps_quantiles(spark):
    got = values(spark, [7.0] * 6, [0.0, 1.0, 2.0, 3.0, 4.0, 5.0], quantiles=2)
    assert got["PEARSON_IC", None].status == "CONSTANT_INPUT" and got["PEARSON_IC", None].value is None
    assert got["QUANTILE_RETURN", 1].value == 1 and got["QUANTILE_RETURN", 2].value == 4 and got["LONG_SHORT_RETURN", None].value == 3
    low = values(spark, [7.0] * 6, [0.0, 1.0, 2.0, 3.0, 4.0, 5.0], quantiles=2, direction=evaluation.Direction.LOW_MINUS_HIGH)
    assert low["LONG_SHORT_RETURN", None].value == -3


def test_buckets_are_not_ntile(spark):
    got = values(spark, [float(i) for i in range(7)], [1.0 * i * i for i in range(7)])
    assert [got["QUANTILE_RETURN", b].sample_count for b in range(1, 6)] == [2, 1, 2, 1, 1]


def test_small_samples_and_not_finite_pairs(spark):
    got = values(spark, [1.0, float("nan"), float("inf"), None], [1.0] * 4, min_samples=2)
    assert {k[0] for k in got} == {"PEARSON_IC", "SPEARMAN_RANK_IC"} and got["PEARSON_IC", None].status == "INSUFFICIENT_SAMPLE" and got["PEARSON_IC", None].sample_count == 1


def test_random_input_has_no_skill(spark):
    r = random.Random(7)
    got = values(spark, [r.random() for _ in range(200)], [r.random() for _ in range(200)])
    assert abs(got["PEARSON_IC", None].value) < 0.15


def test_evaluation_codes(spark):
    s, t = cross(spark, [1.0, 2.0], [1.0, 2.0])
    for code, request, a, b in (
        ("LABEL_FIELD_NOT_FOUND", evaluation.Request(("f",), "z"), s, t),
        ("FACTOR_FIELD_NOT_FOUND", evaluation.Request(("g",), "y"), s, t),
        ("DUPLICATE_LABEL_KEY", evaluation.Request(("f",), "y"), s, t.union(t)),
        ("DUPLICATE_FEATURE_KEY", evaluation.Request(("f",), "y"), s.union(s), t),
        ("EMPTY_FEATURE_INPUT", evaluation.Request(("f",), "y"), s.limit(0), t),
        ("NO_ALIGNED_ROWS", evaluation.Request(("f",), "y"), s, t.withColumn("freq", F.lit("1m"))),
    ):
        with pytest.raises(CodedError) as e:
            evaluation.evaluate(request, a, b)
        assert e.value.code == code


def test_matrix_joins_and_filters(spark):
    s, t = cross(spark, [1.0, 2.0, 3.0], [0.5, None])
    x, y = datasets.feature_matrix(s), datasets.label_matrix(t)
    both = datasets.join(x, y)
    assert sorted(both.columns) == sorted([*x.columns, "y"]) and both.count() == 2
    assert [r.symbol for r in datasets.only_features(x, y).collect()] == ["S002"] and datasets.only_labels(x, y).count() == 0
    kept, dropped = datasets.filtered(both, ["y"])
    assert kept.count() == 1 and dropped == {"dropped_warmup": 0, "dropped_null_labels": 1}
    later = t.limit(1).withColumns({"label_version": F.lit("v2"), "value_float": F.lit(9.0)})
    assert datasets.label_matrix(t.union(later)).where("symbol = 'S000'").first().y == 9.0
    with pytest.raises(CodedError):
        datasets.join(x.withColumn("y", F.lit(1)), y)


def test_compatibility_codes():
    base = {"dataset_id": "d", "freq": "1d", "definition_hash": "h", "universe_hash": None, "start": "1", "end": "5"}
    datasets.check_compatible(base, base)
    datasets.check_compatible(base | {"definition_hash": None}, base)  # only one side is pinned
    datasets.check_compatible(base | {"universe_hash": "x"}, base)  # the labels name no universe
    for change, code in (({"dataset_id": "e"}, "DATASET_ID_MISMATCH"), ({"freq": "1m"}, "FREQUENCY_MISMATCH"), ({"definition_hash": "x"}, "MARKET_DATA_DEFINITION_MISMATCH"), ({"universe_hash": "x"}, "UNIVERSE_LINEAGE_MISMATCH"), ({"end": "4"}, "LABEL_SOURCE_RANGE_MISMATCH"), ({"pinned": True}, "LABEL_FORWARD_HORIZON_NOT_COVERED")):
        with pytest.raises(CodedError) as e:
            datasets.check_compatible(base, base | change)
        assert e.value.code == code


def periods(spark, n):
    return spark.createDataFrame([(T0 + timedelta(days=i), s) for i in range(n) for s in "AB"], "as_of timestamp, symbol string")


def test_rolling_folds(spark):
    found = datasets.folds(periods(spark, 12), datasets.SplitPlan(4, 2, 2, 1, 1)).collect()
    at = {(r.fold_id, r.part): ((r["first"] - T0).days, (r["last"] - T0).days) for r in found}
    assert len({f for f, _ in at}) == 3 and at["fold-000", "train"] == (0, 3) and at["fold-000", "purge"] == (4, 4) and at["fold-000", "embargo"] == (5, 5) and at["fold-000", "test"] == (6, 7) and at["fold-002", "test"] == (10, 11)
    assert datasets.assign(periods(spark, 12), datasets.folds(periods(spark, 12), datasets.SplitPlan(4, 2, 2, 1, 1))).where("part = 'test'").count() == 12


def test_expanding_folds_and_codes(spark):
    found = datasets.folds(periods(spark, 11), datasets.SplitPlan(4, 2, mode=datasets.SplitMode.EXPANDING)).where("part = 'train'").orderBy("fold_id").collect()
    assert [r.n_periods for r in found] == [4, 6, 8]
    for code, act in (("INVALID_SPLIT_PLAN", lambda: datasets.SplitPlan(0, 1)), ("OVERLAPPING_OOS_WINDOWS", lambda: datasets.SplitPlan(4, 2, 1)), ("INSUFFICIENT_PERIODS", lambda: datasets.folds(periods(spark, 5), datasets.SplitPlan(4, 2)))):
        with pytest.raises(CodedError) as e:
            act()
        assert e.value.code == code
