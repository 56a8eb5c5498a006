from __future__ import annotations

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest

from tessera.operators import portfolio as P
from tessera.types import CodedError

DAY = date(2026, 7, 1)


def scores(spark, values):
    t = datetime(2026, 7, 1, 7)
    return spark.createDataFrame([("d", "1d", t, s, v, t + timedelta(minutes=i)) for i, (s, v) in enumerate(values.items())], "dataset_id string, freq string, as_of timestamp, symbol string, score double, available_at timestamp")


def test_ties_go_by_symbol(spark):
    got = P.weights(scores(spark, {"B": 1.0, "A": 1.0, "C": 0.5}), P.PortfolioConfig(k=1)).collect()
    assert [(r.symbol, r.weight) for r in got] == [("A", 1.0)]


def test_quantiles_cover_all(spark):
    seen = []
    for q in range(1, 6):
        chosen = P.weights(scores(spark, {f"S{i}": float(i) for i in range(6)}), P.PortfolioConfig(P.Selection.TOP_QUANTILE, target=q)).collect()
        assert chosen
        seen += [r.symbol for r in chosen]
    assert sorted(seen) == [f"S{i}" for i in range(6)]
    top = P.weights(scores(spark, {f"S{i}": float(i) for i in range(6)}), P.PortfolioConfig(P.Selection.TOP_QUANTILE, gross=0.5)).collect()
    assert {r.symbol for r in top} == {"S5", "S4"} and {r.weight for r in top} == {0.25}


def test_codes(spark):
    with pytest.raises(CodedError):
        P.weights(scores(spark, {"A": 1.0}).union(scores(spark, {"A": 1.0})), P.PortfolioConfig())
    for bad in (lambda: P.PortfolioConfig(k=0), lambda: P.Costs(Decimal(1)), lambda: P.BacktestConfig(cash=Decimal(0))):
        with pytest.raises(CodedError):
            bad()
    with pytest.raises(CodedError) as e:
        P.simulate([], [], P.BacktestConfig())
    assert e.value.code == "NO_MATCHING_BARS"
    with pytest.raises(CodedError) as e:
        P.simulate([bar(0, 10, 10)] * 2, [], P.BacktestConfig())
    assert e.value.code == "DUPLICATE_DAILY_BAR"


def bar(day, open_, close, symbol="A", volume=100000):
    d = DAY + timedelta(days=day)
    at = datetime(d.year, d.month, d.day, 1, 30)
    return {"symbol": symbol, "trading_date": d, "bar_start_time": at, "bar_end_time": at + timedelta(hours=5, minutes=30), "open": Decimal(open_), "close": Decimal(close), "volume": Decimal(volume)}


def target(day, weight=1.0, symbol="A"):
    t = bar(day, 1, 1)["bar_end_time"]
    return {"as_of": t, "symbol": symbol, "weight": weight, "available_at": t}


def events(bars, targets, kind, **how):
    return [e for e in P.simulate(bars, targets, P.BacktestConfig(**{"cash": Decimal(1000), **how})) if e["kind"] == kind]


BARS = [bar(0, 10, 10), bar(1, 10, 11), bar(2, 11, 12)]


def test_buys_at_the_next_open():
    fills = events(BARS, [target(0)], "FILL")
    assert [(f["side"], f["quantity"], f["price"], f["trading_date"].day) for f in fills] == [("BUY", 100, 10, 2)]
    assert [n["amount"] for n in events(BARS, [target(0)], "NAV")] == [1000, 1100, 1200]
    assert [p["quantity"] for p in events(BARS, [target(0)], "POSITION")] == [100, 100]


def test_costs_and_lots():
    fills = events(BARS, [target(0)], "FILL", costs=P.Costs(Decimal("0.01")))
    assert fills[0]["quantity"] == 99 and fills[0]["cost"] == Decimal("9.90")
    assert events(BARS, [target(0, 0.55)], "FILL", lot=10)[0]["quantity"] == 50


def test_stays_pending_until_it_can_trade():
    bars = [bar(0, 10, 10), bar(1, 10, 10, volume=0), bar(2, 10, 10)]
    assert [f["trading_date"].day for f in events(bars, [target(0)], "FILL")] == [3]
    assert events(bars, [target(0)], "FILL", eligible=lambda b, side: False) == []


def test_a_later_target_replaces_an_earlier_one():
    bars = [bar(d, 10, 10, s) for d in range(3) for s in "AB"]
    fills = events(bars, [target(0, 1.0, "A"), target(1, 1.0, "B")], "FILL")
    assert [(f["symbol"], f["side"], f["quantity"]) for f in fills] == [("A", "BUY", 100), ("A", "SELL", 100), ("B", "BUY", 100)]


def test_missing_mark_and_bad_price():
    with pytest.raises(CodedError) as e:
        events([bar(0, 10, 10), bar(1, 0, 10)], [target(0)], "FILL")
    assert e.value.code == "INVALID_EXECUTION_PRICE"


def test_distributed_runs_and_analytics(spark):
    rows = [("d", b["symbol"], b["trading_date"], b["bar_start_time"], b["bar_end_time"], str(b["open"]), str(b["close"]), "100000") for b in BARS]
    bars = spark.createDataFrame(rows, "dataset_id string, symbol string, trading_date date, bar_start_time timestamp, bar_end_time timestamp, open string, close string, volume string")
    t = target(0)
    goal = spark.createDataFrame([(r, "d", "1d", t["as_of"], "A", w, t["available_at"]) for r, w in (("one", 1.0), ("half", 0.5))], "backtest_run_id string, dataset_id string, freq string, as_of timestamp, symbol string, weight double, available_at timestamp")
    out = P.backtest(bars, goal, P.BacktestConfig(cash=Decimal(1000)))
    nav = {(r.backtest_run_id, r.trading_date.day): float(r.amount) for r in out.where("kind = 'NAV'").collect()}
    assert nav["one", 3] == 1200 and nav["half", 3] == 1100
    m = {(r.backtest_run_id, r.metric): r.value for r in P.analytics(out, 1000.0).collect()}
    assert m["one", "total_return"] == pytest.approx(0.2) and m["one", "trade_count"] == 1 and m["half", "turnover"] == 0.5 and m["one", "maximum_drawdown"] == 0


def test_target_checks(spark):
    t = datetime(2026, 7, 1)
    make = lambda *rows: spark.createDataFrame([(d, f, t, s, w, t) for d, f, s, w in rows], "dataset_id string, freq string, as_of timestamp, symbol string, weight double, available_at timestamp")
    P.check_targets(make(("d", "1d", "A", 1.0)))
    for code, rows in (("EXPOSURE_EXCEEDED", [("d", "1d", "A", 0.6), ("d", "1d", "B", 0.6)]), ("DUPLICATE_TARGET_KEY", [("d", "1d", "A", 0.1)] * 2), ("UNSUPPORTED_FREQUENCY", [("d", "1m", "A", 0.1)]), ("MULTIPLE_DATASETS", [("d", "1d", "A", 0.1), ("e", "1d", "B", 0.1)])):
        with pytest.raises(CodedError) as e:
            P.check_targets(make(*rows))
        assert e.value.code == code
