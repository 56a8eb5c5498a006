"""Equal-weight portfolios, the daily backtest and its analytics."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import ROUND_FLOOR, Decimal
from enum import StrEnum
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..types import CodedError
from .features import assert_unique

GROUP = ["dataset_id", "freq", "as_of"]


class Selection(StrEnum):
    TOP_K = "TOP_K"
    TOP_QUANTILE = "TOP_QUANTILE"


@dataclass(frozen=True)
class PortfolioConfig:
    selection: Selection = Selection.TOP_K
    k: int = 10
    quantiles: int = 5
    target: int = 5
    gross: float = 1.0

    def __post_init__(self) -> None:
        if self.k < 1 or self.quantiles < 2 or not 1 <= self.target <= self.quantiles or not 0 < self.gross <= 1:
            raise CodedError("INVALID_PORTFOLIO_CONFIG")


def weights(scores: DataFrame, config: PortfolioConfig, checked: bool = False) -> DataFrame:
    """dataset_id, freq, as_of, symbol, weight, available_at. Scores fall, ties go by symbol; a group that selects nothing is not there."""
    if not checked:
        assert_unique(scores, [*GROUP, "symbol"], "DUPLICATE_SCORE_KEY")
    w = Window.partitionBy(*GROUP)
    pos = F.row_number().over(w.orderBy(F.desc("score"), "symbol")) - 1
    ranked = scores.select(*GROUP, "symbol", "available_at", pos.alias("pos"), F.count("*").over(w).alias("n"))
    if config.selection is Selection.TOP_K:
        chosen = ranked.where(F.col("pos") < config.k)
    else:
        chosen = ranked.where(config.quantiles - F.floor(F.col("pos") * config.quantiles / F.col("n")) == config.target)
    return chosen.select(*GROUP, "symbol", (F.lit(config.gross) / F.count("*").over(w)).alias("weight"), F.max("available_at").over(w).alias("available_at"))


def check_targets(targets: DataFrame, bound: float = 1 + 1e-12) -> None:
    if targets.isEmpty():
        raise CodedError("EMPTY_TARGET_SET")
    if targets.select("dataset_id").distinct().limit(2).count() > 1:
        raise CodedError("MULTIPLE_DATASETS")
    if not targets.where(F.col("freq") != "1d").isEmpty():
        raise CodedError("UNSUPPORTED_FREQUENCY")
    assert_unique(targets, ["as_of", "symbol"], "DUPLICATE_TARGET_KEY")
    if not targets.groupBy("as_of").agg(F.sum("weight").alias("w")).where(F.col("w") > bound).isEmpty():
        raise CodedError("EXPOSURE_EXCEEDED")


@dataclass(frozen=True)
class Costs:
    """Cost is notional times the side's rate."""

    buy_rate: Decimal = Decimal(0)
    sell_rate: Decimal = Decimal(0)

    def __post_init__(self) -> None:
        for r in (self.buy_rate, self.sell_rate):
            if not 0 <= r < 1:
                raise CodedError("INVALID_COST_RATE", str(r))

    def of(self, side: str, notional: Decimal) -> Decimal:
        return notional * (self.buy_rate if side == "BUY" else self.sell_rate)


def tradable(bar: dict, side: str) -> bool:
    """The default eligibility: an open price and some volume."""
    return bar["open"] > 0 and bar["volume"] > 0


@dataclass(frozen=True)
class BacktestConfig:
    cash: Decimal = Decimal(1_000_000)
    lot: int = 1
    costs: Costs = field(default_factory=Costs)
    eligible: Callable[[dict, str], bool] = tradable

    def __post_init__(self) -> None:
        if self.cash <= 0 or self.lot < 1:
            raise CodedError("INVALID_BACKTEST_CONFIG")


EVENT = "backtest_run_id string, kind string, trading_date date, at timestamp, symbol string, side string, quantity long, price decimal(28,10), amount decimal(28,10), cost decimal(28,10), cash decimal(28,10), seq long"


def _floor(x: Decimal, lot: int) -> int:
    return int((x / lot).to_integral_value(rounding=ROUND_FLOOR)) * lot


class _Day:
    """One day's bars, and whether any of them comes after some moment."""

    def __init__(self, date, rows: list[dict]) -> None:
        self.date, self.bars = date, {}
        for b in rows:
            if b["symbol"] in self.bars:
                raise CodedError("DUPLICATE_DAILY_BAR", f"{b['symbol']} {date}")
            self.bars[b["symbol"]] = b
        by_start = sorted(((b["bar_start_time"], b["bar_end_time"]) for b in rows), reverse=True)
        self._starts = [start for start, _ in reversed(by_start)]
        self._ends = list(accumulate((end for _, end in by_start), max))[::-1]  # the last end of the bars from here on
        self.end = self._ends[0]

    def follows(self, as_of, available) -> bool:
        i = bisect_left(self._starts, available)
        return i < len(self._starts) and self._ends[i] > as_of


class _Goal:
    """The weights of one as_of, and when the last of them was there."""

    def __init__(self, as_of, rows: list[dict]) -> None:
        self.as_of = as_of
        self.weights = {t["symbol"]: (Decimal(str(t["weight"])), t["available_at"]) for t in rows}
        self.available = max(at for _, at in self.weights.values())

    def quantity(self, bar: dict, nav: Decimal, lot: int) -> int | None:
        """What to hold of a bar's symbol by its open, or None if the bar comes too early for it."""
        weight, at = self.weights.get(bar["symbol"], (None, self.available))
        if bar["bar_end_time"] <= self.as_of or bar["bar_start_time"] < at:
            return None
        if bar["open"] <= 0:
            raise CodedError("INVALID_EXECUTION_PRICE", f"{bar['symbol']} {bar['trading_date']}")
        return 0 if weight is None else _floor(nav * weight / bar["open"], lot)


class _Account:
    """Cash, quantities and last closes of one run, and the events that they make."""

    def __init__(self, config: BacktestConfig) -> None:
        self.config, self.cash = config, config.cash
        self.held: dict[str, int] = {}
        self.closes: dict[str, Decimal] = {}
        self.events: list[dict] = []
        self.fills = 0

    def _event(self, kind: str, day: _Day, at, **values) -> None:
        self.events.append(dict.fromkeys(("symbol", "side", "quantity", "price", "amount", "cost", "cash", "seq")) | {"kind": kind, "trading_date": day.date, "at": at} | values)

    def worth(self, day: _Day) -> Decimal:
        """Value at the opens, by the last close where a symbol has no bar."""
        opens = {s: day.bars[s]["open"] if s in day.bars else self.closes.get(s) for s in self.held}
        if lack := [s for s, price in opens.items() if price is None]:
            raise CodedError("MISSING_MARK_PRICE", lack[0])
        return self.cash + sum(q * opens[s] for s, q in self.held.items())

    def trade(self, day: _Day, symbol: str, change: int) -> None:
        """As much of a change as the rules and, for a purchase, the cash allow."""
        bar, side = day.bars[symbol], "BUY" if change > 0 else "SELL"
        if not self.config.eligible(bar, side):
            return
        if change > 0:
            change = min(change, max(0, _floor(self.cash / (bar["open"] * (1 + self.config.costs.buy_rate)), self.config.lot)))
        if not change:
            return
        amount = bar["open"] * abs(change)
        cost = self.config.costs.of(side, amount)
        self.cash -= bar["open"] * change + cost
        self.held[symbol] = self.held.get(symbol, 0) + change
        if not self.held[symbol]:
            del self.held[symbol]
        self.fills += 1
        self._event("FILL", day, bar["bar_start_time"], symbol=symbol, side=side, quantity=abs(change), price=bar["open"], amount=amount, cost=cost, cash=self.cash, seq=self.fills)

    def move(self, day: _Day, goal: _Goal, symbols: set[str]) -> set[str]:
        """Trades towards a goal, sales first and each side by symbol; returns the symbols that are not there yet."""
        nav = self.worth(day)
        wanted = {s: goal.quantity(day.bars[s], nav, self.config.lot) for s in sorted(symbols & day.bars.keys())}
        gap = {s: want - self.held.get(s, 0) for s, want in wanted.items() if want is not None}
        for s in sorted(gap, key=lambda s: gap[s] > 0):
            if gap[s]:
                self.trade(day, s, gap[s])
        return {s for s in symbols if s not in gap or self.held.get(s, 0) != wanted[s]}

    def close(self, day: _Day) -> None:
        self.closes |= {s: b["close"] for s, b in day.bars.items()}
        total = self.cash
        for s, q in sorted(self.held.items()):
            total += q * self.closes[s]
            self._event("POSITION", day, day.end, symbol=s, quantity=q, price=self.closes[s], amount=q * self.closes[s])
        self._event("NAV", day, day.end, amount=total, cash=self.cash)


def _grouped(rows: list[dict], key: str) -> list[tuple]:
    out: dict = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return sorted(out.items(), key=lambda x: x[0])


def simulate(bars: list[dict], targets: list[dict], config: BacktestConfig) -> list[dict]:
    """FILL, POSITION and NAV events of one run.

    Goals stand in the order of their as_of, and a day moves on to the last one that it follows: one of its bars ends after the
    as_of and starts when all weights were there. Then what is held and what is wanted is open until its quantity is reached.
    """
    days = [_Day(date, rows) for date, rows in _grouped(bars, "trading_date")]
    if not days:
        raise CodedError("NO_MATCHING_BARS")
    goals = [_Goal(as_of, rows) for as_of, rows in _grouped(targets, "as_of")]
    account, at, waiting = _Account(config), -1, set()
    for day in days:
        due = bisect_left(goals, day.end, key=lambda g: g.as_of)
        newest = next((i for i in range(due - 1, at, -1) if day.follows(goals[i].as_of, goals[i].available)), at)
        if newest > at:
            at, waiting = newest, account.held.keys() | goals[newest].weights.keys()
        if waiting:
            waiting = account.move(day, goals[at], waiting)
        account.close(day)
    return account.events


def backtest(bars: DataFrame, targets: DataFrame, config: BacktestConfig) -> DataFrame:
    """Events of every run in targets[backtest_run_id]. Cash feeds back into quantities, so one run is sequential; runs are spread.

    Bars: symbol, trading_date, bar_start_time, bar_end_time, open, close, volume (texts or numbers).
    """
    money = "decimal(28,10)"
    keys = targets.select("backtest_run_id", "dataset_id").distinct()
    own = bars.select("dataset_id", "symbol", "trading_date", "bar_start_time", "bar_end_time", F.col("open").cast(money), F.col("close").cast(money), F.col("volume").cast(money))
    own = own.join(keys, "dataset_id").drop("dataset_id")
    own = own.select(*[F.col(c).alias(c) for c in own.columns])
    goal = targets.select(*[F.col(c).alias(c) for c in ("backtest_run_id", "as_of", "symbol", "weight", "available_at")])  # names of its own: both sides may come from one table

    def run(key: tuple, b: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        rows = simulate(b.to_dict("records"), t.to_dict("records"), config)
        names = [x.split()[0] for x in EVENT.split(", ")]
        return pd.DataFrame([{**r, "backtest_run_id": key[0]} for r in rows], columns=names).astype({"quantity": "Int64", "seq": "Int64"})

    return own.groupBy("backtest_run_id").cogroup(goal.groupBy("backtest_run_id")).applyInPandas(run, EVENT)


def drawdowns(nav: DataFrame) -> DataFrame:
    """Each run's NAV with its running peak, from the first NAV on, and the drawdown against it."""
    w = Window.partitionBy("backtest_run_id").orderBy("trading_date").rowsBetween(Window.unboundedPreceding, 0)
    peak = F.max("nav").over(w)
    return nav.withColumn("peak", peak).withColumn("drawdown", F.when(F.col("peak") > 0, (F.col("peak") - F.col("nav")) / F.col("peak")).otherwise(0.0))


def analytics(events: DataFrame, cash: float) -> DataFrame:
    """backtest_run_id, metric, value: total_return, maximum_drawdown, turnover, total_cost, trade_count."""
    nav = events.where("kind = 'NAV'").select("backtest_run_id", "trading_date", F.col("amount").cast("double").alias("nav"))
    a = drawdowns(nav).groupBy("backtest_run_id").agg((F.max_by("nav", "trading_date") / cash - 1).alias("total_return"), F.max("drawdown").alias("maximum_drawdown"))
    fills = events.where("kind = 'FILL'").groupBy("backtest_run_id").agg((F.sum("amount").cast("double") / cash).alias("turnover"), F.sum("cost").cast("double").alias("total_cost"), F.count("*").cast("double").alias("trade_count"))
    both = a.join(fills, "backtest_run_id", "left").fillna(0.0)
    return both.unpivot("backtest_run_id", ["total_return", "maximum_drawdown", "turnover", "total_cost", "trade_count"], "metric", "value")
