"""Expected slots from calendar, universe and statuses, and their comparison with actual bars."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from enum import StrEnum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import CodedError, Frequency, Severity

SLOT = ["trading_date", "symbol", "expected_at"]


class Policy(StrEnum):
    STRICT = "STRICT"
    WARNING = "WARNING"


@dataclass(frozen=True)
class Request:
    start: date
    end: date
    freq: str = "1d"
    timezone: str = "Asia/Shanghai"
    label: str = "BAR_END"
    policy: Policy = Policy.STRICT
    min_ratio: float = 1.0

    def __post_init__(self) -> None:
        if self.start > self.end or not 0 <= self.min_ratio <= 1 or self.freq not in tuple(Frequency) or self.label not in ("BAR_START", "BAR_END"):
            raise CodedError("INVALID_COVERAGE_REQUEST")


@dataclass(frozen=True)
class Generation:
    """scope: (trading_date, symbol, resolved); slots: SLOT; issues: code, severity, trading_date, symbol, expected_at."""

    scope: DataFrame
    slots: DataFrame
    issues: DataFrame


def _issue(df: DataFrame, code: str, severity: Severity, at: str = "CAST(NULL AS timestamp)") -> DataFrame:
    return df.select(F.lit(code).alias("code"), F.lit(str(severity)).alias("severity"), "trading_date", "symbol", F.expr(at).alias("expected_at"))


def expected_slots(request: Request, calendar: DataFrame, members: DataFrame, statuses: DataFrame) -> Generation:
    """calendar: calendar_date, states, sessions; members: trading_date, instrument_id; statuses: trading_date, instrument_id, bar_expectation, intervals.

    A closed day resolves its members without slots. Days are few, so the calendar is broadcast if it is
    small; members and statuses meet on (date, symbol).
    """
    days = calendar.where(F.col("calendar_date").between(F.lit(request.start), F.lit(request.end))).select(F.col("calendar_date").alias("trading_date"), F.array_contains("states", True).alias("opened"), "sessions")
    who = members.select("trading_date", F.col("instrument_id").alias("symbol")).distinct().join(days, "trading_date")
    state = statuses.select("trading_date", F.col("instrument_id").alias("symbol"), "bar_expectation", "intervals")
    base = who.join(state, ["trading_date", "symbol"], "left")
    unknown = F.col("opened") & (F.col("bar_expectation").isNull() | (F.col("bar_expectation") == "UNKNOWN"))
    base = base.withColumn("resolved", ~unknown)
    broken = F.expr("exists(sessions, s -> s.start IS NULL OR s.end IS NULL)")
    full, custom = F.col("bar_expectation") == "FULL_SESSION", F.col("bar_expectation") == "CUSTOM_INTERVALS"
    active = base.where(F.col("opened") & F.col("resolved") & (full | custom))
    bad = active.where(full & broken)
    active = active.where(~(full & broken))
    spans = F.when(custom, F.transform("intervals", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))).otherwise(F.transform("sessions", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    issues = _issue(base.where(unknown), "UNKNOWN_EXPECTATION", Severity.ERROR).unionByName(_issue(bad, "INVALID_CALENDAR_SESSION", Severity.ERROR))
    at = lambda s: F.to_utc_timestamp(F.timestamp_seconds(F.unix_date("trading_date").cast("long") * 86400 + s), F.lit(request.timezone))
    if request.freq == Frequency.D1:
        edge = F.expr("array_min(transform(sessions, s -> s.start))") if request.label == "BAR_START" else F.expr("array_max(transform(sessions, s -> s.end))")
        slots = active.select("trading_date", "symbol", at(edge).alias("expected_at"))
    else:
        step = Frequency(request.freq).minutes * 60
        each = active.select("trading_date", "symbol", F.explode(spans).alias("x"))
        issues = issues.unionByName(_issue(each.where("x.start IS NULL OR x.end IS NULL OR x.start >= x.end"), "INVALID_EXPECTED_INTERVAL", Severity.ERROR))
        cut = each.where(F.expr(f"x.start < x.end AND x.start + {step} <= x.end"))
        slot = cut.select("trading_date", "symbol", F.explode(F.expr(f"sequence(x.start, x.end - {step}, {step})")).alias("s"))
        slots = slot.select("trading_date", "symbol", at(F.col("s") + (step if request.label == "BAR_END" else 0)).alias("expected_at"))
    return Generation(base.select("trading_date", "symbol", "resolved").distinct(), slots.distinct(), issues)


@dataclass(frozen=True)
class Analysis:
    metrics: DataFrame
    issues: DataFrame


def compare(request: Request, g: Generation, bars: DataFrame) -> Analysis:
    """Expected against actual slots. A day is one slot whatever its time; unresolved symbol-days count as actual, never as unexpected."""
    daily = request.freq == Frequency.D1
    none = F.lit(None).cast("timestamp")
    time = none if daily else (F.col("bar_end_time") if request.label == "BAR_END" else F.col("bar_start_time"))
    inside = bars.where((F.col("freq") == request.freq) & F.col("trading_date").between(F.lit(request.start), F.lit(request.end)))
    inside = inside.select("trading_date", "symbol", time.alias("k")).join(g.scope, ["trading_date", "symbol"])
    actual = inside.groupBy("trading_date", "symbol", "k").agg(F.count("*").alias("times"), F.first("resolved").alias("resolved"))
    want = g.slots.select("trading_date", "symbol", (none if daily else F.col("expected_at")).alias("k"), "expected_at").withColumn("e", F.lit(True))
    a, w = actual.alias("a"), want.alias("w")
    on = (F.col("a.trading_date") == F.col("w.trading_date")) & (F.col("a.symbol") == F.col("w.symbol")) & F.col("a.k").eqNullSafe(F.col("w.k"))
    pair = w.join(a, on, "full_outer").select(F.coalesce("w.trading_date", "a.trading_date").alias("trading_date"), F.coalesce("w.symbol", "a.symbol").alias("symbol"), F.coalesce("w.expected_at", "a.k").alias("expected_at"), F.coalesce("e", F.lit(False)).alias("e"), F.col("times").isNotNull().alias("a"), F.coalesce("resolved", F.lit(True)).alias("r"), F.coalesce("times", F.lit(0)).alias("times"))
    missing, extra = F.col("e") & ~F.col("a"), F.col("a") & ~F.col("e") & F.col("r")
    counts = pair.groupBy("trading_date", "symbol").agg(F.count_if("e").alias("expected"), F.count_if("a").alias("actual"), F.count_if(F.col("e") & F.col("a")).alias("matched"), F.count_if(missing).alias("missing"), F.count_if(extra).alias("unexpected"))
    cols = ["expected", "actual", "matched", "missing", "unexpected"]
    each = g.scope.join(counts, ["trading_date", "symbol"], "left").fillna(0, cols)
    sums = [F.sum(c).alias(c) for c in cols]
    rolled = each.groupingSets([["trading_date", "symbol"], ["trading_date"], []], "trading_date", "symbol").agg(F.grouping_id().alias("level"), *sums)
    scope = F.when(F.col("level") == 0, "SYMBOL_DATE").when(F.col("level") == 1, "DATE").otherwise("RUN")
    ratio = F.when(F.col("expected") > 0, F.col("matched") / F.col("expected")).when(F.col("actual") > 0, 0.0).otherwise(1.0)
    metrics = rolled.select(scope.alias("scope"), "trading_date", "symbol", *[F.coalesce(c, F.lit(0)).alias(c) for c in cols], ratio.alias("coverage_ratio"))
    issues = g.issues.unionByName(_issue(pair.where("times > 1"), "DUPLICATE_ACTUAL_SLOT", Severity.ERROR, "expected_at")).unionByName(_issue(pair.where(missing), "MISSING_SLOT", Severity.WARNING, "expected_at")).unionByName(_issue(pair.where(extra), "UNEXPECTED_SLOT", Severity.WARNING, "expected_at"))
    key = F.concat_ws("|", "code", F.col("trading_date").cast("string"), "symbol", F.coalesce(F.col("expected_at").cast("string"), F.lit("")))
    return Analysis(metrics, issues.withColumn("issue_id", F.sha2(key, 256)))


def consumable(request: Request, analysis: Analysis) -> bool:
    if not analysis.issues.where(F.col("severity") == str(Severity.ERROR)).isEmpty():
        return False
    if request.policy is Policy.WARNING:
        return True
    run = analysis.metrics.where("scope = 'RUN'").first()
    return run is not None and run.coverage_ratio >= request.min_ratio and run.missing == 0 and run.unexpected == 0


def dates(spark: SparkSession, start: date, end: date) -> DataFrame:
    """trading_date: all dates of the range."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("trading_date"))


def check_definitions(market: dict, calendar: dict, universe: dict, status: dict) -> None:
    """What the inputs' definitions say of calendar, zone and asset class must agree where they say it."""

    def differ(*values) -> bool:
        return len({v for v in values if v is not None}) > 1

    if differ(*(d.get("calendar_id") for d in (market, calendar, universe, status))):
        raise CodedError("COVERAGE_CALENDAR_MISMATCH")
    if status.get("calendar_version") is not None and status["calendar_version"] != calendar.get("calendar_version", calendar["version"]):
        raise CodedError("COVERAGE_CALENDAR_VERSION_MISMATCH")
    if differ(*(d.get("zone") for d in (market, calendar, status))):
        raise CodedError("COVERAGE_TIMEZONE_MISMATCH")
    if differ(*(d.get("asset_class") for d in (market, universe, status))):
        raise CodedError("COVERAGE_ASSET_CLASS_MISMATCH")
