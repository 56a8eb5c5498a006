from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tessera.operators import coverage, quality
from tessera.sources import files, normalize
from tessera.types import CodedError

DAILY = "symbol,exchange,date,open,high,low,close,volume,turnover\n600519.SH,SSE,2026-07-01,10,12.5,9.75,11,800,8640\n600519.SH,SSE,2026-07-02,11,11.25,10.5,10.75,640,\n"


def minute(times):
    return "symbol,exchange,datetime,open,high,low,close,volume,turnover\n" + "".join(f"000001.sz , szse,2026-07-01T{t}+08:00,10,10.2,9.9,10.1,1000,1\n" for t in times)


def raw(spark, tmp_path, text, name="bars.csv"):
    p = tmp_path / name
    p.write_text(text)
    return files.raw_rows(files.read(spark, str(p), "CSV"))


def test_daily_bars(spark, tmp_path):
    got = normalize.bars(raw(spark, tmp_path, DAILY), normalize.BarSource("d", "src"), "run").orderBy("source_row_id").collect()
    assert [r.source_row_id for r in got] == [1, 2] and got[0].open == "10" and got[1].turnover is None and got[0].asset_class == "EQUITY"
    assert got[0].bar_start_time == datetime(2026, 7, 1, 1, 30) and got[0].bar_end_time == datetime(2026, 7, 1, 7, 0) and got[1].raw_ref == "raw://src/run/2"
    assert quality.check_bars(normalize.bars(raw(spark, tmp_path, DAILY), normalize.BarSource("d", "src"), "run")).count() == 0


@pytest.mark.parametrize(("convention", "start"), [("START_TIME", datetime(2026, 7, 1, 1, 30)), ("END_TIME", datetime(2026, 7, 1, 1, 29))])
def test_minute_windows(spark, tmp_path, convention, start):
    got = normalize.bars(raw(spark, tmp_path, minute(["09:30:00", "09:31:00"])), normalize.BarSource("d", "s", "1m", convention=convention), "r").orderBy("source_row_id").first()
    assert got.bar_start_time == start and got.bar_end_time == start + timedelta(minutes=1) and got.symbol == "000001.SZ" and got.exchange == "SZSE" and got.trading_date == date(2026, 7, 1)


def codes(spark, tmp_path, times, calendar=None):
    bars = normalize.bars(raw(spark, tmp_path, minute(times)), normalize.BarSource("d", "s", "1m"), "r")
    return sorted(r.code for r in quality.check_bars(bars, calendar).collect())


def test_gaps_orders_and_repeats(spark, tmp_path):
    assert codes(spark, tmp_path, ["09:30:00", "09:32:00"]) == ["MISSING_BAR_WINDOW"]
    assert codes(spark, tmp_path, ["09:31:00", "09:30:00"]) == ["OUT_OF_ORDER_BAR"]
    assert codes(spark, tmp_path, ["09:30:00"] * 3) == ["DUPLICATE_BAR"] * 2 + ["OVERLAPPING_BAR_WINDOW"] * 2
    assert codes(spark, tmp_path, ["11:29:00", "13:00:00"]) == ["MISSING_BAR_WINDOW"]
    assert codes(spark, tmp_path, ["11:29:00", "13:00:00"], "xshg-xshe") == []


def test_broken_prices_and_volumes(spark, tmp_path):
    text = DAILY + "X,SZSE,2026-07-03,10,9,9,10,-1,\nY,SZSE,2026-07-03,abc,9,9,10,,\n"
    found = quality.check_bars(normalize.bars(raw(spark, tmp_path, text), normalize.BarSource("d", "s"), "r")).collect()
    assert sorted((r.code, r.symbol) for r in found) == [("INVALID_OHLC", "X"), ("INVALID_OHLC", "Y"), ("NEGATIVE_VOLUME", "X"), ("NEGATIVE_VOLUME", "Y")]


def test_csv_and_parquet_agree(spark, tmp_path):
    from tessera.hashing import content_hash

    rows = spark.createDataFrame([("A", "SHFE", date(2026, 7, 1), 10.0, 11.0, 9.5, 10.5, 100, None)], "symbol string, exchange string, date date, open double, high double, low double, close double, volume long, turnover long")
    rows.write.parquet(str(tmp_path / "b.parquet"))
    a = normalize.bars(files.raw_rows(files.read(spark, str(tmp_path / "b.parquet"), "PARQUET")), normalize.BarSource("d", "s"), "r")
    b = normalize.bars(raw(spark, tmp_path, "symbol,exchange,date,open,high,low,close,volume,turnover\nA,SHFE,2026-07-01,10,11,9.5,10.5,100,\n"), normalize.BarSource("d", "s"), "r")
    assert a.first().asset_class == "FUTURE" and content_hash(a) == content_hash(b)
    with pytest.raises(CodedError):
        files.read(spark, "x", "DUCKDB_TABLE")


def test_row_ids_follow_the_names_of_files(spark, tmp_path):
    for i, n in enumerate((3, 400, 20)):
        (tmp_path / f"{i}.csv").write_text("symbol,note\n" + "".join(f'F{i}-{k},"two\nlines"\n' for k in range(n)))
    got = files.raw_rows(files.read(spark, str(tmp_path), "CSV")).orderBy("source_row_id").collect()
    assert [r.symbol for r in got] == [f"F{i}-{k}" for i, n in enumerate((3, 400, 20)) for k in range(n)] and [r.source_row_id for r in got] == list(range(1, 424))
    assert {r.note for r in got} == {"two\nlines"}


def test_row_ids_follow_the_file(spark, tmp_path):
    text = "symbol\n" + "".join(f"S{i}\n" for i in range(500))
    got = raw(spark, tmp_path, text).repartition(5).collect()
    assert all(r.symbol == f"S{r.source_row_id - 1}" for r in got) and len(got) == 500


def test_partition_checks(spark, tmp_path):
    bars = normalize.bars(raw(spark, tmp_path, DAILY), normalize.BarSource("d", "s"), "r")
    known = datetime(2026, 7, 2, tzinfo=timezone.utc)
    meta = {"dataset_id": "other", "freq": "1d", "adjustment": "NONE", "asset_class": "FUND", "trading_date": date(2026, 7, 1), "known_at": known, "source_data_cutoff": datetime(2026, 7, 2, 0, tzinfo=timezone.utc), "definition_hash": "a", "source_definition_hash": "b"}
    got = sorted(r.code for r in quality.check_partition(bars, meta).collect())
    assert got == sorted(["BAR_DATASET_MISMATCH"] * 2 + ["BAR_ASSET_CLASS_MISMATCH"] * 2 + ["PARTITION_DATE_MISMATCH", "BAR_AFTER_SOURCE_CUTOFF", "DEFINITION_SOURCE_MISMATCH"])
    got = {r.code for r in quality.check_partition(bars.limit(0), {"known_at": datetime(2026, 7, 2), "source_data_cutoff": known}).collect()}
    assert got == {"EMPTY_PARTITION", "NAIVE_KNOWN_AT"}
    got = {r.code for r in quality.check_partition(bars, {"known_at": known, "source_data_cutoff": known + timedelta(days=9)}).collect()}
    assert got == {"SOURCE_CUTOFF_AFTER_KNOWN_AT"}


def test_members(spark):
    rows = spark.createDataFrame([("a", "2026-07-01", "0.5", "1", '["x", "b","x"]'), ("a", "2026-07-01", "", "0", "q|p"), (" ", "2026-07-02", "-1", "", "z, y,")], "symbol string, trading_date string, weight string, rank string, tags string")
    m = normalize.members(rows)
    assert [r.tags for r in m.collect()] == [["b", "x"], ["p", "q"], ["y", "z"]]
    known = datetime(2026, 7, 1, 2, tzinfo=timezone.utc)
    got = sorted(r.code for r in quality.check_members(m, {"trading_date": date(2026, 7, 1), "known_at": known, "source_data_cutoff": known + timedelta(1), "selection_cutoff": known - timedelta(1)}).collect())
    assert got == ["DUPLICATE_MEMBER", "EMPTY_INSTRUMENT_ID", "FUTURE_SOURCE_CUTOFF", "INVALID_RANK", "INVALID_WEIGHT", "LATE_KNOWN_AT", "PARTITION_DATE_MISMATCH"]


CAL = "calendar_date string, is_trading_day string, session_id string, session_start string, session_end string, session_kind string"
SESSIONS = [("2026-07-01", "true", "am", "09:30", "11:30", ""), ("2026-07-01", "true", "pm", "13:00", "15:00", ""), ("2026-07-02", "closed", "", "", "", "")]
META = {"known_at": datetime(2026, 1, 1, tzinfo=timezone.utc), "source_data_cutoff": datetime(2026, 1, 1, tzinfo=timezone.utc)}


def test_calendar(spark):
    days = normalize.calendar_days(spark.createDataFrame(SESSIONS, CAL))
    got = {str(r.calendar_date): r for r in days.collect()}
    assert [(s.start, s.end, s.kind) for s in got["2026-07-01"].sessions] == [(34200, 41400, "REGULAR"), (46800, 54000, "REGULAR")] and got["2026-07-02"].sessions == [] and got["2026-07-02"].states == [False]
    assert quality.check_calendar(days, META).count() == 0
    bad = normalize.calendar_days(spark.createDataFrame([("2026-07-01", "yes", "a", "09:30", "11:30", ""), ("2026-07-01", "0", "a", "11:00", "10:00", ""), ("2026-07-02", "open", "", "", "", ""), ("2026-07-03", "open", "", "09:30", "", "")], CAL))
    assert {r.code for r in quality.check_calendar(bad, META).collect()} == {"INCONSISTENT_DAY_STATE", "DUPLICATE_SESSION", "INVALID_SESSION_RANGE", "OVERLAPPING_SESSIONS", "OPEN_DAY_WITHOUT_SESSIONS", "EMPTY_SESSION_ID", "MISSING_SESSION_TIME"}


STATUS = "trading_date string, instrument_id string, market_state string, bar_expectation string, custom_intervals string"


def statuses(spark, *rows):
    return normalize.statuses(spark.createDataFrame([("2026-07-01", i, "active", e, c) for i, e, c in rows], STATUS))


def test_statuses(spark):
    s = statuses(spark, ("a", "custom_intervals", '[{"start_time": "10:00", "end_time": "10:10"}]'), ("b", "custom_intervals", "13:00-13:05|10:00-10:10"), ("c", "no_bars", ""))
    got = {r.instrument_id: [(x.start, x.end) for x in r.intervals] for r in s.collect()}
    assert got == {"A": [(36000, 36600)], "B": [(36000, 36600), (46800, 47100)], "C": []}
    bad = statuses(spark, ("a", "custom_intervals", ""), ("b", "no_bars", "10:00-11:00"), ("c", "custom_intervals", "10:00-11:00|10:30-12:00"), ("d", "custom_intervals", "11:00-10:00"), ("e", "no_bars", ""), ("e", "no_bars", ""))
    assert {r.code for r in quality.check_statuses(bad, META).collect()} == {"MISSING_CUSTOM_INTERVALS", "UNEXPECTED_CUSTOM_INTERVALS", "OVERLAPPING_INTERVALS", "INVALID_INTERVAL", "DUPLICATE_STATUS"}


def generated(spark, freq, *rows, label="BAR_END"):
    request = coverage.Request(date(2026, 7, 1), date(2026, 7, 2), freq, label=label)
    members = spark.createDataFrame([(date(2026, 7, d), i.upper()) for d in (1, 2) for i, *_ in rows], "trading_date date, instrument_id string")
    return request, coverage.expected_slots(request, normalize.calendar_days(spark.createDataFrame(SESSIONS, CAL)), members, statuses(spark, *rows))


@pytest.mark.parametrize(("freq", "n"), [("1m", 240), ("5m", 48), ("1d", 1)])
def test_full_sessions(spark, freq, n):
    _, g = generated(spark, freq, ("a", "full_session", ""))
    assert g.slots.count() == n and g.issues.count() == 0 and g.scope.count() == 2


def test_slot_times(spark):
    _, g = generated(spark, "5m", ("a", "custom_intervals", "10:00-10:10"), ("b", "no_bars", ""), ("c", "unknown", ""))
    assert [r.expected_at for r in g.slots.orderBy("expected_at").collect()] == [datetime(2026, 7, 1, 2, 5), datetime(2026, 7, 1, 2, 10)]
    assert [(r.code, r.symbol) for r in g.issues.collect()] == [("UNKNOWN_EXPECTATION", "C")]
    _, g = generated(spark, "5m", ("a", "custom_intervals", "10:00-10:10"), label="BAR_START")
    assert g.slots.agg(F.min("expected_at")).first()[0] == datetime(2026, 7, 1, 2, 0)


def actual(spark, *rows):
    return spark.createDataFrame([(s, "1d", date(2026, 7, d), datetime(2026, 7, d, 1, 30), datetime(2026, 7, d, 7)) for s, d in rows], "symbol string, freq string, trading_date date, bar_start_time timestamp, bar_end_time timestamp")


def test_comparison(spark):
    request, g = generated(spark, "1d", ("a", "full_session", ""), ("b", "full_session", ""), ("c", "unknown", ""))
    a = coverage.compare(request, g, actual(spark, ("A", 1), ("A", 1), ("C", 1), ("A", 2), ("Z", 1)))
    run = a.metrics.where("scope = 'RUN'").first()
    assert (run.expected, run.actual, run.matched, run.missing, run.unexpected, run.coverage_ratio) == (2, 3, 1, 1, 1, 0.5)
    assert a.metrics.where("scope = 'SYMBOL_DATE'").count() == 6 and a.metrics.where("scope = 'DATE'").count() == 2
    assert sorted(r.code for r in a.issues.collect()) == ["DUPLICATE_ACTUAL_SLOT", "MISSING_SLOT", "UNEXPECTED_SLOT", "UNKNOWN_EXPECTATION"]
    assert not coverage.consumable(request, a)
    request, g = generated(spark, "1d", ("a", "full_session", ""), ("b", "full_session", ""))
    half = coverage.compare(request, g, actual(spark, ("A", 1)))
    assert not coverage.consumable(request, half)
    warn = coverage.Request(request.start, request.end, policy=coverage.Policy.WARNING)
    assert coverage.consumable(warn, half)
    whole = coverage.compare(request, g, actual(spark, ("A", 1), ("B", 1)))
    assert coverage.consumable(request, whole)
    assert sorted(str(r[0]) for r in coverage.dates(spark, request.start, request.end).collect()) == ["2026-07-01", "2026-07-02"]
