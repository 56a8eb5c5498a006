"""Validation of bars, partitions, universes, calendars and statuses: each check is a query whose rows are issues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..types import BAR_KEY, ISSUE, Frequency, Severity

#: Calendars whose midday break, 11:30 to 13:00 local, is no gap.
BREAK_CALENDARS = ("XSHG", "XSHE", "XSHG_XSHE", "XSHG-XSHE")
BREAK = ("11:30:00", "13:00:00")


def _issues(df: DataFrame, code: str | Column, message: str | Column = "") -> DataFrame:
    """Rows of df as issues; columns that df lacks are null."""
    has = set(df.columns)
    pick = lambda n, t: (F.col(n) if n in has else F.lit(None)).cast(t).alias(n)
    code = F.lit(code) if isinstance(code, str) else code
    message = F.lit(message) if isinstance(message, str) else message
    return df.select(code.alias("code"), F.lit(str(Severity.ERROR)).alias("severity"), pick("symbol", "string"), pick("trading_date", "date"), pick("source_row_id", "long"), message.cast("string").alias("message"))


def union(*issues: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, issues)


def valid_ohlc() -> Column:
    o, h, low, c = (F.col(n).try_cast("decimal(38,10)") for n in ("open", "high", "low", "close"))
    return F.coalesce((h >= F.greatest(o, c)) & (low <= F.least(o, c)) & o.isNotNull() & c.isNotNull(), F.lit(False))


def duplicate_bars(bars: DataFrame) -> DataFrame:
    """Every bar of a key but the first, by source row."""
    n = F.row_number().over(Window.partitionBy(*BAR_KEY).orderBy("source_row_id"))
    return bars.withColumn("_n", n).where("_n > 1").drop("_n")


def out_of_order(bars: DataFrame) -> DataFrame:
    """Bars that start before the one in the source row before them, in their series."""
    last = F.lag("bar_start_time").over(Window.partitionBy("symbol", "freq", "adjustment").orderBy("source_row_id"))
    return bars.withColumn("_last", last).where("bar_start_time < _last").drop("_last")


def window_gaps(bars: DataFrame, calendar_id: str | None = None, zone: str = "Asia/Shanghai") -> DataFrame:
    """Intraday bars that overlap the one before them or leave a gap: columns gap_s and missing are added (missing 0: overlap)."""
    minutes = F.create_map(*[F.lit(x) for f in Frequency if f.minutes for x in (str(f), f.minutes * 60)])
    step = F.try_element_at(minutes, F.col("freq"))
    w = Window.partitionBy("symbol", "freq", "trading_date").orderBy("bar_start_time", "source_row_id")
    timed = bars.where(F.col("freq") != "1d").withColumn("_end", F.lag("bar_end_time").over(w))
    gap = F.unix_timestamp("bar_start_time") - F.unix_timestamp("_end")
    out = timed.withColumn("gap_s", gap).where("gap_s <> 0")
    if calendar_id is not None and calendar_id.upper() in BREAK_CALENDARS:
        at = lambda c: F.date_format(F.from_utc_timestamp(c, zone), "HH:mm:ss")
        out = out.where(~((at("_end") == BREAK[0]) & (at("bar_start_time") == BREAK[1])))
    return out.withColumn("missing", F.when(F.col("gap_s") < 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.col("gap_s") / step)))).drop("_end")


def check_bars(bars: DataFrame, calendar_id: str | None = None, zone: str = "Asia/Shanghai") -> DataFrame:
    volume = F.col("volume").try_cast("decimal(38,10)")
    gaps = window_gaps(bars, calendar_id, zone)
    return union(
        _issues(duplicate_bars(bars), "DUPLICATE_BAR"),
        _issues(bars.where(~valid_ohlc()), "INVALID_OHLC"),
        _issues(bars.where(F.coalesce(volume < 0, F.lit(True))), "NEGATIVE_VOLUME"),
        _issues(out_of_order(bars), "OUT_OF_ORDER_BAR"),
        _issues(gaps, F.when(F.col("gap_s") < 0, "OVERLAPPING_BAR_WINDOW").otherwise("MISSING_BAR_WINDOW"), F.concat(F.lit("missing "), F.col("missing").cast("string"))),
    )


def _when(spark, ok: bool, code: str, message: str = "") -> DataFrame:
    return spark.createDataFrame([] if ok else [(code, str(Severity.ERROR), None, None, None, message)], ISSUE)


def _point_in_time(spark, meta: dict) -> list[DataFrame]:
    known, cutoff = meta.get("known_at"), meta.get("source_data_cutoff")
    aware = lambda t: t is not None and t.tzinfo is not None
    late = aware(known) and aware(cutoff) and cutoff > known
    return [_when(spark, aware(known), "NAIVE_KNOWN_AT"), _when(spark, aware(cutoff), "NAIVE_SOURCE_DATA_CUTOFF"), _when(spark, not late, "SOURCE_CUTOFF_AFTER_KNOWN_AT")]


def check_partition(bars: DataFrame, meta: dict) -> DataFrame:
    """One day's partition against its definition; meta: dataset_id, freq, adjustment, asset_class, trading_date, known_at, source_data_cutoff, definition_hash, source_definition_hash."""
    spark = bars.sparkSession
    other = {"dataset_id": "BAR_DATASET_MISMATCH", "freq": "BAR_FREQUENCY_MISMATCH", "adjustment": "BAR_ADJUSTMENT_MISMATCH", "asset_class": "BAR_ASSET_CLASS_MISMATCH", "trading_date": "PARTITION_DATE_MISMATCH"}
    rows = [_issues(bars.where(~F.col(k).eqNullSafe(F.lit(meta[k]))), code) for k, code in other.items() if k in meta]
    rows.append(_issues(bars.where("bar_start_time IS NULL OR bar_end_time IS NULL"), "NAIVE_BAR_TIMESTAMP"))
    if meta.get("source_data_cutoff") is not None:
        rows.append(_issues(bars.where(F.col("bar_end_time") > F.lit(meta["source_data_cutoff"])), "BAR_AFTER_SOURCE_CUTOFF"))
    head = [_when(spark, not bars.isEmpty(), "EMPTY_PARTITION"), _when(spark, meta.get("definition_hash") == meta.get("source_definition_hash"), "DEFINITION_SOURCE_MISMATCH"), *_point_in_time(spark, meta)]
    return union(*head, *rows, check_bars(bars, meta.get("calendar_id"), meta.get("timezone", "Asia/Shanghai")))


def check_members(members: DataFrame, meta: dict) -> DataFrame:
    """One day's universe; meta as above, with selection_cutoff, an aware time."""
    spark = members.sparkSession
    m = members.withColumn("symbol", F.col("instrument_id"))
    known, cutoff, limit = meta.get("known_at"), meta.get("source_data_cutoff"), meta.get("selection_cutoff")
    aware = all(t is not None and t.tzinfo is not None for t in (known, cutoff))
    twice = m.groupBy("symbol", "trading_date").count().where("count > 1")
    return union(
        _when(spark, meta.get("definition_hash") == meta.get("source_definition_hash"), "DEFINITION_SOURCE_MISMATCH"),
        _when(spark, not m.isEmpty(), "EMPTY_SNAPSHOT"),
        _when(spark, aware, "NAIVE_POINT_IN_TIME"),
        _when(spark, not aware or cutoff <= known, "FUTURE_SOURCE_CUTOFF"),
        _when(spark, not aware or limit is None or known <= limit, "LATE_KNOWN_AT"),
        _issues(m.where("coalesce(trim(instrument_id), '') = ''"), "EMPTY_INSTRUMENT_ID"),
        _issues(twice, "DUPLICATE_MEMBER"),
        _issues(m.where(~F.col("trading_date").eqNullSafe(F.lit(meta.get("trading_date")))), "PARTITION_DATE_MISMATCH"),
        _issues(m.where("weight IS NOT NULL AND (isnan(weight) OR abs(weight) = double('inf') OR weight < 0)"), "INVALID_WEIGHT"),
        _issues(m.where("rank IS NOT NULL AND rank < 1"), "INVALID_RANK"),
    )


def _overlap(spans: str) -> Column:
    return F.expr(f"exists(sequence(2, greatest(size({spans}), 2)), i -> i <= size({spans}) AND {spans}[i - 1].start < {spans}[i - 2].end)")


def check_calendar(days: DataFrame, meta: dict) -> DataFrame:
    spark = days.sparkSession
    d = days.withColumn("trading_date", F.col("calendar_date"))
    opened = F.array_contains("states", True)
    return union(
        _when(spark, meta.get("definition_hash") == meta.get("source_definition_hash"), "DEFINITION_SOURCE_MISMATCH"),
        _when(spark, not d.isEmpty(), "EMPTY_SNAPSHOT"),
        *_point_in_time(spark, meta),
        _issues(d.where(~F.col("trading_date").eqNullSafe(F.lit(meta.get("trading_date")))), "PARTITION_DATE_MISMATCH") if meta.get("trading_date") else _when(spark, True, ""),
        _issues(d.where("size(states) > 1"), "INCONSISTENT_DAY_STATE"),
        _issues(d.where(opened & (F.size("sessions") == 0)), "OPEN_DAY_WITHOUT_SESSIONS"),
        _issues(d.where(~opened & (F.size("sessions") > 0)), "CLOSED_DAY_WITH_SESSIONS"),
        _issues(d.where("exists(sessions, s -> coalesce(s.session_id, '') = '')"), "EMPTY_SESSION_ID"),
        _issues(d.where("size(array_distinct(transform(sessions, s -> s.session_id))) < size(sessions)"), "DUPLICATE_SESSION"),
        _issues(d.where("exists(sessions, s -> s.start IS NULL OR s.end IS NULL)"), "MISSING_SESSION_TIME"),
        _issues(d.where("exists(sessions, s -> s.start >= s.end)"), "INVALID_SESSION_RANGE"),
        _issues(d.where(_overlap("sessions")), "OVERLAPPING_SESSIONS"),
    )


def check_statuses(statuses: DataFrame, meta: dict) -> DataFrame:
    spark = statuses.sparkSession
    s = statuses.withColumn("symbol", F.col("instrument_id"))
    custom = F.col("bar_expectation") == "CUSTOM_INTERVALS"
    return union(
        _when(spark, meta.get("definition_hash") == meta.get("source_definition_hash"), "DEFINITION_SOURCE_MISMATCH"),
        _when(spark, not s.isEmpty(), "EMPTY_SNAPSHOT"),
        *_point_in_time(spark, meta),
        _issues(s.where(~F.col("trading_date").eqNullSafe(F.lit(meta.get("trading_date")))), "PARTITION_DATE_MISMATCH") if meta.get("trading_date") else _when(spark, True, ""),
        _issues(s.where("coalesce(instrument_id, '') = ''"), "EMPTY_INSTRUMENT_ID"),
        _issues(s.groupBy("symbol", "trading_date").count().where("count > 1"), "DUPLICATE_STATUS"),
        _issues(s.where(custom & (F.size("intervals") == 0)), "MISSING_CUSTOM_INTERVALS"),
        _issues(s.where(~custom & (F.size("intervals") > 0)), "UNEXPECTED_CUSTOM_INTERVALS"),
        _issues(s.where("exists(intervals, x -> x.start IS NULL OR x.end IS NULL OR x.start >= x.end)"), "INVALID_INTERVAL"),
        _issues(s.where(_overlap("intervals")), "OVERLAPPING_INTERVALS"),
    )
