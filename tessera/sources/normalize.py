"""Raw rows to curated bars, universe members, calendar days and daily statuses."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import CURATED_BAR, FUTURE_VENUES, Adjustment, AssetClass, BarExpectation, CodedError, Frequency, MarketState

DAY_OPEN, DAY_CLOSE = "09:30:00", "15:00:00"
BAR_FIELDS = ("symbol", "exchange", "date", "datetime", "open", "high", "low", "close", "volume", "turnover")


@dataclass(frozen=True)
class BarSource:
    dataset_id: str
    source_id: str
    freq: str = "1d"
    timezone: str = "Asia/Shanghai"
    convention: str = "START_TIME"
    adjustment: str = "NONE"
    mapping: dict[str, str] = field(default_factory=dict)
    symbols: dict[str, str] = field(default_factory=dict)
    strict: bool = True

    def __post_init__(self) -> None:
        if self.freq not in tuple(Frequency):
            raise CodedError("UNSUPPORTED_FREQUENCY", self.freq)
        if self.adjustment not in tuple(Adjustment):
            raise CodedError("INVALID_SOURCE_SPEC", self.adjustment)
        if self.convention not in ("START_TIME", "END_TIME"):
            raise CodedError("INVALID_SOURCE_SPEC", self.convention)


def mapped(df: DataFrame, names, mapping: dict[str, str]) -> dict[str, Column]:
    """Canonical column -> source column; what the source lacks is ''."""
    have = set(df.columns)
    return {n: F.coalesce(F.col(f"`{mapping.get(n, n)}`").cast("string"), F.lit("")) if mapping.get(n, n) in have else F.lit("") for n in names}


def asset_class(exchange: Column) -> Column:
    return F.when(exchange.isin(*FUTURE_VENUES), str(AssetClass.FUTURE)).otherwise(str(AssetClass.EQUITY))


def bars(rows: DataFrame, source: BarSource, run_id: str) -> DataFrame:
    c = mapped(rows, BAR_FIELDS, source.mapping)
    symbol = c["symbol"]
    if source.symbols:
        table = F.create_map(*[F.lit(x) for kv in source.symbols.items() for x in kv])
        symbol = F.coalesce(F.try_element_at(table, symbol), symbol)
    exchange = F.upper(F.trim(c["exchange"]))
    zone = F.lit(source.timezone)
    if source.freq == Frequency.D1:
        day = F.to_date(F.trim(c["date"]))
        start, end = (F.to_utc_timestamp(F.concat_ws(" ", day.cast("string"), F.lit(t)), zone) for t in (DAY_OPEN, DAY_CLOSE))
    else:
        text = F.trim(c["datetime"])
        # an aware time keeps its own offset; a naive one is in the source's zone. The date is as written.
        at = F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.to_timestamp(text)).otherwise(F.to_utc_timestamp(F.regexp_replace(text, "T", " "), zone))
        day = F.to_date(F.substring(text, 1, 10))
        step = F.expr(f"INTERVAL {Frequency(source.freq).minutes} MINUTE")
        start, end = (at, at + step) if source.convention == "START_TIME" else (at - step, at)
    made = {
        "dataset_id": F.lit(source.dataset_id), "symbol": F.upper(F.trim(symbol)), "exchange": exchange, "asset_class": asset_class(exchange), "freq": F.lit(source.freq), "trading_date": day, "bar_start_time": start, "bar_end_time": end,
        **{p: F.trim(c[p]) for p in ("open", "high", "low", "close", "volume")}, "turnover": F.nullif(F.trim(c["turnover"]), F.lit("")), "adjustment": F.lit(source.adjustment), "source": F.lit(source.source_id), "source_run_id": F.lit(run_id), "source_row_id": F.col("source_row_id"),
        "raw_ref": F.concat(F.lit(f"raw://{source.source_id}/{run_id}/"), F.col("source_row_id").cast("string")), "market_data_partition_id": F.lit(None).cast("string"),
    }
    return rows.select(*[made[f.name].cast(f.dataType).alias(f.name) for f in CURATED_BAR.fields])


def factor_frame(bars_: DataFrame) -> DataFrame:
    """Typed frame of the factors: numbers as doubles, as_of is the bar's end."""
    from ..types import FRAME_COLUMNS

    numbers = ("open", "high", "low", "close", "volume", "turnover")
    frame = bars_.withColumn("as_of", F.col("bar_end_time")).withColumns({n: F.col(n).cast("double") for n in numbers})
    return frame.select(*FRAME_COLUMNS)


def _number(c: Column, kind: str) -> Column:
    """A number or null for empty text; other text is an error under ANSI."""
    return F.nullif(F.trim(c), F.lit("")).cast(kind)


def tags(text: Column) -> Column:
    """A JSON list, or text split at | if there is one, else at commas; trimmed, distinct, sorted, without empty ones."""
    t = F.trim(text)
    listed = F.when(t.startswith("["), F.from_json(t, "array<string>")).when(t.contains("|"), F.split(t, r"\|")).otherwise(F.split(t, ","))
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")))


def members(rows: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """instrument_id, trading_date, weight, rank, tags."""
    mapping = mapping or {}
    c = mapped(rows, ("symbol", "trading_date", "weight", "rank"), mapping)
    name = mapping.get("tags", "tags")
    listed = F.lit("") if name not in rows.columns else F.col(name)
    if name in rows.columns and dict(rows.dtypes)[name].startswith("array"):
        listed = F.array_sort(F.array_distinct(F.filter(F.transform(name, lambda x: F.trim(x)), lambda x: x != "")))
    else:
        listed = tags(listed)
    return rows.select(F.upper(F.trim(c["symbol"])).alias("instrument_id"), F.to_date(F.nullif(F.trim(c["trading_date"]), F.lit(""))).alias("trading_date"), _number(c["weight"], "double").alias("weight"), _number(c["rank"], "long").alias("rank"), listed.alias("tags"))


def _flag(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin("1", "true", "yes", "y", "open"), True).when(t.isin("0", "false", "no", "n", "closed"), False).otherwise(F.raise_error(F.concat(F.lit("INVALID_BOOLEAN: "), text)).cast("boolean"))


def clock(text: Column) -> Column:
    """Seconds of the day of hh:mm or hh:mm:ss; null for empty text."""
    t = F.nullif(F.trim(text), F.lit(""))
    p = F.split(t, ":")
    return (F.try_element_at(p, F.lit(1)).cast("int") * 3600 + F.try_element_at(p, F.lit(2)).cast("int") * 60 + F.coalesce(F.try_element_at(p, F.lit(3)).cast("int"), F.lit(0)))


def calendar_days(rows: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """calendar_date, states (distinct), sessions: array of (start, end, session_id, kind), by start; times in seconds."""
    c = mapped(rows, ("calendar_date", "is_trading_day", "session_id", "session_start", "session_end", "session_kind"), mapping or {})
    one = rows.select(F.to_date(F.trim(c["calendar_date"])).alias("calendar_date"), _flag(c["is_trading_day"]).alias("open"), clock(c["session_start"]).alias("start"), clock(c["session_end"]).alias("end"), F.trim(c["session_id"]).alias("session_id"), F.coalesce(F.nullif(F.trim(c["session_kind"]), F.lit("")), F.lit("REGULAR")).alias("kind"))
    there = (F.col("session_id") != "") | F.col("start").isNotNull() | F.col("end").isNotNull()
    return one.groupBy("calendar_date").agg(F.array_sort(F.collect_set("open")).alias("states"), F.array_sort(F.collect_list(F.when(there, F.struct("start", "end", "session_id", "kind")))).alias("sessions"))


def _one_of(kind: type, text: Column) -> Column:
    """A value of an enum, whatever its case; any other is an error."""
    t = F.upper(F.trim(text))
    return F.when(t.isin(*[str(x) for x in kind]), t).otherwise(F.raise_error(F.concat(F.lit(f"INVALID_{kind.__name__.upper()}: "), text)).cast("string"))


def statuses(rows: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """instrument_id, trading_date, market_state, bar_expectation, intervals: array of (start, end) in seconds."""
    c = mapped(rows, ("trading_date", "instrument_id", "market_state", "bar_expectation", "custom_intervals"), mapping or {})
    t = F.trim(c["custom_intervals"])
    item = "struct<start_time:string,start:string,end_time:string,end:string>"
    as_json = F.transform(F.from_json(t, f"array<{item}>"), lambda x: F.struct(clock(F.coalesce(x["start_time"], x["start"])).alias("start"), clock(F.coalesce(x["end_time"], x["end"])).alias("end")))
    as_text = F.transform(F.split(t, r"\|"), lambda x: F.struct(clock(F.split(x, "-")[0]).alias("start"), clock(F.split(x, "-")[1]).alias("end")))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    return rows.select(F.upper(F.trim(c["instrument_id"])).alias("instrument_id"), F.to_date(F.trim(c["trading_date"])).alias("trading_date"), _one_of(MarketState, c["market_state"]).alias("market_state"), _one_of(BarExpectation, c["bar_expectation"]).alias("bar_expectation"), F.array_sort(F.when(t == "", empty).when(t.startswith("["), as_json).otherwise(as_text)).alias("intervals"))
