"""Enums, table schemas and the coded error of the engine."""

from __future__ import annotations

from enum import StrEnum

from pyspark.sql import types as T


class CodedError(ValueError):
    """An error with a stable code."""

    def __init__(self, code: str, message: str = "", step: str = "") -> None:
        super().__init__(f"{code}: {message}" if message else code)
        self.code, self.message, self.step = code, message, step


class Frequency(StrEnum):
    M1 = "1m"
    M5 = "5m"
    M15 = "15m"
    M30 = "30m"
    M60 = "60m"
    D1 = "1d"

    @property
    def minutes(self) -> int | None:
        return None if self is Frequency.D1 else int(self.value[:-1])


class AssetClass(StrEnum):
    EQUITY = "EQUITY"
    FUTURE = "FUTURE"
    OPTION = "OPTION"
    FUND = "FUND"
    CRYPTO = "CRYPTO"


class Adjustment(StrEnum):
    NONE = "NONE"
    FORWARD = "FORWARD"
    BACKWARD = "BACKWARD"


class Severity(StrEnum):
    INFO = "INFO"
    WARNING = "WARNING"
    ERROR = "ERROR"


class QualityStatus(StrEnum):
    PASSED = "PASSED"
    WARNING = "WARNING"
    FAILED = "FAILED"


class RunStatus(StrEnum):
    CREATED = "CREATED"
    COMMITTED = "COMMITTED"
    FAILED = "FAILED"
    QUALITY_FAILED = "QUALITY_FAILED"


class BarExpectation(StrEnum):
    FULL_SESSION = "FULL_SESSION"
    NO_BARS = "NO_BARS"
    CUSTOM_INTERVALS = "CUSTOM_INTERVALS"
    UNKNOWN = "UNKNOWN"


class MarketState(StrEnum):
    ACTIVE = "ACTIVE"
    SUSPENDED = "SUSPENDED"
    NOT_LISTED = "NOT_LISTED"
    UNKNOWN = "UNKNOWN"


class MetricStatus(StrEnum):
    COMPUTED = "COMPUTED"
    INSUFFICIENT_SAMPLE = "INSUFFICIENT_SAMPLE"
    CONSTANT_INPUT = "CONSTANT_INPUT"


# Venues whose instruments are futures.
FUTURE_VENUES = ("CFFEX", "SHFE", "DCE", "CZCE", "INE", "GFEX")


_TYPES = {"string": T.StringType, "long": T.LongType, "double": T.DoubleType, "date": T.DateType, "timestamp": T.TimestampType}


def _schema(text: str) -> T.StructType:
    """Fields from "name type, name type"; needs no session, unlike a DDL text."""
    return T.StructType([T.StructField(n, _TYPES[k]()) for n, k in (x.split() for x in text.split(", "))])


CURATED_BAR = _schema(
    "dataset_id string, symbol string, exchange string, asset_class string, freq string, trading_date date, bar_start_time timestamp, bar_end_time timestamp, "
    "open string, high string, low string, close string, volume string, turnover string, adjustment string, source string, source_run_id string, source_row_id long, raw_ref string, market_data_partition_id string"
)
BAR_KEY = ["dataset_id", "symbol", "freq", "adjustment", "bar_start_time"]
PRICES = ["open", "high", "low", "close"]
SERIES = ["dataset_id", "freq", "symbol"]
SAMPLE_KEY = ["dataset_id", "symbol", "freq", "as_of"]
FRAME_COLUMNS = ["dataset_id", "symbol", "exchange", "asset_class", "freq", "trading_date", "bar_start_time", "bar_end_time", "as_of", *PRICES, "volume", "turnover", "adjustment", "source_run_id"]
FEATURE_KEY = ["feature_set_id", *SAMPLE_KEY, "factor_id", "factor_version", "output_field"]
LABEL_KEY = ["label_set_id", *SAMPLE_KEY, "label_id", "label_version", "source_run_id"]
ISSUE = _schema("code string, severity string, symbol string, trading_date date, source_row_id long, message string")
METRIC = _schema("factor_id string, output_field string, metric string, value double, severity string")
