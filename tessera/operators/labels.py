"""Forward-return labels and their quality; labels from features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import by
from ..types import LABEL_KEY, SERIES, CodedError, Severity


@dataclass(frozen=True)
class ForwardReturn:
    label_set_id: str
    label_id: str
    horizon: int = 1
    version: str = "v1"
    price: str = "close"

    def __post_init__(self) -> None:
        if self.horizon < 1 or not self.label_id or not self.label_set_id:
            raise CodedError("INVALID_LABEL_CONFIG", "ids and a positive horizon are required")


def forward_returns(bars: DataFrame, config: ForwardReturn, run_id: str = "run") -> DataFrame:
    """price[t + horizon] / price[t] - 1 at each bar's end; the tail of each series is null.

    The difference is taken in decimals of 18 places, so that it is exact, and then divided by the price.
    """
    p = F.col(config.price).cast("decimal(38,18)")
    ahead = F.lead(p, config.horizon).over(by(SERIES, "bar_end_time"))
    value = F.when(p != 0, (ahead - p).cast("double") / p.cast("double"))
    return bars.select("dataset_id", "symbol", "freq", F.col("bar_end_time").alias("as_of"), F.lit(config.label_set_id).alias("label_set_id"), F.lit(config.label_id).alias("label_id"), F.lit(config.version).alias("label_version"), F.lit(run_id).alias("source_run_id"), value.alias("value_float"))


def from_features(values: DataFrame, label_set_id: str, run_id: str) -> DataFrame:
    """Feature values of one run as labels, named by their output field."""
    if values.select("factor_run_id").distinct().limit(2).count() > 1:
        raise CodedError("MULTIPLE_SOURCE_RUNS")
    return values.select("dataset_id", "symbol", "freq", "as_of", F.lit(label_set_id).alias("label_set_id"), F.col("output_field").alias("label_id"), F.col("factor_version").alias("label_version"), F.lit(run_id).alias("source_run_id"), "value_float")


def source_range(bars: DataFrame) -> dict[str, object]:
    """First and last time; dataset and frequency if there is just one."""
    one = lambda c: F.when(F.count_distinct(c) == 1, F.min(c)).alias(c)
    return bars.agg(F.min("bar_end_time").alias("start"), F.max("bar_end_time").alias("end"), one("dataset_id"), one("freq")).first().asDict()


def quality(labels: DataFrame, max_null_ratio: float = 1.0) -> DataFrame:
    """label_id, metric, value (text), severity: six metrics of each label."""
    per_key = labels.groupBy(*LABEL_KEY).agg(F.count("*").alias("n"), F.count_if(F.col("value_float").isNull()).alias("nulls"))
    per_symbol = per_key.groupBy("label_id", "symbol").agg(F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.sum(F.col("n") - 1).alias("dups"), F.min("as_of").alias("lo"), F.max("as_of").alias("hi"))
    s = per_symbol.groupBy("label_id").agg(F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.sum("dups").alias("dups"), F.count("*").alias("symbols"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    ratio = F.col("nulls") / F.col("n")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    info, error = F.lit(str(Severity.INFO)), F.lit(str(Severity.ERROR))
    named = {"row_count": (F.col("n").cast("string"), info), "null_ratio": (F.round(ratio, 6).cast("string"), F.when(ratio > max_null_ratio, error).otherwise(info)), "symbol_count": (F.col("symbols").cast("string"), info), "as_of_min": (stamp("lo"), info), "as_of_max": (stamp("hi"), info), "duplicate_key_count": (F.col("dups").cast("string"), F.when(F.col("dups") > 0, error).otherwise(info))}
    return s.select("label_id", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value"), sev.alias("severity")) for k, (v, sev) in named.items()])).alias("m")).select("label_id", "m.*")
