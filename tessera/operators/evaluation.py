"""Cross-sectional evaluation of factors against labels."""

from __future__ import annotations

from dataclasses import dataclass
from enum import StrEnum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import average_rank, bucket, finite
from ..types import SAMPLE_KEY, CodedError, MetricStatus
from .features import assert_unique


class Direction(StrEnum):
    HIGH_MINUS_LOW = "HIGH_MINUS_LOW"
    LOW_MINUS_HIGH = "LOW_MINUS_HIGH"


@dataclass(frozen=True)
class Request:
    factor_fields: tuple[str, ...]
    label_id: str
    quantiles: int = 5
    min_samples: int = 30
    direction: Direction = Direction.HIGH_MINUS_LOW

    def __post_init__(self) -> None:
        object.__setattr__(self, "factor_fields", tuple(sorted(set(self.factor_fields))))
        if not self.factor_fields or self.quantiles < 2 or self.min_samples < 2:
            raise CodedError("INVALID_EVALUATION_REQUEST")


def _corr(x: str, y: str, varied: Column) -> Column:
    """Pearson correlation; null for constant input, which would raise under ANSI."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when(varied, F.try_divide(F.covar_pop(x, y), sx * sy))


def check_inputs(request: Request, snapshots: DataFrame, labels: DataFrame) -> None:
    if snapshots.isEmpty():
        raise CodedError("EMPTY_FEATURE_INPUT")
    if labels.where(F.col("label_id") == request.label_id).isEmpty():
        raise CodedError("LABEL_FIELD_NOT_FOUND", request.label_id)
    assert_unique(snapshots, SAMPLE_KEY, "DUPLICATE_FEATURE_KEY")
    assert_unique(labels.where(F.col("label_id") == request.label_id), SAMPLE_KEY, "DUPLICATE_LABEL_KEY")
    there = snapshots.agg(*[F.bool_or(F.array_contains(F.map_keys("features"), f)).alias(f) for f in request.factor_fields]).first()
    if lack := [f for f in request.factor_fields if not there[f]]:
        raise CodedError("FACTOR_FIELD_NOT_FOUND", ", ".join(lack))
    if snapshots.join(labels.where(F.col("label_id") == request.label_id), SAMPLE_KEY, "left_semi").isEmpty():
        raise CodedError("NO_ALIGNED_ROWS")


def evaluate(request: Request, snapshots: DataFrame, labels: DataFrame, checked: bool = False) -> DataFrame:
    """factor_field, as_of, metric, bucket (null but for quantiles), value, sample_count, status.

    Every requested field has rows at every aligned time, even without any finite pair. All windows and
    aggregates are by (field, as_of), so one exchange serves them.
    """
    if not checked:
        check_inputs(request, snapshots, labels)
    cross = ["factor_field", "as_of"]
    y = labels.where(F.col("label_id") == request.label_id).select(*SAMPLE_KEY, F.col("value_float").alias("y"))
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("factor_field"), F.try_element_at("features", F.lit(f)).alias("x")) for f in request.factor_fields]))
    pairs = snapshots.select(*SAMPLE_KEY, "features").join(y, SAMPLE_KEY).select("symbol", "as_of", fields.alias("f"), "y").select("f.factor_field", "as_of", "symbol", "f.x", "y")
    good = finite(F.col("x")) & finite(F.col("y"))
    grid = pairs.groupBy(*cross).agg(F.count_if(good).alias("n"), F.coalesce(F.min(F.when(good, F.col("x"))) < F.max(F.when(good, F.col("x"))), F.lit(False)).alias("vx"), F.coalesce(F.min(F.when(good, F.col("y"))) < F.max(F.when(good, F.col("y"))), F.lit(False)).alias("vy"))
    ranked = pairs.where(good).withColumns({"rx": average_rank("x", cross), "ry": average_rank("y", cross), "bucket": bucket(cross, ["x", "symbol"], request.quantiles)})
    varied = (F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))
    ic = ranked.groupBy(*cross).agg(_corr("x", "y", varied).alias("pearson"), _corr("rx", "ry", varied).alias("spearman"))
    enough, constant = F.col("n") >= request.min_samples, ~(F.col("vx") & F.col("vy"))
    status = F.when(~enough, str(MetricStatus.INSUFFICIENT_SAMPLE)).when(constant, str(MetricStatus.CONSTANT_INPUT)).otherwise(str(MetricStatus.COMPUTED))
    shape = lambda metric, bucket_, value, st: F.struct(F.lit(metric).alias("metric"), bucket_.cast("long").alias("bucket"), value.cast("double").alias("value"), st.alias("status"))
    both = grid.join(ic, cross, "left").withColumn("status", status)
    none = F.lit(None)
    keep = lambda c: F.when(F.col("status") == str(MetricStatus.COMPUTED), F.col(c))
    ics = both.select(*cross, F.col("n").alias("sample_count"), F.explode(F.array(shape("PEARSON_IC", none, keep("pearson"), F.col("status")), shape("SPEARMAN_RANK_IC", none, keep("spearman"), F.col("status")))).alias("m"))
    computed = F.lit(str(MetricStatus.COMPUTED))
    sized = ranked.withColumn("n", F.count("*").over(Window.partitionBy(*cross))).where(enough)
    buckets = sized.groupBy(*cross, "bucket").agg(F.avg("y").alias("mean"), F.count("*").alias("sample_count"), F.first("n").alias("n"))
    quantiles = buckets.select(*cross, "sample_count", shape("QUANTILE_RETURN", F.col("bucket"), F.col("mean"), computed).alias("m"))
    sign = 1.0 if request.direction is Direction.HIGH_MINUS_LOW else -1.0
    spread = buckets.groupBy(*cross).agg(F.first("n").alias("sample_count"), ((F.max_by("mean", "bucket") - F.min_by("mean", "bucket")) * sign).alias("v"))
    spreads = spread.select(*cross, "sample_count", shape("LONG_SHORT_RETURN", none, F.col("v"), computed).alias("m"))
    return ics.unionByName(quantiles).unionByName(spreads).select(*cross, "m.metric", "m.bucket", "m.value", "sample_count", "m.status")
