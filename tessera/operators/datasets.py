"""Training matrices, their filters, and walk-forward folds."""

from __future__ import annotations

from dataclasses import dataclass
from enum import StrEnum

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..types import SAMPLE_KEY, CodedError


def feature_matrix(snapshots: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Snapshots with a column for each feature; without fields, the sorted union of their keys."""
    if fields is None:
        fields = sorted(r[0] for r in snapshots.select(F.explode(F.map_keys("features"))).distinct().collect())
    return snapshots.select("feature_set_id", *SAMPLE_KEY, "factor_run_ids", "warmup_complete", *[F.try_element_at("features", F.lit(f)).alias(f) for f in fields])


def label_matrix(labels: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Labels with a column for each label_id; of several versions the last one counts."""
    if fields is None:
        fields = sorted(r[0] for r in labels.select("label_id").distinct().collect())
    last = F.max_by("value_float", F.struct("label_version", "source_run_id"))
    return labels.groupBy(*SAMPLE_KEY).pivot("label_id", fields).agg(last)


def join(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Samples with both; the features say which samples there are."""
    own = set(features.columns) - set(SAMPLE_KEY)
    if clash := sorted(own & (set(labels.columns) - set(SAMPLE_KEY))):
        raise CodedError("FIELD_COLLISION", ", ".join(clash))
    return features.join(labels, SAMPLE_KEY)


def only_features(features: DataFrame, labels: DataFrame) -> DataFrame:
    return features.join(labels, SAMPLE_KEY, "left_anti")


def only_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    return labels.join(features, SAMPLE_KEY, "left_anti")


def filtered(matrix: DataFrame, label_fields: list[str], drop_cold: bool = True, drop_null_labels: bool = True) -> tuple[DataFrame, dict[str, int]]:
    """Without incomplete warm-up, then without null labels; and the rows that each took."""
    warm = F.coalesce("warmup_complete", F.lit(False)) if drop_cold else F.lit(True)
    full = F.lit(True)
    for f in label_fields if drop_null_labels else []:
        full = full & F.col(f).isNotNull()
    n = matrix.agg(F.count_if(~warm).alias("cold"), F.count_if(warm & ~full).alias("unlabelled")).first()
    return matrix.where(warm & full), {"dropped_warmup": n.cold, "dropped_null_labels": n.unlabelled}


def check_compatible(features: dict, labels: dict) -> None:
    """Manifests that may be joined: one dataset and frequency, where the labels have just one; one definition of the market data, where
    both are pinned; the labels' universe, where they have one; and labels that span the features."""
    for key, code in (("dataset_id", "DATASET_ID_MISMATCH"), ("freq", "FREQUENCY_MISMATCH"), ("definition_hash", "MARKET_DATA_DEFINITION_MISMATCH"), ("universe_hash", "UNIVERSE_LINEAGE_MISMATCH")):
        x, y = features.get(key), labels.get(key)
        if y is not None and x != y and not (key == "definition_hash" and x is None):
            raise CodedError(code, f"{x} and {y}")
    if labels["start"] > features["start"] or labels["end"] < features["end"]:
        raise CodedError("LABEL_SOURCE_RANGE_MISMATCH")
    if labels.get("pinned") and not labels["end"] > features["end"]:
        raise CodedError("LABEL_FORWARD_HORIZON_NOT_COVERED")


class SplitMode(StrEnum):
    ROLLING = "ROLLING"
    EXPANDING = "EXPANDING"


@dataclass(frozen=True)
class SplitPlan:
    train: int
    test: int
    step: int | None = None
    purge: int = 0
    embargo: int = 0
    mode: SplitMode = SplitMode.ROLLING

    def __post_init__(self) -> None:
        if self.train < 1 or self.test < 1 or self.purge < 0 or self.embargo < 0 or (self.step is not None and self.step < 1):
            raise CodedError("INVALID_SPLIT_PLAN")
        if self.step is not None and self.step < self.test:
            raise CodedError("OVERLAPPING_OOS_WINDOWS")


PARTS = ("train", "purge", "embargo", "test")


def folds(matrix: DataFrame, plan: SplitPlan, period: str = "as_of") -> DataFrame:
    """fold_id, part, first and last period of each part of each fold, n_periods. An incomplete last fold is left out.

    Works on the observed periods: their number is the calendar's, not the data's, so one window numbers them.
    """
    step = plan.step or plan.test
    times = matrix.select(F.col(period).alias("t")).distinct()
    n = times.count()
    gap = plan.purge + plan.embargo
    starts = list(range(plan.train + gap, n - plan.test + 1, step))
    if not starts:
        raise CodedError("INSUFFICIENT_PERIODS", f"{n} periods")
    spans = []
    for k, test in enumerate(starts):
        end = test - gap
        first = 0 if plan.mode is SplitMode.EXPANDING else end - plan.train
        edges = {"train": (first, end), "purge": (end, end + plan.purge), "embargo": (end + plan.purge, test), "test": (test, test + plan.test)}
        spans += [(f"fold-{k:03d}", p, a, b) for p, (a, b) in edges.items() if a < b]
    table = matrix.sparkSession.createDataFrame(spans, "fold_id string, part string, a long, b long")
    ranked = times.select("t", (F.row_number().over(Window.orderBy("t")) - 1).alias("i"))
    inside = ranked.join(F.broadcast(table), (F.col("i") >= F.col("a")) & (F.col("i") < F.col("b")))
    return inside.groupBy("fold_id", "part").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("n_periods"))


def assign(matrix: DataFrame, found: DataFrame, period: str = "as_of") -> DataFrame:
    """Rows of the matrix with fold_id and part; folds are few, so they are broadcast."""
    return matrix.join(F.broadcast(found.drop("n_periods")), F.col(period).between(F.col("first"), F.col("last"))).drop("first", "last")
