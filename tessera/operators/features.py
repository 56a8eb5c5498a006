"""Features: long values, packed snapshots, quality metrics and the prefix-invariance probe."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from enum import StrEnum


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import INF, by, same
from ..types import FEATURE_KEY, SAMPLE_KEY, SERIES, CodedError, QualityStatus, Severity
from .factors import Factor, RunConfig, run_factors


def tag_value(c: Column, kind: T.DataType) -> tuple[Column, Column, Column]:
    """value_float, value_string, value_kind of a column by its type; booleans are kept as text."""
    none_d, none_s = F.lit(None).cast("double"), F.lit(None).cast("string")
    if isinstance(kind, T.BooleanType):
        return none_d, c.cast("string"), F.when(c.isNull(), "null").otherwise("bool")
    if isinstance(kind, T.NumericType):
        return c.cast("double"), none_s, F.when(c.isNull(), "null").otherwise("float")
    return none_d, c.cast("string"), F.when(c.isNull(), "null").otherwise("string")


def long_values(frame: DataFrame, factors: list[Factor], config: RunConfig) -> DataFrame:
    """One row for each sample and declared output. Warm-up is counted on the frame as it is given, so after any crop."""
    if lack := sorted(set(SAMPLE_KEY) - set(frame.columns)):
        raise CodedError("MISSING_KEY_COLUMN", ", ".join(lack))
    outputs = [(f.spec, o) for f in factors for o in f.spec.outputs]
    if len({o for _, o in outputs}) != len(outputs):
        raise CodedError("DUPLICATE_OUTPUT_FIELD")
    if lack := sorted({o for _, o in outputs} - set(frame.columns)):
        raise CodedError("MISSING_FACTOR_OUTPUT", ", ".join(lack))
    frame = frame.withColumn("_row", F.row_number().over(by(SERIES)) - 1)
    rows = []
    for s, o in outputs:
        v, t, k = tag_value(F.col(o), frame.schema[o].dataType)
        rows.append(F.struct(F.lit(s.factor_id).alias("factor_id"), F.lit(s.version).alias("factor_version"), F.lit(o).alias("output_field"), v.alias("value_float"), t.alias("value_string"), k.alias("value_kind"), (F.col("_row") >= s.warmup_bars).alias("warmup_complete"), F.lit(s.leaks_by_declaration).alias("declared_leak")))
    out = frame.select(*SAMPLE_KEY, F.explode(F.array(*rows)).alias("_v")).select(*SAMPLE_KEY, "_v.*")
    return out.withColumns({"feature_set_id": F.lit(config.feature_set_id), "factor_run_id": F.lit(config.factor_run_id), "input_refs": F.array(*[F.lit(r) for r in sorted(config.input_refs)]).cast("array<string>"), "quality_flags": F.array().cast("array<string>")})


def snapshots(values: DataFrame) -> DataFrame:
    """One row for each sample: a map of its numeric features, run ids, refs and flags, warm-up of all."""
    entry = F.struct("output_field", F.when(F.col("value_kind") == "bool", (F.col("value_string") == "true").cast("double")).otherwise(F.col("value_float")).alias("v"))
    sets = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    return values.groupBy("feature_set_id", *SAMPLE_KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("features"), F.array_sort(F.collect_set("factor_run_id")).alias("factor_run_ids"), sets("input_refs").alias("input_refs"), sets("quality_flags").alias("quality_flags"), F.bool_and("warmup_complete").alias("warmup_complete"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> int:
    """Rows beyond the first of each key."""
    return int(df.groupBy(*keys).agg((F.count("*") - 1).alias("n")).where("n > 0").agg(F.sum("n")).first()[0] or 0)


def assert_unique(df: DataFrame, keys: list[str], code: str) -> None:
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise CodedError(code, ", ".join(keys))


#: Which metrics make an error, and at what value, by default.
LIMITS = {"null_ratio": (1.0, Severity.WARNING), "duplicate_key_count": (0.0, Severity.ERROR), "extreme_value_count": (0.0, Severity.ERROR), "future_leakage_count": (0.0, Severity.ERROR)}
METRICS = ["row_count", "null_ratio", "warmup_incomplete_count", "symbol_count", "symbol_coverage_ratio", "warmup_drop_count", "duplicate_key_count", "extreme_value_count", "future_leakage_count"]


def quality(values: DataFrame, expected_symbols: int | None = None) -> DataFrame:
    """Nine metrics of each factor output: factor_id, output_field, metric, value, severity."""
    per_key = values.groupBy("factor_id", "output_field", "symbol", *[k for k in FEATURE_KEY if k not in ("factor_id", "output_field", "symbol")]).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("value_kind") == "null").alias("nulls"),
        F.count_if(~F.col("warmup_complete")).alias("cold"),
        F.count_if(~F.col("warmup_complete") & (F.col("value_kind") == "null")).alias("dropped"),
        F.count_if(F.isnan("value_float") | (F.abs("value_float") == INF)).alias("extreme"),
        F.count_if("declared_leak").alias("leaks"),
    )
    by_symbol = per_key.groupBy("factor_id", "output_field", "symbol").agg(*[F.sum(c).alias(c) for c in ("n", "nulls", "cold", "dropped", "extreme", "leaks")], F.sum(F.col("n") - 1).alias("dups"), F.sum(F.col("n") - F.col("nulls")).alias("filled"))
    s = by_symbol.groupBy("factor_id", "output_field").agg(*[F.sum(c).cast("double").alias(c) for c in ("n", "nulls", "cold", "dropped", "extreme", "leaks", "dups")], F.count("*").cast("double").alias("symbols"), F.count_if(F.col("filled") > 0).cast("double").alias("covered"))
    base = F.lit(float(expected_symbols)) if expected_symbols else F.col("symbols")
    value = dict(zip(METRICS, [F.col("n"), F.col("nulls") / F.col("n"), F.col("cold"), F.col("symbols"), F.col("covered") / base, F.col("dropped"), F.col("dups"), F.col("extreme"), F.col("leaks")], strict=True))

    def severity(name: str, v: Column) -> Column:
        limit, level = LIMITS.get(name, (None, None))
        bad = v >= limit if name == "null_ratio" else (v > limit if limit is not None else F.lit(False))
        return F.when(bad, F.lit(str(level))).otherwise(F.lit(str(Severity.INFO)))

    rows = F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value"), severity(k, v).alias("severity")) for k, v in value.items()])
    return s.select("factor_id", "output_field", F.explode(rows).alias("m")).select("factor_id", "output_field", "m.*")


def overall(metrics: DataFrame) -> QualityStatus:
    worst = {r[0] for r in metrics.select("severity").distinct().collect()}
    return QualityStatus.FAILED if Severity.ERROR in worst else QualityStatus.WARNING if Severity.WARNING in worst else QualityStatus.PASSED


def summary(metrics: DataFrame) -> dict[str, int]:
    return {r[0]: r[1] for r in metrics.groupBy("severity").count().collect()}


def gate_status(base: DataFrame, probe: DataFrame | None = None) -> QualityStatus:
    """A pipeline's verdict: warnings count as errors, and no metrics at all is a failure."""
    rows = base.select("severity").union(probe.select("severity")) if probe is not None else base.select("severity")
    found = {r[0] for r in rows.distinct().collect()}
    return QualityStatus.PASSED if found == {Severity.INFO} else QualityStatus.FAILED


# -- look-ahead probe --------------------------------------------------------------------------------------
class CutMode(StrEnum):
    EVENLY_SPACED = "EVENLY_SPACED"
    PERIOD_END = "PERIOD_END"
    EXPLICIT = "EXPLICIT"


@dataclass(frozen=True)
class ProbeConfig:
    mode: CutMode = CutMode.EVENLY_SPACED
    cutpoints: int = 5
    min_prefix_rows: int = 20
    tail: int = 20
    min_compare_rows: int = 1
    max_examples: int = 20
    rtol: float = 1e-9
    atol: float = 1e-12
    period: str = "month"
    explicit: tuple[datetime, ...] = ()


def period_key(c: Column, period: str) -> Column:
    match period:
        case "week":
            return F.concat_ws("-W", F.extract(F.lit("YEAROFWEEK"), c), F.lpad(F.weekofyear(c).cast("string"), 2, "0"))
        case "month":
            return F.date_format(c, "yyyy-MM")
        case "quarter":
            return F.concat_ws("-Q", F.year(c), F.quarter(c))
    raise CodedError("INVALID_PROBE_CONFIG", period)


def cutpoints(frame: DataFrame, config: ProbeConfig) -> tuple[list[datetime], int]:
    """Times to cut at, and how many requested ones can't be used. The last time is never a cut."""
    times = frame.groupBy("as_of").count()
    upto = times.select("as_of", F.sum("count").over(Window.orderBy("as_of")).alias("rows"))
    last = times.agg(F.max("as_of"), F.count("*")).first()
    if (last[1] or 0) < 2:
        return [], 0
    usable = upto.where((F.col("rows") >= config.min_prefix_rows) & (F.col("as_of") < F.lit(last[0])))
    if config.mode is CutMode.EXPLICIT:
        good = {r[0] for r in usable.where(F.col("as_of").isin(list(config.explicit))).collect()} if config.explicit else set()
        return sorted(good), len(set(config.explicit) - good)
    if config.mode is CutMode.PERIOD_END:
        ends = usable.groupBy(period_key(F.col("as_of"), config.period).alias("p")).agg(F.max("as_of").alias("t")).orderBy(F.desc("t")).limit(config.cutpoints).collect()
        return sorted(r.t for r in ends), 0
    n = usable.count()
    if not n:
        return [], 0
    if n <= config.cutpoints:
        picks = list(range(n))
    elif config.cutpoints == 1:
        picks = [n - 1]
    else:
        step = (n - 1) / (config.cutpoints - 1)
        picks = sorted({round(i * step) for i in range(config.cutpoints)})
    ranked = usable.select("as_of", (F.row_number().over(Window.orderBy("as_of")) - 1).alias("i"))
    return sorted(r.as_of for r in ranked.where(F.col("i").isin(picks)).collect()), 0


def probe(frame: DataFrame, factors: list[Factor], config: ProbeConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """Metrics and examples of values that change when later rows are taken away.

    The frame is repeated for each cut, with the cut as part of the series key, so all prefixes are one job.
    """
    config = config or ProbeConfig()
    spark = frame.sparkSession
    cuts, skipped = cutpoints(frame, config)
    outputs = [(f.spec.factor_id, o) for f in factors for o in f.spec.outputs]
    need = list(dict.fromkeys([*SAMPLE_KEY, *[c for f in factors for c in f.spec.inputs if c in frame.columns]]))
    base = frame.select(*need)
    table = spark.createDataFrame([(i, c) for i, c in enumerate(cuts)], T.StructType([T.StructField("cut_id", T.LongType()), T.StructField("cut", frame.schema["as_of"].dataType)]))
    cut = F.broadcast(table)  # as many rows as cutpoints
    prefix = run_factors(base.join(cut, F.col("as_of") <= F.col("cut")), factors, ["cut_id", *SERIES])
    full = run_factors(base, factors).join(cut, F.col("as_of") <= F.col("cut"))
    if config.tail > 0:
        full = full.withColumn("_back", F.row_number().over(Window.partitionBy("cut_id", *SERIES).orderBy(F.desc("as_of")))).where(F.col("_back") <= config.tail)
    pack = lambda df: F.array(*[F.struct(F.lit(i).alias("factor_id"), F.lit(o).alias("output_field"), F.col(o).cast("double").alias("v")) for i, o in outputs])
    keys = ["cut_id", *SAMPLE_KEY, "factor_id", "output_field"]
    a = full.select("cut_id", *SAMPLE_KEY, F.explode(pack(full)).alias("x")).select("cut_id", *SAMPLE_KEY, "x.factor_id", "x.output_field", F.col("x.v").alias("full_value"))
    b = prefix.select("cut_id", *SAMPLE_KEY, F.explode(pack(prefix)).alias("x")).select("cut_id", *SAMPLE_KEY, "x.factor_id", "x.output_field", F.col("x.v").alias("prefix_value"), F.lit(True).alias("there"))
    held = a.join(b, keys, "left").withColumn("changed", F.col("there").isNull() | ~same(F.col("full_value"), F.col("prefix_value"), config.rtol, config.atol))
    per = held.groupBy("factor_id", "output_field", "cut_id").agg(F.count("*").alias("rows"), F.count_if("changed").alias("changed"))
    enough = F.col("rows") >= config.min_compare_rows
    sums = per.groupBy("factor_id", "output_field").agg(F.coalesce(F.sum(F.when(enough, F.col("changed"))), F.lit(0)).alias("bad"), F.count_if(enough).alias("cuts"), F.coalesce(F.sum(F.when(enough, F.col("rows"))), F.lit(0)).alias("rows"))
    every = spark.createDataFrame(outputs, "factor_id string, output_field string")
    s = F.broadcast(every).join(sums, ["factor_id", "output_field"], "left").fillna(0)
    short = F.lit(len(cuts) + skipped) - F.col("cuts") + (1 if not cuts else 0)
    named = {"prefix_invariance_violation_count": (F.col("bad"), Severity.ERROR), "prefix_probe_cutpoint_count": (F.col("cuts"), None), "prefix_probe_compared_value_count": (F.col("rows"), None), "prefix_probe_warning_count": (short, Severity.WARNING), "prefix_probe_changed_ratio": (F.when(F.col("rows") > 0, F.col("bad") / F.col("rows")).otherwise(0.0), None)}
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value"), (F.when(v > 0, str(level)).otherwise(str(Severity.INFO)) if level else F.lit(str(Severity.INFO))).alias("severity")) for k, (v, level) in named.items()])
    examples = held.where("changed").orderBy("symbol", "as_of", "factor_id", "output_field", "cut_id").limit(config.max_examples)
    return s.select("factor_id", "output_field", F.explode(rows).alias("m")).select("factor_id", "output_field", "m.*"), examples
