"""Factors: a small expression language, an operator registry, its compiler to columns, the registry and the runner."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from enum import StrEnum
from typing import Any

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions import by, divide, log, pct_change, rolling_mean, rolling_std
from ..types import SERIES, CodedError, Frequency


# -- expressions -------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Expr:
    """A node: a field, a literal, a binary operation or a call of a registered operator."""

    kind: str
    value: Any = None
    args: tuple[Expr, ...] = ()
    params: tuple[tuple[str, Any], ...] = ()
    name: str | None = None

    def _with(self, sign: str, other: Any, swap: bool = False) -> Expr:
        pair = (self, lift(other))
        return Expr("binary", sign, pair[::-1] if swap else pair)

    def __add__(self, o: Any) -> Expr:
        return self._with("+", o)

    def __radd__(self, o: Any) -> Expr:
        return self._with("+", o, True)

    def __sub__(self, o: Any) -> Expr:
        return self._with("-", o)

    def __rsub__(self, o: Any) -> Expr:
        return self._with("-", o, True)

    def __mul__(self, o: Any) -> Expr:
        return self._with("*", o)

    def __rmul__(self, o: Any) -> Expr:
        return self._with("*", o, True)

    def __truediv__(self, o: Any) -> Expr:
        return self._with("/", o)

    def __rtruediv__(self, o: Any) -> Expr:
        return self._with("/", o, True)

    def alias(self, name: str) -> Expr:
        return replace(self, name=name)


def lift(x: Any) -> Expr:
    return x if isinstance(x, Expr) else literal(x)


def field_(name: str) -> Expr:
    return Expr("field", name)


def literal(value: Any) -> Expr:
    return Expr("literal", value)


def call(op_id: str, *args: Any, **params: Any) -> Expr:
    return Expr("operator", op_id, tuple(map(lift, args)), tuple(sorted(params.items())))


@dataclass(frozen=True)
class Operator:
    """compile(argument columns, parameters, window of the series) -> column."""

    op_id: str
    compile: Callable[[list[Column], dict[str, Any], WindowSpec], Column]
    description: str = ""
    requires_sorted: bool = True
    supports_streaming: bool = False


class Operators:
    def __init__(self, operators: Iterable[Operator] = ()) -> None:
        self._by_id: dict[str, Operator] = {}
        for op in operators:
            self.register(op)

    def register(self, op: Operator) -> None:
        if op.op_id in self._by_id:
            raise CodedError("DUPLICATE_OPERATOR", op.op_id)
        self._by_id[op.op_id] = op

    def get(self, op_id: str) -> Operator:
        if op_id not in self._by_id:
            raise CodedError("UNKNOWN_OPERATOR", op_id)
        return self._by_id[op_id]

    def list(self) -> list[Operator]:
        return [self._by_id[k] for k in sorted(self._by_id)]


def default_operators() -> Operators:
    return Operators(
        [
            Operator("op.pct_change", lambda a, p, w: pct_change(a[0], w, int(p.get("periods", 1))), "change against an earlier row"),
            Operator("op.rolling_mean", lambda a, p, w: rolling_mean(a[0], w, int(p["window"])), "mean of a full window"),
        ]
    )


_BINARY = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divide}


def compile_expr(e: Expr, w: WindowSpec, operators: Operators) -> Column:
    match e.kind:
        case "field":
            return F.col(e.value)
        case "literal":
            return F.lit(e.value)
        case "binary" if e.value in _BINARY:
            a, b = (compile_expr(x, w, operators) for x in e.args)
            return _BINARY[e.value](a, b)
        case "operator":
            return operators.get(e.value).compile([compile_expr(x, w, operators) for x in e.args], dict(e.params), w)
    raise CodedError("UNSUPPORTED_EXPRESSION", f"{e.kind} {e.value}")


# -- factors -----------------------------------------------------------------------------------------------
class Mode(StrEnum):
    OPERATOR_GRAPH = "OPERATOR_GRAPH"
    COLUMN_EXPR = "COLUMN_EXPR"
    FRAME_TRANSFORM = "FRAME_TRANSFORM"
    PYTHON_UDF = "PYTHON_UDF"


@dataclass(frozen=True)
class Spec:
    factor_id: str
    version: str = "v1"
    mode: Mode = Mode.COLUMN_EXPR
    namespace: str = "core"
    inputs: tuple[str, ...] = ("close",)
    outputs: tuple[str, ...] = ()
    warmup_bars: int = 0
    frequencies: tuple[str, ...] = tuple(Frequency)
    tags: tuple[str, ...] = ()
    causal: bool = True
    uses_future_data: bool = False
    forward_bars: int = 0

    def __post_init__(self) -> None:
        if not self.factor_id or not self.version:
            raise CodedError("INVALID_FACTOR_SPEC", "factor_id and version are required")
        if not self.outputs:
            object.__setattr__(self, "outputs", (self.factor_id,))
        if len(set(self.outputs)) != len(self.outputs) or not all(self.outputs):
            raise CodedError("DUPLICATE_OUTPUT_FIELD", self.factor_id)
        if self.warmup_bars < 0 or self.forward_bars < 0:
            raise CodedError("INVALID_FACTOR_SPEC", "bar counts can't be negative")

    @property
    def leaks_by_declaration(self) -> bool:
        return self.forward_bars > 0 or self.uses_future_data or not self.causal


@dataclass(frozen=True)
class Factor:
    """make: an Expr or tuple of them; or f(window) -> column(s); or f(frame, series keys) -> frame."""

    spec: Spec
    make: Any


class Registry:
    def __init__(self, factors: Iterable[Factor] = ()) -> None:
        self._by_key: dict[tuple[str, str], Factor] = {}
        for f in factors:
            self.register(f)

    def register(self, f: Factor) -> None:
        key = (f.spec.factor_id, f.spec.version)
        if key in self._by_key:
            raise CodedError("DUPLICATE_FACTOR", f"{key[0]} {key[1]}")
        self._by_key[key] = f

    def get(self, factor_id: str, version: str | None = None, freq: str | None = None) -> Factor:
        found = [f for (i, v), f in sorted(self._by_key.items()) if i == factor_id and version in (None, v)]
        if not found:
            raise CodedError("UNKNOWN_FACTOR", factor_id)
        if len(found) > 1:
            raise CodedError("AMBIGUOUS_FACTOR_VERSION", factor_id)
        if freq is not None and freq not in found[0].spec.frequencies:
            raise CodedError("UNSUPPORTED_FREQUENCY", f"{factor_id} {freq}")
        return found[0]

    def list(self, namespace: str | None = None, tag: str | None = None) -> list[Factor]:
        return [f for _, f in sorted(self._by_key.items()) if namespace in (None, f.spec.namespace) and (tag is None or tag in f.spec.tags)]


def run_factors(frame: DataFrame, factors: Iterable[Factor], keys: list[str] | None = None, operators: Operators | None = None, order: str = "as_of") -> DataFrame:
    """frame with every factor's outputs, in the order asked for, so later ones may read earlier ones.

    Windows of one partitioning share one exchange and sort. keys: what a series is.
    """
    keys, operators = keys or SERIES, operators or default_operators()
    w = by(keys, order)
    for f in factors:
        s = f.spec
        if lack := sorted(set(s.inputs) - set(frame.columns)):
            raise CodedError("MISSING_INPUT_FIELD", f"{s.factor_id}: {', '.join(lack)}")
        match s.mode:
            case Mode.FRAME_TRANSFORM:
                frame = f.make(frame, keys)
            case Mode.OPERATOR_GRAPH | Mode.COLUMN_EXPR:
                made = f.make(w) if s.mode is Mode.COLUMN_EXPR else f.make
                made = made if isinstance(made, (tuple, list)) else (made,)
                if len(made) != len(s.outputs):
                    raise CodedError("MISSING_FACTOR_OUTPUT", s.factor_id)
                if s.mode is Mode.OPERATOR_GRAPH:
                    made = tuple(compile_expr(e, w, operators) for e in made)
                frame = frame.withColumns(dict(zip(s.outputs, made, strict=True)))
            case _:
                raise CodedError("UNSUPPORTED_COMPUTE_MODE", s.mode)
        if lack := sorted(set(s.outputs) - set(frame.columns)):
            raise CodedError("MISSING_FACTOR_OUTPUT", f"{s.factor_id}: {', '.join(lack)}")
    return frame


def _volatility(frame: DataFrame, keys: list[str]) -> DataFrame:
    w = by(keys)
    frame = frame.withColumn("_r", pct_change(F.col("close"), w))
    return frame.withColumn("volatility_20", rolling_std(F.col("_r"), w, 20)).drop("_r")


def _true_range(w: WindowSpec) -> Column:
    last = F.lag("close").over(w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - last), F.abs(F.col("low") - last))


def builtin() -> Registry:
    close = field_("close")
    mean = lambda n: call("op.rolling_mean", close, window=n)
    graph = lambda name, warmup, e: Factor(Spec(name, mode=Mode.OPERATOR_GRAPH, warmup_bars=warmup, tags=("price",)), e)
    return Registry(
        [
            graph("ret_1", 1, call("op.pct_change", close, periods=1)),
            graph("ret_5", 5, call("op.pct_change", close, periods=5)),
            Factor(Spec("log_ret_1", warmup_bars=1, tags=("price",)), lambda w: log(F.col("close")) - F.lag(log(F.col("close"))).over(w)),
            graph("ma_5", 4, mean(5)),
            graph("ma_20", 19, mean(20)),
            graph("close_over_ma20", 19, close / mean(20)),
            Factor(Spec("true_range", inputs=("high", "low", "close"), tags=("range",)), _true_range),
            Factor(Spec("volatility_20", mode=Mode.FRAME_TRANSFORM, warmup_bars=20, tags=("risk",)), _volatility),
        ]
    )


@dataclass(frozen=True)
class RunConfig:
    """Lineage of one factor run; a pinned input needs its definition hash and the universe's."""

    factor_run_id: str
    feature_set_id: str
    dataset_id: str
    freq: str
    input_refs: tuple[str, ...] = ()
    definition_hash: str | None = None
    universe_ref: str | None = None
    universe_hash: str | None = None
    execution_mode: str = "batch"
    options: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not all((self.factor_run_id, self.feature_set_id, self.dataset_id, self.freq)):
            raise CodedError("INVALID_RUN_CONFIG", "ids are required")
        if bool(self.universe_ref) != bool(self.universe_hash):
            raise CodedError("INCOMPLETE_LINEAGE", "a universe needs its ref and its hash")
