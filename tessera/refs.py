"""Pointers to tables and pinned sets, as URIs."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import parse_qsl, quote, unquote, urlencode, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .types import CodedError

SCHEME = "tessera"
#: Columns that a reference to each table may filter by.
FILTERS = {
    "bars": ("dataset_id", "symbol", "exchange", "freq", "trading_date", "adjustment", "source", "source_run_id", "market_data_partition_id", "snapshot_set_id"),
    "features": ("factor_run_id",),
    "snapshots": ("feature_set_id", "factor_run_id", "dataset_id", "symbol", "freq", "as_of"),
    "labels": ("label_set_id", "label_id", "label_version", "source_run_id", "dataset_id", "symbol", "freq"),
    "evaluation_metrics": ("evaluation_run_id", "factor_field", "metric"),
    "coverage": ("coverage_run_id",),
    "universe": ("snapshot_set_id",),
    "calendar": ("snapshot_set_id",),
    "daily_status": ("snapshot_set_id",),
    "market_data": ("snapshot_set_id",),
}
STRICT = ("universe", "calendar", "daily_status", "market_data", "coverage")


@dataclass(frozen=True)
class TableRef:
    table: str
    filters: tuple[tuple[str, str], ...] = ()

    @classmethod
    def of(cls, table: str, **filters: str) -> TableRef:
        return cls(table, tuple(sorted(filters.items())))

    @classmethod
    def parse(cls, uri: str) -> TableRef:
        """A strict table needs exactly its one filter; others take those of FILTERS."""
        u = urlsplit(uri)
        if u.scheme != SCHEME or not u.netloc or u.path not in ("", "/") or u.fragment:
            raise CodedError("UNSUPPORTED_REF", uri)
        pairs = parse_qsl(u.query, keep_blank_values=True, strict_parsing=bool(u.query))
        if len({k for k, _ in pairs}) != len(pairs):
            raise CodedError("UNSUPPORTED_REF", uri)
        ref = cls(u.netloc, tuple(sorted(pairs)))
        allowed = FILTERS.get(ref.table)
        if allowed is None or any(k not in allowed for k, _ in pairs):
            raise CodedError("UNSUPPORTED_REF", uri)
        if ref.table in STRICT and (len(pairs) != 1 or not pairs[0][1]):
            raise CodedError("UNSUPPORTED_REF", uri)
        return ref

    @property
    def uri(self) -> str:
        return f"{SCHEME}://{self.table}" + (f"?{urlencode(self.filters)}" if self.filters else "")

    def get(self, key: str) -> str | None:
        return dict(self.filters).get(key)

    def apply(self, df: DataFrame) -> DataFrame:
        """Equality filters, which reach the scan; an id within an array column must be its only one."""
        kinds = dict(df.dtypes)
        for k, v in self.filters:
            if k == "factor_run_id" and kinds.get("factor_run_ids", "").startswith("array"):
                df = df.where((F.size("factor_run_ids") == 1) & F.array_contains("factor_run_ids", v))
            else:
                df = df.where(F.col(k) == F.lit(v).cast(kinds[k]))
        return df


def canonical(uri: str) -> str:
    return TableRef.parse(uri).uri


def parquet_ref(path: str) -> str:
    if not path.startswith("/"):
        raise CodedError("INVALID_ARTIFACT_PATH", path)
    return f"parquet://{quote(path)}"


def parquet_path(ref: str) -> str:
    u = urlsplit(ref)
    if u.scheme != "parquet" or u.netloc or not u.path.startswith("/"):
        raise CodedError("UNSUPPORTED_REF", ref)
    return unquote(u.path)
