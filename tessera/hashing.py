"""Canonical JSON and content hashes: of small values on the driver, of rows on the executors."""

from __future__ import annotations

import hashlib
import json
from datetime import date, datetime, timezone
from decimal import Decimal
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _plain(x: Any) -> Any:
    if isinstance(x, Enum):
        return x.value
    if isinstance(x, datetime):
        return (x if x.tzinfo is None else x.astimezone(timezone.utc)).isoformat()
    if isinstance(x, date):
        return x.isoformat()
    if isinstance(x, Decimal):
        return format(x.normalize(), "f") if x else "0"
    if isinstance(x, (set, frozenset)):
        return sorted(x)
    raise TypeError(f"no canonical form: {type(x).__name__}")


def canonical_json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=_plain)


def digest(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def content_hash(df: DataFrame, columns: list[str] | None = None) -> str:
    """A hash of the rows as a multiset: order and partitioning don't matter, repeats do.

    A row's hash is made on the executors; four 60-bit sums and the count come back, so no task holds all rows' hashes.
    """
    names = sorted(columns or df.columns)
    row = F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
    got = df.select(row.alias("h")).agg(F.count("*").alias("n"), *parts).first()
    return digest([names, *[str(x) for x in got]])
