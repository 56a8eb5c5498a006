"""Ingestion of bars, immutable day partitions and reference assets."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..hashing import digest
from ..operators import quality
from ..refs import TableRef
from ..sources import files, normalize
from ..store import Store
from ..types import CURATED_BAR, PRICES, CodedError, RunStatus


def new_id() -> str:
    return uuid.uuid4().hex


def file_hash(spark: SparkSession, path: str) -> str:
    """sha256 of a file's bytes, or of a folder's files in order, read in pieces."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [p] if fs.getFileStatus(p).isFile() else [s.getPath() for s in fs.listStatus(p) if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
    total = hashlib.sha256()
    for one in sorted(names, key=lambda x: x.getName()):
        stream = fs.open(one)
        try:
            total.update(str(jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)).encode())
        finally:
            stream.close()
    return total.hexdigest()


@dataclass(frozen=True)
class Result:
    run_id: str
    status: str
    ref: str | None = None
    reused: bool = False
    issues: int = 0
    details: dict = field(default_factory=dict)


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


@dataclass
class BarIngestion:
    """Raw bars of one file to curated bars; readers and the id factory can be put in."""

    spark: SparkSession
    store: Store
    readers: dict = field(default_factory=dict)
    make_id: Callable[[], str] = new_id

    def normalized(self, path: str, kind: str, source: normalize.BarSource, run_id: str) -> DataFrame:
        return normalize.bars(files.raw_rows(files.read(self.spark, path, kind, self.readers)), source, run_id)

    def run(self, path: str, kind: str, source: normalize.BarSource, calendar_id: str | None = None) -> Result:
        """The same file under the same source is not read twice. In strict mode any issue fails the run, and no bar is kept."""
        key = {"dataset_id": source.dataset_id, "source_id": source.source_id, "freq": source.freq, "adjustment": source.adjustment, "file_hash": file_hash(self.spark, path)}
        if old := self.store.latest("import", **key):
            return Result(old["run_id"], old["status"], old["ref"], True)
        run_id = self.make_id()
        config = asdict(source)
        try:
            bars = self.normalized(path, kind, source, run_id)
            issues = quality.check_bars(bars, calendar_id, source.timezone).cache()
            n = issues.count()
        except CodedError as e:
            self.store.fail("import", run_id, config, code=e.code, message=e.message)
            raise
        try:
            if n and source.strict:
                self.store.fail("import", run_id, config, issues, "QUALITY_FAILED", f"{n} issues")
                return Result(run_id, str(RunStatus.FAILED), None, False, n)
            ref = TableRef.of("bars", dataset_id=source.dataset_id, source_run_id=run_id).uri
            self.store.put_issues(run_id, issues)
            self.store.commit("import", run_id, {"bars": bars}, config, ref=ref, finished_at=_now(), **key)
            return Result(run_id, str(RunStatus.COMMITTED), ref, False, n)
        finally:
            issues.unpersist()


def validate(store: Store, ref: str, calendar_id: str | None = None) -> DataFrame:
    """Issues of bars that are committed."""
    return quality.check_bars(store.scan(ref, CURATED_BAR), calendar_id)


@dataclass(frozen=True)
class Definition:
    """What a versioned, immutable asset is; content goes into its hash."""

    kind: str
    definition_id: str
    version: str
    content: dict


_ASSETS: dict[str, tuple[Callable, Callable, str]] = {
    "universe": (normalize.members, quality.check_members, "trading_date"),
    "calendar": (normalize.calendar_days, quality.check_calendar, "calendar_date"),
    "daily_status": (normalize.statuses, quality.check_statuses, "trading_date"),
}


@dataclass
class AssetIngestion:
    """One service for immutable day assets: bars (market_data), universe, calendar, daily_status."""

    spark: SparkSession
    store: Store
    readers: dict = field(default_factory=dict)
    make_id: Callable[[], str] = new_id

    def run(self, definition: Definition, day, path: str, kind: str, meta: dict, source: normalize.BarSource | None = None, mapping: dict | None = None) -> Result:
        """Imports one day. meta: known_at, source_data_cutoff and so on; a replay of the same import is found by its fingerprint."""
        d_hash = self.store.register(definition.kind, definition.definition_id, definition.version, definition.content)
        meta = {"definition_hash": d_hash, "source_definition_hash": d_hash, "trading_date": day, **meta}
        print_ = digest([2, file_hash(self.spark, path), asdict(source) if source else mapping or {}, d_hash, str(day)])
        if old := self.store.latest(f"{definition.kind}_import", fingerprint=print_):
            return Result(old["run_id"], old["status"], old["ref"], True, 0, {"partition_id": old["partition_id"]})
        run_id = self.make_id()
        frame = files.read(self.spark, path, kind, self.readers)
        if definition.kind == "market_data":
            rows = normalize.bars(files.raw_rows(frame), source, run_id)
            issues = quality.check_partition(rows, {**meta, "dataset_id": source.dataset_id, "freq": source.freq, "adjustment": source.adjustment, **definition.content})
            numbers = [*PRICES, "volume", "turnover"]  # 10, 10.0 and 1e1 are one price
            hashed = [c for c in rows.columns if c not in ("source_run_id", "raw_ref", "source", "market_data_partition_id", "source_row_id")]
        else:
            make, check, column = _ASSETS[definition.kind]
            rows = make(frame, mapping)
            rows = rows.where(F.col(column) == F.lit(day)) if meta.pop("only_day", False) else rows
            issues, hashed, numbers = check(rows, meta), None, None
        config = {"fingerprint": print_, "definition_hash": d_hash}
        n = issues.count()
        if n:
            self.store.fail(f"{definition.kind}_import", run_id, config, issues, "QUALITY_FAILED", f"{n} issues")
            return Result(run_id, str(RunStatus.FAILED), None, False, n)
        part = self.store.put_partition(definition.kind, definition.definition_id, definition.version, str(day), rows, d_hash, hashed, numbers, known_at=str(meta.get("known_at")), source_data_cutoff=str(meta.get("source_data_cutoff")))
        ref = f"{definition.kind}/{part['run_id']}"
        self.store.put_manifest(f"{definition.kind}_import", run_id, {"status": str(RunStatus.COMMITTED), "fingerprint": print_, "partition_id": part["run_id"], "ref": ref, "finished_at": _now()})
        return Result(run_id, str(RunStatus.COMMITTED), ref, part["reused"], 0, {"partition_id": part["run_id"]})
