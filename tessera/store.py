"""A warehouse of Parquet tables with manifests.

Rows are written first, every attempt to a folder of its own, and the manifest last, which names those folders; readers trust
committed manifests alone, so a write that broke off, or one that is to replace a run, is never half seen. Manifests are
single JSON files, written under a temporary name and put in place by one rename; row data never passes through the driver.
Partitions are also listed by their definition, so that looking one up reads no other definition's manifests.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import canonical_number
from .hashing import canonical_json, content_hash, digest
from .refs import TableRef
from .types import CodedError, RunStatus


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    # -- files
    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return sorted(str(s.getPath().getName()) for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _read_json(self, name: str) -> dict | None:
        p = self._path(name)
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write_json(self, name: str, value: dict) -> None:
        folder, _, last = name.rpartition("/")
        tmp, jvm = self._path(f"{folder}/.{last}.{uuid.uuid4().hex}"), self.spark._jvm
        out = self._fs.create(tmp, True)
        try:
            out.write(bytearray(canonical_json(value).encode()))
        finally:
            out.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(self._fs.makeQualified(tmp), self._fs.makeQualified(self._path(name)), how)
        except Exception as e:
            raise CodedError("STORE_WRITE_FAILED", name) from e

    def publish(self, temporary: str, target: str) -> bool:
        """Renames a finished folder; False, and the folder goes, if the target is there already."""
        jvm = self.spark._jvm
        old, new = (jvm.org.apache.hadoop.fs.Path(p) for p in (temporary, target))
        fs = old.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = not fs.exists(new) and fs.rename(old, new)
        if not done:
            fs.delete(old, True)
        return done

    # -- manifests
    def manifest(self, kind: str, run_id: str) -> dict | None:
        return self._read_json(f"_manifests/{kind}/{run_id}.json")

    def put_manifest(self, kind: str, run_id: str, value: dict) -> None:
        if not run_id or "/" in run_id or run_id.startswith("."):
            raise CodedError("INVALID_RUN_ID", run_id)
        self._write_json(f"_manifests/{kind}/{run_id}.json", {**value, "run_id": run_id})

    def manifests(self, kind: str) -> list[dict]:
        found = (self._read_json(f"_manifests/{kind}/{n}") for n in self._names(f"_manifests/{kind}") if n.endswith(".json") and not n.startswith("."))
        return [m for m in found if m]

    def latest(self, kind: str, **where: Any) -> dict | None:
        """The committed run that finished last, then by id, with these values."""
        found = [m for m in self.manifests(kind) if m.get("status") == RunStatus.COMMITTED and all(m.get(k) == v for k, v in where.items())]
        return max(found, key=lambda m: (str(m.get("finished_at", "")), m["run_id"]), default=None)

    # -- rows
    def write(self, table: str, run_id: str, df: DataFrame) -> str:
        """Writes rows to a new folder of the run and returns its name, which counts once a manifest has it."""
        folder = f"{table}/{run_id}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        return folder

    def vacuum(self, kind: str, run_id: str) -> list[str]:
        """Removes the folders of a run that its manifest doesn't name: attempts that broke off or were replaced."""
        named = set((self.manifest(kind, run_id) or {}).get("folders", {}).values())
        tables = [t for t, k in _KIND.items() if k == kind] + [f"{kind}_quality"]
        gone = [f"{t}/{run_id}/{n}" for t in tables for n in self._names(f"{t}/{run_id}") if f"{t}/{run_id}/{n}" not in named]
        for folder in gone:
            self._fs.delete(self._path(folder), True)
        return gone

    def read(self, table: str, runs: list[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
        """Rows of committed runs (all of them, or those named); later columns are null in earlier files."""
        kind = _KIND.get(table, table)
        found = self.manifests(kind) if runs is None else [m for m in (self.manifest(kind, r) for r in dict.fromkeys(runs)) if m]
        paths = [f"{self.root}/{m['folders'][table]}" for m in found if m.get("status") in (RunStatus.COMMITTED, RunStatus.QUALITY_FAILED) and table in m.get("folders", {})]
        if not paths:
            if schema is None:
                raise CodedError("UNKNOWN_RUN", f"{table} {runs}")
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read.option("mergeSchema", "true")
        return reader.parquet(*paths)

    def scan(self, ref: str | TableRef, schema: T.StructType | None = None) -> DataFrame:
        """Rows that a reference names; a pinned set reads its partitions' folders only, which is partition pruning by path."""
        ref = TableRef.parse(ref) if isinstance(ref, str) else ref
        pinned = ref.get("snapshot_set_id")
        if pinned:
            items = self.pinned(ref.table if ref.table != "bars" else "market_data", pinned)["items"]
            return self.read(_PINNED[ref.table], [i["partition_id"] for i in items], schema)
        run = ref.get("source_run_id") or ref.get("factor_run_id")
        runs = [run] if run and ref.table in ("bars", "features") else None
        return ref.apply(self.read(ref.table, runs, schema))

    # -- commits
    def commit(self, kind: str, run_id: str, tables: dict[str, DataFrame], config: dict, rule: str = "replace", conflict: str = "RUN_CONFLICT", status: str = RunStatus.COMMITTED, **more: Any) -> dict:
        """Writes a run's tables, then its manifest.

        rule says what a second commit of the run does: replace it; refuse it; reuse it if its config is the same
        (config), or its config and rows are (content), else raise the conflict.
        """
        config_hash, old = digest(config), self.manifest(kind, run_id)
        held = old is not None and old["status"] in (RunStatus.COMMITTED, RunStatus.QUALITY_FAILED)
        if held and rule == "refuse":
            raise CodedError(conflict, run_id)
        if held and rule == "config":
            if old["config_hash"] == config_hash:
                return old | {"reused": True}
            raise CodedError(conflict, run_id)
        hashes = {t: content_hash(df) for t, df in tables.items()} if rule == "content" else {}
        if held and rule == "content":
            if old["config_hash"] == config_hash and old["content"] == hashes:
                return old | {"reused": True}
            raise CodedError(conflict, run_id)
        folders = {t: self.write(t, run_id, df) for t, df in tables.items()}
        self.put_manifest(kind, run_id, {"status": str(status), "config": config, "config_hash": config_hash, "content": hashes, "folders": folders, **more})
        return self.manifest(kind, run_id) | {"reused": False}

    def fail(self, kind: str, run_id: str, config: dict, issues: DataFrame | None = None, code: str = "", message: str = "") -> dict:
        """A failed run: its manifest and issues, no rows. A run that was committed before is left as it is."""
        old = self.manifest(kind, run_id)
        if old is not None and old["status"] in (RunStatus.COMMITTED, RunStatus.QUALITY_FAILED):
            raise CodedError("RUN_ALREADY_COMMITTED", run_id)
        if issues is not None:
            self.put_issues(run_id, issues)
        self.put_manifest(kind, run_id, {"status": str(RunStatus.FAILED), "config": config, "config_hash": digest(config), "code": code, "message": message})
        return self.manifest(kind, run_id)

    def put_issues(self, run_id: str, issues: DataFrame) -> None:
        self.put_manifest("quality_issues", run_id, {"folder": self.write("quality_issues", run_id, issues)})

    def put_quality(self, kind: str, run_id: str, metrics: DataFrame, status: str, summary: dict) -> None:
        """Replaces a run's metrics and puts the verdict into its manifest."""
        m = self.manifest(kind, run_id)
        if m is None:
            raise CodedError("UNKNOWN_RUN", run_id)
        folder = self.write(f"{kind}_quality", run_id, metrics)
        self.put_manifest(kind, run_id, m | {"folders": m.get("folders", {}) | {f"{kind}_quality": folder}, "quality_status": str(status), "quality_summary": summary})

    def quality_metrics(self, kind: str, run_id: str) -> DataFrame:
        folder = (self.manifest(kind, run_id) or {}).get("folders", {}).get(f"{kind}_quality")
        if folder is None:
            raise CodedError("UNKNOWN_RUN", run_id)
        return self.spark.read.parquet(f"{self.root}/{folder}")

    def quality_issues(self, run_id: str) -> DataFrame:
        m = self.manifest("quality_issues", run_id)
        if m is None:
            raise CodedError("UNKNOWN_RUN", run_id)
        return self.spark.read.parquet(f"{self.root}/{m['folder']}").orderBy("code", "symbol", "source_row_id")

    # -- definitions, immutable day partitions, pinned sets
    def register(self, kind: str, definition_id: str, version: str, content: dict) -> str:
        """A definition's hash; other content under the same version is a conflict."""
        name, new = f"{definition_id}@{version}", digest(content)
        old = self.manifest(f"{kind}_definition", name)
        if old and old["hash"] != new:
            raise CodedError("DEFINITION_CONFLICT", name)
        if not old:
            self.put_manifest(f"{kind}_definition", name, {"content": content, "hash": new})
        return new

    def put_partition(self, kind: str, definition_id: str, version: str, day: str, rows: DataFrame, definition_hash: str, columns: list[str] | None = None, numbers: list[str] | None = None, **more: Any) -> dict:
        """A day's rows, once: the same content is reused, other content is a conflict. The id comes from the content.

        columns: those that count (all, if none are named); numbers: those whose texts count as numbers, however they are written.
        """
        columns, numbers = columns or rows.columns, numbers or []
        content = _rows_hash(rows, columns, numbers)
        if m := self.partition(kind, definition_id, version, day):
            if m["content_hash"] == content and m["definition_hash"] == definition_hash:
                return m | {"reused": True}
            raise CodedError("IMMUTABLE_PARTITION_CONFLICT", f"{definition_id} {day}")
        pid = digest([kind, definition_id, version, day, content, definition_hash])[:32]
        folder = self.write(_PINNED[kind], pid, rows.withColumn("market_data_partition_id", F.lit(pid)) if kind == "market_data" else rows)
        self.put_manifest(kind, pid, {"status": str(RunStatus.COMMITTED), "definition_id": definition_id, "version": version, "day": day, "content_hash": content, "definition_hash": definition_hash, "columns": columns, "numbers": numbers, "folders": {_PINNED[kind]: folder}, **more})
        self._write_json(f"{self._listing(kind, definition_id, version)}/{day}.json", {"partition_id": pid})
        return self.manifest(kind, pid) | {"reused": False}

    def _listing(self, kind: str, definition_id: str, version: str) -> str:
        return f"_partitions/{kind}/{digest([definition_id, version])[:32]}"

    def partition(self, kind: str, definition_id: str, version: str, day: str) -> dict | None:
        """A definition's partition of one day."""
        at = self._read_json(f"{self._listing(kind, definition_id, version)}/{day}.json")
        return self.manifest(kind, at["partition_id"]) if at else None

    def partitions(self, kind: str, definition_id: str, version: str) -> list[dict]:
        """All partitions of a definition, by day."""
        days = [n.removesuffix(".json") for n in self._names(self._listing(kind, definition_id, version)) if n.endswith(".json") and not n.startswith(".")]
        return [m for m in (self.partition(kind, definition_id, version, d) for d in days) if m]

    def snapshot_set(self, kind: str, set_id: str) -> tuple[dict, list[dict]]:
        """A set's manifest and its partitions' manifests."""
        m = self.pinned(kind, set_id)
        return m, [self.manifest(kind, i["partition_id"]) for i in m["items"]]

    def definition(self, kind: str, definition_id: str, version: str) -> dict | None:
        return self.manifest(f"{kind}_definition", f"{definition_id}@{version}")

    def pin(self, kind: str, definition_id: str, version: str, days: list[str]) -> dict:
        """A set of days' partitions, all of which must be there; its id comes from them, so the same set is the same id."""
        days = sorted(set(days))
        have = {d: m for d in days if (m := self.partition(kind, definition_id, version, d))}
        if not days or (lack := [d for d in days if d not in have]):
            raise CodedError("MISSING_PARTITION", ", ".join(lack) if days else "no days")
        items = [{"day": d, "partition_id": have[d]["run_id"], "content_hash": have[d]["content_hash"]} for d in days]
        set_id = digest([kind, definition_id, version, items])[:32]
        old = self.manifest(f"{kind}_set", set_id)
        if old is None:
            self.put_manifest(f"{kind}_set", set_id, {"definition_id": definition_id, "version": version, "definition_hash": have[days[0]]["definition_hash"], "items": items})
        return self.manifest(f"{kind}_set", set_id) | {"reused": old is not None}

    def pinned(self, kind: str, set_id: str, verify: bool = True) -> dict:
        """A set's manifest, checked against its definition, and its identity and partitions against theirs."""
        m = self.manifest(f"{kind}_set", set_id)
        if m is None:
            raise CodedError("UNKNOWN_SNAPSHOT_SET", set_id)
        if verify:
            if digest([kind, m["definition_id"], m["version"], m["items"]])[:32] != set_id:
                raise CodedError("SNAPSHOT_SET_HASH_MISMATCH", set_id)
            definition = self.definition(kind, m["definition_id"], m["version"])
            if definition is not None and definition["hash"] != m["definition_hash"]:
                raise CodedError("DEFINITION_HASH_MISMATCH", set_id)
            for i in m["items"]:
                part = self.manifest(kind, i["partition_id"])
                if part is None:
                    raise CodedError("UNKNOWN_PARTITION", i["partition_id"])
                if (part["definition_id"], part["version"], part["day"], part["definition_hash"]) != (m["definition_id"], m["version"], i["day"], m["definition_hash"]):
                    raise CodedError("PARTITION_IDENTITY_MISMATCH", i["partition_id"])
                if part["content_hash"] != i["content_hash"]:
                    raise CodedError("PARTITION_HASH_MISMATCH", i["partition_id"])
        return m

    def verify_rows(self, kind: str, set_id: str) -> None:
        """Hashes the stored rows of a set's partitions anew, each against its manifest."""
        m, parts = self.snapshot_set(kind, set_id)
        for part in parts:
            rows = self.spark.read.parquet(f"{self.root}/{part['folders'][_PINNED[kind]]}")
            if _rows_hash(rows, part["columns"], part["numbers"]) != part["content_hash"]:
                raise CodedError("PARTITION_CONTENT_MISMATCH", part["run_id"])

    def about(self, ref: str) -> dict:
        """What the definition behind a pinned set says, with its id, version and hash."""
        parsed = TableRef.parse(ref)
        kind = "market_data" if parsed.table == "bars" else parsed.table
        m = self.pinned(kind, parsed.get("snapshot_set_id"))
        definition = self.definition(kind, m["definition_id"], m["version"]) or {"content": {}}
        return definition["content"] | {"definition_id": m["definition_id"], "version": m["version"], "definition_hash": m["definition_hash"]}


def _rows_hash(rows: DataFrame, columns: list[str], numbers: list[str]) -> str:
    return content_hash(rows.withColumns({c: canonical_number(F.col(c)) for c in numbers}) if numbers else rows, columns)


#: The manifests that each table's rows belong to, and the tables of pinned assets.
_KIND = {"bars": "import", "market_data_bars": "market_data", "universe_members": "universe", "calendar_days": "calendar", "daily_statuses": "daily_status", "features": "feature", "snapshots": "feature", "labels": "label", "evaluation_metrics": "evaluation", "coverage_metrics": "coverage", "coverage_issues": "coverage", "fills": "backtest", "positions": "backtest", "nav": "backtest", "backtest_metrics": "backtest"}
_PINNED = {"market_data": "market_data_bars", "bars": "market_data_bars", "universe": "universe_members", "calendar": "calendar_days", "daily_status": "daily_statuses"}


def gate(store: Store, kind: str, ref: str, table: str, id_key: str, missing: str) -> dict:
    """The manifest behind a reference, if its run is committed and passed."""
    try:
        parsed = TableRef.parse(ref)
    except CodedError:
        raise CodedError("UNSUPPORTED_REF", ref) from None
    if parsed.table != table:
        raise CodedError("UNSUPPORTED_REF", ref)
    run_id = parsed.get(id_key)
    if not run_id:
        raise CodedError(missing, ref)
    m = store.manifest(kind, run_id)
    if m is None:
        raise CodedError("MISSING_MANIFEST", run_id)
    if m["status"] != RunStatus.COMMITTED:
        raise CodedError("RUN_NOT_COMMITTED", run_id)
    if m.get("quality_status") != "PASSED":
        raise CodedError("QUALITY_NOT_PASSED", run_id)
    return m


def feature_gate(store: Store, ref: str, table: str = "snapshots") -> dict:
    return gate(store, "feature", ref, table, "factor_run_id", "MISSING_FACTOR_RUN_ID")


def label_gate(store: Store, ref: str) -> dict:
    return gate(store, "label", ref, "labels", "source_run_id", "MISSING_LABEL_RUN_ID")


def coverage_gate(store: Store, ref: str) -> dict:
    try:
        run_id = TableRef.parse(ref)
        assert run_id.table == "coverage"
    except (CodedError, AssertionError):
        raise CodedError("INVALID_COVERAGE_REPORT_REF", ref) from None
    m = store.manifest("coverage", run_id.get("coverage_run_id"))
    if m is None:
        raise CodedError("UNKNOWN_COVERAGE_REPORT", ref)
    if m["status"] != RunStatus.COMMITTED:
        raise CodedError("COVERAGE_RUN_NOT_COMMITTED", ref)
    if not m.get("consumable"):
        raise CodedError("COVERAGE_REPORT_NOT_CONSUMABLE", ref)
    return m
