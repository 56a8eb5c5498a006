"""Commands: ingest-bars, validate-bars, compute-factors, run-pipeline. Results are JSON with sorted keys; exit code 1 if nothing was committed."""

from __future__ import annotations

import argparse
import json
import os
from dataclasses import asdict
from datetime import datetime, timezone

from .plans.ingest import BarIngestion, validate
from .plans.research import ResearchRequest, ResearchRun
from .session import session
from .sources.normalize import BarSource
from .store import Store
from .types import CodedError, RunStatus


def _echo(payload: dict) -> None:
    print(json.dumps(payload, sort_keys=True, default=str))


def _time(text: str | None) -> datetime | None:
    if not text:
        return None
    t = datetime.fromisoformat(str(text))
    return t if t.tzinfo else t.replace(tzinfo=timezone.utc)


def load_config(path: str) -> dict:
    """A YAML file; relative paths in it are relative to it."""
    import yaml

    with open(path) as f:
        config = yaml.safe_load(f)
    if not isinstance(config, dict):
        raise CodedError("INVALID_CONFIG", path)
    here = os.path.dirname(os.path.abspath(path))
    at = lambda p: p if os.path.isabs(p) or "://" in p else os.path.join(here, p)
    for section, key in ((None, "store"), ("source", "path"), (None, "export")):
        part = config if section is None else config.get(section, {})
        if part.get(key):
            part[key] = at(part[key])
    return config


def _source(x: dict) -> BarSource:
    names = BarSource.__dataclass_fields__
    return BarSource(**{k: v for k, v in x.items() if k in names})


def _kind(path: str) -> str:
    return "PARQUET" if path.rstrip("/").endswith(".parquet") else "CSV"


def export_bars(store: Store, ref: str, path: str) -> int:
    from .types import CURATED_BAR

    bars = store.scan(ref, CURATED_BAR)
    if bars.isEmpty():
        raise CodedError("EMPTY_BAR_INPUT", ref)
    bars.write.mode("errorifexists").parquet(path)
    return bars.count()


def run_pipeline(store: Store, config: dict) -> tuple[dict, int]:
    source = config["source"]
    got = BarIngestion(store.spark, store).run(source["path"], source.get("type", _kind(source["path"])), _source(source), source.get("calendar_id"))
    out: dict = {"ingestion": asdict(got)}
    if got.status != RunStatus.COMMITTED:
        return out, 1
    if config.get("export"):
        out["exported_rows"] = export_bars(store, got.ref, config["export"])
    r = config["research"]
    request = ResearchRequest(r["run_id"], r.get("feature_set_id", "default"), got.ref, tuple(r["factors"]), source.get("freq", "1d"), tuple(r.get("symbols", ())), _time(r.get("as_of_start")), _time(r.get("as_of_end")))
    result = ResearchRun(store).run(request)
    out["research"] = asdict(result) | {"consumable": result.consumable}
    return out, 0 if result.status == RunStatus.COMMITTED else 1


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("--master", default=None)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("ingest-bars")
    for name in ("--store", "--path", "--dataset-id", "--source-id"):
        a.add_argument(name, required=True)
    a.add_argument("--type")
    a.add_argument("--freq", default="1d")
    a.add_argument("--timezone", default="Asia/Shanghai")
    a.add_argument("--convention", default="START_TIME")
    a.add_argument("--adjustment", default="NONE")
    a.add_argument("--calendar-id")
    a.add_argument("--lenient", action="store_true")
    a = sub.add_parser("validate-bars")
    for name in ("--store", "--ref"):
        a.add_argument(name, required=True)
    a.add_argument("--calendar-id")
    a = sub.add_parser("compute-factors")
    for name in ("--store", "--ref", "--run-id"):
        a.add_argument(name, required=True)
    a.add_argument("--factor", action="append", required=True)
    a.add_argument("--feature-set-id", default="default")
    a.add_argument("--freq", default="1d")
    a.add_argument("--as-of-start")
    a.add_argument("--as-of-end")
    a = sub.add_parser("run-pipeline")
    a.add_argument("--config", required=True)
    args = p.parse_args(argv)
    config = load_config(args.config) if args.command == "run-pipeline" else {}
    store = Store(session(args.master), config.get("store") or args.store)
    try:
        if args.command == "ingest-bars":
            source = BarSource(args.dataset_id, args.source_id, args.freq, args.timezone, args.convention, args.adjustment, strict=not args.lenient)
            got = BarIngestion(store.spark, store).run(args.path, args.type or _kind(args.path), source, args.calendar_id)
            payload, code = asdict(got), 0 if got.status == RunStatus.COMMITTED else 1
        elif args.command == "validate-bars":
            found = {r.code: r["count"] for r in validate(store, args.ref, args.calendar_id).groupBy("code").count().collect()}
            payload, code = {"issues": found, "valid": not found}, 1 if found else 0
        elif args.command == "compute-factors":
            request = ResearchRequest(args.run_id, args.feature_set_id, args.ref, tuple(args.factor), args.freq, (), _time(args.as_of_start), _time(args.as_of_end))
            result = ResearchRun(store).run(request)
            payload, code = asdict(result) | {"consumable": result.consumable}, 0 if result.status == RunStatus.COMMITTED else 1
        else:
            payload, code = run_pipeline(store, config)
    except CodedError as e:
        payload, code = {"error": {"code": e.code, "message": e.message}}, 1
    _echo(payload)
    return code


if __name__ == "__main__":
    raise SystemExit(main())
