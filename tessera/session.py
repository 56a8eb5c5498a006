"""Sessions with the settings that the engine relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir; a local one only on a local master that names none, as in tests."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "tessera-checkpoints")
    return f"{root.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def session(master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution and Arrow; anything else is the cluster's, or comes in conf (with _ for .)."""
    b = SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("_", "."), v)
    return b.getOrCreate()
