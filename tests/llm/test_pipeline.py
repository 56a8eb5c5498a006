from __future__ import annotations

import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline
import pytest
from common import WORD
from test_dedup import boilerplate_removed, linked
from test_models import base_rules, best_leak

from tessera.llm import line_dedup, mixing, quality_rules

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's rows, written and read again."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return [[r.asDict() for r in df.collect()] for df in out], [df.columns for df in out]


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_join", "decontamination", "mixing"]
    rows, columns = stages
    assert all(c == columns[0] for c in columns[:-1]) and columns[-1] == [*columns[0], "taken"]


def test_quality_keeps_what_passes(stages, spark):
    before, after = stages[0][0], {r["doc_id"] for r in stages[0][1]}
    q = {r.doc_id: r.kept for r in quality_rules.quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")).collect()}
    assert after == {i for i, k in q.items() if k}
    for r in before:
        n, _, _, _, repeated = base_rules(r["text"])
        if n < 50 or 100 * repeated > 50 * n:
            assert r["doc_id"] not in after


def test_lines(stages):
    before, after = stages[0][1], {r["doc_id"]: r for r in stages[0][2]}
    want = boilerplate_removed([(r["doc_id"], r["text"], r["source"]) for r in before], line_dedup.MAX_RATIO, line_dedup.MIN_PAGES)
    assert {(i, t) for i, t, *_ in want} == {(i, r["text"]) for i, r in after.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())


def test_one_of_each_group(stages):
    before, after = stages[0][2], {r["doc_id"] for r in stages[0][3]}
    want = linked([(r["doc_id"], r["text"]) for r in before])
    assert after == {i for i, (_, c) in want.items() if i == c}


def test_leaks_go(stages, spark):
    items = [r.text.lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    keys = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in items]
    before, after = stages[0][3], {r["doc_id"] for r in stages[0][4]}
    for r in before:
        w = r["text"].lower().split()
        own = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
        assert (r["doc_id"] in after) == (not any(own & k and best_leak(w, i) >= 0.8 for i, k in zip(items, keys)))


def test_mix(stages):
    before, after = stages[0][4], stages[0][5]
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    for r in after:
        assert 0 < r["taken"] <= 2 * len(WORD.findall(r["text"]))
        taken[r["source"]] += r["taken"]
    names = sorted(sizes)
    want = mixing.targets([sizes[s] for s in names], [mixing.WEIGHTS[k % 3] for k in range(len(names))], mixing.SHARE * sum(sizes.values()))
    assert all(abs(taken[s] - t) <= 2 * mixing.BLOCK for s, t in zip(names, want))


def test_odd_and_empty_tables(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows and clashing names pass every stage."""
    good = " ".join(f"word{i % 97} of{i % 53}" for i in range(120))
    rows = [(1, good, "en", "s", 1), (None, good, None, None, None), (2, None, "en", "s", 0), (3, "", "en", None, 0), (4, good + " and more", "en", "s", 2), (4, good + " and more", "en", "s", 2), (5, " ".join(f"long{i}" for i in range(60_000)), "en", "t", 3)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    for name, some in (("odd", rows), ("none", rows[:0])):
        sf = f"{tmp_path}/{name}"
        docs = spark.createDataFrame(some, kind).selectExpr("*", "'mine' AS _row", "'mine' AS _id", "'mine' AS _g", "'mine' AS k1", "'mine' AS site")
        docs.write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([(1, None), (2, "long7 long8 long9 long10 long11 long12"), (None, "")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        out = corpus_pipeline.run(spark, sf)
        assert out.columns == [*docs.columns, "taken"]
        got = sorted(((r.doc_id or 0), r.site, r.n_chars == len(r.text)) for r in out.collect())
        assert got == ([] if name == "none" else [(0, "mine", True), (1, "mine", True)])


HELD = r'''
import re
import pyarrow as pa
from pyspark.sql import SparkSession
from tessera.llm import ngram_join, quality_rules

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + FOLDER).config("spark.sql.shuffle.partitions", "2").getOrCreate()

def held(batches):
    for _ in batches:
        pass
    yield pa.RecordBatch.from_arrays([pa.array([int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1]) >> 10])], ["mb"])

def run(n, words):
    docs = spark.range(n).selectExpr("id AS doc_id", f"array_join(transform(sequence(1, {words}), x -> conv(abs(xxhash64(id, x)) % 1000000, 10, 36)), ' ') AS text").coalesce(1)
    for df in (ngram_join.survey(docs), quality_rules.quality(docs, docs.limit(2))):
        df.write.format("noop").mode("overwrite").save()
    return spark.range(1).mapInArrow(held, "mb long").first().mb

print("HELD", run(3, 10), run(400, 20_000))
'''


def test_a_worker_keeps_no_memory_of_its_last_task(tmp_path):
    """Workers wait beside their executor, and count in its memory, until the next task."""
    root = str(Path(__file__).resolve().parents[2])
    out = subprocess.run([sys.executable, "-c", f"FOLDER = {str(tmp_path)!r}\n{HELD}"], cwd=root, env={**os.environ, "PYTHONPATH": root}, capture_output=True, text=True, timeout=200)
    first, then = map(int, out.stdout.rpartition("HELD")[2].split())
    assert then <= first + 6, (first, then)
