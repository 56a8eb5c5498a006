"""Token counts as rollups that deltas maintain.

A change is signed: an insert adds a document's counts, a delete takes them away, a revision does
both. A batch of changes is added up by (source, lang, version) and committed once under its id: every attempt writes its
rows to a folder of its own, and then a marker, which names that folder and the rows' digest and is put in
place by one rename that never overwrites. So of several writers one commits, whatever broke off is never read, and a
batch that comes again changes nothing, if its rows are the same; other rows under a committed id raise
BatchConflict. Totals are the sums over committed batches.

Versions are tokenizers by name and version: words (runs of anything but white space) and byte-level BPE files
in tiktoken's format. Vocabularies are read by the driver from a folder that is a parameter, and broadcast; a file has a
fixed size.

Runs of LONG and more white-space characters are cut out of a text just where the pattern cuts, as its matching would
overflow there; the counts are the same.

Defined results: null or empty text has no tokens and counts as a document; null source or language is a group of
its own; repeated rows each count; groups whose documents cancel out stay, with zeros; an empty table commits an
empty batch. Only the named columns are read.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as X

TOKENIZERS = "/opt/tokenizers"
BPE = ("byte_bpe_50k",)
WORDS = "words"
# Fixed value: the public pre-split pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEYS = ["source", "lang", "version"]
SCHEMA = "source string, lang string, version string, docs long, tokens long"
LONG = 1000
# Fixed value: Unicode's white space.
_BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG)


class BatchConflict(ValueError):
    """Other changes were committed under this batch id."""


def n_tokens(coder, text: str) -> int:
    """How many tokens a text has. A run of white space is one piece of the pattern but for its last character, which
    belongs to what follows; at the text's end it is one piece."""
    total = at = 0
    for m in _BLANKS.finditer(text):
        end = m.end() - (m.end() < len(text))
        total += len(coder.encode_ordinary(text[at : m.start()])) + len(coder._encode_single_piece(text[m.start() : end]))
        at = end
    return total + len(coder.encode_ordinary(text[at:]))


def count_tokens(docs: DataFrame, bpe: tuple[str, ...] = BPE, folder: str = TOKENIZERS, keep: list[str] | None = None) -> DataFrame:
    """The columns keep (doc_id, source, lang) of every row, once for each version, with n_tokens of its whole text."""
    keep = keep or ["doc_id", "source", "lang"]
    files = {}
    for name in bpe:
        with open(f"{folder}/{name}.tiktoken", "rb") as f:
            files[name] = f.read()
    held = docs.sparkSession.sparkContext.broadcast(files)
    chosen = docs.select(*keep, F.col("text").alias("_x"))
    schema = chosen.drop("_x").schema.add("version", "string").add("n_tokens", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        coders = {}
        for name, data in held.value.items():
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
            coders[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            for t in X.texts(b.column(len(keep))):
                part = b.slice(t.first, len(t))
                strings = [x or "" for x in part.column(len(keep)).to_pylist()]
                counts = {WORDS: pa.array(np.diff(X.words(t).ptr))}
                counts |= {name: pa.array([n_tokens(c, s) for s in strings], pa.int64()) for name, c in coders.items()}
                for name, n in counts.items():
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([name] * len(t)), n], schema.names)

    return chosen.mapInArrow(count, schema)


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """Counts as changes that add (1) or take away (-1)."""
    return counts.select(*KEYS, F.lit(sign).cast("long").alias("docs"), (F.col("n_tokens") * sign).alias("tokens"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    return signed(old, -1).union(signed(new, 1))


class Rollup:
    """Additive totals in a shared folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _marker(self, batch: str) -> dict | None:
        at = self._at(f"_done/{batch}")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def committed(self, batch: str) -> bool:
        return self._marker(batch) is not None

    def _mark(self, batch: str, value: dict) -> bool:
        """Whether this marker was the first."""
        jvm = self.spark._jvm
        made = self._at(f"_attempts/{value['folder']}.json")
        out = self._fs.create(made, True)
        try:
            out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        finally:
            out.close()
        self._fs.mkdirs(self._at("_done"))
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri() if made.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(made, self._at(f"_done/{batch}"), none)
        except Exception:
            if self._marker(batch) is None:
                raise
            return False
        return True

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """False if the batch was committed before, with the same changes. Batch ids are letters, digits, - and _."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"bad batch id: {batch!r}")
        sums = changes.groupBy(*KEYS).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens"))
        folder = f"{batch}-{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.path}/rows/{folder}")
        digest = self._digest(folder)
        first = self._marker(batch) is None and self._mark(batch, {"folder": folder, "digest": digest})
        if not first:
            self._fs.delete(self._at(f"rows/{folder}"), True)
            self._fs.delete(self._at(f"_attempts/{folder}.json"), False)
            if self._marker(batch)["digest"] != digest:
                raise BatchConflict(batch)
        return first

    def _digest(self, folder: str) -> str:
        """Of a folder's rows, in any order."""
        rows = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/rows/{folder}")
        got = rows.agg(F.count("*"), *[F.sum(F.xxhash64(F.lit(k), *KEYS, "docs", "tokens").cast("decimal(38,0)")) for k in range(2)]).first()
        return "-".join(map(str, got))

    def batches(self) -> list[str]:
        done = self._at("_done")
        return sorted(str(s.getPath().getName()) for s in self._fs.listStatus(done)) if self._fs.exists(done) else []

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens over all committed batches."""
        paths = [f"{self.path}/rows/{self._marker(b)['folder']}" for b in self.batches()]
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
