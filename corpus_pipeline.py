"""The corpus pipeline: five stages over documents, each written as Parquet and read again for the next.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the
columns of docs. The last adds taken, the words of each document that the mix
takes, repeats counted; documents of which it takes none are not returned.

Defined results: an empty table gives empty results at every stage. A null or empty text fails the quality rules, so later stages see
one only where line dedup has left nothing of a text. Rows without doc_id are judged by their text like all others, but are never near
duplicates of another row; rows that share a doc_id go together there, and stand or fall by their own texts elsewhere. Null sources are
one source, and columns beside those of documents pass untouched, whatever their names; n_chars, if it is there, is counted anew. Texts are
read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, line_dedup, mixing, ngram_join, quality_rules
from tessera.llm.spread import discard, settle


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose likelihood ratio, against the rows labelled good, reaches the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.keep_good(docs, labels.where("quality = 1"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less their source's boilerplate lines."""
    out = line_dedup.drop_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near duplicates."""
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window like a benchmark item."""
    return decontaminate.drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words, with their number."""
    return mixing.mix(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_join", near_duplicates), ("decontamination", decontamination), ("mixing", mixture)]

#: SQL has no form of the hashed likelihood ratio or of the seeded blocks; a brute-force test stands in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that all stages leave. What a stage wrote goes once the next one has written its own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    settled = []
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
        discard(*settled)
        settled = [docs]
    return docs
