"""CSV and Parquet readers. Bars come as text with a row number in file order; reference assets keep their types in Parquet."""

from __future__ import annotations

from collections.abc import Callable
from enum import StrEnum

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import CodedError


class SourceType(StrEnum):
    CSV = "CSV"
    PARQUET = "PARQUET"


def csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text, empty ones as ''. A quoted value may hold line ends, so a file is one task's; large sources come in many files."""
    return spark.read.csv(path, header=True, inferSchema=False, nullValue="\u0000", emptyValue="", ignoreLeadingWhiteSpace=False, multiLine=True, escape='"')


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {SourceType.CSV: csv, SourceType.PARQUET: parquet}


def read(spark: SparkSession, path: str, kind: str, readers: dict | None = None) -> DataFrame:
    readers = READERS | (readers or {})
    if kind not in readers:
        raise CodedError("UNSUPPORTED_SOURCE_TYPE", kind)
    return readers[kind](spark, path)


def as_text(c: str, kind: T.DataType) -> Column:
    """A typed value as the text a CSV would hold; null is ''."""
    col = F.col(f"`{c}`")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = F.when(col == F.floor(col), F.floor(col).cast("string")).otherwise(col.cast("string"))
    else:
        text = col.cast("string")
    return F.coalesce(text, F.lit(""))


def raw_rows(df: DataFrame) -> DataFrame:
    """All columns as text and source_row_id, from 1 in the order of the files' names and of the rows in each.

    A row's place in its piece of a file is its number there less the piece's first; numbering needs the pieces' sizes
    (a count for each), not a global sort.
    """
    text = [as_text(f.name, f.dataType).alias(f.name) for f in df.schema.fields]
    try:
        piece = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
        placed = df.select(*text, *piece, F.monotonically_increasing_id().alias("_id"))
    except AnalysisException:  # rows of a reader of the user's own, which come in the order of their partitions
        placed = df.select(*text, F.lit("").alias("_file"), F.lit(0).cast("long").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    placed = placed.withColumn("_part", F.shiftright("_id", 33))
    sizes = placed.groupBy("_file", "_block", "_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = sizes.select("_file", "_block", "_part", "_first", (F.sum("_n").over(Window.orderBy("_file", "_block", "_part")) - F.col("_n")).alias("_before"))  # one row for each piece
    return placed.join(F.broadcast(before), ["_file", "_block", "_part"]).withColumn("source_row_id", F.col("_before") + F.col("_id") - F.col("_first") + 1).drop("_id", "_part", "_before", "_first", "_file", "_block")
