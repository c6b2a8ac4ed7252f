"""Sinks: manifest as parquet and CSV, reports as ordered text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from mailloom.operators.classify import flat_manifest
from mailloom.operators.reports import LINE_ORDER

# One quote style for writer and reader: a quote inside a field is doubled.
CSV = {"header": True, "quote": '"', "escape": '"'}


def write_manifest_parquet(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def write_manifest_csv(rows: DataFrame, path: str) -> None:
    """The twin of the parquet manifest; each part file has the header."""
    flat_manifest(rows).write.mode("overwrite").options(**CSV).csv(path)


def read_manifest_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    # Blank is null and "" is empty text, so the null mark must be no real value.
    return spark.read.options(**CSV, multiLine=True, nullValue="\x01").schema(schema).csv(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """Range-sorted part files; put in name order they are the page."""
    lines.orderBy(*LINE_ORDER, "line").select("line").write.mode("overwrite").text(path)
