"""Raw mail as files: batch and stream readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from mailloom.schemas import LANDED, RAW


def read_raw(spark: SparkSession, path: str, fmt: str = "parquet",
             schema: StructType = RAW) -> DataFrame:
    """Raw messages from parquet, orc or json files."""
    return spark.read.format(fmt).schema(schema).load(path)


def read_landed(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Landed mail (headers map, recipient list, text and html); see clean_raw."""
    return read_raw(spark, path, fmt, LANDED)


def stream_raw(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: StructType = RAW, max_files: int | None = None) -> DataFrame:
    """The same files as a stream; each file is taken once per checkpoint."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)
