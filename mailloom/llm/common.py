"""What several operators of this folder share: words, row keys, files in the shared folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mailloom.session import fresh_path

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blank_words(text: Column) -> Column:
    """Words between ASCII blanks, unchanged; no words for null or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def ascii_lower(text: Column) -> Column:
    """A-Z only. Pure ASCII text takes the engine's quick path."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower()))


def kept(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: lineage ends here, lost executors cost nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of few rows, so that a batch of long texts stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def filter_before_shuffle(spark: SparkSession) -> None:
    """Spark's runtime Bloom filters at every input size, so that a selective join shuffles
    few rows of its large side. Such a filter holds at most 8 MB; a full one lets rows pass."""
    bloom = "spark.sql.optimizer.runtime.bloomFilter."
    spark.conf.set(bloom + "enabled", "true")
    spark.conf.set(bloom + "applicationSideScanSizeThreshold", "0")
    spark.conf.set(bloom + "creationSideThreshold", "1t")


def parts_for(total_bytes: int, each: int, least: int = 1) -> int:
    """Number of parts, growing with the input."""
    return max(least, -(-int(total_bytes or 0) // each))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    row = df.agg(F.sum(F.octet_length(column)).alias("n")).first()
    return int(row["n"] or 0)


def store_file(folder: str, stem: str, content: bytes) -> str:
    """A file of its own name for each attempt, moved into place when whole.

    Any file system that pyarrow can open by URI. A repeated task leaves one more file,
    which no committed manifest names. Returns the file's name.
    """
    from pyarrow import fs

    at = folder if "://" in folder or folder.startswith("file:") else "file://" + os.path.abspath(folder)
    if at.startswith("file:/") and not at.startswith("file://"):
        at = "file://" + at[len("file:"):]
    system, base = fs.FileSystem.from_uri(at)
    system.create_dir(base, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex}"
    with system.open_output_stream(f"{base}/.{name}.tmp", compression=None) as out:
        out.write(content)
    system.move(f"{base}/.{name}.tmp", f"{base}/{name}")
    return name
