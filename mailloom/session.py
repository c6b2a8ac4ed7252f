"""Shared folder, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

BROADCAST_ROWS = 200_000
SALTS = 16
HEAVY_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see.

    Where none is named, a local one serves a local session; a cluster needs a name.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="mailloom-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """Written once to the shared folder and read back.

    Later uses cost a scan, outlive lost executors, and Spark knows the true size.
    """
    path = fresh_path(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, *measures: Column) -> tuple[DataFrame, dict]:
    """`settled`, with aggregates of its rows that cost no pass of their own."""
    seen = Observation()
    return settled(df.observe(seen, *measures)), seen.get


def spread(df: DataFrame, rows: int, *on: str) -> DataFrame:
    """Dealt out by `on` to about `rows` rows a task, before a step that multiplies rows.

    Meant for stored tables, where a count reads no columns.
    """
    return df.repartition(max(1, -(-df.count() // rows)), *on)


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Count a side before a broadcast is asked for.

    Meant for stored tables and cached batches, where a count reads no columns.
    """
    return df.count() <= max_rows


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], how: str,
                spread: Column, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join to a side that is unique on `on`: broadcast while small, beyond that a join with
    its heavy keys split.

    `spread` is any value that differs inside a hot key of the left side.
    """
    right = settled(right)
    if fits_broadcast(right, max_rows):
        return left.join(F.broadcast(right), on, how)
    return skew_join(left, right, on, how, spread)


def heavy_keys(df: DataFrame, on: list[str], heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """(*on, __parts): keys with more than `heavy_rows` rows, and into how many parts they go.

    Counted, with partial counts in the map tasks; at most one key for each `heavy_rows` rows.
    """
    counts = df.groupBy(*on).agg(F.count("*").alias("__n")).filter(F.col("__n") > heavy_rows)
    return counts.select(*on, F.ceil(F.col("__n") / heavy_rows).cast("int").alias("__parts"))


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str, spread: Column,
              heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """A join whose heavy keys of the left are split by their counted size.

    Only these are spread over tasks, and only their rows of the right are repeated; all other
    keys join plainly. Right for inner, left, semi and anti joins. `left` is read once more, in
    the columns of `on`.
    """
    heavy = F.broadcast(settled(heavy_keys(left, on, heavy_rows)))
    part = F.coalesce(F.pmod(F.xxhash64(spread), F.col("__parts")), F.lit(0)).cast("int")
    parts = F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)
    spread_left = left.join(heavy, on, "left").withColumn("__salt", part).drop("__parts")
    repeated = right.join(heavy, on, "left").withColumn("__salt", F.explode(parts)).drop("__parts")
    return spread_left.join(repeated, [*on, "__salt"], how).drop("__salt")


def narrowed(big: DataFrame, keys: DataFrame, on: list[str], key_rows: int,
             max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`big`, cut to rows that can meet one of `keys` where these are few.

    Only an aid before a join on the same columns: a small batch then reads the
    history without shuffling it. With many keys `big` stays as it is.
    """
    if key_rows > max_rows:
        return big
    return big.join(F.broadcast(keys.select(*on).distinct()), on, "left_semi")


def cluster_conf(input_bytes: int, partition_bytes: int = 128 << 20) -> dict[str, str]:
    """Session settings for an input size: shuffle partitions of about one block
    before AQE merges small ones and splits skewed ones."""
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(max(200, -(-input_bytes // partition_bytes))),
        "spark.sql.session.timeZone": "UTC",
    }


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str,
                spread: Column, salts: int = SALTS) -> DataFrame:
    """Spread each key of the left over `salts` tasks; repeat the right per salt.

    Right for inner, left, semi and anti joins, where each left row is met once.
    """
    salted_left = left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    salted_right = right.withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    return salted_left.join(salted_right, [*on, "__salt"], how).drop("__salt")
