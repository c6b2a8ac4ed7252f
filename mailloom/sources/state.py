"""State tables as append-only parquet datasets with latest-wins views.

heads/N.json                the last one names what is committed; see Head
messages/batch_id=N         rows of ingest run N, sorted by key
messages_base/at=N          live messages of runs up to N, merged and sorted by key
ids_base/at=N/bucket=B      their Message-IDs by hash, sorted, with Bloom filters
profiles_base/at=N          their partial sender profiles by folder
sketches_base/at=N          their distinct-id sketches by folder
cursor/batch_id=N           one row per folder
metrics/batch_id=N          counts of run N
classifications/taxonomy_hash=H/run_seq=N
classifications_base/at=N/taxonomy_hash=H   runs up to N, merged and sorted by key
decisions/run_seq=N         review decisions with their verdict
findings                    replaced by every audit

A run writes its own folder only and never one that it reads, so a run that is
repeated after a loss overwrites its own half-written rows. A new head commits it. A
message is visible from its folder's `live_from` run up to the last committed run: a
rolled-over or rewritten folder moves `live_from`, nothing is deleted.

`compact` merges the committed runs and moves the head's base behind them; readers then
leave the old folders alone, and `vacuum` deletes them. Each table has one writer at a
time: a head is a new file, so of two writers of one run the second gets an error.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from mailloom.operators.decisions import deferrals_view, rules_view
from mailloom.operators.intake import id_sketches
from mailloom.operators.senders import PARTIAL, profile_partials
from mailloom.schemas import (
    CLASSIFICATION, CURSOR, DECISION_LOG, FINDING, KEY, MESSAGE, METRICS, SKETCH,
)
from mailloom.session import BROADCAST_ROWS, narrowed
from mailloom.sources import files

BATCH = StructField("batch_id", LongType())
RUN = StructField("run_seq", LongType())
ID_HASH = StructField("id_hash", LongType())
BUCKET = StructField("bucket", IntegerType())
IDS = StructType([ID_HASH, *[MESSAGE[c] for c in ("message_id", "folder")], BATCH])

IDS_PER_BUCKET = 1_000_000
LEAST_BUCKETS = 64
LITERAL_IDS = 2_000  # ids that are sent to the scan as values
KEPT_HEADS = 20


@dataclass(frozen=True)
class State:
    root: str

    def path(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])


@dataclass(frozen=True)
class Head:
    """What is committed: the last run of each table, and up to which run they are merged."""

    batch: int = 0
    base: int = 0
    buckets: int = LEAST_BUCKETS
    classifications: int = 0
    classifications_base: int = 0
    decisions: int = 0


class Conflict(RuntimeError):
    """Another writer has committed the run that this one was about to commit."""


# --- heads ---------------------------------------------------------------------------


def _heads(spark: SparkSession, state: State) -> list[str]:
    return [n for n in files.names(spark, state.path("heads")) if n.endswith(".json")]


def read_head(spark: SparkSession, state: State) -> Head:
    """The last whole head. A half-written one counts as none."""
    for name in reversed(_heads(spark, state)):
        try:
            return Head(**json.loads(files.read_text(spark, state.path("heads", name))))
        except json.JSONDecodeError:
            continue
    return Head()


def _advance(spark: SparkSession, state: State, **change: int) -> Head:
    """A new head with some values moved on; those of other tables stay as they are.

    `expected_x` names the value that x must have until then.
    """
    expected = {k[9:]: change.pop(k) for k in list(change) if k.startswith("expected_")}
    while True:
        found = _heads(spark, state)
        head = read_head(spark, state)
        for name, value in expected.items():
            if getattr(head, name) != value:
                raise Conflict(f"{name} is at {getattr(head, name)}, not at {value}")
        head = replace(head, **change)
        place = int(found[-1][:-5]) + 1 if found else 1
        if files.create_text(spark, state.path("heads", f"{place:012d}.json"), json.dumps(asdict(head))):
            break
    for old in found[:-KEPT_HEADS]:
        files.delete(spark, state.path("heads", old))
    return head


def init_state(spark: SparkSession, state: State) -> State:
    """Create the empty tables where they are missing."""
    classifications = StructType([
        f for f in CLASSIFICATION.fields if f.name not in ("taxonomy_hash", "run_seq")
    ])
    for parts, schema in [
        (("messages", "batch_id=0"), MESSAGE),
        (("cursor", "batch_id=0"), CURSOR),
        (("metrics", "batch_id=0"), METRICS),
        (("classifications", "taxonomy_hash=none", "run_seq=0"), classifications),
        (("decisions", "run_seq=0"), DECISION_LOG),
        (("findings",), FINDING),
    ]:
        spark.createDataFrame([], schema).write.mode("ignore").parquet(state.path(*parts))
    if not _heads(spark, state):
        _advance(spark, state)
    return state


def _read(spark: SparkSession, state: State, name: str, schema: StructType,
          *partitions: StructField) -> DataFrame:
    fields = [*schema.fields, *[p for p in partitions if p.name not in schema.names]]
    return spark.read.schema(StructType(fields)).parquet(state.path(name))


def _base(spark: SparkSession, state: State, name: str, at: int, schema: StructType,
          *more: StructField) -> DataFrame:
    return _read(spark, state, f"{name}_base/at={at}", schema, *more)


# --- runs of the ingest -----------------------------------------------------------------


def committed_batch(spark: SparkSession, state: State) -> int:
    return read_head(spark, state).batch


def _cursor(spark: SparkSession, state: State, batch: int) -> DataFrame:
    return spark.read.schema(CURSOR).parquet(state.path("cursor", f"batch_id={batch}"))


def read_cursor(spark: SparkSession, state: State, head: Head | None = None) -> DataFrame:
    """The last committed cursor: each run writes the rows of all folders."""
    return _cursor(spark, state, (head or read_head(spark, state)).batch)


def _new_runs(spark: SparkSession, state: State, head: Head) -> DataFrame:
    """Messages of the runs behind the base; older folders are pruned as partitions."""
    return _read(spark, state, "messages", MESSAGE, BATCH).filter(
        (F.col("batch_id") > head.base) & (F.col("batch_id") <= head.batch))


def _alive(rows: DataFrame, cursor: DataFrame) -> DataFrame:
    """The cursor has one row per folder, so Spark broadcasts it by its file size."""
    return rows.join(cursor.select("folder", "live_from"), "folder").filter(
        "batch_id >= live_from").drop("live_from")


def _stored(spark: SparkSession, state: State, head: Head) -> DataFrame:
    """Live messages with the run that brought them."""
    rows = _new_runs(spark, state, head)
    if head.base:
        rows = _base(spark, state, "messages", head.base, MESSAGE, BATCH).unionByName(rows)
    return _alive(rows, read_cursor(spark, state, head)).select(*MESSAGE.names, "batch_id")


def read_messages(spark: SparkSession, state: State, head: Head | None = None) -> DataFrame:
    """Live messages. They do not move, and runs that are merged are not read."""
    return _stored(spark, state, head or read_head(spark, state)).select(*MESSAGE.names)


def id_hash(column: str = "message_id"):
    return F.xxhash64(column)


def read_ids(spark: SparkSession, state: State, wanted: list[str] | None = None,
             head: Head | None = None) -> DataFrame:
    """(folder, message_id) of live messages with an id; of `wanted` ids only, where given.

    The wanted ids go to the scan as values: they pick the hash buckets of the base as
    partitions, and within files row groups are skipped by the range of the sorted hashes
    and by Bloom filters. So a small batch reads a small part of the history.
    """
    head = head or read_head(spark, state)
    rows = _new_runs(spark, state, head).filter("message_id <> ''").select("message_id", "folder", "batch_id")
    if wanted is not None:
        rows = rows.filter(F.col("message_id").isin(wanted))
    if head.base:
        old = _base(spark, state, "ids", head.base, IDS, BUCKET)
        if wanted is not None:
            marks = [r[0] for r in spark.createDataFrame([(w,) for w in wanted], "message_id string")
                     .select(id_hash()).collect()]
            old = old.filter(F.col("bucket").isin(sorted({m % head.buckets for m in marks}))
                             & F.col("id_hash").isin(marks) & F.col("message_id").isin(wanted))
        rows = old.select("message_id", "folder", "batch_id").unionByName(rows)
    return _alive(rows, read_cursor(spark, state, head)).select("folder", "message_id")


def stored_ids(spark: SparkSession, state: State, batch: DataFrame, rows: int,
               head: Head | None = None) -> DataFrame:
    """The (folder, message_id) rows that can meet an id of the batch, which has `rows` rows.

    Few ids are sent to the scan; with more the whole narrow table is offered to a join,
    behind a broadcast filter while the batch fits one.
    """
    if rows <= LITERAL_IDS:
        wanted = {r[0] for r in batch.filter("message_id <> ''").select("message_id").collect()}
        return read_ids(spark, state, sorted(wanted), head)
    return narrowed(read_ids(spark, state, None, head), batch, ["message_id"], rows, BROADCAST_ROWS)


def stored_keys(spark: SparkSession, state: State, lo: int | None, hi: int | None,
                head: Head | None = None) -> DataFrame:
    """Keys of live messages with a uid in the span that a batch has; none for an empty batch.

    Files are sorted by key, so the span leaves most row groups out.
    """
    rows = _stored(spark, state, head or read_head(spark, state)).select(*KEY)
    return rows.filter(F.lit(False) if lo is None else F.col("uid").between(lo, hi))


def write_batch(df: DataFrame, state: State, name: str, batch_id: int) -> None:
    writer = df.write.mode("overwrite")
    if name == "messages":
        writer = df.sortWithinPartitions(*KEY).write.mode("overwrite").option(
            "parquet.bloom.filter.enabled#message_id", "true")
    writer.parquet(state.path(name, f"batch_id={batch_id}"))


def commit_cursor(cursor: DataFrame, state: State, batch_id: int) -> None:
    """Write the cursor of a run and commit the run."""
    write_batch(cursor.select(*CURSOR.names).coalesce(1), state, "cursor", batch_id)
    _advance(cursor.sparkSession, state, batch=batch_id, expected_batch=batch_id - 1)


def read_metrics(spark: SparkSession, state: State) -> DataFrame:
    """Counts of committed runs."""
    return _read(spark, state, "metrics", METRICS, BATCH).filter(
        F.col("batch_id") <= read_head(spark, state).batch)


# --- what is kept with the base ---------------------------------------------------------------


def read_profile_partials(spark: SparkSession, state: State, head: Head | None = None) -> DataFrame:
    """Partial sender profiles of live messages: the stored ones of the base, and those of the
    runs since, which are made on read."""
    head = head or read_head(spark, state)
    cursor = read_cursor(spark, state, head)
    fresh = profile_partials(_alive(_new_runs(spark, state, head), cursor))
    if not head.base:
        return fresh
    return _of_base(spark, state, "profiles", PARTIAL, head, cursor).unionByName(fresh)


def read_id_sketches(spark: SparkSession, state: State, head: Head | None = None) -> DataFrame:
    """Distinct-id sketches of live messages, as read_profile_partials."""
    head = head or read_head(spark, state)
    cursor = read_cursor(spark, state, head)
    fresh = id_sketches(_alive(_new_runs(spark, state, head), cursor))
    if not head.base:
        return fresh
    return _of_base(spark, state, "sketches", SKETCH, head, cursor).unionByName(fresh)


def _of_base(spark: SparkSession, state: State, name: str, schema: StructType, head: Head,
             cursor: DataFrame) -> DataFrame:
    """The base holds what was alive when it was written; later a folder dies as a whole."""
    dead = cursor.filter(F.col("live_from") > head.base).select("folder")
    return _base(spark, state, name, head.base, schema).join(dead, "folder", "left_anti")


def compact(spark: SparkSession, state: State) -> Head:
    """Merge the committed runs of messages and classifications behind the head.

    Readers see the same rows before and after. Without new runs nothing is done.
    """
    head = read_head(spark, state)
    change: dict[str, int] = {}
    if head.batch > head.base:
        at = f"at={head.batch}"
        path = state.path("messages_base", at)
        _stored(spark, state, head).repartitionByRange(*KEY).sortWithinPartitions(*KEY).write.mode(
            "overwrite").option("parquet.bloom.filter.enabled#message_id", "true").parquet(path)
        merged = _base(spark, state, "messages", head.batch, MESSAGE, BATCH)
        ids = merged.filter("message_id <> ''").select(
            id_hash().alias("id_hash"), "message_id", "folder", "batch_id")
        buckets = max(LEAST_BUCKETS, -(-ids.count() // IDS_PER_BUCKET))
        placed = ids.withColumn("bucket", F.pmod("id_hash", F.lit(buckets)).cast("int"))
        placed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "id_hash").write.mode(
            "overwrite").option("parquet.bloom.filter.enabled#id_hash", "true").partitionBy(
            "bucket").parquet(state.path("ids_base", at))
        profile_partials(merged).write.mode("overwrite").parquet(state.path("profiles_base", at))
        id_sketches(merged).write.mode("overwrite").parquet(state.path("sketches_base", at))
        change |= {"base": head.batch, "buckets": buckets, "expected_base": head.base}
    if head.classifications > head.classifications_base:
        log = read_classifications(spark, state, head)
        log.repartitionByRange("taxonomy_hash", *KEY).sortWithinPartitions("taxonomy_hash", *KEY).write.mode(
            "overwrite").partitionBy("taxonomy_hash").parquet(
            state.path("classifications_base", f"at={head.classifications}"))
        change |= {"classifications_base": head.classifications,
                   "expected_classifications_base": head.classifications_base}
    return _advance(spark, state, **change) if change else head


def vacuum(spark: SparkSession, state: State) -> list[str]:
    """Delete folders that no reader of the last head opens; returns their names.

    Readers of older heads must have ended.
    """
    head = read_head(spark, state)

    def number(name: str) -> int:
        return int(name.split("=")[1])

    gone = [f"messages/{n}" for n in files.names(spark, state.path("messages"))
            if n.startswith("batch_id=") and 0 < number(n) <= head.base]
    gone += [f"cursor/{n}" for n in files.names(spark, state.path("cursor"))
             if n.startswith("batch_id=") and 0 < number(n) < head.batch]
    for table, at in (("messages", head.base), ("ids", head.base), ("profiles", head.base),
                      ("sketches", head.base), ("classifications", head.classifications_base)):
        gone += [f"{table}_base/{n}" for n in files.names(spark, state.path(f"{table}_base"))
                 if n.startswith("at=") and number(n) < at]
    for tax in files.names(spark, state.path("classifications")):
        if tax.startswith("taxonomy_hash=") and tax != "taxonomy_hash=none":
            gone += [f"classifications/{tax}/{n}"
                     for n in files.names(spark, state.path("classifications", tax))
                     if n.startswith("run_seq=") and number(n) <= head.classifications_base]
    for name in gone:
        files.delete(spark, state.path(name))
    return gone


# --- classifications ---------------------------------------------------------------


def read_classifications(spark: SparkSession, state: State, head: Head | None = None) -> DataFrame:
    head = head or read_head(spark, state)
    rows = _read(spark, state, "classifications", CLASSIFICATION).filter(
        (F.col("run_seq") > head.classifications_base) & (F.col("run_seq") <= head.classifications))
    if head.classifications_base:
        rows = _base(spark, state, "classifications", head.classifications_base, CLASSIFICATION).unionByName(rows)
    return rows.select(*CLASSIFICATION.names)


def next_run(spark: SparkSession, state: State, name: str = "classifications") -> int:
    return getattr(read_head(spark, state), name) + 1


def _commit_run(spark: SparkSession, state: State, name: str, run_seq: int) -> None:
    """A run that is written again after its commit moves nothing."""
    if run_seq > getattr(read_head(spark, state), name):
        _advance(spark, state, **{name: run_seq})


def append_classification(records: DataFrame, state: State, taxonomy_hash: str,
                          run_seq: int) -> None:
    """Append a run. Its folder is its own, so a repeated run does not double rows."""
    target = state.path("classifications", f"taxonomy_hash={taxonomy_hash}", f"run_seq={run_seq}")
    records.drop("taxonomy_hash", "run_seq").write.mode("overwrite").parquet(target)
    _commit_run(records.sparkSession, state, "classifications", run_seq)


# --- decisions, findings --------------------------------------------------------------


def read_decisions(spark: SparkSession, state: State) -> DataFrame:
    """seq is ordered by run, then by its place in the run."""
    rows = _read(spark, state, "decisions", DECISION_LOG, RUN).filter(
        F.col("run_seq") <= read_head(spark, state).decisions)
    placed = rows.withColumn("seq", F.col("run_seq").cast("long") * (1 << 32) + F.col("seq"))
    return placed.select(*DECISION_LOG.names)


def append_decisions(judged: DataFrame, state: State, run_seq: int) -> None:
    judged.select(*DECISION_LOG.names).write.mode("overwrite").parquet(
        state.path("decisions", f"run_seq={run_seq}")
    )
    _commit_run(judged.sparkSession, state, "decisions", run_seq)


def read_rules(spark: SparkSession, state: State) -> DataFrame:
    return rules_view(read_decisions(spark, state))


def read_deferrals(spark: SparkSession, state: State) -> DataFrame:
    return deferrals_view(read_decisions(spark, state))


def read_findings(spark: SparkSession, state: State) -> DataFrame:
    return _read(spark, state, "findings", FINDING)


def replace_findings(findings: DataFrame, state: State) -> None:
    findings.select(*FINDING.names).write.mode("overwrite").parquet(state.path("findings"))
