"""Raw mail to indexed messages: cleaning, resume, dedup, upsert, cursors, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from mailloom.fixed import MUTATING_COMMANDS
from mailloom.functions.keywords import with_keyword_hint
from mailloom.functions.text import (
    canonical_headers, clean_message_id, domain_of, first_filled, lower_address,
    short_hash, snippet, stripped,
)
from mailloom.schemas import KEY, MESSAGE
from mailloom.session import salted_join
from mailloom.taxonomy import Taxonomy


def _header(name: str) -> Column:
    """Value of a header in any case; of several the first by name."""
    same = F.filter(F.map_entries("headers"), lambda e: F.lower(e["key"]) == name)
    return F.get(F.array_sort(same), F.lit(0))["value"]


def clean_raw(landed: DataFrame) -> DataFrame:
    """Landed mail (headers map, recipient list, text and html) to raw messages."""
    return landed.select(
        "folder", "uidvalidity",
        F.coalesce("uid", F.lit(0).cast("bigint")).alias("uid"),
        clean_message_id(_header("message-id")).alias("message_id"),
        F.coalesce("from_addr", F.lit("")).alias("from_addr"),
        F.coalesce(F.array_join("to", ", "), F.lit("")).alias("to_addr"),
        F.coalesce("subject", F.lit("")).alias("subject"),
        "date",
        F.coalesce("size", F.lit(0).cast("bigint")).alias("size"),
        first_filled(F.col("text"), F.col("html")).alias("text"),
        canonical_headers(F.col("headers")).alias("headers_blob"),
        "fetched_at",
    )


def normalize_messages(raw: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Raw messages to the message columns (and extra ones), all in one projection."""
    return raw.select(
        *KEY, "message_id",
        lower_address(F.col("from_addr")).alias("from_addr"),
        domain_of(F.col("from_addr")).alias("from_domain"),
        "to_addr", "subject", "date", "size",
        snippet(F.col("text")).alias("snippet"),
        short_hash(F.col("headers_blob")).alias("headers_hash"),
        *extra,
    )


def index_messages(raw: DataFrame, taxonomy: Taxonomy, extra: tuple[str, ...] = ()) -> DataFrame:
    """Normalised messages with their keyword hint."""
    return with_keyword_hint(normalize_messages(raw, extra), taxonomy)


# --- generations and resume ---------------------------------------------------


def generation_state(raw: DataFrame, cursor: DataFrame | None = None,
                     run_ts: Column | None = None) -> DataFrame:
    """(folder, uidvalidity, generation_at, rolled): the generation fetched last per folder of
    `raw`, and whether it differs from the one of the cursor.

    The test is by time, not by number. Rows without fetch time count as of now. A
    known cursor takes part, so late rows of an older generation do not revive it.
    One aggregate over the rows and one row per folder of the cursor.
    """
    now = run_ts if run_ts is not None else F.lit(None).cast("timestamp_ntz")
    seen = raw.select("folder", "uidvalidity", F.coalesce("fetched_at", now).alias("at"))
    seen = seen.groupBy("folder", "uidvalidity").agg(F.max("at").alias("at")).withColumn(
        "old", F.lit(None).cast("bigint"))
    if cursor is not None:
        seen = seen.unionByName(cursor.select(
            "folder", "uidvalidity", F.col("generation_at").alias("at"), F.col("uidvalidity").alias("old")))
    return seen.groupBy("folder").agg(
        F.max(F.struct("at", "uidvalidity")).alias("best"), F.max("old").alias("old"),
        F.bool_or(F.col("old").isNull()).alias("here"),
    ).filter("here").select(
        "folder", "best.uidvalidity", F.col("best.at").alias("generation_at"),
        F.coalesce(F.col("best.uidvalidity") != F.col("old"), F.lit(False)).alias("rolled"))


def current_generations(raw: DataFrame, cursor: DataFrame | None = None,
                        run_ts: Column | None = None) -> DataFrame:
    """(folder, uidvalidity, generation_at) of generation_state."""
    return generation_state(raw, cursor, run_ts).drop("rolled")


def rolled_over(generations: DataFrame, cursor: DataFrame) -> DataFrame:
    """(folder): folders whose generation differs from the one of their cursor."""
    old = cursor.select("folder", F.col("uidvalidity").alias("old"))
    return generations.join(old, "folder").filter("uidvalidity != old").select("folder")


def drop_folders(messages: DataFrame, folders: DataFrame) -> DataFrame:
    return messages.join(folders, "folder", "left_anti")


def incremental_scan(raw: DataFrame, cursor: DataFrame, full: bool = False) -> DataFrame:
    """Rows of the current generation past the cursor of their folder.

    A folder without cursor, with a changed generation, or a full run starts at 0.
    """
    known = cursor.select(
        "folder", F.col("uidvalidity").alias("__seen"), F.col("last_uid").alias("__last")
    )
    start = F.lit(0) if full else F.when(
        F.col("__seen") == F.col("uidvalidity"), F.col("__last")
    ).otherwise(0)
    return (
        raw.join(known, "folder", "left")
        .filter(F.col("uid") > F.coalesce(start, F.lit(0)))
        .drop("__seen", "__last")
    )


def fetch_stats(fetched: DataFrame) -> DataFrame:
    """(folder, fetched, top): rows and highest uid per folder, in one scan."""
    return fetched.groupBy("folder").agg(
        F.count("*").alias("fetched"), F.max("uid").alias("top")
    )


_LEDGER = {
    "fetched": F.sum, "top": F.max, "inserted": F.sum, "uidvalidity": F.max, "generation_at": F.max,
    "rolled": F.bool_or, "ran": F.bool_or, "old_uidvalidity": F.max, "old_last_uid": F.max,
    "old_complete": F.bool_or, "old_updated_at": F.max, "old_generation_at": F.max, "old_live_from": F.max,
}
_LEDGER_TYPES = {
    "generation_at": "timestamp_ntz", "rolled": "boolean", "ran": "boolean", "old_complete": "boolean",
    "old_updated_at": "timestamp_ntz", "old_generation_at": "timestamp_ntz",
}


def run_ledger(stats: DataFrame, fresh: DataFrame | None = None, generations: DataFrame | None = None,
               cursor: DataFrame | None = None, rolled: DataFrame | None = None) -> DataFrame:
    """What a run knows of each folder, in one row: counts, generation, and the cursor until then.

    All parts have few rows per folder or combine in the map tasks, so one aggregate by
    folder takes the place of a chain of joins. Columns without a value are null.
    """
    parts = [stats.select("folder", *[c for c in ("fetched", "top") if c in stats.columns])]
    if fresh is not None:
        parts.append(fresh.select("folder", F.lit(1).cast("bigint").alias("inserted")))
    if generations is not None:
        known = [c for c in ("generation_at", "rolled") if c in generations.columns]
        parts.append(generations.select("folder", "uidvalidity", *known, F.lit(True).alias("ran")))
    if cursor is not None:
        parts.append(cursor.select("folder", *[
            F.col(c[4:]).alias(c) for c in _LEDGER if c.startswith("old_") and c[4:] in cursor.columns]))
    if rolled is not None:
        parts.append(rolled.select("folder", F.lit(True).alias("rolled")))
    shapes = [p.select("folder", *[
        (F.col(c) if c in p.columns else F.lit(None)).cast(_LEDGER_TYPES.get(c, "bigint")).alias(c) for c in _LEDGER
    ]) for p in parts]
    return reduce(DataFrame.unionByName, shapes).groupBy("folder").agg(
        *[how(c).alias(c) for c, how in _LEDGER.items()])


def cursor_of(ledger: DataFrame, run_ts: Column, full: bool = False, run: int = 0) -> DataFrame:
    """The cursor after a run, one row per folder. Folders outside the run keep their row.

    `live_from` is the first run whose rows are alive: this one for a folder that is new,
    rolled over or rewritten.
    """
    ran = F.coalesce("ran", F.lit(False))
    start = F.when(
        F.lit(not full) & (F.col("old_uidvalidity") == F.col("uidvalidity")), F.col("old_last_uid")
    ).otherwise(0)
    restart = F.coalesce("rolled", F.lit(False)) | F.col("old_live_from").isNull() | (F.lit(full) & ran)
    return ledger.filter(ran | F.col("old_uidvalidity").isNotNull()).select(
        "folder",
        F.coalesce("uidvalidity", "old_uidvalidity").alias("uidvalidity"),
        F.when(ran, F.greatest(F.coalesce("top", F.lit(0)), start))
        .otherwise(F.col("old_last_uid")).alias("last_uid"),
        F.when(ran, F.lit(True)).otherwise(F.col("old_complete")).alias("complete"),
        F.when(ran, run_ts).otherwise(F.col("old_updated_at")).alias("updated_at"),
        F.coalesce("generation_at", "old_generation_at").alias("generation_at"),
        F.when(restart, F.lit(run).cast("bigint")).otherwise(F.col("old_live_from")).alias("live_from"),
    )


def metrics_of(ledger: DataFrame) -> DataFrame:
    """fetched, inserted, deduped, resynced per folder of the run."""
    inserted = F.coalesce("inserted", F.lit(0))
    return ledger.filter("fetched IS NOT NULL").select(
        "folder", "fetched", inserted.alias("inserted"), (F.col("fetched") - inserted).alias("deduped"),
        F.coalesce("rolled", F.lit(False)).alias("resynced"))


def advance_cursor(stats: DataFrame, generations: DataFrame, cursor: DataFrame,
                   run_ts: Column, full: bool = False) -> DataFrame:
    """Place of each folder after a run, without the columns that only stored runs have."""
    ledger = run_ledger(stats, generations=generations, cursor=cursor)
    return cursor_of(ledger, run_ts, full).drop("generation_at", "live_from")


# --- dedup by Message-ID --------------------------------------------------------


def folder_position(folders: list[str] | None) -> Column:
    """Order in which folders are taken; without a list all rank alike."""
    if not folders:
        return F.lit(0)
    place = F.array_position(F.lit(folders), F.col("folder"))
    return F.when(place == 0, len(folders) + 1).otherwise(place)


def _identity() -> Column:
    """Message-ID, or for a missing one a value of its own, so it is never merged
    and never gathers in one task."""
    own = F.concat_ws("\x01", F.lit(""), "folder", "uidvalidity", "uid")
    return F.when(F.col("message_id") == "", own).otherwise(F.col("message_id"))


def first_seen(batch: DataFrame, folders: list[str] | None = None) -> DataFrame:
    """First row of each Message-ID by folder order, then uid; all rows without id.

    The rank filter lets Spark keep one row per id in every map task before the
    shuffle, so an id with very many copies stays small.
    """
    w = Window.partitionBy("__id").orderBy(folder_position(folders), "folder", "uid")
    return (
        batch.withColumn("__id", _identity())
        .withColumn("__rn", F.row_number().over(w))
        .filter("__rn = 1")
        .drop("__rn")
    )


def dedup_messages(batch: DataFrame, stored: DataFrame | None = None,
                   folders: list[str] | None = None,
                   released: DataFrame | None = None) -> DataFrame:
    """First-seen rows whose Message-ID is not stored yet.

    The batch is first cut to one row per id, then the anti join reuses that
    partitioning. `released` holds (folder, message_id) of folders dropped in this
    run: such an id still blocks the folders taken before the dropped one.
    """
    if released is not None:
        rank = folder_position(folders)
        gone = released.filter("message_id != ''").select(
            "message_id", F.struct(rank.alias("p"), F.col("folder").alias("f")).alias("__until")
        ).groupBy("message_id").agg(F.max("__until").alias("__until"))
        here = F.struct(rank.alias("p"), F.col("folder").alias("f"))
        batch = salted_join(
            batch, gone, ["message_id"], "left", F.struct(*KEY)
        ).filter(F.col("__until").isNull() | (here >= F.col("__until"))).drop("__until")
    first = first_seen(batch, folders)
    if stored is not None:
        seen = stored.filter("message_id != ''").select(F.col("message_id").alias("__id")).distinct()
        first = first.join(seen, "__id", "left_anti")
    return first.drop("__id")


def dedup_refresh(batch: DataFrame, stored: DataFrame,
                  folders: list[str] | None = None) -> DataFrame:
    """As dedup_messages, but a message that is stored under its own key stays in,
    so that its columns can be refreshed."""
    own = F.struct(*KEY)
    owners = stored.filter("message_id != ''").groupBy("message_id").agg(F.min(own).alias("__owner"))
    met = salted_join(batch, owners, ["message_id"], "left", own)
    free = met.filter(F.col("__owner").isNull() | (F.col("__owner") == own)).drop("__owner")
    return first_seen(free, folders).drop("__id")


def new_ids(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Non-empty ids of the batch that are not stored, as a set."""
    ids = batch.filter("message_id != ''").select("message_id").distinct()
    return ids.join(stored.select("message_id").distinct(), "message_id", "left_anti")


# --- upsert -----------------------------------------------------------------------


REFRESHED = ("message_id", "subject", "snippet", "keyword_hint")


def upsert_messages(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Insert new keys; on a known key refresh four columns, keep the rest."""
    new = batch.select(
        *KEY, *[F.col(c).alias(f"__new_{c}") for c in MESSAGE.names if c not in KEY],
        F.lit(True).alias("__in_batch"),
    )
    old = stored.select(*MESSAGE.names, F.lit(True).alias("__in_stored"))
    joined = old.join(new, KEY, "full")

    def pick(name: str) -> Column:
        fresh, kept = F.col(f"__new_{name}"), F.col(name)
        if name in REFRESHED:
            return F.when(F.col("__in_batch"), fresh).otherwise(kept)
        return F.when(F.col("__in_stored"), kept).otherwise(fresh)

    return joined.select(*KEY, *[pick(c).alias(c) for c in MESSAGE.names if c not in KEY])


# --- counts -------------------------------------------------------------------------


def message_count(messages: DataFrame) -> DataFrame:
    return messages.agg(F.count("*").alias("messages"))


def distinct_message_count(messages: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct Message-IDs; the empty id counts as one value."""
    n = F.approx_count_distinct("message_id") if approximate else F.count_distinct("message_id")
    return messages.agg(n.alias("distinct_messages"))


SKETCH_BITS = 14  # 2**14 registers: a standard error below one percent


def id_sketches(messages: DataFrame) -> DataFrame:
    """(folder, sketch): a HyperLogLog sketch of the Message-IDs of each folder.

    Sketches of any parts merge into that of the whole. The empty id, which a sketch would
    leave out, counts as one value, as in the exact count.
    """
    marked = F.concat(F.lit("\x01"), F.col("message_id"))
    return messages.groupBy("folder").agg(F.hll_sketch_agg(marked, F.lit(SKETCH_BITS)).alias("sketch"))


def distinct_message_estimate(sketches: DataFrame) -> DataFrame:
    """Distinct Message-IDs by merged sketches; see distinct_message_count for the exact number."""
    merged = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return sketches.agg(F.coalesce(merged, F.lit(0)).alias("distinct_messages"))


def sync_metrics(stats: DataFrame, inserted: DataFrame, rolled: DataFrame) -> DataFrame:
    """fetched, inserted, deduped, resynced per folder of the run."""
    return metrics_of(run_ledger(stats, inserted, rolled=rolled))


# --- access log -----------------------------------------------------------------------


def flag_commands(log: DataFrame, command: str = "command") -> DataFrame:
    """Log rows whose command would change server state: a verb alone or before a space."""
    head = F.upper(stripped(F.col(command)))
    verbs = "|".join(MUTATING_COMMANDS)
    return log.filter(F.rlike(head, F.lit(f"^({verbs})($| )")))
