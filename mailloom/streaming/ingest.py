"""Ingest as a stream: each micro-batch is one ingest run on the same state.

Dedup reaches over all history, so it is an anti join with the stored messages and
needs no operator state. A micro-batch that is repeated after a failure finds its
keys stored and adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from mailloom.operators.intake import index_messages
from mailloom.plans.jobs import ingest_indexed
from mailloom.sources.state import State, compact, read_head
from mailloom.taxonomy import Taxonomy

OBSERVED = "intake"


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def start_ingest(raw: DataFrame, state: State, taxonomy: Taxonomy, checkpoint: str,
                 folders: list[str] | None = None, clock: Callable[[], datetime] = utc_now,
                 once: bool = True, compact_every: int = 64) -> StreamingQuery:
    """Start the stream; `once` takes what is there and stops.

    After `compact_every` runs they are merged, so that a batch never meets more run folders.
    """
    # Rows are indexed in the stream, so a micro-batch holds snippets, not whole texts.
    rows = index_messages(raw, taxonomy, ("fetched_at",))
    observed = rows.observe(OBSERVED, F.count(F.lit(1)).alias("fetched"))

    def on_batch(batch: DataFrame, _: int) -> None:
        # An ingest run reads its batch in several jobs.
        batch.persist()
        try:
            ingest_indexed(batch.sparkSession, state, batch, clock(), folders, streamed=True)
            head = read_head(batch.sparkSession, state)
            if head.batch - head.base >= compact_every:
                compact(batch.sparkSession, state)
        finally:
            batch.unpersist()

    writer = observed.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def bounded_dedup(raw: DataFrame, delay: str, time: str = "fetched_at") -> DataFrame:
    """Message-ID dedup with state that is bounded by a watermark.

    For a stream that only needs ids to be unique within `delay`. Rows without id
    get one of their own, so they are never merged.
    """
    own = F.concat_ws("\x01", F.lit(""), "folder", "uidvalidity", "uid")
    keyed = raw.withColumn("__id", F.coalesce(F.nullif("message_id", F.lit("")), own))
    return (
        keyed.withColumn("__at", F.col(time).cast("timestamp")).withWatermark("__at", delay)
        .dropDuplicatesWithinWatermark(["__id"])
        .drop("__id", "__at")
    )


class IntakeListener(StreamingQueryListener):
    """Hands the running number of fetched messages to a callback."""

    def __init__(self, callback: Callable[[int], None]) -> None:
        self.callback = callback
        self.fetched = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(OBSERVED)
        if seen is not None:
            self.fetched += seen["fetched"]
            self.callback(self.fetched)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
