"""Review decisions: an append-only log and the tables it stands for.

Actions: set (leaf given), accept (hint of the queue item), defer (note), clear
(drop the deferral), delete (drop the rule). Later rows win by (decided_at, seq).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mailloom.functions.text import leaf_subtag, leaf_tag, stripped
from mailloom.operators.rules import is_leaf
from mailloom.operators.senders import sender_stats
from mailloom.schemas import KEY
from mailloom.session import lookup_join, salted_join
from mailloom.taxonomy import Taxonomy

ITEM = ["scope", "key"]
ACTIONS = ["set", "accept", "defer", "clear", "delete"]
SCOPES = ["addr", "domain"]


def parse_leaf(rows: DataFrame, taxonomy: Taxonomy, leaf: str = "leaf") -> DataFrame:
    """Add tag, subtag and valid for a leaf text; both null when it is no leaf."""
    ok = F.coalesce(is_leaf(stripped(F.col(leaf)), taxonomy), F.lit(False))
    return rows.withColumns({
        "tag": F.when(ok, leaf_tag(F.col(leaf))),
        "subtag": F.when(ok, leaf_subtag(F.col(leaf))),
        "valid": ok,
    })


def accept_hints(messages: DataFrame, decisions: DataFrame) -> DataFrame:
    """(scope, key, hint) of the senders that are to be accepted; domains have none.

    Only messages of these senders are counted.
    """
    wanted = decisions.filter("action = 'accept' AND scope = 'addr'").select(
        F.col("key").alias("from_addr")
    ).distinct()
    own = lookup_join(
        messages.select(*KEY, "from_addr", "from_domain", "date", "keyword_hint"),
        wanted, ["from_addr"], "left_semi", F.struct(*KEY),
    )
    return sender_stats(own).select(
        F.lit("addr").alias("scope"), F.col("from_addr").alias("key"),
        F.col("keyword_hint").alias("hint"),
    )


def judge_decisions(decisions: DataFrame, queue: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """Decisions with tag, subtag and `rejected` (null, or why it has no effect).

    The queue (or accept_hints) has one row per item, a decision log may name one
    item very often.
    """
    hints = queue.select(*ITEM, F.col("hint").alias("__hint"))
    spread = F.struct("decided_at", "seq")
    met = salted_join(decisions, hints, ITEM, "left", spread)
    chosen = F.when(F.col("action") == "accept", F.col("__hint")).when(
        F.col("action") == "set", F.col("leaf")
    )
    parsed = parse_leaf(met.withColumn("leaf", chosen), taxonomy)
    ruling = F.col("action").isin("set", "accept")
    return parsed.withColumn(
        "rejected",
        F.when(~F.col("action").isin(ACTIONS), "unknown action")
        .when(~F.col("scope").isin(SCOPES), "unknown scope")
        .when((F.col("action") == "accept") & F.nullif("__hint", F.lit("")).isNull(), "no hint")
        .when(ruling & ~F.col("valid"), "not a leaf"),
    ).drop("__hint", "valid")


def _order() -> Column:
    return F.struct("decided_at", "seq")


def rules_view(log: DataFrame) -> DataFrame:
    """Current rules: the last set / accept of each item unless deleted later.

    max over a struct combines in the map tasks, whatever the size of one item.
    """
    last = F.max(F.struct(
        F.col("decided_at"), F.col("seq"), F.col("action"), F.col("tag"), F.col("subtag"),
        F.col("decided_by"),
    ))
    return (
        log.filter("rejected IS NULL AND action IN ('set', 'accept', 'delete')")
        .groupBy(*ITEM).agg(last.alias("last"))
        .filter("last.action != 'delete'")
        .select(
            *ITEM, "last.tag", "last.subtag", F.col("last.decided_by").alias("confirmed_by"),
            F.col("last.decided_at").alias("confirmed_at"),
        )
    )


def deferrals_view(log: DataFrame) -> DataFrame:
    """Current deferrals: those after the last rule or clear of their item.

    created_at is the first of them, the note is the last one.
    """
    sound = log.filter("rejected IS NULL")
    cleared = sound.filter("action IN ('set', 'accept', 'clear')").groupBy(*ITEM).agg(
        F.max(_order()).alias("__cleared")
    )
    deferred = sound.filter("action = 'defer'")
    live = salted_join(deferred, cleared, ITEM, "left", _order()).filter(
        F.col("__cleared").isNull() | (_order() > F.col("__cleared"))
    )
    return live.groupBy(*ITEM).agg(
        F.max(F.struct("decided_at", "seq", F.coalesce("note", F.lit("")).alias("note")))["note"]
        .alias("note"),
        F.min("decided_at").alias("created_at"),
    )
