"""The model path: payloads, calls, one retry, checked outcomes, abstention.

A completer is any function (system, user, sampling) -> reply text, or, with `listed`,
(system, [user, ...], sampling) -> [reply text, ...] for at most that many users at once,
so that a client can send them together. It comes from a factory that can be pickled, and
each Python worker task makes its own. A table of recorded replies can take its place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from mailloom import fixed
from mailloom.functions.keywords import with_keyword_hint
from mailloom.functions.reply import PARSED, abstain, with_outcome, with_parsed_reply
from mailloom.functions.text import hint_line, kept_length, payload_head, token_estimate
from mailloom.operators.classify import as_records
from mailloom.schemas import KEY
from mailloom.taxonomy import Taxonomy

Completer = Callable[[str, str, dict], str | None]
ListCompleter = Callable[[str, list[str], dict], list[str | None]]
CompleterFactory = Callable[[], Completer | ListCompleter]


def build_payload(messages: DataFrame, taxonomy: Taxonomy,
                  budget: int = fixed.PAYLOAD_TOKEN_BUDGET,
                  keep: list[str] | None = None) -> DataFrame:
    """Add payload and truncated. The hint line, of `taxonomy`, comes after the cut."""
    staged = with_keyword_hint(messages, taxonomy, "__hint").withColumn(
        "__head", payload_head(F.col("from_addr"), F.col("subject"), F.col("date"))
    ).withColumn("__kept", kept_length(F.col("__head"), F.col("snippet"), budget))
    return staged.select(
        *(keep or messages.columns),
        F.concat(
            F.col("__head"), F.left("snippet", F.col("__kept").cast("int")),
            hint_line(F.col("__hint")),
        ).alias("payload"),
        (F.col("__kept") < F.length("snippet")).alias("truncated"),
    )


def prompt_budget(payloads: DataFrame, taxonomy: Taxonomy, budget: int) -> DataFrame:
    """Tokens of system prompt and payload per message, and whether they fit."""
    tokens = token_estimate(F.lit(taxonomy.system_prompt())) + token_estimate(F.col("payload"))
    return payloads.select(*KEY, tokens.alias("tokens"), (tokens > budget).alias("over_budget"))


# --- replies -------------------------------------------------------------------


def replay(payloads: DataFrame, replies: DataFrame, attempt: int, out: str) -> DataFrame:
    """Add the recorded reply of one attempt (unique per message and attempt)."""
    rows = replies.filter(F.col("attempt") == attempt).select(*KEY, F.col("raw").alias(out))
    return payloads.join(rows, KEY, "left")


def complete(payloads: DataFrame, factory: CompleterFactory, system: str, out: str,
             wanted: str | None = None, listed: int = 0) -> DataFrame:
    """Add the model's reply text; only rows where `wanted` is true are sent.

    All rows pass through in one stream of Arrow batches, so a second attempt
    never repeats the first. A null reply counts as invalid.
    """
    sampling = dict(fixed.SAMPLING)

    def replies(call, users: list[str]) -> list[str | None]:
        if not listed:
            return [call(system, user, sampling) for user in users]
        found: list[str | None] = []
        for at in range(0, len(users), listed):
            some = users[at:at + listed]
            answers = list(call(system, some, sampling))
            if len(answers) != len(some):
                raise ValueError(f"{len(some)} payloads were sent, {len(answers)} replies came back")
            found += answers
        return found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = factory()
        for batch in batches:
            asked = batch[wanted].to_numpy(bool) if wanted else np.ones(len(batch), bool)
            answers = np.full(len(batch), None, object)
            answers[asked] = replies(call, batch["payload"][asked].tolist())
            batch[out] = answers
            yield batch

    schema = StructType([*payloads.schema.fields, StructField(out, StringType())])
    return payloads.mapInPandas(run, schema)


def with_replies(payloads: DataFrame, taxonomy: Taxonomy,
                 factory: CompleterFactory | None = None,
                 replies: DataFrame | None = None, listed: int = 0) -> DataFrame:
    """Add `reply`: the first valid of two attempts, null when both fail."""
    if factory is None:
        # Both attempts of a message become one row, so the messages shuffle once.
        pairs = replies.groupBy(*KEY).agg(
            *[F.max(F.when(F.col("attempt") == i, F.col("raw"))).alias(f"raw{i}") for i in (1, 2)]
        )
        first = with_parsed_reply(payloads.join(pairs, KEY, "left"), "raw1", "reply1")
        second = with_parsed_reply(first, "raw2", "reply2")
    else:
        system = taxonomy.system_prompt()
        first = with_parsed_reply(complete(payloads, factory, system, "raw1", listed=listed), "raw1", "reply1")
        # The checked reply passes through Python as text.
        flat = first.withColumn("again", F.col("reply1").isNull()).withColumn(
            "reply1", F.to_json("reply1")
        )
        asked = complete(flat, factory, system, "raw2", "again", listed).drop("again")
        back = asked.withColumn("reply1", F.from_json("reply1", PARSED))
        second = with_parsed_reply(back, "raw2", "reply2")
    return second.withColumn("reply", F.coalesce("reply1", "reply2")).drop(
        "raw1", "raw2", "reply1", "reply2"
    )


# --- outcome ----------------------------------------------------------------------


def classify_llm(payloads: DataFrame, taxonomy: Taxonomy, model_id: str,
                 factory: CompleterFactory | None = None,
                 replies: DataFrame | None = None, listed: int = 0) -> DataFrame:
    """Key, tag, subtag, confidence, rationale, truncated and provenance."""
    outcome = with_outcome(with_replies(payloads, taxonomy, factory, replies, listed), taxonomy)
    return outcome.select(
        *KEY, "tag", "subtag", "confidence", "rationale", "truncated",
        F.lit(model_id).alias("model_id"), F.lit(fixed.PROMPT_VERSION).alias("prompt_version"),
    )


def classify_llm_batch(residue: DataFrame, taxonomy: Taxonomy, model_id: str, run_ts: Column,
                       run_seq: int, factory: CompleterFactory | None = None,
                       replies: DataFrame | None = None,
                       threshold: float = fixed.CONFIDENCE_THRESHOLD,
                       budget: int = fixed.PAYLOAD_TOKEN_BUDGET, listed: int = 0) -> DataFrame:
    """Records of a model run over the residue (cut it with llm_limit before)."""
    payloads = build_payload(residue, taxonomy, budget, KEY)
    outcome = abstain(classify_llm(payloads, taxonomy, model_id, factory, replies, listed), threshold)
    named = outcome.withColumn("method", F.lit("llm"))
    return as_records(named, taxonomy, run_ts, run_seq, "tag", "subtag")


def llm_counts() -> list[Column]:
    """Measures of a model run, for an aggregate or an observation."""
    return [F.count(F.lit(1)).alias("called"),
            F.count_if(F.col("tag") == fixed.UNCLASSIFIED).alias("unclassified")]


def llm_metrics(records: DataFrame) -> DataFrame:
    return records.agg(*llm_counts())
