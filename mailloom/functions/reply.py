"""Strict checks of model replies and their outcome, all as native expressions.

A reply is a JSON object in any noise. Its schema: tag text, required; subtags
list of text; confidence number (text and booleans are read as numbers);
rationale text. Anything else is invalid. `from_json` would coerce wrong types,
so the fields are read through VARIANT and their types are checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mailloom import fixed
from mailloom.taxonomy import Taxonomy

# A number as text: decimal digits, single underscores between them, or a word for infinity.
_DIGITS = "[0-9](_?[0-9])*"
NUMBER = rf"^([+-]?(({_DIGITS}[.]?({_DIGITS})?|[.]{_DIGITS})(e[+-]?{_DIGITS})?|inf|infinity)|nan)$"
PARSED = "struct<tag:string,subtags:array<string>,confidence:double,rationale:string>"


def reply_json(raw: Column) -> Column:
    """Text from the first { to the last }, null when there is none."""
    return F.nullif(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), F.lit(""))


def with_parsed_reply(replies: DataFrame, raw: str, column: str = "reply") -> DataFrame:
    """Add `column`: the checked reply as a struct, null when it is invalid."""

    def field(name: str, kind: str) -> Column:
        return F.try_variant_get(F.col("__v"), f"$.{name}", kind)

    def kind_of(name: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(F.col("__v"), f"$.{name}", "variant"))

    js = F.col("__js")
    one_value = F.json_array_length(F.concat(F.lit("["), js, F.lit("]"))) == 1
    number_text = F.lower(F.trim(field("confidence", "string")))
    confidence = (
        F.when(F.col("__tc").isNull(), F.lit(0.0))
        .when(
            F.col("__tc") == "STRING",
            F.when(F.rlike(number_text, F.lit(NUMBER)), F.translate(number_text, "_", "").try_cast("double")),
        )
        .when(F.col("__tc") == "BOOLEAN", field("confidence", "boolean").cast("double"))
        .when(
            F.rlike(F.col("__tc"), F.lit("^(BIGINT|DOUBLE|DECIMAL|FLOAT)")),
            field("confidence", "double"),
        )
    )
    subtags = F.coalesce(field("subtags", "array<string>"), F.array().cast("array<string>"))
    checked = (
        replies.withColumn("__js", reply_json(F.col(raw)))
        .withColumn("__v", F.when(one_value, F.try_parse_json(js)))
        .withColumns({
            "__tt": kind_of("tag"), "__ts": kind_of("subtags"),
            "__tc": kind_of("confidence"), "__tr": kind_of("rationale"),
        })
        .withColumns({"__conf": confidence, "__subs": subtags})
    )
    ok = (
        F.coalesce(F.col("__tt") == "STRING", F.lit(False))
        & F.col("__conf").isNotNull()
        & (F.col("__ts").isNull() | F.col("__ts").isin("ARRAY<STRING>", "ARRAY<VOID>"))
        & ~F.exists("__subs", lambda s: s.isNull())
        & (F.col("__tr").isNull() | (F.col("__tr") == "STRING"))
    )
    parsed = F.struct(
        field("tag", "string").alias("tag"),
        F.col("__subs").alias("subtags"),
        F.col("__conf").alias("confidence"),
        F.coalesce(field("rationale", "string"), F.lit("")).alias("rationale"),
    ).cast(PARSED)
    return checked.withColumn(column, F.when(ok, parsed)).drop(
        "__js", "__v", "__tt", "__ts", "__tc", "__tr", "__conf", "__subs"
    )


def with_outcome(replies: DataFrame, taxonomy: Taxonomy, reply: str = "reply") -> DataFrame:
    """Add tag, subtag, confidence, rationale. Unknown tags and invalid replies
    become unclassified with confidence 0. The subtag is the part after the slash
    of the first listed subtag that the taxonomy has."""
    leaves = taxonomy.leaves
    r = F.col(reply)
    known = F.coalesce(r["tag"].isin(leaves), F.lit(False))
    subs = [leaf for leaf in leaves if "/" in leaf]
    first_sub = F.get(F.filter(r["subtags"], lambda s: s.isin(subs)), F.lit(0))
    subtag = F.try_element_at(F.split(first_sub, "/", 2), F.lit(2))
    return replies.withColumns({
        "tag": F.when(known, r["tag"]).otherwise(fixed.UNCLASSIFIED),
        "subtag": F.when(known, subtag),
        "confidence": F.when(known, r["confidence"]).otherwise(0.0),
        "rationale": F.when(known, r["rationale"]).otherwise(""),
    })


def abstain(outcomes: DataFrame, threshold: float = fixed.CONFIDENCE_THRESHOLD) -> DataFrame:
    """Turn tags below the threshold into unclassified; keep why."""
    unsure = (F.col("tag") != fixed.UNCLASSIFIED) & (F.col("confidence") < threshold)
    return outcomes.withColumns({
        "tag": F.when(unsure, fixed.UNCLASSIFIED).otherwise(F.col("tag")),
        "subtag": F.when(~unsure, F.col("subtag")),
    })
