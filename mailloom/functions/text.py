"""Scalar column functions for addresses, snippets, leaves, tokens and payloads."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mailloom import fixed

# Unicode white space (the set that Python's split() uses) as one regex class.
# Single characters below 256 become a bit set, and the outer range turns away all
# other Latin text with one comparison; plain ranges cost four times as much.
WHITESPACE = (
    r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
)


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, f"^[{WHITESPACE}]+|[{WHITESPACE}]+$", "")


def lower_address(addr: Column) -> Column:
    return F.lower(addr)


def domain_of(addr: Column) -> Column:
    """Lower-case part after the last @, or '' without one."""
    return F.when(
        F.contains(addr, F.lit("@")), F.lower(F.substring_index(addr, "@", -1))
    ).otherwise(F.lit(""))


def snippet(text: Column, length: int = fixed.SNIPPET_LENGTH) -> Column:
    """White-space runs become one space, ends are trimmed, then cut to length.

    The result is made of the first `length` other characters at most, however long
    the space between them, so only the stretch that holds them is rewritten.
    """
    head = F.regexp_extract(
        text, f"^(?:[{WHITESPACE}]*+[^{WHITESPACE}]){{0,{length}}}+", 0
    )
    return F.left(F.trim(F.regexp_replace(head, f"[{WHITESPACE}]+", " ")), F.lit(length))


def short_hash(blob: Column) -> Column:
    return F.left(F.sha2(blob, 256), F.lit(16))


def clean_message_id(raw: Column) -> Column:
    return F.btrim(F.coalesce(raw, F.lit("")), F.lit("<> "))


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def canonical_headers(headers: Column) -> Column:
    """Stable text of a header map: its entries in sorted order, as JSON."""
    return F.coalesce(F.to_json(F.array_sort(F.map_entries(headers))), F.lit("[]"))


def iso_text(ts: Column) -> Column:
    """ISO-8601 text of a TIMESTAMP_NTZ, six digits of fraction or none at all.

    A cast keeps the wall clock whatever the session time zone is.
    """
    plain = F.translate(ts.cast("string"), " ", "T")
    return F.when(F.contains(plain, F.lit(".")), F.rpad(plain, 26, "0")).otherwise(plain)


def leaf_of(tag: Column, subtag: Column) -> Column:
    return F.concat_ws("/", tag, F.nullif(subtag, F.lit("")))


def leaf_tag(leaf: Column) -> Column:
    return F.split_part(stripped(leaf), F.lit("/"), F.lit(1))


def leaf_subtag(leaf: Column) -> Column:
    """Everything after the first slash, null without one."""
    return F.try_element_at(F.split(stripped(leaf), "/", 2), F.lit(2))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(fixed.CHARS_PER_TOKEN))


def comma_text(values: Column) -> Column:
    return F.array_join(values, ",")


def comma_list(text: Column) -> Column:
    return F.filter(F.split(text, ","), lambda part: part != "")


def payload_head(from_addr: Column, subject: Column, date: Column) -> Column:
    return F.concat(
        F.lit("From: "), from_addr, F.lit("\nSubject: "), subject,
        F.lit("\nDate: "), F.coalesce(iso_text(date), F.lit("")), F.lit("\nSnippet: "),
    )


def kept_length(head: Column, body: Column, budget: int) -> Column:
    """How much of the body stays when it is cut from its tail in fixed steps.

    Closed form: the least number of steps that brings the body under the room
    left by the head.
    """
    room = F.greatest(F.lit(budget) - token_estimate(head), F.lit(0))
    excess = F.length(body) - room * fixed.CHARS_PER_TOKEN
    steps = F.greatest(F.ceil(excess / F.lit(fixed.PAYLOAD_CUT_STEP)), F.lit(0))
    return F.greatest(F.length(body) - steps * fixed.PAYLOAD_CUT_STEP, F.lit(0))


def hint_line(hint: Column) -> Column:
    """Advisory line for the model; '' without a hint."""
    return F.when(
        hint.isNotNull(), F.concat(F.lit("\nKeyword hint (advisory, may be wrong): "), hint)
    ).otherwise(F.lit(""))
