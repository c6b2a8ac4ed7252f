"""Explicit schemas of every input and state table; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, BinaryType, BooleanType, DataType, DoubleType, IntegerType, LongType, MapType, StringType,
    StructField, StructType, TimestampNTZType,
)

_TYPES: dict[str, DataType] = {
    "STRING": StringType(), "BIGINT": LongType(), "INT": IntegerType(), "DOUBLE": DoubleType(),
    "BOOLEAN": BooleanType(), "BINARY": BinaryType(), "TIMESTAMP_NTZ": TimestampNTZType(),
    "ARRAY<STRING>": ArrayType(StringType()), "MAP<STRING,STRING>": MapType(StringType(), StringType()),
}


def struct(columns: str) -> StructType:
    """Columns as `name TYPE, ...`; needs no session, unlike a DDL parse."""
    pairs = [column.split() for column in columns.split(", ")]
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


KEY = ["folder", "uidvalidity", "uid"]

LANDED = struct(
    "folder STRING, uidvalidity BIGINT, uid BIGINT, headers MAP<STRING,STRING>,"
    " from_addr STRING, to ARRAY<STRING>, subject STRING, date TIMESTAMP_NTZ,"
    " size BIGINT, text STRING, html STRING, fetched_at TIMESTAMP_NTZ"
)

RAW = struct(
    "folder STRING, uidvalidity BIGINT, uid BIGINT, message_id STRING, from_addr STRING,"
    " to_addr STRING, subject STRING, date TIMESTAMP_NTZ, size BIGINT, text STRING,"
    " headers_blob STRING, fetched_at TIMESTAMP_NTZ"
)

MESSAGE = struct(
    "folder STRING, uidvalidity BIGINT, uid BIGINT, message_id STRING, from_addr STRING,"
    " from_domain STRING, to_addr STRING, subject STRING, date TIMESTAMP_NTZ, size BIGINT,"
    " snippet STRING, headers_hash STRING, keyword_hint STRING"
)

CURSOR = struct(
    "folder STRING, uidvalidity BIGINT, last_uid BIGINT, complete BOOLEAN,"
    " updated_at TIMESTAMP_NTZ, generation_at TIMESTAMP_NTZ, live_from BIGINT"
)

DECISION = struct(
    "key STRING, scope STRING, action STRING, leaf STRING, note STRING,"
    " decided_by STRING, decided_at TIMESTAMP_NTZ, seq BIGINT"
)

DECISION_LOG = struct(
    "key STRING, scope STRING, action STRING, leaf STRING, note STRING,"
    " decided_by STRING, decided_at TIMESTAMP_NTZ, seq BIGINT, tag STRING, subtag STRING,"
    " rejected STRING"
)

RULE = struct(
    "scope STRING, key STRING, tag STRING, subtag STRING, confirmed_by STRING,"
    " confirmed_at TIMESTAMP_NTZ"
)

DEFERRAL = struct(
    "scope STRING, key STRING, note STRING, created_at TIMESTAMP_NTZ"
)

CLASSIFICATION = struct(
    "folder STRING, uidvalidity BIGINT, uid BIGINT, tag STRING, subtags ARRAY<STRING>,"
    " confidence DOUBLE, method STRING, taxonomy_version STRING, taxonomy_hash STRING,"
    " model_id STRING, prompt_version STRING, rationale STRING, truncated BOOLEAN,"
    " created_at TIMESTAMP_NTZ, run_seq BIGINT"
)

FINDING = struct(
    "folder STRING, uidvalidity BIGINT, uid BIGINT, assigned_tag STRING,"
    " suspected_tag STRING, trigger_keywords ARRAY<STRING>, resolved BOOLEAN"
)

REPLY = struct(
    "folder STRING, uidvalidity BIGINT, uid BIGINT, attempt INT, raw STRING"
)

MANIFEST_COLUMNS = [
    "folder", "uid", "message_id", "from_addr", "from_domain", "subject", "date",
    "tag", "subtags", "confidence", "method", "taxonomy_version", "model_id",
    "prompt_version", "rationale", "truncated", "created_at",
]

METRICS = struct(
    "folder STRING, fetched BIGINT, inserted BIGINT, deduped BIGINT, resynced BOOLEAN"
)

SKETCH = struct("folder STRING, sketch BINARY")
