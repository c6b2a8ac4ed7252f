"""A mail view over the supplied tables, with the state tables that belong to it.

Everything is derived from the tables, so it grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailloom.functions.text import comma_list, domain_of
from mailloom.operators.intake import dedup_messages, index_messages
from mailloom.schemas import struct
from mailloom.session import settled, spread
from mailloom.taxonomy import Taxonomy, load_taxonomy

TAXONOMY: Taxonomy = load_taxonomy()
FOLDERS = ["INBOX", "Archive", "Lists"]
DOCUMENTS = struct("doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")

# Expressions that read alike in both engines but for the two marked types.
MAIL = {
    "uid": "doc_id + 1",  # no mail has uid 0
    "folder": "CASE lang WHEN 'en' THEN 'INBOX' WHEN 'de' THEN 'Archive' ELSE 'Lists' END",
    "uidvalidity": "CAST(CASE lang WHEN 'en' THEN 10 WHEN 'de' THEN 20 ELSE 30 END AS BIGINT)",
    "message_id": "CASE WHEN doc_id % 97 = 0 THEN '' ELSE md5(text) END",
    "from_addr": "CASE WHEN doc_id % 101 = 0 THEN 'Mailer-Daemon'"
                 " WHEN doc_id % 5 = 0 THEN 'U0@src0.Example.com'"
                 " ELSE concat('U', CAST(doc_id % 7 AS $TEXT), '@', source, '.Example.com') END",
    "to_addr": "'me@example.com'",
    "subject": "concat(CASE doc_id % 12 WHEN 0 THEN 'Big SALE, now 30% off' WHEN 1 THEN 'Your invoice'"
               " WHEN 2 THEN 'Order shipped' WHEN 3 THEN 'Weekly digest'"
               " WHEN 4 THEN 'Payment statement' WHEN 5 THEN 'Build failed'"
               " WHEN 6 THEN 'wholesale reminder' ELSE 'Hello' END,"
               " ' ', CAST(doc_id AS $TEXT))",
    "date": "$DATE",
    "size": "n_chars",
    "text": "concat(text, CASE WHEN doc_id % 7 = 0 THEN ' To stop, Unsubscribe.' ELSE '' END)",
    "headers_blob": "concat('h', CAST(doc_id AS $TEXT))",
    "fetched_at": "$DATE",
}

RUN_TS = "2026-06-01 00:00:00"
MODEL_ID = "recorded"
PAYLOAD_BUDGET = 60
CUSTOMERS_A_TASK = 20_000


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mail_of(documents: DataFrame) -> DataFrame:
    date = "timestampadd(MINUTE, doc_id, TIMESTAMP_NTZ'2024-01-01 00:00:00')"
    return documents.selectExpr(*[
        f"{e.replace('$TEXT', 'STRING').replace('$DATE', date)} AS {name}"
        for name, e in MAIL.items()
    ])


def mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail_of(table(spark, sf_dir, "documents"))


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All mail, before dedup."""
    return index_messages(mail(spark, sf_dir), TAXONOMY)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message table after a first ingest."""
    return dedup_messages(indexed(spark, sf_dir), folders=FOLDERS)


def cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INBOX half read, Archive of an older generation, Lists never read. Settled, as
    a cursor is stored in real use."""
    return settled(mail(spark, sf_dir).filter("folder != 'Lists'").groupBy("folder").agg(
        F.max(F.when(F.col("folder") == "Archive", 19).otherwise(F.col("uidvalidity")))
        .cast("bigint").alias("uidvalidity"),
        F.floor(F.max("uid") / 2).alias("last_uid"),
        (F.col("folder") == "INBOX").alias("complete"),
        ntz("2025-01-01 00:00:00").alias("updated_at"),
    ))


def senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mail(spark, sf_dir)
    return m.select(
        F.lower("from_addr").alias("from_addr"), domain_of(F.col("from_addr")).alias("from_domain")
    ).distinct()


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address rules for u0, u1 (with subtag) and u2 (unknown leaf), domain rules
    for src1*. Settled, as a rule table is stored in real use."""
    s = senders(spark, sf_dir)
    addr = s.filter("from_addr LIKE 'u0@%' OR from_addr LIKE 'u1@%' OR from_addr LIKE 'u2@%'").select(
        F.lit("addr").alias("scope"), F.col("from_addr").alias("key"),
        F.expr("CASE WHEN from_addr LIKE 'u0@%' THEN 'junk' WHEN from_addr LIKE 'u1@%'"
               " THEN 'receipt' ELSE 'ghost' END").alias("tag"),
        F.expr("CASE WHEN from_addr LIKE 'u1@%' THEN 'bank' END").alias("subtag"),
    )
    domain = s.filter("from_domain LIKE 'src1%'").select(
        F.lit("domain").alias("scope"), F.col("from_domain").alias("key"),
        F.lit("newsletter").alias("tag"), F.lit(None).cast("string").alias("subtag"),
    ).distinct()
    return settled(addr.unionByName(domain).withColumns({
        "confirmed_by": F.lit("reviewer"), "confirmed_at": ntz("2025-01-01 00:00:00"),
    }))


def deferrals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return senders(spark, sf_dir).filter("from_domain != ''").select(
        F.lit("domain").alias("scope"), F.col("from_domain").alias("key"),
        F.concat(F.lit("later "), F.col("from_domain")).alias("note"),
        ntz("2025-01-01 00:00:00").alias("created_at"),
    ).distinct()


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decision per message, so a hot sender is a hot key of the log."""
    return mail(spark, sf_dir).select(
        F.expr("CASE WHEN folder = 'Lists' THEN 'domain' ELSE 'addr' END").alias("scope"),
        F.when(F.col("folder") == "Lists", domain_of(F.col("from_addr")))
        .otherwise(F.lower("from_addr")).alias("key"),
        F.expr("CASE uid % 11 WHEN 0 THEN 'set' WHEN 1 THEN 'set' WHEN 2 THEN 'set'"
               " WHEN 3 THEN 'accept' WHEN 6 THEN 'clear' WHEN 7 THEN 'delete' WHEN 8 THEN 'drop'"
               " ELSE 'defer' END").alias("action"),
        F.expr("CASE uid % 11 WHEN 0 THEN 'keep' WHEN 1 THEN ' receipt/bank ' WHEN 2 THEN 'nonsuch'"
               " END").alias("leaf"),
        F.concat(F.lit("note "), F.col("uid").cast("string")).alias("note"),
        F.lit("reviewer").alias("decided_by"),
        F.col("date").alias("decided_at"),
        F.col("uid").alias("seq"),
    )


def classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier runs over the labelled messages: a model run, a later rule run for
    the toxic ones, and a run under another taxonomy."""
    labelled = mail(spark, sf_dir).select("folder", "uidvalidity", "uid").join(
        table(spark, sf_dir, "labels").withColumn("uid", F.col("doc_id") + 1).drop("doc_id"), "uid"
    )

    def record(tag, subtags, confidence, method, hash_, at, seq):
        return F.struct(
            tag.alias("tag"), subtags.alias("subtags"), confidence.alias("confidence"),
            F.lit(method).alias("method"), F.lit("v1").alias("taxonomy_version"),
            F.lit(hash_).alias("taxonomy_hash"), ntz(at).alias("created_at"),
            F.lit(seq).cast("bigint").alias("run_seq"),
        )

    h = TAXONOMY.content_hash
    first = record(
        F.expr("CASE WHEN quality = 1 THEN 'keep' ELSE 'receipt' END"),
        F.expr("CASE WHEN quality = 1 THEN '' ELSE 'bank' END"),
        F.expr("CAST(0.5 AS DOUBLE) + quality * CAST(0.25 AS DOUBLE)"),
        "llm", h, "2026-01-01 00:00:00", 1,
    )
    second = record(F.lit("junk"), F.lit(""), F.lit(1.0), "sender_rule", h,
                    "2026-01-02 00:00:00", 2)
    other = record(F.lit("keep"), F.lit(""), F.lit(1.0), "keyword_rule", "older",
                   "2026-01-03 00:00:00", 3)
    runs = F.when(F.col("toxic") == 1, F.array(first, second, other)).otherwise(
        F.array(first, other)
    )
    return labelled.select("folder", "uidvalidity", "uid", F.inline(runs)).select(
        "folder", "uidvalidity", "uid", "tag", comma_list(F.col("subtags")).alias("subtags"),
        "confidence", "method", "taxonomy_version", "taxonomy_hash",
        F.when(F.col("method") == "llm", "m0").alias("model_id"),
        F.when(F.col("method") == "llm", "classify_v1").alias("prompt_version"),
        F.when(F.col("method") == "llm", "earlier run").alias("rationale"),
        F.lit(False).alias("truncated"), "created_at", "run_seq",
    )


# Recorded replies by uid % 10: valid, noise around, low confidence, unknown tag,
# subtag, garbage then valid, garbage twice, confidence as text, two objects, null list.
REPLIES_1 = [
    '{"tag":"keep","confidence":0.9,"rationale":"ok"}',
    'Reply follows >> {"tag":"junk","confidence":0.95} << end',
    '{"tag":"newsletter","confidence":0.4,"rationale":"unsure"}',
    '{"tag":"spam","confidence":0.99}',
    '{"tag":"receipt","subtags":["x","receipt/bank"],"confidence":0.8}',
    'no idea',
    'no',
    '{"tag":"keep","confidence":" 0.85 "}',
    '{"tag":"keep"} {"tag":"junk"}',
    '{"tag":"keep","subtags":null,"confidence":1}',
]
REPLIES_2 = [
    '{"tag":"keep","confidence":0.75}',
    '{"tag":"keep","confidence":0.75}',
    '{"tag":"keep","confidence":0.75}',
    '{"tag":"keep","confidence":0.75}',
    '{"tag":"keep","confidence":0.75}',
    '{"tag":"keep","confidence":"0.8"}',
    '}{',
    '{"tag":"notification","confidence":0.7,"more":[1]}',
    '{"tag":"receipt/bank","confidence":true}',
    '{"tag":5}',
]


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    which = F.pmod(F.col("uid"), F.lit(10)).cast("int")
    both = F.array(*[
        F.struct(F.lit(i).alias("attempt"), F.get(F.lit(texts), which).alias("raw"))
        for i, texts in ((1, REPLIES_1), (2, REPLIES_2))
    ])
    return mail(spark, sf_dir).select("folder", "uidvalidity", "uid", F.inline(both))


def answer_by_length():
    """A list completer whose reply follows from the payload: tag, confidence and validity by its length."""
    tags = ["keep", "junk", "receipt", "nonsuch"]

    def answers(system: str, users: list[str], sampling: dict) -> list[str]:
        return [f'{{"tag":"{tags[len(u) % 4]}","confidence":0.{5 + len(u) % 5}}}' if len(u) % 3 else "no" for u in users]

    return answers


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mailbox access log from the event table."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.expr("CASE event_type WHEN 'click' THEN 'EXAMINE INBOX'"
               " WHEN 'error' THEN concat('uid store ', CAST(event_id AS STRING), ' +FLAGS')"
               " WHEN 'view' THEN 'STOREX 1' WHEN 'purchase' THEN ' expunge '"
               " ELSE concat('Copy ', CAST(user_id AS STRING)) END").alias("command"),
    )


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(version, c_mktsegment, c_name), one row per customer. Each row becomes many tags or
    rules, so the tasks follow the number of customers, not the few bytes of their file."""
    customers = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("v1-"), F.col("c_custkey").cast("string")).alias("version"),
        "c_mktsegment", "c_name")
    return spread(customers, CUSTOMERS_A_TASK, "version")


def taxonomy_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One taxonomy version per customer; its segment may add a tag of its own."""
    tags = F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(t.name).alias("name"),
                 F.lit(t.definition).alias("definition"),
                 F.lit(list(t.subtags)).cast("array<string>").alias("subtags"))
        for i, t in enumerate(TAXONOMY.tags)
    ])
    own = F.struct(
        F.lit(len(TAXONOMY.tags)).alias("pos"), F.lower("c_mktsegment").alias("name"),
        F.lit("Mail of the segment.").alias("definition"),
        F.array(F.concat(F.lower("c_mktsegment"), F.lit("/"), F.lower("c_name"))).alias("subtags"),
    )
    return _versions(spark, sf_dir).select("version", F.inline(F.array_append(tags, own)))


def taxonomy_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword rules of the same versions, keywords as written (upper case allowed)."""
    rows = F.array(*[
        F.struct(F.lit(i).alias("rule_pos"), F.lit(r.tag).alias("tag"),
                 F.lit(list(r.fields)).alias("fields"), F.lit(list(r.keywords)).alias("keywords"))
        for i, r in enumerate(TAXONOMY.keyword_rules)
    ])
    own = F.struct(
        F.lit(len(TAXONOMY.keyword_rules)).alias("rule_pos"),
        F.lower("c_mktsegment").alias("tag"),
        F.lit(None).cast("array<string>").alias("fields"),
        F.array("c_mktsegment").alias("keywords"),
    )
    return _versions(spark, sf_dir).select("version", F.inline(F.array_append(rows, own)))


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as landed mail: headers, recipients, text that may be missing."""
    return table(spark, sf_dir, "pages").select(
        F.lit("Pages").alias("folder"), F.lit(1).cast("bigint").alias("uidvalidity"),
        F.col("page_id").alias("uid"),
        F.create_map(
            F.lit("x-url"), F.col("url"),
            F.lit("message-id"), F.concat(F.lit("< <"), F.md5("url"), F.lit("> ")),
        ).alias("headers"),
        F.expr("CASE WHEN url LIKE '%/en/%' THEN 'Web@Example.com' END").alias("from_addr"),
        F.array(F.lit("me@example.com"), F.concat(F.lit("p"), F.col("page_id").cast("string"),
                                                  F.lit("@example.com"))).alias("to"),
        F.expr("CASE WHEN url NOT LIKE '%?%' THEN url END").alias("subject"),
        F.lit(None).cast("timestamp_ntz").alias("date"),
        F.expr("CASE WHEN url NOT LIKE '%#%' THEN CAST(length(html) AS BIGINT) END").alias("size"),
        F.expr("CASE WHEN url LIKE '%/en/%' THEN '' WHEN url LIKE '%/fr/%' THEN url END").alias("text"),
        F.col("html"),
        F.lit(None).cast("timestamp_ntz").alias("fetched_at"),
    )
