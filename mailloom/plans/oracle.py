"""DuckDB SQL that states what each registered query must return."""

from __future__ import annotations

from mailloom.plans import fixtures as fx

TAX = fx.TAXONOMY
HASH = TAX.content_hash


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(texts: list[str]) -> str:
    return "[" + ", ".join(_quote(t) for t in texts) + "]"


def _iso(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S')"


_DATE = "TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS INTEGER))"
_DOMAIN = ("CASE WHEN contains(from_addr, '@') THEN lower(split_part(from_addr, '@', -1))"
           " ELSE '' END")
_SPACES = (r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
           r"\x{202f}\x{205f}\x{3000}]+")
_FOLDER = "CASE folder WHEN 'INBOX' THEN 1 WHEN 'Archive' THEN 2 ELSE 3 END"
_MSG = ("folder, uidvalidity, uid, message_id, from_addr, from_domain, to_addr, subject, "
        f"{_iso('date')} AS date, size, snippet, headers_hash")
_REC = ("folder, uidvalidity, uid, tag, subtags, confidence, method, taxonomy_version,"
        " taxonomy_hash, model_id, prompt_version, rationale, truncated,"
        f" {_iso('created_at')} AS created_at, run_seq")
_FINDING = ("folder, uidvalidity, uid, assigned_tag, suspected_tag,"
            " array_to_string(kws, ',') AS trigger_keywords, false AS resolved")


def _has(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {_quote(w)})" for w in words) + ")"


_JUNK = ["unsubscribe", "% off", "sale", "limited offer", "act now"]
_RECEIPT = ["invoice", "receipt", "statement", "order confirmation", "payment"]
_NOTE = ["shipped", "delivered", "build passed", "build failed", "reminder"]
_NEWS = ["newsletter", "digest", "weekly", "this week"]


def _matched(words: list[str]) -> str:
    return f"list_filter({_list(words)}, lambda k: contains(h, k))"


# Named relations, each with the relations it reads.
_CTE: dict[str, tuple[list[str], str]] = {
    "mail": ([], "SELECT " + ", ".join(
        f"{e.replace('$TEXT', 'VARCHAR').replace('$DATE', _DATE)} AS {n}"
        for n, e in fx.MAIL.items()) + " FROM documents"),
    "norm": (["mail"], f"""
        SELECT folder, uidvalidity, uid, message_id, lower(from_addr) AS from_addr,
               {_DOMAIN} AS from_domain, to_addr, subject, date, size,
               left(trim(regexp_replace(text, '{_SPACES}', ' ', 'g')), 500) AS snippet,
               left(sha256(headers_blob), 16) AS headers_hash
        FROM mail"""),
    "hinted": (["norm"], f"""
        SELECT * EXCLUDE (h1, h2),
               CASE WHEN {_has('h2', _JUNK)} THEN 'junk' WHEN {_has('h1', _RECEIPT)} THEN 'receipt'
                    WHEN {_has('h1', _NOTE)} THEN 'notification'
                    WHEN {_has('h2', _NEWS)} THEN 'newsletter' END AS keyword_hint
        FROM (SELECT *, lower(subject) AS h1, lower(concat(subject, ' ', snippet)) AS h2
              FROM norm)"""),
    "messages": (["hinted"], f"""
        SELECT * FROM hinted QUALIFY message_id = '' OR
          row_number() OVER (PARTITION BY message_id ORDER BY {_FOLDER}, uid) = 1"""),
    "cur": (["mail"], """
        SELECT folder, CASE folder WHEN 'Archive' THEN 19 ELSE 10 END AS uidvalidity,
               CAST(floor(max(uid) / 2) AS BIGINT) AS last_uid, folder = 'INBOX' AS complete,
               TIMESTAMP '2025-01-01 00:00:00' AS updated_at
        FROM mail WHERE folder <> 'Lists' GROUP BY folder"""),
    "fetched": (["mail", "cur"], """
        SELECT m.* FROM mail m LEFT JOIN cur c ON m.folder = c.folder
        WHERE m.uid > CASE WHEN c.uidvalidity = m.uidvalidity THEN c.last_uid ELSE 0 END"""),
    "senders": (["norm"], "SELECT DISTINCT from_addr, from_domain FROM norm"),
    "rules": (["senders"], """
        SELECT 'addr' AS scope, from_addr AS key,
               CASE WHEN from_addr LIKE 'u0@%' THEN 'junk' WHEN from_addr LIKE 'u1@%'
                    THEN 'receipt' ELSE 'ghost' END AS tag,
               CASE WHEN from_addr LIKE 'u1@%' THEN 'bank' END AS subtag
        FROM senders WHERE regexp_matches(from_addr, '^u[012]@')
        UNION ALL
        SELECT DISTINCT 'domain', from_domain, 'newsletter', NULL
        FROM senders WHERE from_domain LIKE 'src1%'"""),
    "leafed": (["rules"], "SELECT *, concat_ws('/', tag, subtag) AS leaf FROM rules"),
    "sound": (["leafed"], "SELECT * FROM leafed WHERE tag <> 'ghost'"),
    "deferrals": (["senders"], """
        SELECT DISTINCT 'domain' AS scope, from_domain AS key,
               concat('later ', from_domain) AS note
        FROM senders WHERE from_domain <> ''"""),
    "log": (["mail"], f"""
        SELECT m.folder, m.uidvalidity, m.uid, r.* EXCLUDE (doc_id), 'v1' AS taxonomy_version,
               CASE WHEN method = 'llm' THEN 'm0' END AS model_id,
               CASE WHEN method = 'llm' THEN 'classify_v1' END AS prompt_version,
               CASE WHEN method = 'llm' THEN 'earlier run' END AS rationale,
               false AS truncated
        FROM mail m JOIN (
          SELECT doc_id, CASE WHEN quality = 1 THEN 'keep' ELSE 'receipt' END AS tag,
                 CASE WHEN quality = 1 THEN '' ELSE 'bank' END AS subtags,
                 CAST(0.5 + quality * 0.25 AS DOUBLE) AS confidence, 'llm' AS method,
                 '{HASH}' AS taxonomy_hash, TIMESTAMP '2026-01-01 00:00:00' AS created_at,
                 CAST(1 AS BIGINT) AS run_seq
          FROM labels
          UNION ALL
          SELECT doc_id, 'junk', '', 1.0, 'sender_rule', '{HASH}',
                 TIMESTAMP '2026-01-02 00:00:00', 2 FROM labels WHERE toxic = 1
          UNION ALL
          SELECT doc_id, 'keep', '', 1.0, 'keyword_rule', 'older',
                 TIMESTAMP '2026-01-03 00:00:00', 3 FROM labels) r ON m.uid = r.doc_id + 1"""),
    "latest": (["log"], f"""
        SELECT * FROM log WHERE taxonomy_hash = '{HASH}' QUALIFY row_number() OVER
          (PARTITION BY folder, uidvalidity, uid ORDER BY created_at DESC, run_seq DESC) = 1"""),
    "resolved": (["messages", "sound"], """
        SELECT m.*, COALESCE(a.tag, d.tag) AS rule_tag,
               CASE WHEN a.tag IS NOT NULL THEN a.subtag ELSE d.subtag END AS rule_subtag
        FROM messages m
        LEFT JOIN sound a ON a.scope = 'addr' AND a.key = m.from_addr
        LEFT JOIN sound d ON d.scope = 'domain' AND d.key = m.from_domain"""),
    "manifest": (["messages", "latest"], """
        SELECT m.folder, m.uid, message_id, from_addr, from_domain, subject, date, tag, subtags,
               confidence, method, taxonomy_version, model_id, prompt_version, rationale,
               truncated, created_at
        FROM messages m JOIN latest l
          ON m.folder = l.folder AND m.uidvalidity = l.uidvalidity AND m.uid = l.uid"""),
    "findings": (["messages", "latest"], f"""
        SELECT folder, uidvalidity, uid, assigned_tag, f.tag AS suspected_tag, f.kws AS kws FROM (
          SELECT *, list_filter([
              {{'tag': 'junk', 'kws': {_matched(_JUNK)}}},
              {{'tag': 'receipt', 'kws': {_matched(_RECEIPT)}}},
              {{'tag': 'notification', 'kws': {_matched(_NOTE)}}},
              {{'tag': 'newsletter', 'kws': {_matched(_NEWS)}}}],
              lambda s: s.tag <> assigned_tag AND len(s.kws) > 0)[1] AS f
          FROM (SELECT m.folder, m.uidvalidity, m.uid, l.tag AS assigned_tag,
                       lower(concat(subject, chr(10), snippet)) AS h
                FROM messages m JOIN latest l ON m.folder = l.folder
                 AND m.uidvalidity = l.uidvalidity AND m.uid = l.uid))
        WHERE f IS NOT NULL"""),
    "profiles": (["messages"], """
        SELECT s.from_addr, s.from_domain, message_count, first_seen, last_seen, keyword_hint, subjects
        FROM (SELECT from_addr, min(from_domain) AS from_domain, count(*) AS message_count,
                     min(date) AS first_seen, max(date) AS last_seen
              FROM messages GROUP BY from_addr) s
        LEFT JOIN (SELECT from_addr, keyword_hint FROM messages WHERE keyword_hint IS NOT NULL
                   GROUP BY from_addr, keyword_hint QUALIFY row_number() OVER
                     (PARTITION BY from_addr ORDER BY count(*) DESC, keyword_hint) = 1) h
          ON s.from_addr = h.from_addr
        LEFT JOIN (SELECT from_addr, list(subject ORDER BY rn) AS subjects FROM (
                     SELECT from_addr, subject, row_number() OVER
                       (PARTITION BY from_addr ORDER BY folder, uid) AS rn FROM messages)
                   WHERE rn <= 3 GROUP BY from_addr) e ON s.from_addr = e.from_addr"""),
    "top": (["profiles"],
            "SELECT * FROM profiles ORDER BY message_count DESC, from_addr LIMIT 100"),
    "queue": (["top", "leafed", "deferrals"], """
        SELECT i.*, CASE WHEN r.leaf IS NOT NULL THEN 'decided' WHEN d.note IS NOT NULL
                    THEN 'deferred' ELSE 'undecided' END AS status,
               r.leaf AS current_leaf, COALESCE(d.note, '') AS note
        FROM (SELECT 'addr' AS scope, from_addr AS key, from_domain AS label, message_count,
                     keyword_hint AS hint, array_to_string(subjects, ' ; ') AS example_subjects
              FROM top
              UNION ALL
              SELECT 'domain', from_domain, from_domain, CAST(sum(message_count) AS BIGINT), NULL, ''
              FROM top WHERE from_domain <> '' GROUP BY from_domain) i
        LEFT JOIN leafed r ON r.scope = i.scope AND r.key = i.key
        LEFT JOIN deferrals d ON d.scope = i.scope AND d.key = i.key"""),
    "counts": (["manifest"],
               "SELECT tag, method, from_addr, count(*) AS n FROM manifest GROUP BY ALL"),
    "ranked": (["counts"], """
        SELECT tag, from_addr, n, row_number() OVER
                 (PARTITION BY tag ORDER BY n DESC, from_addr) AS rank
        FROM (SELECT tag, from_addr, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY ALL)"""),
    "lowest": (["manifest"], """
        SELECT folder, uid, from_addr, subject, tag, confidence FROM manifest
        WHERE method = 'llm' ORDER BY confidence, folder, uid LIMIT 15"""),
    "cover": (["messages", "manifest", "findings"], """
        SELECT d AS distinct_messages, c AS classified, greatest(d - c, 0) AS unclassified,
               CASE WHEN d > 0 THEN c * 100.0 / d ELSE 0 END AS percent, f AS open_findings
        FROM (SELECT count(DISTINCT message_id) AS d FROM messages),
             (SELECT count(*) AS c FROM manifest), (SELECT count(*) AS f FROM findings)"""),
    "decisions": (["norm"], """
        SELECT CASE WHEN folder = 'Lists' THEN 'domain' ELSE 'addr' END AS scope,
               CASE WHEN folder = 'Lists' THEN from_domain ELSE from_addr END AS key,
               CASE uid % 11 WHEN 0 THEN 'set' WHEN 1 THEN 'set' WHEN 2 THEN 'set'
                    WHEN 3 THEN 'accept' WHEN 6 THEN 'clear' WHEN 7 THEN 'delete'
                    WHEN 8 THEN 'drop' ELSE 'defer' END AS action,
               CASE uid % 11 WHEN 0 THEN 'keep' WHEN 1 THEN ' receipt/bank '
                    WHEN 2 THEN 'nonsuch' END AS given,
               concat('note ', CAST(uid AS VARCHAR)) AS note, date AS made, uid AS seq
        FROM norm"""),
    "judged": (["decisions", "profiles"], f"""
        SELECT *, CASE WHEN action = 'drop' THEN 'unknown action'
                       WHEN action = 'accept' AND leaf IS NULL THEN 'no hint'
                       WHEN action IN ('set', 'accept')
                        AND NOT list_contains({_list(TAX.leaves)}, trim(leaf)) THEN 'not a leaf'
                  END AS rejected
        FROM (SELECT d.*, CASE action WHEN 'set' THEN given WHEN 'accept' THEN p.keyword_hint END
                     AS leaf
              FROM decisions d LEFT JOIN profiles p
                ON d.scope = 'addr' AND p.from_addr = d.key)"""),
    "reply1": (["mail"], f"""
        SELECT folder, uidvalidity, uid, attempt,
               CASE attempt WHEN 1 THEN {_list(fx.REPLIES_1)}[CAST(uid % 10 + 1 AS INTEGER)]
                            ELSE {_list(fx.REPLIES_2)}[CAST(uid % 10 + 1 AS INTEGER)] END AS raw
        FROM mail, (SELECT unnest([1, 2]) AS attempt)"""),
    "jsoned": (["reply1"], """
        SELECT *, CASE WHEN json_valid(json) THEN json END AS js FROM (
          SELECT *, nullif(regexp_extract(raw, '(?s)(\\{.*\\})', 1), '') AS json FROM reply1)"""
               .replace("\\\\", "\\")),
    "parsed": (["jsoned"], """
        SELECT folder, uidvalidity, uid, attempt,
               CASE WHEN ok THEN json_extract_string(js, '$.tag') END AS tag,
               CASE WHEN ok THEN COALESCE(CAST(json_extract(js, '$.subtags') AS VARCHAR[]), []) END
                 AS subtags,
               CASE WHEN ok THEN conf END AS confidence,
               CASE WHEN ok THEN COALESCE(json_extract_string(js, '$.rationale'), '') END
                 AS rationale, ok
        FROM (SELECT *, js IS NOT NULL AND COALESCE(json_type(js, '$.tag') = 'VARCHAR', false)
                     AND conf IS NOT NULL
                     AND COALESCE(json_type(js, '$.subtags'), 'ARRAY') = 'ARRAY'
                     AND COALESCE(json_type(js, '$.rationale'), 'VARCHAR') = 'VARCHAR' AS ok
              FROM (SELECT *, CASE COALESCE(json_type(js, '$.confidence'), 'NONE')
                      WHEN 'NONE' THEN 0.0
                      WHEN 'VARCHAR' THEN
                        try_cast(trim(json_extract_string(js, '$.confidence')) AS DOUBLE)
                      WHEN 'BOOLEAN' THEN
                        CASE json_extract_string(js, '$.confidence') WHEN 'true' THEN 1.0 ELSE 0.0 END
                      WHEN 'NULL' THEN NULL
                      ELSE try_cast(json_extract_string(js, '$.confidence') AS DOUBLE) END AS conf
                    FROM jsoned))"""),
    "outcome": (["parsed"], f"""
        SELECT folder, uidvalidity, uid, attempt,
               CASE WHEN known THEN tag ELSE 'unclassified' END AS tag,
               CASE WHEN known THEN split_part(list_filter(subtags, lambda s: contains(s, '/')
                      AND list_contains({_list(TAX.leaves)}, s))[1], '/', 2) END AS subtag,
               CASE WHEN known THEN confidence ELSE 0.0 END AS confidence,
               CASE WHEN known THEN rationale ELSE '' END AS rationale, ok
        FROM (SELECT *, COALESCE(list_contains({_list(TAX.leaves)}, tag), false) AS known
              FROM parsed)"""),
    "chosen": (["outcome"], """
        SELECT a.folder, a.uidvalidity, a.uid,
               CASE WHEN a.ok THEN a.tag ELSE b.tag END AS tag,
               CASE WHEN a.ok THEN a.subtag ELSE b.subtag END AS subtag,
               CASE WHEN a.ok THEN a.confidence ELSE b.confidence END AS confidence,
               CASE WHEN a.ok THEN a.rationale ELSE b.rationale END AS rationale
        FROM outcome a JOIN outcome b ON a.uid = b.uid AND a.attempt = 1 AND b.attempt = 2"""),
    "residue": (["resolved", "log"], f"""
        SELECT r.* FROM resolved r WHERE rule_tag IS NULL AND NOT EXISTS (
          SELECT 1 FROM log l WHERE l.taxonomy_hash = '{HASH}' AND l.folder = r.folder
             AND l.uidvalidity = r.uidvalidity AND l.uid = r.uid)"""),
    "modelled": (["residue", "chosen"], """
        SELECT c.folder, c.uidvalidity, c.uid,
               CASE WHEN low THEN 'unclassified' ELSE tag END AS tag,
               CASE WHEN NOT low THEN subtag END AS subtag, confidence, rationale
        FROM (SELECT *, tag <> 'unclassified' AND confidence < 0.7 AS low FROM chosen) c
        JOIN residue r ON r.uid = c.uid"""),
    "covered": (["resolved", "latest"], """
        SELECT r.folder, r.uidvalidity, r.uid, COALESCE(rule_tag, keyword_hint) AS tag,
               CASE WHEN rule_tag IS NOT NULL THEN COALESCE(rule_subtag, '') ELSE '' END AS subtags,
               CASE WHEN rule_tag IS NOT NULL THEN 'sender_rule' ELSE 'keyword_rule' END AS method,
               l.tag AS latest_tag
        FROM resolved r LEFT JOIN latest l ON r.folder = l.folder
         AND r.uidvalidity = l.uidvalidity AND r.uid = l.uid
        WHERE COALESCE(rule_tag, keyword_hint) IS NOT NULL"""),
    "vtags": ([], """
        SELECT concat('v1-', CAST(c_custkey AS VARCHAR)) AS version, t.pos, t.name, t.definition,
               t.subtags
        FROM customer, LATERAL (SELECT unnest(list_append(""" + "[" + ", ".join(
                   f"{{'pos': {i}, 'name': {_quote(t.name)}, 'definition': {_quote(t.definition)},"
                   f" 'subtags': CAST({_list(list(t.subtags))} AS VARCHAR[])}}"
                   for i, t in enumerate(TAX.tags)) + """],
               {'pos': 6, 'name': lower(c_mktsegment), 'definition': 'Mail of the segment.',
                'subtags': [concat(lower(c_mktsegment), '/', lower(c_name))]})) AS t)"""),
    "vrules": ([], """
        SELECT concat('v1-', CAST(c_custkey AS VARCHAR)) AS version, r.rule_pos, r.tag,
               COALESCE(r.fields, 'subject') AS fields, r.keywords
        FROM customer, LATERAL (SELECT unnest(list_append(""" + "[" + ", ".join(
                   f"{{'rule_pos': {i}, 'tag': {_quote(r.tag)},"
                   f" 'fields': {_quote(','.join(r.fields))}, 'keywords': {_list(list(r.keywords))}}}"
                   for i, r in enumerate(TAX.keyword_rules)) + """],
               {'rule_pos': 4, 'tag': lower(c_mktsegment), 'fields': CAST(NULL AS VARCHAR),
                'keywords': [c_mktsegment]})) AS r)"""),
    "vprompt": (["vtags"], """
        SELECT version, concat('Taxonomy ', version, ':', chr(10), string_agg(concat('- ', name,
                 ': ', definition, CASE WHEN len(subtags) > 0 THEN concat(' (subtags: ',
                 array_to_string(subtags, ', '), ')') ELSE '' END), chr(10) ORDER BY pos)) AS prompt
        FROM vtags GROUP BY version"""),
}


# Mail that came in three runs, by uid modulo 3.
_CTE["messages3"] = (["hinted"], f"""
    SELECT *, uid % 3 + 1 AS batch_id FROM hinted QUALIFY message_id = '' OR
      row_number() OVER (PARTITION BY message_id ORDER BY uid % 3, {_FOLDER}, uid) = 1""")
_CTE["profiles3"] = (["messages3"], _CTE["profiles"][1].replace("FROM messages", "FROM messages3"))


def _sql(main: str, *reads: str) -> str:
    """A statement with the relations it needs, in order of definition."""
    needed: set[str] = set()

    def visit(name: str) -> None:
        if name not in needed:
            needed.add(name)
            for other in _CTE[name][0]:
                visit(other)

    for name in reads:
        visit(name)
    with_ = ", ".join(f"{n} AS ({sql})" for n, (_, sql) in _CTE.items() if n in needed)
    return f"WITH {with_} {main}" if with_ else main


_NEW_STORE = f"""
  , batch AS (SELECT h.* FROM hinted h JOIN fetched f ON h.uid = f.uid),
  kept AS (SELECT * FROM messages WHERE folder <> 'Archive'),
  gone AS (SELECT message_id FROM messages WHERE folder = 'Archive' AND message_id <> ''),
  fresh AS (
    SELECT * FROM batch b
    WHERE NOT (folder = 'INBOX' AND message_id IN (SELECT message_id FROM gone))
    QUALIFY message_id = '' OR
      row_number() OVER (PARTITION BY message_id ORDER BY {_FOLDER}, uid) = 1),
  added AS (SELECT * FROM fresh WHERE message_id = ''
            OR message_id NOT IN (SELECT message_id FROM kept))
  SELECT folder, uidvalidity, uid, message_id, subject FROM kept
  UNION
  SELECT folder, uidvalidity, uid, message_id, subject FROM added"""

_PROFILE_COLUMNS = (
    f"from_addr, from_domain, message_count, {_iso('first_seen')} AS first_seen,"
    f" {_iso('last_seen')} AS last_seen, keyword_hint,"
    " array_to_string(subjects, ' ; ') AS example_subjects"
)

_RULE_LINES = """SELECT 1 AS section, concat(scope, chr(9), key) AS k1, 0 AS k2, {line} AS line
  FROM leafed"""


def _heads(section: int, lines: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {section} AS section, '{i:04d}' AS k1, 0 AS k2, {_quote(line)} AS line"
        for i, line in enumerate(lines)
    )


_HEAD = "concat('From: ', from_addr, chr(10), 'Subject: ', subject, chr(10), 'Date: ', " \
        f"{_iso('date')}, chr(10), 'Snippet: ')"


def _payload(budget: int, source: str = "messages") -> str:
    """Payload by trying every number of 32-character cuts and taking the least that fits."""
    return f"""
      SELECT folder, uidvalidity, uid,
             concat(head, left(snippet, kept), CASE WHEN keyword_hint IS NULL THEN '' ELSE
               concat(chr(10), 'Keyword hint (advisory, may be wrong): ', keyword_hint) END) AS payload,
             kept < length(snippet) AS truncated
      FROM (SELECT *, list_filter(list_transform(range(0, 17),
                      lambda i: greatest(length(snippet) - 32 * i, 0)),
                      lambda n: ceil(n / 4.0) <= greatest({budget} - ceil(length(head) / 4.0), 0))[1]
                      AS kept
            FROM (SELECT *, {_HEAD} AS head FROM {source}))"""


def _pct(part: str, whole: str) -> str:
    return f"printf('%.1f', CASE WHEN {whole} > 0 THEN {part} * 100.0 / {whole} ELSE 0.0 END)"


_SUMMARY = " UNION ALL ".join([
    _heads(0, ["# Inbox summary", "", f"_Taxonomy {TAX.version} ({HASH})_", "", "## Coverage"]),
    "SELECT 1, '', 0, concat('- Distinct messages: ', distinct_messages) FROM cover",
    "SELECT 1, '', 1, concat('- Classified: ', classified, ' (',"
    f" {_pct('classified', 'distinct_messages')}, '%)') FROM cover",
    "SELECT 1, '', 2, concat('- Unclassified: ', unclassified) FROM cover",
    "SELECT 1, '', 3, concat('- Open audit findings: ', open_findings) FROM cover",
    _heads(2, ["", "## Tag distribution"]),
    "SELECT 3, '', -n, concat('- ', tag, ': ', n) FROM"
    " (SELECT tag, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY tag)",
    _heads(4, ["", "## Method breakdown (rule leverage)"]),
    f"SELECT 5, '', -n, concat('- ', method, ': ', n, ' (', {_pct('n', 't')}, '%)') FROM"
    " (SELECT method, CAST(sum(n) AS BIGINT) AS n, CAST(sum(sum(n)) OVER () AS BIGINT) AS t"
    "  FROM counts GROUP BY method)",
    _heads(6, ["", "## Top senders per tag"]),
    "SELECT DISTINCT 7, tag, 0, concat('### ', tag) FROM counts",
    "SELECT 7, tag, rank, concat('- ', from_addr, ': ', n) FROM ranked WHERE rank <= 10",
    _heads(8, ["", "## Needs review (lowest-confidence LLM calls)"]),
    "SELECT 9, '', row_number() OVER (ORDER BY confidence, folder, uid),"
    " concat('- [', printf('%.2f', confidence), '] ', tag, ' — ', from_addr, ': ',"
    " left(subject, 60)) FROM lowest",
    "SELECT 10, '', 0, concat('- …plus ', unclassified, ' unclassified message(s) to triage')"
    " FROM cover WHERE unclassified > 0",
])

_QUEUE_RANK = "CASE status WHEN 'decided' THEN 2 WHEN 'deferred' THEN 1 ELSE 0 END"
_RESOLVED_METHOD = ("CASE WHEN rule_tag IS NOT NULL THEN 'sender_rule'"
                    " WHEN {hint} IS NOT NULL THEN 'keyword_rule' END")
_MODEL_TRUNC = f"(SELECT * FROM ({_payload(fx.PAYLOAD_BUDGET)}))"
_MANIFEST = ("SELECT * EXCLUDE (date, created_at), " + _iso("date") + " AS date, "
             + _iso("created_at") + " AS created_at FROM manifest")

_TAGS = ["keep", "junk", "receipt", "nonsuch"]
_ANSWER = ("CASE WHEN n % 3 = 0 THEN 'no' ELSE concat('{\"tag\":\"', " + _list(_TAGS) + "[n % 4 + 1],"
           " '\",\"confidence\":0.', 5 + n % 5, '}') END")

ORACLE: dict[str, str] = {
    "scan_raw": _sql(
        f"SELECT folder, uid, from_addr, subject, {_iso('date')} AS date, size FROM mail", "mail"),
    "clean_raw": """
        SELECT 'Pages' AS folder, CAST(1 AS BIGINT) AS uidvalidity, page_id AS uid,
               md5(url) AS message_id,
               CASE WHEN url LIKE '%/en/%' THEN 'Web@Example.com' ELSE '' END AS from_addr,
               concat('me@example.com, p', CAST(page_id AS VARCHAR), '@example.com') AS to_addr,
               CASE WHEN url NOT LIKE '%?%' THEN url ELSE '' END AS subject,
               CAST(NULL AS VARCHAR) AS date,
               CASE WHEN url NOT LIKE '%#%' THEN CAST(length(html) AS BIGINT) ELSE 0 END AS size,
               CASE WHEN url NOT LIKE '%/en/%' AND url LIKE '%/fr/%' THEN url ELSE html END AS text,
               concat('[{"key":"message-id","value":"< <', md5(url), '> "},{"key":"x-url","value":"',
                      url, '"}]') AS headers_blob,
               CAST(NULL AS VARCHAR) AS fetched_at
        FROM pages""",
    "normalize_messages": _sql(f"SELECT {_MSG} FROM norm", "norm"),
    "keyword_hint": _sql("SELECT folder, uid, keyword_hint FROM hinted", "hinted"),
    "scan_messages": _sql(f"SELECT {_MSG} FROM messages", "messages"),
    "incremental_scan": _sql("SELECT folder, uidvalidity, uid, subject FROM fetched", "fetched"),
    "dedup_messages": _sql(
        "SELECT folder, uidvalidity, uid, message_id, subject FROM messages", "messages"),
    "first_seen_dedup": _sql(
        "SELECT folder, count(*) AS kept, CAST(sum(uid) AS BIGINT) AS uid_sum FROM messages"
        " GROUP BY folder", "messages"),
    "new_ids": _sql(
        "SELECT DISTINCT message_id FROM mail WHERE message_id <> '' AND message_id NOT IN"
        " (SELECT message_id FROM mail WHERE folder = 'INBOX')", "mail"),
    "upsert_messages": _sql(f"""
        SELECT h.folder, h.uidvalidity, h.uid, h.message_id,
               CASE WHEN m.uid IS NULL THEN 'new@new.org' ELSE m.from_addr END AS from_addr,
               h.from_domain, h.to_addr, concat('Re: ', h.subject) AS subject,
               {_iso('h.date')} AS date, CASE WHEN m.uid IS NULL THEN -1 ELSE m.size END AS size,
               h.snippet, h.headers_hash, h.keyword_hint
        FROM hinted h LEFT JOIN messages m ON h.uid = m.uid""", "hinted", "messages"),
    "drop_folder": _sql(
        "SELECT folder, uidvalidity, uid, message_id FROM messages WHERE folder <> 'Archive'",
        "messages"),
    "advance_cursor": _sql(f"""
        SELECT m.folder, m.uidvalidity,
               greatest(COALESCE(f.top, 0), CASE WHEN c.uidvalidity = m.uidvalidity THEN c.last_uid
                        ELSE 0 END) AS last_uid,
               true AS complete, '{fx.RUN_TS.replace(' ', 'T')}' AS updated_at
        FROM (SELECT DISTINCT folder, uidvalidity FROM mail) m
        LEFT JOIN (SELECT folder, max(uid) AS top FROM fetched GROUP BY folder) f
          ON m.folder = f.folder
        LEFT JOIN cur c ON m.folder = c.folder""", "mail", "fetched", "cur"),
    "rollover": _sql("", "messages", "fetched").rstrip() + _NEW_STORE,
    "sync_metrics": _sql(f"""
        SELECT folder, fetched, inserted, fetched - inserted AS deduped,
               folder = 'Archive' AS resynced
        FROM (SELECT folder, count(*) AS fetched,
                     count(*) FILTER (message_id = '' OR rn = 1) AS inserted
              FROM (SELECT *, row_number() OVER
                      (PARTITION BY message_id ORDER BY {_FOLDER}, uid) AS rn FROM fetched)
              GROUP BY folder)""", "fetched"),
    "message_count": _sql("SELECT count(*) AS messages FROM messages", "messages"),
    "distinct_message_count": _sql(
        "SELECT count(DISTINCT message_id) AS distinct_messages FROM messages", "messages"),
    "flag_commands": """
        SELECT event_id, command FROM (
          SELECT event_id, CASE event_type WHEN 'click' THEN 'EXAMINE INBOX'
                 WHEN 'error' THEN concat('uid store ', event_id, ' +FLAGS')
                 WHEN 'view' THEN 'STOREX 1' WHEN 'purchase' THEN ' expunge '
                 ELSE concat('Copy ', user_id) END AS command FROM events)
        WHERE list_bool_or(list_transform(['STORE', 'UID STORE', 'EXPUNGE', 'COPY', 'UID COPY',
                'MOVE', 'UID MOVE', 'APPEND', 'CREATE', 'DELETE', 'RENAME', 'SETACL', 'SUBSCRIBE'],
                lambda b: upper(trim(command)) = b OR starts_with(upper(trim(command)), b || ' ')))""",
    "stream_ingest": _sql(f"SELECT {_MSG}, keyword_hint FROM messages", "messages"),
    "stream_dedup": _sql(
        "SELECT message_id, count(*) AS n, min(uid) AS first_uid FROM messages GROUP BY message_id",
        "messages"),
    "stream_metrics": _sql("""
        SELECT m.folder, fetched, inserted, fetched - inserted AS deduped, false AS resynced
        FROM (SELECT folder, count(*) AS fetched FROM mail GROUP BY folder) m
        JOIN (SELECT folder, count(*) AS inserted FROM messages GROUP BY folder) k
          ON m.folder = k.folder""", "mail", "messages"),
    "taxonomy_frames": _sql("""
        SELECT version, rule_pos, tag, fields, k.i - 1 AS kw_pos, lower(keywords[k.i]) AS keyword
        FROM vrules, LATERAL (SELECT unnest(range(1, len(keywords) + 1)) AS i) k""", "vrules"),
    "valid_leaves": _sql("""
        SELECT version, name AS leaf FROM vtags UNION
        SELECT version, unnest(subtags) FROM vtags""", "vtags"),
    "taxonomy_prompt": _sql("SELECT version, prompt FROM vprompt", "vprompt"),
    "taxonomy_hash": _sql("""
        SELECT version, left(sha256(concat_ws(chr(29), version, t, r)), 16) AS taxonomy_hash
        FROM (SELECT version, string_agg(concat(name, chr(31), definition, chr(31),
                     COALESCE(array_to_string(subtags, chr(30)), '')), chr(29) ORDER BY pos) AS t
              FROM vtags GROUP BY version)
        LEFT JOIN (SELECT version, string_agg(concat(tag, chr(31), replace(fields, ',', chr(30)), chr(31),
                     lower(array_to_string(keywords, chr(30)))), chr(29) ORDER BY rule_pos) AS r
              FROM vrules GROUP BY version) USING (version)""", "vtags", "vrules"),
    "taxonomy_budget": _sql(
        "SELECT version, CAST(ceil(length(prompt) / 4.0) AS BIGINT) AS tokens,"
        " ceil(length(prompt) / 4.0) > 150 AS over_budget FROM vprompt", "vprompt"),
    "sender_profiles": _sql(f"SELECT {_PROFILE_COLUMNS} FROM profiles", "profiles"),
    "dominant_hint": _sql("SELECT from_addr, keyword_hint FROM profiles", "profiles"),
    "example_subjects": _sql(
        "SELECT from_addr, array_to_string(subjects, ' ; ') AS example_subjects FROM profiles",
        "profiles"),
    "sender_span": _sql(
        f"SELECT from_addr, {_iso('min(date)')} AS first_seen, {_iso('max(date)')} AS last_seen"
        " FROM messages GROUP BY from_addr", "messages"),
    "top_senders": _sql(f"SELECT {_PROFILE_COLUMNS} FROM top", "top"),
    "senders_matching": _sql(
        f"SELECT {_PROFILE_COLUMNS} FROM profiles WHERE contains(from_addr, 'u3@src1')"
        " OR contains(from_domain, 'u3@src1')", "profiles"),
    "domain_rollup": _sql("""
        SELECT from_domain, CAST(sum(message_count) AS BIGINT) AS message_count
        FROM (SELECT * FROM profiles ORDER BY message_count DESC, from_addr LIMIT 50)
        WHERE from_domain <> '' GROUP BY from_domain""", "profiles"),
    "sender_report_lines": _sql(_heads(0, [
        "# Top 20 senders", "", f"_Taxonomy version: {TAX.version}_", "",
        "| # | Sender | Domain | Count | Hint | Example subjects |",
        "|---|--------|--------|-------|------|------------------|"]) + """
        UNION ALL SELECT 1, '', rn, concat('| ', rn, ' | ', from_addr, ' | ', from_domain, ' | ',
          message_count, ' | ', COALESCE(keyword_hint, '—'), ' | ',
          replace(array_to_string(subjects, ' · '), '|', chr(92) || '|'), ' |')
        FROM (SELECT *, row_number() OVER (ORDER BY message_count DESC, from_addr) AS rn
              FROM profiles) WHERE rn <= 20""", "profiles"),
    "review_queue": _sql("SELECT * FROM queue", "queue"),
    "review_queue_matching": _sql("SELECT * FROM queue", "queue").replace(
        "SELECT * FROM profiles ORDER BY message_count DESC, from_addr LIMIT 100",
        "SELECT * FROM profiles WHERE contains(from_addr, 'src2') OR contains(from_domain, 'src2')"),
    "queue_search": _sql(
        "SELECT * FROM queue WHERE contains(lower(label), 'src7') OR contains(lower(key), 'src7')",
        "queue"),
    "queue_sort": _sql(f"""
        SELECT row_number() OVER (ORDER BY {_QUEUE_RANK}, message_count DESC, scope DESC, key) AS pos,
               scope, key, status, message_count FROM queue""", "queue"),
    "queue_sort_by": _sql("""
        SELECT row_number() OVER (ORDER BY COALESCE(nullif(current_leaf, ''), note) DESC, scope, key)
               AS pos, scope, key FROM queue""", "queue"),
    "apply_decisions": _sql(f"""
        SELECT 'rule' AS kind, scope, key, trim(leaf) AS leaf, CAST(NULL AS VARCHAR) AS note,
               {_iso('made')} AS "at"
        FROM (SELECT * FROM judged WHERE rejected IS NULL AND action IN ('set', 'accept', 'delete')
              QUALIFY row_number() OVER (PARTITION BY scope, key ORDER BY made DESC, seq DESC) = 1)
        WHERE action <> 'delete'
        UNION ALL
        SELECT 'deferral', d.scope, d.key, NULL, arg_max(d.note, d.seq), {_iso('min(d.made)')}
        FROM judged d LEFT JOIN (
          SELECT scope, key, max(seq) AS cleared FROM judged
          WHERE rejected IS NULL AND action IN ('set', 'accept', 'clear') GROUP BY ALL) c
          ON d.scope = c.scope AND d.key = c.key
        WHERE d.action = 'defer' AND d.seq > COALESCE(c.cleared, -1) GROUP BY d.scope, d.key
        UNION ALL
        SELECT 'rejected', scope, key, leaf, rejected, {_iso('made')} FROM judged
        WHERE rejected IS NOT NULL""", "judged"),
    "parse_leaf": _sql("""
        SELECT seq, given AS leaf,
               CASE trim(given) WHEN 'keep' THEN 'keep' WHEN 'receipt/bank' THEN 'receipt' END AS tag,
               CASE trim(given) WHEN 'receipt/bank' THEN 'bank' END AS subtag,
               given <> 'nonsuch' AS valid
        FROM decisions WHERE given IS NOT NULL""", "decisions"),
    "rule_leaf": _sql("SELECT scope, key, leaf FROM leafed", "leafed"),
    "invalid_rules": _sql("SELECT scope, key, leaf FROM leafed WHERE tag = 'ghost'", "leafed"),
    "mark_stale_rules": _sql("SELECT scope, key, tag = 'ghost' AS stale FROM leafed", "leafed"),
    "stale_rules": _sql(
        "SELECT r.version, r.tag AS leaf FROM vrules r WHERE NOT EXISTS (SELECT 1 FROM vtags t"
        " WHERE t.version = r.version AND t.name = r.tag AND t.name <> 'junk')", "vrules", "vtags"),
    "resolve_rules": _sql(f"""
        SELECT folder, uidvalidity, uid, COALESCE(rule_tag, keyword_hint) AS tag,
               rule_subtag AS subtag, {_RESOLVED_METHOD.format(hint='keyword_hint')} AS method,
               CASE WHEN COALESCE(rule_tag, keyword_hint) IS NOT NULL THEN 1.0 END AS confidence
        FROM resolved""", "resolved"),
    "resolve_rules_advisory": _sql(f"""
        SELECT folder, uidvalidity, uid, rule_tag AS tag,
               {_RESOLVED_METHOD.format(hint='NULL')} AS method,
               CASE WHEN rule_tag IS NOT NULL THEN 1.0 END AS confidence FROM resolved""",
        "resolved"),
    "first_rule": _sql(f"""
        SELECT folder, uidvalidity, uid, f.tag AS suspected_tag, array_to_string(f.kws, ',') AS trigger_keywords
        FROM (SELECT *, list_filter([
                {{'tag': 'junk', 'kws': {_matched(_JUNK)}}}, {{'tag': 'receipt', 'kws': {_matched(_RECEIPT)}}},
                {{'tag': 'notification', 'kws': {_matched(_NOTE)}}}, {{'tag': 'newsletter', 'kws': {_matched(_NEWS)}}}],
                lambda s: len(s.kws) > 0)[1] AS f
              FROM (SELECT *, lower(concat(subject, chr(10), snippet)) AS h FROM hinted))
        WHERE f IS NOT NULL""", "hinted"),
    "coverage": _sql("""
        SELECT total, covered, round(covered / total, 6) AS fraction,
               covered / total < 0.6 AS below_target
        FROM (SELECT count(*) AS total,
                     count(COALESCE(rule_tag, keyword_hint)) AS covered FROM resolved)""",
        "resolved"),
    "rules_tsv": _sql(_heads(0, ["scope\tkey\tleaf"]) + " UNION ALL " + _RULE_LINES.format(
        line="concat(scope, chr(9), key, chr(9), leaf)"), "leafed"),
    "rules_sieve": _sql(_heads(0, ['require ["fileinto"];', ""]) + " UNION ALL " +
                        _RULE_LINES.format(line="""CASE scope WHEN 'domain' THEN
        concat('if address :domain :is "from" "', key, '" { fileinto "', leaf, '"; }')
        ELSE concat('if address :is "from" "', key, '" { fileinto "', leaf, '"; }') END"""),
                        "leafed"),
    "append_classification": _sql(
        f"SELECT {_REC} FROM log WHERE taxonomy_hash = '{HASH}'", "log"),
    "latest_classification": _sql(f"SELECT {_REC} FROM latest", "latest"),
    "latest_tag": _sql("""
        SELECT m.folder, m.uidvalidity, m.uid, l.tag AS latest_tag
        FROM messages m LEFT JOIN latest l ON m.folder = l.folder AND m.uid = l.uid
         AND m.uidvalidity = l.uidvalidity""", "messages", "latest"),
    "classified_count": _sql(
        "SELECT count(DISTINCT concat(folder, ':', uid)) AS classified FROM log", "log"),
    "classify_rules": _sql(f"""
        SELECT folder, uidvalidity, uid, tag, subtags, 1.0 AS confidence, method,
               'v1' AS taxonomy_version, '{HASH}' AS taxonomy_hash, CAST(NULL AS VARCHAR) AS model_id,
               CAST(NULL AS VARCHAR) AS prompt_version, CAST(NULL AS VARCHAR) AS rationale,
               false AS truncated, '{fx.RUN_TS.replace(' ', 'T')}' AS created_at, 9 AS run_seq
        FROM covered WHERE tag IS DISTINCT FROM latest_tag""", "covered"),
    "classify_metrics": _sql("""
        SELECT scanned, written, covered - written AS unchanged, scanned - covered AS uncovered
        FROM (SELECT count(*) AS scanned FROM messages),
             (SELECT count(*) AS covered,
                     count(*) FILTER (tag IS DISTINCT FROM latest_tag) AS written FROM covered)""",
        "messages", "covered"),
    "manifest": _sql(_MANIFEST, "manifest"),
    "manifest_parquet": _sql(_MANIFEST, "manifest"),
    "manifest_csv": _sql(_MANIFEST, "manifest"),
    "audit": _sql(f"SELECT {_FINDING} FROM findings", "findings"),
    "open_findings": _sql("SELECT count(*) AS open_findings FROM findings", "findings"),
    "replace_findings": _sql(f"SELECT {_FINDING} FROM findings", "findings"),
    "audit_report_lines": _sql(_heads(0, ["# Audit findings", ""]) + """
        UNION ALL SELECT 1, '', 0, concat('_', count(*),
          ' contradiction(s) between assigned tag and keyword signals_') FROM findings
        UNION ALL """ + _heads(2, [
        "", "| Folder:UID | Assigned | Suspected | Trigger keywords |",
        "|------------|----------|-----------|------------------|"]) + """
        UNION ALL SELECT 3, folder, uid, concat('| ', folder, ':', uid, ' | ', assigned_tag, ' | ',
          suspected_tag, ' | ', array_to_string(kws, ', '), ' |') FROM findings""", "findings"),
    "tag_distribution": _sql(
        "SELECT tag, count(*) AS n FROM manifest GROUP BY tag", "manifest"),
    "method_breakdown": _sql(
        "SELECT method, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share"
        " FROM manifest GROUP BY method", "manifest"),
    "top_senders_per_tag": _sql("SELECT * FROM ranked WHERE rank <= 10", "ranked"),
    "lowest_confidence": _sql("SELECT * FROM lowest", "lowest"),
    "summary_coverage": _sql("SELECT * REPLACE (round(percent, 6) AS percent) FROM cover", "cover"),
    "status_coverage": _sql("""
        SELECT messages, distinct_messages, classified,
               round(classified * 100.0 / distinct_messages, 6) AS percent
        FROM (SELECT count(*) AS messages, count(DISTINCT message_id) AS distinct_messages
              FROM messages),
             (SELECT count(DISTINCT concat(folder, ':', uid)) AS classified FROM log)""",
        "messages", "log"),
    "folder_status": _sql("""
        SELECT m.folder, CASE WHEN c.folder IS NULL THEN 'not synced' WHEN c.complete THEN 'complete'
                         ELSE 'incomplete' END AS state, c.uidvalidity, c.last_uid
        FROM (SELECT DISTINCT folder FROM mail) m LEFT JOIN cur c ON m.folder = c.folder""",
        "mail", "cur"),
    "summary_lines": _sql(_SUMMARY, "cover", "counts", "ranked", "lowest"),
    "token_estimate": "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents",
    "build_payload": _sql(_payload(fx.PAYLOAD_BUDGET), "messages"),
    "prompt_budget": _sql(f"""
        SELECT folder, uidvalidity, uid, tokens, tokens > 400 AS over_budget
        FROM (SELECT folder, uidvalidity, uid, CAST(ceil({len(TAX.system_prompt())} / 4.0)
                     + ceil(length(payload) / 4.0) AS BIGINT) AS tokens
              FROM ({_payload(300)}))""", "messages"),
    "reply_json": _sql(
        "SELECT folder, uidvalidity, uid, attempt, json FROM jsoned", "jsoned"),
    "parse_reply": _sql(
        "SELECT folder, uidvalidity, uid, attempt, ok AS valid, tag,"
        " array_to_string(subtags, ',') AS subtags, confidence, rationale FROM parsed", "parsed"),
    "reply_outcome": _sql("SELECT * EXCLUDE (ok) FROM outcome", "outcome"),
    "abstain": _sql("""
        SELECT folder, uidvalidity, uid, attempt, CASE WHEN low THEN 'unclassified' ELSE tag END AS tag,
               CASE WHEN NOT low THEN subtag END AS subtag, confidence, rationale
        FROM (SELECT *, tag <> 'unclassified' AND confidence < 0.7 AS low FROM outcome)""",
        "outcome"),
    "complete": _sql(f"""
        SELECT p.folder, p.uidvalidity, p.uid, truncated, raw
        FROM ({_payload(300)}) p JOIN reply1 r ON p.uid = r.uid AND r.attempt = 1""",
        "messages", "reply1"),
    "llm_residue": _sql("SELECT folder, uidvalidity, uid, keyword_hint FROM residue", "residue"),
    "llm_limit": _sql(
        "SELECT folder, uidvalidity, uid FROM residue ORDER BY folder, uid LIMIT 40", "residue"),
    "classify_llm": _sql(f"""
        SELECT c.folder, c.uidvalidity, c.uid, tag, subtag, confidence, rationale, truncated,
               '{fx.MODEL_ID}' AS model_id, 'classify_v1' AS prompt_version
        FROM chosen c JOIN {_MODEL_TRUNC} p ON p.uid = c.uid""", "messages", "chosen"),
    "classify_llm_batch": _sql(f"""
        SELECT c.folder, c.uidvalidity, c.uid, tag, COALESCE(subtag, '') AS subtags, confidence,
               'llm' AS method, 'v1' AS taxonomy_version, '{HASH}' AS taxonomy_hash,
               '{fx.MODEL_ID}' AS model_id, 'classify_v1' AS prompt_version, rationale, truncated,
               '{fx.RUN_TS.replace(' ', 'T')}' AS created_at, 9 AS run_seq
        FROM modelled c JOIN {_MODEL_TRUNC} p ON p.uid = c.uid""", "messages", "modelled"),
    "llm_metrics": _sql("""
        SELECT count(*) AS called, count(*) FILTER (tag = 'unclassified') AS unclassified
        FROM modelled""", "modelled"),
    "compacted_messages": _sql(f"SELECT {_MSG}, keyword_hint FROM messages3", "messages3"),
    "compacted_ids": _sql("""
        SELECT folder, message_id FROM messages3 WHERE message_id <> ''
           AND message_id IN (SELECT message_id FROM mail WHERE folder = 'Lists')""", "messages3", "mail"),
    "maintained_profiles": _sql(f"SELECT {_PROFILE_COLUMNS} FROM profiles3", "profiles3"),
    "distinct_by_sketch": _sql(
        "SELECT count(DISTINCT message_id) AS distinct_messages, true AS close FROM messages3", "messages3"),
    "run_metrics": _sql("""
        SELECT m.folder, m.batch_id, fetched, COALESCE(inserted, 0) AS inserted,
               fetched - COALESCE(inserted, 0) AS deduped
        FROM (SELECT folder, uid % 3 + 1 AS batch_id, count(*) AS fetched FROM mail GROUP BY ALL) m
        LEFT JOIN (SELECT folder, batch_id, count(*) AS inserted FROM messages3 GROUP BY ALL) k
          ON m.folder = k.folder AND m.batch_id = k.batch_id""", "mail", "messages3"),
    "batch_ingest": _sql(
        "SELECT folder, uidvalidity, uid, message_id, keyword_hint FROM messages", "messages"),
    "bounded_dedup": _sql("""
        SELECT message_id, CASE WHEN message_id = '' THEN count(*) ELSE 1 END AS n
        FROM mail GROUP BY message_id""", "mail"),
    "summary_facts": _sql("""
        SELECT 'tag' AS kind, tag, NULL AS method, NULL AS from_addr, count(*) AS n, 1 AS rank
        FROM manifest GROUP BY tag
        UNION ALL
        SELECT 'method', NULL, method, NULL, count(*), 1 FROM manifest GROUP BY method
        UNION ALL
        SELECT 'sender', tag, NULL, from_addr, n, rank FROM ranked WHERE rank <= 10""", "manifest", "ranked"),
    "complete_map": _sql(f"""
        SELECT folder, uidvalidity, uid, truncated, {_ANSWER} AS raw
        FROM (SELECT *, length(payload) AS n FROM ({_payload(300)}))""", "messages"),
    "model_run": _sql(f"""
        SELECT folder, uidvalidity, uid, CASE WHEN invalid OR 5 + n % 5 < 7 THEN 'unclassified'
                 ELSE {_list(_TAGS)}[n % 4 + 1] END AS tag, '' AS subtags,
               CASE WHEN invalid THEN 0.0 ELSE (5 + n % 5) / 10.0 END AS confidence, 'llm' AS method,
               'v1' AS taxonomy_version, '{HASH}' AS taxonomy_hash, '{fx.MODEL_ID}' AS model_id,
               'classify_v1' AS prompt_version, '' AS rationale, truncated,
               '{fx.RUN_TS.replace(' ', 'T')}' AS created_at
        FROM (SELECT *, length(payload) AS n, length(payload) % 3 = 0 OR length(payload) % 4 = 3 AS invalid
              FROM ({_payload(300, "(SELECT * FROM messages WHERE keyword_hint IS NULL)")}))""", "messages"),
}
ORACLE["resolve_many_rules"] = ORACLE["resolve_rules"]
