"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from mailloom.llm.quality_rules import STOP_WORDS, TABLE

ORACLE: dict[str, str] = {}

_STOP = ", ".join(f"'{w}'" for w in sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)}))


def quality_sql(source: str = "documents") -> str:
    """Measures and verdict by doc_id and row; `source` names a table or a subquery."""
    base = " OR ".join(r.sql() for r in TABLE if r.base)
    any_rule = " OR ".join(r.sql() for r in TABLE)
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM {source}),
    w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
                 [l for l in string_split(text, chr(10)) if regexp_matches(l, '[^\x20\x09-\x0D]')] AS ls
          FROM d),
    win AS (SELECT rid, p, array_to_string(ws[p:p + 4], ' ') AS g
            FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS p FROM w)),
    rep AS (SELECT rid, p FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
    cov AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(p, p + 5)) AS q FROM rep)
            GROUP BY rid),
    m AS (SELECT w.rid, w.doc_id, 1 AS one, len(ws)::BIGINT AS n_words,
                 coalesce(list_sum([length(x) for x in ws]), 0)::BIGINT AS word_chars,
                 length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
                 (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
                 coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
                 len([x for x in ws if x IN ({_STOP})])::BIGINT AS n_stop_words,
                 n_stop_words + 1 AS stop_words_and_one
          FROM w LEFT JOIN cov ON w.rid = cov.rid)
    SELECT rid, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           ({base}) AS base_failed, NOT ({any_rule}) AS kept FROM m"""


ORACLE["op9_quality_rules"] = f"SELECT * EXCLUDE (rid) FROM ({quality_sql()})"


def jaccard_sql(source: str = "documents") -> str:
    return rf"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS ws FROM {source}),
    g AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 4], ' ') AS s FROM (
        SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) AS p FROM d)),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b
          ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
          WHERE 100 * o >= 80 * (x.n + y.n - o)),
    r AS (SELECT a AS node, b AS other FROM e UNION SELECT b, a FROM e
          UNION SELECT r.node, x.other FROM r JOIN
          (SELECT a AS node, b AS other FROM e UNION ALL SELECT b, a FROM e) x ON r.other = x.node)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles,
           least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id
    FROM d LEFT JOIN n ON n.doc_id = d.doc_id
    LEFT JOIN (SELECT node, min(other) AS low FROM r GROUP BY node) m ON m.node = d.doc_id"""


ORACLE["op5_ngram_jaccard"] = jaccard_sql()


ORACLE["op3_substring_automata"] = r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    g AS (SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS s FROM (
        SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM d)),
    m AS (SELECT doc_id, p FROM g QUALIFY min(doc_id) OVER (PARTITION BY s) < doc_id),
    c AS (SELECT doc_id, list(DISTINCT q) AS qs FROM (
        SELECT doc_id, unnest(range(p, p + 13)) AS q FROM m) GROUP BY doc_id),
    w AS (SELECT d.doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
    k AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.p) AS t FROM w LEFT JOIN (
        SELECT doc_id, unnest(qs) AS p FROM c) x ON x.doc_id = w.doc_id AND x.p = w.p
        WHERE x.p IS NULL GROUP BY w.doc_id)
    SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(c.qs), 0)::BIGINT AS n_removed,
           sha256(coalesce(k.t, '')) AS kept_sha256
    FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id"""


ORACLE["op4_positional_index"] = r"""
    WITH low AS (SELECT 'd' AS k, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
        UNION ALL SELECT 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
    w AS (SELECT k, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM low),
    b AS (SELECT id AS item_id, least(len(ws), 10) AS n, array_to_string(ws[p:p + 9], ' ') AS s FROM (
        SELECT id, ws, unnest(range(1, greatest(len(ws) - 9, least(len(ws), 1)) + 1)) AS p FROM w WHERE k = 'b')),
    g AS (SELECT DISTINCT n FROM b),
    d AS (SELECT id AS doc_id, p, g.n, array_to_string(ws[p:p + g.n - 1], ' ') AS s
          FROM (SELECT id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w WHERE k = 'd'), g WHERE p + g.n - 1 <= len(ws)),
    h AS (SELECT DISTINCT d.doc_id, d.p, d.n, b.item_id FROM d JOIN b ON d.s = b.s AND d.n = b.n),
    c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
    i AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs FROM (
        SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id)
    SELECT w.id AS doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
           coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(xs, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM w LEFT JOIN c ON c.doc_id = w.id LEFT JOIN i ON i.doc_id = w.id WHERE w.k = 'd'"""


ORACLE["op11_inverted_multi_index"] = """
    WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    u AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL
          AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(e, lambda x: x <> 0)) > 0),
    p AS (SELECT a.rid, a.vec_id AS node, b.vec_id AS other FROM u a JOIN u b
          ON a.label = b.label AND len(a.e) = len(b.e) AND a.rid <> b.rid
          WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
    c AS (SELECT rid, count(*) AS n FROM p GROUP BY rid),
    e AS (SELECT DISTINCT node, other FROM p),
    r AS (SELECT node, other FROM e UNION SELECT r.node, e.other FROM r JOIN e ON r.other = e.node),
    m AS (SELECT node, min(other) AS low FROM r GROUP BY node)
    SELECT v.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, least(v.vec_id, m.low) AS component_id,
           v.vec_id IS NOT DISTINCT FROM least(v.vec_id, m.low) AS kept
    FROM v LEFT JOIN c ON c.rid = v.rid LEFT JOIN m ON m.node = v.vec_id"""


ORACLE["op12_son_phrases"] = r"""
    WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, string_split_regex(translate(
        coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
    w AS (SELECT lang, regexp_extract_all(unnest(ps), '[^\x20\x09]+') AS ws FROM d),
    g AS (SELECT lang, k, array_to_string(ws[p:p + k - 1], ' ') AS phrase FROM (
        SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM w, (SELECT unnest([1, 2, 3]) AS k))),
    f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 10),
    n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
    s AS (SELECT lang, k AS words, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
    c AS (SELECT *, array_to_string(ws[:k], ' ') AS x, array_to_string(ws[k + 1:], ' ') AS y
          FROM (SELECT *, unnest(range(1, words)) AS k FROM s)),
    z AS (SELECT c.lang, c.phrase, c.a, c.words, c.k, x.a AS l, y.a AS r,
                 (1000000::HUGEINT * c.a * c.a // (x.a::HUGEINT * y.a))::BIGINT AS score
          FROM c JOIN f x ON x.lang = c.lang AND x.phrase = c.x JOIN f y ON y.lang = c.lang AND y.phrase = c.y),
    m AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    i AS (SELECT lang, phrase, max(a) AS longer FROM (
        SELECT lang, a, unnest([array_to_string(ws[:2], ' '), array_to_string(ws[2:], ' ')]) AS phrase FROM s WHERE words = 3)
        GROUP BY ALL),
    o AS (SELECT m.* FROM m LEFT JOIN i ON i.lang = m.lang AND i.phrase = m.phrase
          WHERE i.longer IS NULL OR 100 * i.longer < 50 * m.a)
    SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) AS rank,
           phrase, a, l, r, n.n, score
    FROM o JOIN n ON n.lang = o.lang
    QUALIFY row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) <= 2000"""


ORACLE["op13_threshold_negatives"] = """
    WITH v AS (SELECT row_number() OVER () AS rid, vec_id,
               CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding::DOUBLE[] AS e FROM embeddings),
    u AS (SELECT rid, vec_id, label, list_transform(e, lambda x: floor(256 * x)) AS e FROM v
          WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0
          AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.rid AS aid, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same,
                 list_dot_product(a.e, b.e)::BIGINT AS score
          FROM u a JOIN u b ON a.rid <> b.rid AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
    p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY aid ORDER BY score DESC, vec_id, rid) <= 5)
    SELECT p.anchor_id, p.vec_id AS positive_id,
           (row_number() OVER w)::INTEGER AS rank, n.vec_id AS negative_id,
           p.score AS positive_score, n.score AS negative_score
    FROM p JOIN s n ON n.aid = p.aid AND NOT n.same
     AND 100 * n.score BETWEEN 30 * p.score AND 90 * p.score
    WINDOW w AS (PARTITION BY p.aid, p.rid ORDER BY n.score DESC, n.vec_id, n.rid)
    QUALIFY row_number() OVER w <= 10"""
