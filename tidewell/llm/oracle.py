"""DuckDB SQL for the queries of this subpackage that SQL can express, over whole tables and whole texts.

The others have hashes, tokenizers, models or random draws in them; tests hold those against brute-force versions and round trips.
"""

from __future__ import annotations

from tidewell.llm.quality import CAPITALS, GROWTH, LEAST, METRICS, MIN_GROUP, REACH, SPREAD, SYMBOLS

#: Words of a text; DuckDB's split gives empty strings at the ends.
WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_FIVE = " + ".join(f"{16 >> k} * CAST(substr(bits, 5 * i + {k + 1}, 1) AS INTEGER)" for k in range(5))

WARC = f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, body, CAST(CAST(unhex(sha1(body)) AS BIT) AS VARCHAR) AS bits FROM p),
    k AS (SELECT body, max(page_id) AS keeper FROM p GROUP BY body)
    SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('{BASE32}', CAST(1 + {_FIVE} AS BIGINT), 1)), '') AS payload_digest,
        CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
    FROM d JOIN k USING (body)"""

#: Smallest doc_id reachable, from shared shingles counted per pair of documents.
NEAR = f"""
    WITH RECURSIVE w AS (SELECT doc_id, list_transform({WORDS}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS h FROM w WHERE len(w) > 0),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    e AS MATERIALIZED (
        SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL) t
        JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
    both_ways AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON x.a = r.b),
    c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
    SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
    FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""

_TOP = {"symbol_ratio": "n_symbols / word_chars", "capital_ratio": "n_capitals / word_chars", "repeat_ratio": "n_repeat_words / n_words", "dup_line_ratio": "n_dup_lines / n_lines", "mean_word": "word_chars / n_words"}


def _ratio(m: str) -> str:
    top, base = _TOP[m].split(" / ")
    return f"CASE WHEN {base} > 0 THEN {top} / {base} ELSE 0.0 END"


def _quartiles(name: str, keys: str) -> str:
    at = lambda q, c: f"CASE WHEN min(bucket) FILTER (upto >= ceil({q} * n)) = 0 THEN 0.0 ELSE {LEAST!r} * pow({GROWTH!r}, min(bucket) FILTER (upto >= ceil({q} * n)) - 1.5) END AS {c}"
    group = f"{keys}, metric" if keys else "metric"
    return f"""{name} AS (SELECT {group}, max(n) AS n, {at(0.25, 'q1')}, {at(0.5, 'q2')}, {at(0.75, 'q3')} FROM (
        SELECT {group}, bucket, sum(sum(k)) OVER (PARTITION BY {group} ORDER BY bucket) AS upto, sum(sum(k)) OVER (PARTITION BY {group}) AS n FROM sketch GROUP BY {group}, bucket) GROUP BY {group})"""


def _pick(q: str) -> str:
    return f"CASE WHEN o.n >= {MIN_GROUP} THEN o.{q} WHEN l.n >= {MIN_GROUP} THEN l.{q} ELSE a.{q} END"


_INSIDE = " AND ".join([f"{m} <= top_{m}" for m in METRICS] + ["mean_word >= low_mean_word"])
QUALITY = f"""
    WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT regexp_full_match(x, '[\\x20\\x09-\\x0D]*')) AS l FROM documents),
    tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
    twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS k FROM tri) WHERE k > 1),
    rep AS (SELECT doc_id, count(DISTINCT place) AS r FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS place FROM twice) GROUP BY doc_id),
    f AS MATERIALIZED (
        SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
            CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines, CAST(length(t) - length(translate(t, '{CAPITALS}', '')) AS BIGINT) AS n_capitals
        FROM t LEFT JOIN rep USING (doc_id)),
    g AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {", ".join(f"{_ratio(m)} AS {m}" for m in METRICS)} FROM f),
    v AS ({" UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {m} AS v FROM g WHERE NOT base_failed" for m in METRICS)}),
    sketch AS MATERIALIZED (SELECT lang, source, metric, CASE WHEN v < {LEAST!r} THEN 0 ELSE CAST(ceil(ln(v / {LEAST!r}) / ln({GROWTH!r})) AS INTEGER) + 1 END AS bucket, count(*) AS k FROM v GROUP BY ALL),
    {_quartiles("o", "lang, source")}, {_quartiles("l", "lang")}, {_quartiles("a", "")},
    q AS (SELECT o.lang, o.source, o.metric, {_pick("q1")} AS q1, {_pick("q2")} AS q2, {_pick("q3")} AS q3, CASE o.metric {" ".join(f"WHEN '{m}' THEN {s!r}" for m, s in SPREAD.items())} END AS spread
        FROM o JOIN l ON o.lang IS NOT DISTINCT FROM l.lang AND o.metric = l.metric JOIN a ON o.metric = a.metric),
    h AS (SELECT *, CASE WHEN metric = 'mean_word' THEN least(q2 - q1, q3 - q2) ELSE q2 - q1 END AS half FROM q),
    b AS (SELECT lang, source, {", ".join(f"max(q2 + half + {REACH!r} * greatest(2 * half, spread)) FILTER (metric = '{m}') AS top_{m}" for m in METRICS)},
        max(q2 - (half + {REACH!r} * greatest(2 * half, spread))) FILTER (metric = 'mean_word') AS low_mean_word FROM h GROUP BY lang, source)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({_INSIDE}, true) AS kept
    FROM g LEFT JOIN b ON g.lang IS NOT DISTINCT FROM b.lang AND g.source IS NOT DISTINCT FROM b.source"""

SQL = {"op1_near_dedup": NEAR, "op3_warc": WARC, "op7_quality_rules": QUALITY}
