"""DuckDB SQL for the engine's queries, written against the driver's tables."""

from __future__ import annotations

from tidewell.functions.histogram import BOUNDS, BUCKETS, GROWTH, LEAST, QUANTILES

KEYS = "tenant_id, metric, kind, label_hash, window_start"

POINTS = """
    SELECT event_id, 'tenant-' || (user_id % 4) AS tenant_id, 'b-' || (event_id // 100) AS batch_id, 'events.' || event_type AS metric,
        CASE event_type WHEN 'error' THEN 'counter' WHEN 'purchase' THEN 'histogram' WHEN 'view' THEN 'histogram' ELSE 'gauge' END AS kind,
        value, CAST(ts AS TIMESTAMP) AS ts, CAST(user_id % 10 AS VARCHAR) AS shard, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS VARCHAR) AS k
    FROM events"""


def hash_of(k: str = "k", shard: str = "shard") -> str:
    return f"substr(sha256('1:k' || length({k}) || ':' || {k} || '5:shard' || length({shard}) || ':' || {shard}), 1, 32)"


def bucket(ts: str, hours: int) -> str:
    return f"time_bucket(INTERVAL '{hours} hours', {ts}, TIMESTAMP '1970-01-01')"


def pts(hours: int, extra: str = "") -> str:
    return f"p AS ({POINTS}), w AS (SELECT *, {hash_of()} AS label_hash, {bucket('ts', hours)} AS window_start FROM p {extra})"


AGGS = "count(*) AS count, sum(value) AS sum, min(value) AS min, max(value) AS max, (max({'t': ts, 'v': value})).v AS last, max(ts) AS last_event_at"


def rolled(hours: int, extra: str = "") -> str:
    """CTEs p, w and r: points, windowed points, rollups."""
    return f"WITH {pts(hours, extra)}, r AS (SELECT {KEYS}, any_value(k) AS k, any_value(shard) AS shard, {AGGS}, window_start + INTERVAL '{hours} hours' AS window_end FROM w GROUP BY {KEYS})"


SLOT = f"""CASE WHEN value < 0 THEN 0 WHEN value = 0 THEN 1 WHEN value <= {LEAST!r} THEN 2
    ELSE least(greatest(CAST(floor((ln(value) - ln({LEAST!r}::DOUBLE)) / ln({GROWTH!r}::DOUBLE)) AS INTEGER), 0), {BUCKETS}) + 2 END"""
BOUND = "[0.0::DOUBLE, 0.0::DOUBLE, " + ", ".join(f"{b!r}::DOUBLE" for b in BOUNDS) + f", {BOUNDS[-1]!r}::DOUBLE]"


def quantile(keys: str, q: float, source: str = "w") -> str:
    """CTEs s, c and q: sparse slots, running counts, the bound where the target is reached."""
    return f"""s AS (SELECT {keys}, {SLOT} AS slot, count(*) AS n FROM {source} WHERE kind = 'histogram' GROUP BY ALL),
    c AS (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY slot) AS upto, sum(n) OVER (PARTITION BY {keys}) AS total FROM s),
    q AS (SELECT {keys}, {BOUND}[min(slot) + 1] AS v, any_value(total) AS total FROM c WHERE upto >= greatest(ceil({q} * total), 1) GROUP BY {keys})"""


def stat(name: str) -> str:
    if name in QUANTILES:
        return f"WITH {pts(24)}, {quantile(KEYS, QUANTILES[name])} SELECT {KEYS}, round(v, 6) AS v FROM q"
    v = {"avg": "sum / count", "count": "count::DOUBLE"}.get(name, name)
    return f"{rolled(24)} SELECT {KEYS}, round({v}, 6) AS v FROM r"


LABELS = """'{"k":"' || k || '","shard":"' || shard || '"}'"""
SCALARS = f"{KEYS}, count, round(sum, 6) AS sum"
FULL = f"{SCALARS}, min, max, last, last_event_at"
WHERE = "tenant_id = 'tenant-1' AND metric = 'events.view'"
RANGE = f"{WHERE} AND window_start >= TIMESTAMP '2024-01-05' AND window_start < TIMESTAMP '2024-01-20'"
OWN = "tenant_id, metric, kind, label_hash"
ANSWER = f"{rolled(1)}, a AS (SELECT {OWN}, k, shard, window_start AS t, sum / count AS v FROM r)"


def capped(value: str, series: int, points: int, rows: int, ctes: str) -> str:
    return f"""{ctes},
    cut AS (SELECT *, row_number() OVER (ORDER BY window_start DESC, kind, label_hash) AS rank FROM src WHERE {RANGE} QUALIFY rank <= {rows}),
    e AS (SELECT *, {value} AS v FROM cut WHERE {value} IS NOT NULL),
    f AS (SELECT *, min(rank) OVER (PARTITION BY kind, label_hash) AS first FROM e),
    g AS (SELECT *, dense_rank() OVER (ORDER BY first) AS nth FROM f),
    h AS (SELECT *, row_number() OVER (ORDER BY rank) AS n FROM g WHERE nth <= {series})
    SELECT kind, label_hash, {LABELS} AS labels, window_start AS t, round(v, 6) AS v FROM h WHERE n <= {points}"""


def broken() -> str:
    n = "event_id % 26"
    return f"""b AS (SELECT event_id, tenant_id, batch_id, {n} AS n,
        CASE {n} WHEN 1 THEN '' WHEN 2 THEN repeat('x', 201) WHEN 3 THEN '9bad' WHEN 4 THEN 'a..b' WHEN 5 THEN 'a.' WHEN 6 THEN 'né' ELSE metric END AS metric,
        CASE {n} WHEN 7 THEN '' WHEN 8 THEN 'Gauge' WHEN 9 THEN 'counter' ELSE kind END AS kind,
        CASE {n} WHEN 9 THEN -1.0 WHEN 10 THEN NULL WHEN 11 THEN 'nan'::DOUBLE WHEN 12 THEN 1.1e100 WHEN 13 THEN -1e100 ELSE value END AS value,
        CASE {n} WHEN 14 THEN NULL WHEN 15 THEN TIMESTAMP '1600-01-01' WHEN 16 THEN TIMESTAMP '2024-01-25 00:05:00' ELSE ts END AS ts
        FROM ({POINTS}))"""


RULES = """list_filter([
        CASE WHEN metric = '' THEN 'metric:required' WHEN strlen(metric) > 200 THEN 'metric:length' WHEN NOT regexp_full_match(metric, '[A-Za-z_][A-Za-z0-9_.\\-]*') THEN 'metric:grammar'
            WHEN metric LIKE '%.' OR metric LIKE '%..%' THEN 'metric:segment' END,
        CASE WHEN kind = '' THEN 'kind:required' WHEN kind NOT IN ('gauge', 'counter', 'histogram') THEN 'kind:unknown' END,
        CASE WHEN value IS NULL THEN 'value:required' WHEN isnan(value) OR abs(value) > 1e100 THEN 'value:finite' END,
        CASE WHEN kind = 'counter' AND value < 0 THEN 'value:negative' END,
        CASE WHEN ts IS NULL THEN 'timestamp:required' WHEN year(ts) NOT BETWEEN 1678 AND 2261 THEN 'timestamp:year' {age} END,
        CASE n WHEN 17 THEN 'labels.:empty' WHEN 18 THEN 'labels.__own:reserved' WHEN 19 THEN 'labels.' || repeat('k', 65) || ':key-length' WHEN 20 THEN 'labels.a-b:key-grammar' WHEN 21 THEN 'labels.a:value-length' WHEN 22 THEN 'labels:count' WHEN 23 THEN 'labels.a:value-control' WHEN 24 THEN 'labels.a:value-utf8' END
    ], lambda x: x IS NOT NULL)"""
AGE = "WHEN ts > TIMESTAMP '2024-01-25 00:05:00' THEN 'timestamp:future' WHEN ts < TIMESTAMP '2024-01-18' THEN 'timestamp:old'"

DELTAS = f"""WITH {pts(24)}, x AS (SELECT *, CAST(split_part(batch_id, '-', 2) AS BIGINT) % 10 + 1 AS revision FROM w),
    m AS (SELECT {KEYS}, any_value(k) AS k, any_value(shard) AS shard, {AGGS}, max(revision) AS revision FROM x GROUP BY {KEYS})"""
FEED = "revision, metric, kind, label_hash, window_start"
PAGE = f"SELECT {FEED}, count, round(sum, 6) AS sum, last"
COST = """1024 + 4 * strlen('{"k":"' || k || '","shard":"' || shard || '"}') + strlen(tenant_id) + strlen(metric) + strlen(kind) + 32"""

SQL: dict[str, str] = {
    "p95_by_metric": f"WITH {pts(24)}, {quantile('tenant_id, metric, window_start', 0.95)} SELECT tenant_id, metric, window_start, total::BIGINT AS count, round(v, 6) AS p95 FROM q",
    "rollup_hourly": f"{rolled(1)} SELECT {KEYS}, window_end, count, round(sum, 6) AS sum, min, max, last, last_event_at FROM r",
    **{f"agg_{a}": stat(a) for a in ("sum", "count", "avg", "min", "max", "last", *QUANTILES)},
    "histogram_vector": f"WITH {pts(24)} SELECT {KEYS}, {SLOT} AS slot, count(*) AS n FROM w WHERE kind = 'histogram' GROUP BY ALL",
    "label_hash": f"WITH p AS ({POINTS}) SELECT event_id, {hash_of()} AS label_hash, '{{k=' || k || ',shard=' || shard || '}}' AS shown FROM p",
    "merge_partials": f"{rolled(24)}, {quantile(KEYS, 0.9)} SELECT {FULL}, round(q.v, 6) AS p90 FROM r LEFT JOIN q USING ({KEYS})",
    "vector_add": f"WITH {pts(24)} SELECT {KEYS}, 2 * count(*) AS doubled, count(*) AS kept, count(*) AS right_only FROM w WHERE kind = 'histogram' GROUP BY {KEYS}",
    "nearest_rank": f"WITH p AS ({POINTS}), n AS (SELECT metric, value, row_number() OVER (PARTITION BY metric ORDER BY value) AS i, count(*) OVER (PARTITION BY metric) AS c FROM p) SELECT metric, value AS p95 FROM n WHERE i = greatest(ceil(0.95 * c), 1)",
    "status_counts": f"SELECT kind, metric, count(*) AS n FROM ({POINTS}) GROUP BY ALL",
    "default_agg": f"SELECT DISTINCT kind, CASE kind WHEN 'counter' THEN 'sum' WHEN 'histogram' THEN 'p95' ELSE 'last' END AS agg FROM ({POINTS})",
    "window_assign": """SELECT event_id, make_timestamp(epoch_us(ts) // 604800000000 * 604800000000) AS week, make_timestamp((epoch_us(ts) // 604800000000 + 1) * 604800000000) AS week_end,
        make_timestamp(CAST(floor((epoch_us(ts) - 1892160000000000) / 900000000.0) AS BIGINT) * 900000000) AS early FROM events""",
    "filter_labels": f"{rolled(1)} SELECT {SCALARS} FROM r WHERE {RANGE} AND k = '2'",
    "scan_newest": f"{rolled(1)} SELECT {SCALARS} FROM r WHERE {RANGE} ORDER BY window_start DESC, kind, label_hash LIMIT 100",
    "scan_plain": f"{rolled(1)} SELECT {SCALARS} FROM r WHERE {RANGE} ORDER BY window_start DESC, label_hash, kind LIMIT 50",
    "metrics_summary": f"{rolled(1)} SELECT metric, kind, count(DISTINCT label_hash) AS series_count, min(window_start) AS oldest, max(window_start) AS newest FROM r WHERE tenant_id = 'tenant-1' GROUP BY metric, kind",
    "label_keys": f"SELECT DISTINCT unnest(map_keys(MAP {{'k': k, 'shard': shard}})) AS key FROM ({POINTS}) WHERE {WHERE}",
    "label_values": f"SELECT DISTINCT shard AS value FROM ({POINTS}) WHERE {WHERE}",
    "metric_names": f"SELECT DISTINCT metric FROM ({POINTS}) WHERE tenant_id = 'tenant-1'",
    "series_search": f"WITH p AS ({POINTS}) SELECT DISTINCT kind, {hash_of()} AS label_hash, {LABELS} AS labels FROM p WHERE shard = '3'",
    "query_capped": capped("sum", 7, 40, 400, f"{rolled(24)}, src AS (SELECT * FROM r)"),
    "query_quantile": capped("v0", 500, 50_000, 50_001, f"{rolled(24)}, {quantile(KEYS, 0.95)}, src AS (SELECT r.*, q.v AS v0 FROM r LEFT JOIN q USING ({KEYS}))"),
    "kind_roll_up": f"SELECT tenant_id, CASE WHEN count(DISTINCT kind) > 1 THEN 'mixed' ELSE min(kind) END AS kind FROM ({POINTS}) GROUP BY tenant_id",
    "read_budget": f"""{rolled(24)} SELECT {KEYS}, 1024 + 4 * strlen({LABELS}) + CASE WHEN kind = 'histogram' THEN 16 * 153 ELSE 0 END + strlen(tenant_id) + strlen(metric) + strlen(kind) + 32 AS cost,
        1024 + 2 * (strlen(tenant_id) + strlen(metric) + 32) + 256 + 2 * (6 + strlen(k) + strlen(shard)) + CASE WHEN kind = 'histogram' THEN 2048 ELSE 0 END AS state FROM r""",
    "stream_event": f"{rolled(1)} SELECT metric, kind, {LABELS} AS labels, window_start, window_end, count, round(sum, 6) AS sum, round(sum / count, 6) AS avg, min, max, last FROM r",
    "validate_points": f"WITH {broken()} SELECT event_id, array_to_string({RULES.replace('{age}', AGE)}, ';') AS violations FROM b",
    "partial_success": f"""WITH {broken()}, v AS (SELECT tenant_id, batch_id, len({RULES.replace('{age}', '')}) AS n FROM b)
        SELECT tenant_id, batch_id, sum((n = 0)::BIGINT)::BIGINT AS accepted, sum((n > 0)::BIGINT)::BIGINT AS rejected, least(sum(n), 100)::BIGINT AS shown, sum(n) > 100 AS errors_truncated FROM v GROUP BY ALL""",
    "envelope_round_trip": f"{rolled(24)} SELECT {SCALARS}, min, max, last FROM r",
    "envelope_faults": f"""WITH d AS (SELECT DISTINCT tenant_id, batch_id FROM ({POINTS})) SELECT ['none', 'version', 'identity', 'empty', 'json'][CAST(split_part(batch_id, '-', 2) AS BIGINT) % 5 + 1] AS fault, count(*) AS n FROM d GROUP BY 1""",
    "dedup_ledger": f"""WITH {pts(24)}, done AS (SELECT DISTINCT tenant_id, batch_id, window_start FROM w WHERE CAST(split_part(batch_id, '-', 2) AS BIGINT) % 4 = 0)
        SELECT {KEYS}, count(*) AS count, round(sum(value), 6) AS sum FROM w WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.tenant_id = w.tenant_id AND done.batch_id = w.batch_id AND done.window_start = w.window_start) GROUP BY {KEYS}""",
    "claims_committed": f"WITH {pts(24)} SELECT DISTINCT tenant_id, batch_id, window_start FROM w WHERE kind = 'counter'",
    "batch_windows": f"WITH {pts(6)} SELECT DISTINCT tenant_id, batch_id, window_start FROM w",
    "change_feed_page": f"""{DELTAS}, f AS (SELECT *, sum({COST}) OVER (ORDER BY {FEED}) AS bytes, row_number() OVER (ORDER BY {FEED}) AS i FROM m
        WHERE tenant_id = 'tenant-1' AND ({FEED}) > (8, 'events.view', 'histogram', '8', TIMESTAMP '2024-01-10'))
        {PAGE} FROM f WHERE i <= 1000 AND (bytes <= 262144 OR i = 1)""",
    "change_feed_metric": f"""{DELTAS} {PAGE} FROM m WHERE tenant_id = 'tenant-1' AND metric = 'events.view' AND ({FEED}) > (3, 'events.view', 'histogram', '8', TIMESTAMP '2024-01-10') ORDER BY {FEED} LIMIT 60""",
    "newest_revision": f"""{DELTAS.split(", m AS")[0]} SELECT tenant_id, max(revision) AS newest, coalesce(max(revision) FILTER (metric = 'events.error' AND revision < 8), 0) AS older_error, coalesce(max(revision) FILTER (metric = 'none'), 0) AS none FROM x GROUP BY tenant_id""",
    "store_merge": f"{DELTAS} SELECT {FULL}, revision FROM m",
    "retention": f"{rolled(1)} SELECT tenant_id, count(*) AS expired, max(window_end) AS newest FROM r WHERE window_end < TIMESTAMP '2024-02-10' - INTERVAL '30 days' GROUP BY tenant_id",
    "idempotent_requests": """WITH b AS (SELECT event_id, 'key-' || (user_id % 50) AS idempotency_key, user_id % 10 AS f, CAST(ts AS TIMESTAMP) AS t0 FROM events WHERE event_type = 'purchase'),
        h AS (SELECT idempotency_key, max({'t0': t0, 'id': event_id, 'f': f}) AS r FROM b WHERE event_id % 2 = 0 GROUP BY 1)
        SELECT event_id, idempotency_key, CASE WHEN r IS NULL OR r.t0 + INTERVAL '2 days' <= b.t0 THEN 'new' WHEN r.f = b.f THEN 'replay' ELSE 'conflict' END AS outcome,
            CASE WHEN r IS NOT NULL AND r.t0 + INTERVAL '2 days' > b.t0 AND r.f = b.f THEN 'answer-' || r.id END AS response
        FROM b LEFT JOIN h USING (idempotency_key) WHERE event_id % 2 = 1""",
    "median_interval": f"""{ANSWER}, d AS (SELECT {OWN}, epoch_us(t) - lag(epoch_us(t)) OVER (PARTITION BY {OWN} ORDER BY t) AS d FROM a)
        SELECT {OWN}, list_sort(list(d))[len(list(d)) // 2 + 1] AS interval FROM d WHERE d > 0 GROUP BY ALL""",
    "gap_segments": f"""{ANSWER}, d AS (SELECT *, epoch_us(t) - lag(epoch_us(t)) OVER (PARTITION BY {OWN} ORDER BY t) AS d FROM a),
        i AS (SELECT {OWN}, list_sort(list(d))[len(list(d)) // 2 + 1] AS i FROM d WHERE d > 0 GROUP BY ALL)
        SELECT {OWN}, t, CAST(sum(CASE WHEN d > i * 1.5 THEN 1 ELSE 0 END) OVER (PARTITION BY {OWN} ORDER BY t) AS BIGINT) AS segment FROM d LEFT JOIN i USING ({OWN})""",
    "decimate": f"""WITH p AS ({POINTS}), d AS (SELECT kind, metric AS label_hash, event_id AS t, floor(value) AS v, row_number() OVER (PARTITION BY metric ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY metric) AS n FROM p),
        b AS (SELECT *, CASE WHEN rn > 1 AND rn < n THEN (rn - 2) // CAST(ceil((n - 2) / 49.0) AS BIGINT) END AS b FROM d),
        m AS (SELECT *, first_value(rn) OVER (PARTITION BY label_hash, b ORDER BY v, rn) AS lo, first_value(rn) OVER (PARTITION BY label_hash, b ORDER BY v DESC, rn) AS hi FROM b)
        SELECT kind, label_hash, t, v FROM m WHERE n <= 100 OR b IS NULL OR rn = lo OR rn = hi""",
    "csv_export": f"""{ANSWER} SELECT '"' || metric || '","' || kind || '","' || replace({LABELS}, '"', '""') || '","' || strftime(t, '%Y-%m-%dT%H:%M:%S') || '.000Z","' || CAST(round(v, 3) AS VARCHAR) || '","false"' AS line FROM a""",
    "csv_guard": f"""WITH p AS ({POINTS}), c AS (SELECT event_id, ['=', '+', '-', '@', chr(9), chr(13), '', 'q"'][event_id % 8 + 1] || metric AS c FROM p)
        SELECT event_id, '"' || CASE WHEN c[1] IN ('=', '+', '-', '@', chr(9), chr(13)) THEN '''' ELSE '' END || replace(c, '"', '""') || '"' AS cell FROM c""",
    "series_stats": f"{ANSWER} SELECT {OWN}, round(arg_max(v, t), 6) AS latest, round(min(v), 6) AS min, round(max(v), 6) AS max, count(*) AS n FROM a GROUP BY ALL",
    "nearest_point": f"""{ANSWER}, o AS (SELECT *, row_number() OVER (PARTITION BY {OWN} ORDER BY abs(epoch_us(t) - epoch_us(TIMESTAMP '2024-01-12 12:00:00')), t DESC) AS i FROM a)
        SELECT {OWN}, t, round(v, 6) AS v FROM o WHERE i = 1""",
    "reconcile": f"""{rolled(24)}, a AS (SELECT tenant_id, window_start, sum(count) AS n FROM r GROUP BY ALL), b AS (SELECT tenant_id, date_trunc('day', ts) AS window_start, count(*) AS n FROM p GROUP BY ALL)
        SELECT count(*) AS windows, CAST(sum(CASE WHEN a.n IS NOT DISTINCT FROM b.n THEN 0 ELSE 1 END) AS BIGINT) AS mismatches FROM a FULL JOIN b USING (tenant_id, window_start)""",
    "pressure_rollup": """WITH g AS (SELECT row_number() OVER () - 1 AS id FROM events), v AS (SELECT ['counter', 'gauge', 'histogram'][id % 3 + 1] AS kind, 'host-' || (id % 200) AS host, (id % 17 + 1)::DOUBLE AS value FROM g)
        SELECT kind, host, TIMESTAMP '2024-01-25' AS window_start, count(*) AS count, sum(value) AS sum, min(value) AS min, max(value) AS max, max(value) AS last FROM v GROUP BY kind, host""",
    "table_fingerprint": f"""{rolled(24)}, j AS (SELECT sha256('{{"count":' || count || ',"metric":"' || metric || '","tenant_id":"' || tenant_id || '","window_start":"' || strftime(window_start, '%Y-%m-%dT%H:%M:%S.000Z') || '"}}') AS h FROM r),
        s AS (SELECT {", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 12 * i}, 12) AS BIGINT)) AS VARCHAR) AS s{i}" for i in range(5))}, count(*) AS rows FROM j)
        SELECT md5(concat_ws(':', s0, s1, s2, s3, s4, rows)) AS fingerprint, rows FROM s""",
    "sse_frames": f"""{DELTAS} SELECT 'event: rollup' || chr(10) || 'data: {{"metric":"' || metric || '","kind":"' || kind || '","labels":{{"k":"' || k || '","shard":"' || shard || '"}},"window_start":"' || strftime(window_start, '%Y-%m-%dT%H:%M:%S.000Z')
        || '","window_end":"' || strftime(window_start + INTERVAL '24 hours', '%Y-%m-%dT%H:%M:%S.000Z') || '","count":' || count || ',"sum":' || round(sum, 6) || ',"avg":' || round(sum, 6) / count || ',"min":' || round(min, 6) || ',"max":' || round(max, 6) || ',"last":' || round(last, 6) || '}}' || chr(10) || chr(10) AS frame FROM m""",
}
