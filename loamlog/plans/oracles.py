"""The same results in plain SQL over the same tables."""

from __future__ import annotations

# The events table as logs.
LOGS = """
  SELECT event_id + 1 AS id, ts AS log_ts,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn'
                    WHEN 'view' THEN 'debug' ELSE 'info' END AS level,
    CASE user_id % 5 WHEN 0 THEN 'checkout' WHEN 1 THEN 'auth' WHEN 2 THEN 'payments'
                     WHEN 3 THEN 'inventory' ELSE 'notifications' END AS service,
    concat(upper(event_type), ' by user_', CAST(user_id AS VARCHAR),
           CASE WHEN value >= 100 THEN ' at 100% quota' ELSE ' at 50 quota' END) AS message,
    props->>'$.k' AS attr_k, CAST(user_id AS VARCHAR) AS attr_user_id,
    CASE WHEN value > 20 THEN 'true' ELSE 'false' END AS attr_active, value
  FROM events
"""
WITH_LOGS = f"WITH l AS ({LOGS})"
SINCE, UNTIL = "TIMESTAMP '2024-01-05 03:17:42.250'", "TIMESTAMP '2024-01-20 21:44:13.875'"
FIRST_MINUTE, LAST_MINUTE = "TIMESTAMP '2024-01-05 03:18:00'", "TIMESTAMP '2024-01-20 21:44:00'"
CURSOR = "(TIMESTAMP '2024-01-15 12:00:00', 5000)"
CUTOFF = "TIMESTAMP '2024-01-11 06:30:15'"
CAP = 210
IN_RANGE = f"log_ts >= {SINCE} AND log_ts < {UNTIL}"
ROW = 'CAST(id AS VARCHAR) AS id, log_ts AS "timestamp", level, service, message'
INTERVALS = {"1m": "1 minute", "5m": "5 minutes", "1h": "1 hour", "1d": "1 day"}


def _bucket(bucket: str, column: str = "log_ts") -> str:
    return f"time_bucket(INTERVAL '{INTERVALS[bucket]}', {column}, TIMESTAMP '1970-01-01')"


def _rows(where: str, tail: str = "") -> str:
    return f"{WITH_LOGS} SELECT {ROW} FROM l WHERE {where} {tail}"


def _counts(bucket: str, group_by: str | None, where: str = IN_RANGE) -> str:
    group = group_by or "CAST(NULL AS VARCHAR)"
    return (
        f'{WITH_LOGS} SELECT {_bucket(bucket)} AS start, {group} AS "group", '
        f"count(*) AS count FROM l WHERE {where} GROUP BY 1, 2"
    )


def _minutes(where: str = "true", logs: str = "l") -> str:
    return (
        f"SELECT {_bucket('1m')} AS bucket_start, service, level, count(*) AS log_count "
        f"FROM {logs} WHERE {where} GROUP BY 1, 2, 3"
    )


# ---- ingest ----------------------------------------------------------------

# The reasons clients get, with the limits in them.
_TOO_MANY = "logs array must contain at most 10000 entries"
_NO_LOGS = "request body must contain a logs array"
_NOT_AN_OBJECT = "request body must be an object"
_MALFORMED = "malformed JSON"
_ALL_REJECTED = "all log entries were rejected"
_FLAT = "attributes must be a flat object containing only string, number, or boolean values"
_ENTRIES = f"""
  l AS ({LOGS}),
  requests AS (
    SELECT *, level = 'error' AND value < 5 AS all_bad, level = 'info' AND value < 5 AS bare,
      CASE WHEN id % 2500 = 7 THEN '{_TOO_MANY}'
           WHEN level = 'warn' AND value < 5 THEN '{_NO_LOGS}'
           WHEN level = 'debug' AND value < 3 THEN '{_MALFORMED}'
           WHEN level = 'debug' AND value < 4 THEN '{_NOT_AN_OBJECT}'
           WHEN level = 'debug' AND value < 5 THEN '{_MALFORMED}' END AS envelope
    FROM l
  ),
  listed AS (
    SELECT *, [x FOR x IN [
      CASE WHEN NOT all_bad THEN 'ok' END,
      'timestamp is required and must be a string',
      'timestamp is required and must be a string',
      'timestamp must be a valid ISO 8601 timestamp',
      'timestamp must not be more than five minutes in the future',
      concat('invalid level: ''', upper(level), ''''),
      'service must be a non-empty string',
      'service must be at most 256 characters',
      'message must be a non-empty string',
      '{_FLAT}',
      '{_FLAT}',
      'attribute keys must be non-empty strings',
      'log entry must be an object',
      CASE WHEN level = 'debug' THEN 'message must be at most 8192 characters' END,
      'timestamp must not be before the year 1',
      'timestamp must not be before the year 1',
      'attributes must contain at most 50 keys',
      'attribute keys must be at most 128 characters',
      'attribute number values must be finite',
      'attribute string values must be at most 4096 characters',
      concat('invalid level: ''', level, ',1,,2''')
    ] IF x IS NOT NULL] AS outcomes
    FROM requests
  ),
  entries AS (
    SELECT id, log_ts, level, service, message, CAST(NULL AS INTEGER) AS idx,
           envelope AS outcome, attr_k, attr_user_id, attr_active, value, bare
    FROM listed WHERE envelope IS NOT NULL
    UNION ALL
    SELECT id, log_ts, level, service, message,
           CAST(unnest(range(len(outcomes))) AS INTEGER) AS idx,
           unnest(outcomes) AS outcome, attr_k, attr_user_id, attr_active, value, bare
    FROM listed WHERE envelope IS NULL
  )
"""
_VALIDATE = f"""
WITH {_ENTRIES}
SELECT id AS request_id, idx AS "index",
  CASE WHEN outcome <> 'ok' THEN outcome END AS reason,
  CASE WHEN outcome = 'ok' THEN date_trunc('milliseconds', log_ts) END AS log_ts,
  CASE WHEN outcome = 'ok' THEN level END AS level,
  CASE WHEN outcome = 'ok' THEN service END AS service,
  CASE WHEN outcome = 'ok' THEN message END AS message
FROM entries
"""
_REPORT_ROW = f"""
  count(*) FILTER (outcome = 'ok') AS accepted,
  coalesce(string_agg(concat(idx, ':', outcome), '|' ORDER BY idx)
           FILTER (outcome <> 'ok' AND idx IS NOT NULL), '') AS rejected,
  CASE WHEN max(idx) IS NULL THEN max(outcome)
       WHEN count(*) FILTER (outcome = 'ok') = 0 THEN '{_ALL_REJECTED}' END AS error
"""
_REPORT = f"WITH {_ENTRIES} SELECT id AS request_id, {_REPORT_ROW} FROM entries GROUP BY id"
_STREAM_REPORT = f"WITH {_ENTRIES} SELECT {_REPORT_ROW} FROM entries GROUP BY id"
_DEAD = f"""
WITH {_ENTRIES}, refused AS (
  SELECT *, outcome = 'log entry must be an object' OR idx IS NULL AS no_object
  FROM entries WHERE outcome <> 'ok')
SELECT id AS request_id, idx AS "index", outcome AS reason,
  CAST(CASE WHEN no_object THEN NULL
       WHEN outcome = 'message must be a non-empty string' THEN length(attr_user_id)
       WHEN outcome = 'message must be at most 8192 characters' THEN 320 * length(message)
       ELSE length(message) END AS INTEGER) AS message_length,
  CASE WHEN no_object THEN NULL
       WHEN outcome = concat('invalid level: ''', upper(level), '''') THEN upper(level)
       WHEN outcome LIKE 'invalid level%' THEN concat('[["', level, '"],[1,[null,2]]]')
       ELSE level END AS its_level,
  CASE WHEN no_object THEN NULL
       WHEN outcome = 'service must be a non-empty string' THEN ''
       WHEN outcome = 'service must be at most 256 characters' THEN repeat(service, 65)
       ELSE service END AS its_service,
  idx IS NULL AS has_body
FROM refused
"""
_TEXTS = f"""
WITH {_ENTRIES}, good AS (SELECT * FROM entries WHERE outcome = 'ok' AND NOT bare)
SELECT id AS request_id, 'k' AS key, attr_k AS value FROM good
UNION ALL SELECT id, 'user_id', attr_user_id FROM good
UNION ALL SELECT id, 'active', attr_active FROM good
UNION ALL SELECT id, 'value', regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') FROM good
"""

# ---- paging and retention --------------------------------------------------

_PAGES = f"""
{WITH_LOGS}, ranked AS (
  SELECT id, log_ts, row_number() OVER (ORDER BY log_ts DESC, id DESC) - 1 AS rank,
         count(*) OVER () AS total
  FROM l WHERE service = 'checkout'
)
SELECT id, rank // 100 + 1 AS page, rank % 100 + 1 AS position,
  CASE WHEN rank % 100 = 99 AND rank + 1 < total THEN
    rtrim(translate(to_base64(encode(concat('{{"timestamp":"',
      CASE WHEN date_trunc('milliseconds', log_ts) = log_ts
           THEN strftime(log_ts, '%Y-%m-%dT%H:%M:%S.%gZ')
           ELSE strftime(log_ts, '%Y-%m-%dT%H:%M:%S.%fZ') END,
      '","id":"', id, '"}}'))), '+/', '-_'), '=') END AS next_cursor
FROM ranked
"""


def _retained(cap: int | None) -> dict[str, str]:
    suffix = "" if cap is None else "_capped"
    limit = "true" if cap is None else f"rn <= {cap}"
    head = f"""
{WITH_LOGS}, aged AS (SELECT *, row_number() OVER (ORDER BY log_ts, id) AS rn FROM l),
marked AS (SELECT *, log_ts < {CUTOFF} AND {limit} AS gone FROM aged)"""
    return {
        f"retention_delete{suffix}": f"{head} SELECT {ROW} FROM marked WHERE NOT gone",
        f"retention_rollup{suffix}": f"{head} {_minutes('NOT gone', 'marked')}",
        f"retention_totals{suffix}": f"""{head}, minutes AS (
  SELECT {_bucket('1m')} AS b, service, level, count(*) FILTER (gone) AS g, count(*) AS n
  FROM marked GROUP BY 1, 2, 3)
SELECT CAST(sum(g) AS BIGINT) AS deleted_count,
       count(*) FILTER (g > 0 AND g = n) AS rollup_rows_removed FROM minutes""",
    }


# Stored rows went through JSON, which carries milliseconds.
_STORED = f"{WITH_LOGS}, s AS (SELECT * REPLACE (date_trunc('milliseconds', log_ts) AS log_ts) FROM l)"
_STORED_ROW = "log_ts, level, service, message"


def oracle_sql() -> dict[str, str]:
    found = {
        "search_newest": _rows("true", "ORDER BY log_ts DESC, l.id DESC LIMIT 101"),
        "search_export": f"""{WITH_LOGS}
SELECT id, concat('{{"id":"', id, '","timestamp":"', strftime(log_ts, '%Y-%m-%dT%H:%M:%S.%gZ'),
  '","level":"', level, '","service":"', service, '","message":"', message,
  '","attributes":{{"k":"', attr_k, '","user_id":"', attr_user_id, '","active":"',
  attr_active, '"}}}}') AS log FROM l""",
        "filter_none": _rows("true"),
        "filter_service_level": _rows("service = 'checkout' AND level = 'error'"),
        "filter_time_range": _rows(IN_RANGE),
        "filter_message_substring": (
            "SELECT doc_id, lang, n_chars FROM documents WHERE text ILIKE '%LICENSE%'"
        ),
        "filter_literal_wildcards": _rows("message ILIKE '%100\\% Quota%' ESCAPE '\\'"),
        "filter_escaped_pattern": _rows("message ILIKE '%\\_5%' ESCAPE '\\'"),
        "filter_attributes": _rows("attr_k = '69' AND attr_active = 'true'"),
        "search_after_cursor": _rows(
            f"(log_ts, l.id) < {CURSOR}", "ORDER BY log_ts DESC, l.id DESC LIMIT 251"
        ),
        "search_all_filters": _rows(
            f"service = 'auth' AND level = 'info' AND {IN_RANGE} AND message ILIKE '%USER\\_1%' "
            f"ESCAPE '\\' AND attr_active = 'false' AND (log_ts, l.id) < {CURSOR}"
        ),
        "page_walk": _PAGES,
        "minute_rollup": f"{WITH_LOGS} {_minutes()}",
        "rollup_merge_batches": f"{WITH_LOGS} {_minutes()}",
        "agg_raw_edges": _counts(
            "1h",
            "service",
            f"log_ts < {_bucket('1m', '(SELECT min(ts) FROM events)')} + INTERVAL 1 MINUTE "
            f"OR log_ts >= {_bucket('1m', '(SELECT max(ts) FROM events)')}",
        ),
        "agg_rollup_whole_range": _counts("1d", "level", "true"),
        "agg_rollup_middle": _counts(
            "5m", "level", f"log_ts >= {FIRST_MINUTE} AND log_ts < {LAST_MINUTE}"
        ),
        "agg_rollup_routed": _counts("1h", "service"),
        "agg_rollup_service_level": _counts(
            "1d", "level", f"{IN_RANGE} AND service = 'payments' AND level = 'info'"
        ),
        "agg_filtered": _counts(
            "1d",
            "level",
            f"{IN_RANGE} AND message ILIKE '%by user\\_%' ESCAPE '\\' AND attr_active = 'true'",
        ),
        "agg_empty_range": _counts("1h", None, f"log_ts >= {SINCE} AND log_ts < {SINCE}"),
        "agg_export": (
            f"{WITH_LOGS} SELECT strftime({_bucket('1h')}, '%Y-%m-%dT%H:%M:%S.%gZ') AS start, "
            f'CAST(NULL AS VARCHAR) AS "group", count(*) AS count FROM l WHERE {IN_RANGE} '
            "GROUP BY 1"
        ),
        "ingest_validate": _VALIDATE,
        "ingest_report": _REPORT,
        "dead_letters": _DEAD,
        "attributes_text": _TEXTS,
        "backfill_attributes": _TEXTS,
        "rows_from_arrays": f"""{WITH_LOGS}
SELECT id, unnest([level, upper(level)]) AS word,
       CAST(unnest([length(service), length(message)]) AS INTEGER) AS size FROM l""",
        "assign_ids": (
            "SELECT ts, event_id, row_number() OVER (ORDER BY ts, event_id) AS id FROM events"
        ),
        **_retained(None),
        **_retained(CAP),
        "latency_summary": """
SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95,
       quantile_disc(value, 0.99) AS p99, max(value) AS max
FROM events GROUP BY event_type""",
        "stream_rollup": f"{WITH_LOGS} {_minutes()}",
        "store_logs": f"{_STORED} SELECT {_STORED_ROW} FROM s",
        "store_search": f"""{WITH_LOGS}
SELECT strftime(log_ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS "timestamp", service, message FROM (
  SELECT * FROM l WHERE level = 'error' ORDER BY log_ts DESC, id DESC LIMIT 200)""",
        "store_filter": (
            f"{_STORED} SELECT {_STORED_ROW} FROM s WHERE {IN_RANGE} "
            "AND attr_user_id = '42' AND attr_active = 'false'"
        ),
        "store_aggregate": _counts("1h", "service").replace(WITH_LOGS, _STORED).replace(
            "FROM l WHERE", "FROM s WHERE"
        ),
        "store_retention_logs": (
            f"{_STORED} SELECT {_STORED_ROW} FROM s WHERE log_ts >= {CUTOFF}"
        ),
        "store_retention_rollup": f"{_STORED} {_minutes(f'log_ts >= {CUTOFF}', 's')}",
        "store_compaction": f"{_STORED} SELECT {_STORED_ROW} FROM s WHERE log_ts >= {CUTOFF}",
        "stream_ingest": f"""{_STORED}
SELECT {_bucket('1m')} AS bucket_start, service, level, count(*) AS log_count
FROM s WHERE NOT (level IN ('warn', 'error', 'debug') AND value < 5) AND id % 2500 <> 7
GROUP BY 1, 2, 3""",
        "stream_report": _STREAM_REPORT,
        "stream_two_inboxes": f"{_STORED} SELECT {_STORED_ROW} FROM s",
        "store_filter_late_hot": (
            f"{_STORED} SELECT {_STORED_ROW} FROM s WHERE attr_user_id = '42'"
        ),
        "store_ids": f"""{_STORED}
SELECT row_number() OVER (
  ORDER BY CASE WHEN id % 10 = 3 THEN 0 WHEN id % 10 > 3 THEN 1 ELSE 2 END, s.id) AS id,
  {_STORED_ROW} FROM s""",
        "stream_row_limit": f"""{_STORED}
SELECT row_number() OVER (
  ORDER BY CASE WHEN id % 10 = 3 THEN 0 WHEN id % 10 > 3 THEN 1 ELSE 2 END, s.id) AS id,
  true AS fits, {_STORED_ROW} FROM s""",
    }
    for group_by in (None, "service", "level"):
        for bucket in INTERVALS:
            found[f"agg_raw_{group_by or 'none'}_{bucket}"] = _counts(bucket, group_by)
    return found
