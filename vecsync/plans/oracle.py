"""Independent DuckDB SQL for each registered query (the correctness oracle)."""
from __future__ import annotations

from . import derive
from . import sqlfrag as S

ORACLE: dict[str, str] = {}

ORACLE["completion_after_backfill"] = f"""
WITH u AS (
  SELECT d.doc_id, d.text, d.lang, e.embedding AS text_vector
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id
), c AS (
  SELECT *, CASE WHEN text_vector IS NULL THEN {S.basic_clean('text')} END AS cl FROM u
), s AS (
  SELECT lang, CASE WHEN text_vector IS NOT NULL THEN 'present'
                    WHEN cl = '' THEN 'skipped'
                    ELSE replace({S.vector_status(S.mock_embedding('cl', derive.DIMENSION), derive.DIMENSION)}, 'ok', 'created')
               END AS st
  FROM c
), g AS (
  SELECT lang, count(*) AS total_rows,
         count(*) FILTER (WHERE st <> 'present') AS null_before,
         count(*) FILTER (WHERE st = 'created') AS vectors_created,
         count(*) FILTER (WHERE st = 'skipped') AS skipped_blank,
         count(*) FILTER (WHERE st NOT IN ('present', 'created', 'skipped')) AS invalid_vectors,
         count(*) FILTER (WHERE st NOT IN ('present', 'created')) AS null_after
  FROM s GROUP BY lang
)
SELECT lang, total_rows, null_before, vectors_created, skipped_blank, invalid_vectors, null_after,
       {S.completion_pct('null_before', 'total_rows')} AS completion_before,
       {S.completion_pct('null_after', 'total_rows')} AS completion_after
FROM g
"""


# ---------------------------------------------------------------------------
# shared SQL pieces
# ---------------------------------------------------------------------------
def _lit(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int):
        return str(v)
    return S.q(v)


ROUTING_CTE = "routing(config_order, database, database_name, schema, \"table\", text_column, " \
    "id_column, vector_column, model_column, embedding_config, cleaning_enabled, cleaning_config) AS " \
    "(VALUES " + ", ".join("(" + ", ".join(_lit(v) for v in row) + ")"
                           for row in derive.ROUTING_ROWS) + ")"

ROUTE_KEYS_CTE = """route_keys AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY _db, schema, "table" ORDER BY config_order) AS _rn
    FROM (SELECT database AS _db, * FROM routing
          UNION SELECT database_name AS _db, * FROM routing) a
  ) b WHERE _rn = 1
)"""

TEXT_ROWS_CTE = """text_rows AS (
  SELECT 'documents' AS "table", CAST(doc_id AS VARCHAR) AS row_id, text FROM documents
  UNION ALL SELECT 'pages', CAST(page_id AS VARCHAR), html FROM pages
  UNION ALL SELECT 'conversations', CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR), text
            FROM conversations
  UNION ALL SELECT 'benchmark', CAST(item_id AS VARCHAR), text FROM benchmark
  UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), p_name FROM part
)"""

ROUTED_TEXTS_CTE = f"""routed_texts AS (
  SELECT t.*, k.cleaning_enabled, k.cleaning_config
  FROM text_rows t JOIN route_keys k
    ON k._db = '{derive.DATABASE}' AND k.schema = '{derive.SCHEMA}' AND k."table" = t."table"
)"""


def clean_by_config(t: str) -> str:
    return (f"CASE WHEN coalesce(cleaning_enabled, FALSE) THEN CASE "
            f"WHEN cleaning_config = 'basic_text' THEN {S.basic_clean(t)} "
            f"WHEN cleaning_config = 'html_to_text' THEN {S.basic_clean(S.html_clean(t))} "
            f"WHEN cleaning_config = 'markdown_to_text' THEN {S.basic_clean(S.markdown_clean(t))} "
            f"ELSE {S.basic_clean(t)} END ELSE {t} END")


K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"

# expected feed fields, computed straight from events (independent of JSON)
FEED_CTE = f"""ev AS (
  SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, {K} AS k,
    CASE WHEN event_type IN ('click', 'purchase') THEN 'documents' WHEN event_type = 'view' THEN 'pages'
         WHEN event_type = 'signup' THEN 'conversations' ELSE 'audit_log' END AS "table",
    CASE WHEN {K} < 25 THEN 'INSERT' WHEN {K} >= 90 THEN 'DELETE' ELSE 'UPDATE' END AS operation,
    CASE WHEN {K} < 50 THEN '{derive.DATABASE}' ELSE 'primary' END AS database
  FROM events
), feed AS (
  SELECT *, '{derive.SCHEMA}' AS schema, user_id AS row_id,
    CASE WHEN operation <> 'DELETE' THEN 'text ' || CAST(CAST(floor(k / 3) AS BIGINT) AS VARCHAR) END AS new_text,
    CASE WHEN operation = 'INSERT' THEN NULL
         WHEN k < 60 THEN 'text ' || CAST(CAST(floor(k / 3) - 1 AS BIGINT) AS VARCHAR)
         ELSE 'text ' || CAST(CAST(floor(k / 3) AS BIGINT) AS VARCHAR) END AS old_text,
    (operation = 'INSERT' AND k BETWEEN 20 AND 24) AS has_new_vector
  FROM ev WHERE k < 96
)"""

ROUTED_FEED_CTE = """routed_feed AS (
  SELECT f.*, k._db, k.database AS config_name, k.config_order, k.text_column, k.vector_column
  FROM feed f JOIN route_keys k ON k._db = f.database AND k.schema = f.schema AND k."table" = f."table"
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ---------------------------------------------------------------------------
ORACLE["completion_after_backfill_native"] = ORACLE["completion_after_backfill"]
ORACLE["scan_text_table"] = "SELECT doc_id AS row_id, text FROM documents"
ORACLE["scan_multi_target"] = """
SELECT conv_id, turn, 'role' AS text_column, role AS text FROM conversations
UNION ALL SELECT conv_id, turn, 'text', text FROM conversations"""
ORACLE["clean_basic"] = f"SELECT doc_id, {S.basic_clean('text')} AS cleaned FROM documents"
ORACLE["clean_markdown"] = f"SELECT doc_id, {S.markdown_clean('text')} AS cleaned FROM documents"
ORACLE["clean_html"] = f"SELECT page_id, {S.html_clean('html')} AS cleaned FROM pages"
ORACLE["clean_html_parser"] = ORACLE["clean_html"]
ORACLE["clean_steps"] = f"""
SELECT page_id, {S.basic_clean(S.markdown_clean(S.html_clean('html')))} AS cleaned,
       'web_cleanup:html_to_markdown->markdown_cleanup->basic_cleanup' AS config_name,
       'unicode_normalize' AS skipped_steps
FROM pages"""
ORACLE["clean_presets"] = f"""
SELECT doc_id, 'basic_text' AS preset, {S.basic_clean('text')} AS cleaned FROM documents
UNION ALL SELECT doc_id, 'html_to_text', {S.basic_clean(S.html_clean('text'))} FROM documents
UNION ALL SELECT doc_id, 'markdown_to_text', {S.basic_clean(S.markdown_clean('text'))} FROM documents"""
ORACLE["clean_routed"] = with_(ROUTING_CTE, ROUTE_KEYS_CTE, TEXT_ROWS_CTE, ROUTED_TEXTS_CTE) + \
    f'SELECT "table", row_id, {clean_by_config("text")} AS cleaned FROM routed_texts'
ORACLE["cleaned_with_provenance"] = f"""
SELECT doc_id, {S.basic_clean('text')} AS text_cleaned,
       'basic_text:basic_cleanup' AS text_cleaning_config,
       TIMESTAMP '{derive.AS_OF}' AS text_cleaned_at
FROM documents"""
ORACLE["clean_extra"] = f"""
SELECT doc_id, lower(text) AS lowered,
       regexp_replace(text, '[!-/:-@\\[-`{{-~]', '', 'g') AS no_punct,
       regexp_replace(text, '\\n{{3,}}', chr(10) || chr(10), 'g') AS newlines_limited,
       trim(regexp_replace(text, {S.q(S.WS + '+')}, ' ', 'g')) AS ws_normalized
FROM documents"""

ORACLE["snapshot_diff"] = """
WITH old AS (
  SELECT doc_id, CASE WHEN lang = 'de' THEN text || ' (rev. 1)' ELSE text END AS text
  FROM documents WHERE source <> 'src0'
  UNION ALL SELECT -item_id - 1, text FROM benchmark
)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id,
  CASE WHEN o.doc_id IS NULL THEN 'INSERT' WHEN n.doc_id IS NULL THEN 'DELETE'
       WHEN o.text IS DISTINCT FROM n.text THEN 'UPDATE' ELSE 'UNCHANGED' END AS operation,
  length(o.text) AS old_len, length(n.text) AS new_len
FROM old o FULL OUTER JOIN documents n ON o.doc_id = n.doc_id"""

ORACLE["snapshot_diff_texts"] = ORACLE["snapshot_diff"]
ORACLE["snapshot_diff_tree"] = ORACLE["snapshot_diff"]

ORACLE["feed_parse"] = with_(FEED_CTE) + """
SELECT event_id, database, schema, "table", operation, row_id, new_text, old_text,
       'default' AS config_key FROM feed"""
ORACLE["feed_valid"] = f"""
SELECT event_id, {K} < 96 AS is_valid,
       CASE WHEN {K} >= 98 THEN NULL WHEN {K} >= 96 THEN 'table' ELSE '' END AS missing_fields
FROM events"""
ORACLE["feed_rejects"] = f"""
SELECT event_id, CASE WHEN {K} >= 98 THEN 'malformed_json' ELSE 'missing_fields:table' END
       AS reject_reason
FROM events WHERE {K} >= 96"""
ORACLE["route_events"] = with_(ROUTING_CTE, ROUTE_KEYS_CTE, FEED_CTE, ROUTED_FEED_CTE) + """
SELECT event_id, database, "table", config_name, config_order, text_column, vector_column
FROM routed_feed"""
ORACLE["unrouted_events"] = with_(ROUTING_CTE, ROUTE_KEYS_CTE, FEED_CTE) + """
SELECT event_id, database, "table" FROM feed f
WHERE NOT EXISTS (SELECT 1 FROM route_keys k
                  WHERE k._db = f.database AND k.schema = f.schema AND k."table" = f."table")"""
ORACLE["needs_vectorization"] = with_(ROUTING_CTE, ROUTE_KEYS_CTE, FEED_CTE, ROUTED_FEED_CTE) + """
SELECT event_id, "table", operation, row_id,
  (operation = 'INSERT' AND NOT has_new_vector)
  OR (operation = 'UPDATE' AND old_text IS DISTINCT FROM new_text) AS needs_vectorization
FROM routed_feed"""
ORACLE["debounce_events"] = with_(FEED_CTE) + """
SELECT event_id, "table", row_id, ts FROM (
  SELECT *, lag(ts) OVER (PARTITION BY "table", row_id ORDER BY ts) AS prev FROM feed) x
WHERE prev IS NULL OR epoch_us(ts) - epoch_us(prev) >= CAST(3600000000 AS BIGINT)"""
ORACLE["latest_event"] = with_(FEED_CTE) + """
SELECT event_id, "table", row_id, operation FROM (
  SELECT *, row_number() OVER (PARTITION BY "table", row_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM feed) x WHERE rn = 1"""
ORACLE["backfill_set"] = """
SELECT d.doc_id, 'low' AS priority FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id AND e.embedding IS NOT NULL)"""
ORACLE["skip_blank"] = with_(ROUTING_CTE, ROUTE_KEYS_CTE, TEXT_ROWS_CTE, ROUTED_TEXTS_CTE) + f"""
SELECT "table", row_id,
  CASE WHEN {S.basic_clean('text')} = '' OR {clean_by_config('text')} = '' THEN 'skipped'
       ELSE 'embed' END AS status
FROM routed_texts"""
ORACLE["conditional_backfill"] = """
SELECT d.doc_id, d.lang, l.quality, l.toxic
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id
LEFT JOIN labels l ON l.doc_id = d.doc_id
WHERE e.embedding IS NULL AND l.quality = 1 AND l.toxic = 0 AND d.lang IN ('en', 'de')"""
ORACLE["outdated_model"] = f"""
SELECT vec_id AS doc_id, '{derive.PREVIOUS_MODEL}' AS text_embedding_model
FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id
WHERE e.embedding IS NOT NULL AND e.label = 0"""
_LOG_STATUS = ("CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' THEN 'retry' "
               "WHEN event_type = 'view' THEN 'skipped' ELSE 'success' END")
ORACLE["recent_log"] = "\nUNION ALL\n".join(
    f"SELECT {_LOG_STATUS} AS status, count(*) AS n, '{iv}' AS look_back FROM events "
    f"WHERE CAST(ts AS TIMESTAMP) > TIMESTAMP '{derive.AS_OF}' - INTERVAL {n} {u} GROUP BY 1"
    for iv, n, u in (("1 HOURS", 1, "HOUR"), ("24 HOURS", 24, "HOUR"), ("7 DAYS", 7, "DAY")))
ORACLE["input_quality"] = with_(TEXT_ROWS_CTE) + f"""
SELECT "table", CASE WHEN text IS NULL THEN 'null_text' WHEN {S.basic_clean('text')} = '' THEN 'blank'
                     ELSE 'ok' END AS quality, count(*) AS n
FROM text_rows GROUP BY ALL"""


def _desired_sql() -> str:
    rows = []
    for (order, _db, _pdb, _sc, table, text, _id, vec, model, _emb, clean, _cfg) in derive.ROUTING_ROWS:
        vec = vec or f"{text}_vector"
        model = model or f"{text}_embedding_model"
        items = [(vec, "vector"), (model, "model"), (f"{vec}_created_at", "timestamp")]
        if clean:
            items += [(f"{text}_cleaned", "cleaned"), (f"{text}_cleaned_config", "cleaned_config"),
                      (f"{text}_cleaned_at", "cleaned_timestamp")]
        rows += [f"({order}, '{table}', '{text}', '{c}', '{r}')" for c, r in items]
    return ("WITH desired(config_order, \"table\", text_column, column_name, role) AS (VALUES "
            + ", ".join(rows) + "), " + TEXT_ROWS_CTE + """
SELECT d.*, c.rows_to_fill FROM desired d
LEFT JOIN (SELECT "table", count(*) AS rows_to_fill FROM text_rows GROUP BY 1) c USING ("table")""")


ORACLE["desired_columns"] = _desired_sql()


# ---------------------------------------------------------------------------
# batch 3
# ---------------------------------------------------------------------------
_TABLE_OF_USER = ("CASE WHEN user_id < 50 THEN 'documents' WHEN user_id < 100 THEN 'pages' "
                  "ELSE 'conversations' END")
LOG_CTE = f"""log AS (
  SELECT event_id AS log_id, CAST(ts AS TIMESTAMP) AS created_at,
    '{derive.DATABASE}' AS database_name, '{derive.SCHEMA}' AS schema_name,
    {_TABLE_OF_USER} AS table_name, '{{"id":' || CAST(user_id AS VARCHAR) || '}}' AS row_id,
    'text' AS text_column, 'text_vector' AS vector_column,
    CASE WHEN event_type = 'purchase' THEN '{derive.PREVIOUS_MODEL}' ELSE '{derive.CURRENT_MODEL}' END
      AS embedding_model,
    value AS processing_time, {_LOG_STATUS} AS status,
    CASE WHEN event_type = 'error' THEN 'embedding request failed' END AS error_message,
    {K} AS text_length,
    CASE WHEN event_type IN ('click', 'purchase') THEN {derive.DIMENSION} END AS vector_dimension,
    user_id
  FROM events
)"""

HISTORY_CTE = """history AS (
  SELECT max(created_at) AS checked_at, database_name, schema_name, table_name, vector_column,
    'default' AS config_key,
    CAST(count(*) FILTER (WHERE status <> 'success') AS BIGINT) AS null_vectors,
    CAST(count(*) AS BIGINT) AS total_rows,
    max(created_at) FILTER (WHERE status = 'success') AS last_vectorized_at
  FROM log GROUP BY database_name, schema_name, table_name, vector_column, CAST(created_at AS DATE)
)"""

TASKS_CTE = f"""tasks AS (
  SELECT *, CASE WHEN status <> 'pending' THEN created_at END AS started_at,
    CASE WHEN status IN ('completed', 'failed')
         THEN created_at + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) END AS completed_at
  FROM (
    SELECT event_id AS id, 't-' || CAST(event_id AS VARCHAR) AS task_id,
      '{derive.DATABASE}' AS database_name, '{derive.SCHEMA}' AS schema_name,
      {_TABLE_OF_USER} AS table_name, '{{"id":' || CAST(user_id AS VARCHAR) || '}}' AS row_id,
      'default' AS config_key,
      CASE WHEN event_type = 'purchase' THEN 'high' WHEN event_type = 'click' THEN 'medium'
           ELSE 'low' END AS priority,
      CAST(least(floor({K} / 25), 3) AS INTEGER) AS retry_count, 3 AS max_retries,
      CAST(ts AS TIMESTAMP) AS created_at,
      CAST(ts AS TIMESTAMP) + to_minutes(CAST({K} AS BIGINT)) AS scheduled_at,
      CASE WHEN event_type = 'view' THEN 'completed' WHEN event_type = 'error' THEN 'failed'
           WHEN event_type = 'purchase' THEN 'processing' ELSE 'pending' END AS status,
      value
    FROM events) t
)"""

DRIFT_CTE = """drift AS (
  SELECT created_at AS detected_at, database_name, schema_name, table_name,
    CASE WHEN text_length < 30 THEN 'missing_column' WHEN text_length < 60 THEN 'wrong_type'
         ELSE 'dimension_mismatch' END AS drift_type, text_length >= 50 AS resolved
  FROM log WHERE status = 'failed'
)"""

COLL_CTE = """coll AS (
  SELECT created_at AS occurred_at, database_name, schema_name, table_name,
    'text_vector_v' || CAST(text_length AS VARCHAR) AS desired_column_name,
    CASE WHEN text_length < 20 THEN 'critical' WHEN text_length < 50 THEN 'warning'
         WHEN text_length < 80 THEN 'info' ELSE 'safe' END AS collision_severity
  FROM log WHERE status = 'retry'
)"""

USER_CTE = f"""usr AS (
  SELECT d.doc_id, d.text, d.lang, d.source, e.embedding AS text_vector,
    CASE WHEN e.vec_id IS NULL THEN NULL WHEN e.label = 0 THEN '{derive.PREVIOUS_MODEL}'
         ELSE '{derive.CURRENT_MODEL}' END AS text_embedding_model,
    CASE WHEN e.vec_id IS NOT NULL THEN TIMESTAMP '{derive.VECTORS_CREATED_AT}' END
      AS text_vector_created_at
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id
)"""

TNC_CTE = """tnc AS (
  SELECT 'documents' AS table_name, count(*) FILTER (WHERE text_vector IS NULL) AS null_vectors,
         count(*) AS total_rows FROM usr
  UNION ALL
  SELECT "table", count(*), count(*) FROM text_rows WHERE "table" <> 'documents' GROUP BY 1
)"""


def checksum(v: str) -> str:
    return f"round(list_sum(list_transform({v}, lambda x: CAST(x AS DOUBLE))), 4)"


_AS_OF = f"TIMESTAMP '{derive.AS_OF}'"

ORACLE["null_vector_counts"] = with_(USER_CTE) + """
SELECT lang, count(*) FILTER (WHERE text_vector IS NULL) AS null_vectors, count(*) AS total_rows
FROM usr GROUP BY lang"""
ORACLE["completion"] = with_(USER_CTE) + f"""
SELECT lang, {S.completion_pct('n', 't')} AS completion_percentage FROM (
  SELECT lang, count(*) FILTER (WHERE text_vector IS NULL) AS n, count(*) AS t FROM usr GROUP BY lang)"""
ORACLE["completeness_incremental"] = with_(USER_CTE) + f"""
SELECT lang, null_vectors, total_rows, {S.completion_pct('null_vectors', 'total_rows')}
  AS completion_percentage
FROM (SELECT lang, count(*) FILTER (WHERE text_vector IS NULL) AS null_vectors,
             count(*) AS total_rows FROM usr GROUP BY lang)"""
ORACLE["health_sketches"] = with_(LOG_CTE) + """
, w AS (SELECT 'all' AS look_back, * FROM log UNION ALL
        SELECT 'week', * FROM log WHERE CAST(created_at AS DATE) >
          (SELECT max(CAST(created_at AS DATE)) FROM log) - INTERVAL 7 DAY)
SELECT look_back, table_name, count(*) AS total,
  count(*) FILTER (WHERE status = 'success') AS successful,
  count(*) FILTER (WHERE status = 'failed') AS failed,
  round(avg(processing_time) FILTER (WHERE status = 'success'), 6) AS avg_ms,
  max(created_at) AS last_vectorization, count(DISTINCT embedding_model) AS distinct_models,
  TRUE AS p95_within_bounds, TRUE AS rows_within_bounds
FROM w GROUP BY look_back, database_name, schema_name, table_name"""
ORACLE["check_null_vectors"] = with_(USER_CTE, TEXT_ROWS_CTE, TNC_CTE) + f"""
SELECT table_name, 'text_vector' AS vector_column, null_vectors, total_rows,
  {S.completion_pct('null_vectors', 'total_rows')} AS completion_percentage,
  'success' AS status,
  null_vectors > 0 AS backfill_requested
FROM tnc"""
ORACLE["backfill_requests"] = with_(USER_CTE, TEXT_ROWS_CTE, TNC_CTE) + """
SELECT table_name, 'text_vector' AS vector_column, null_vectors AS null_count, 'low' AS priority
FROM tnc WHERE null_vectors > 0"""
ORACLE["null_status_daily"] = with_(LOG_CTE, HISTORY_CTE, USER_CTE, TEXT_ROWS_CTE, TNC_CTE) + f"""
, allrows AS (
  SELECT table_name, checked_at, null_vectors, total_rows, vector_column FROM history
  UNION ALL
  SELECT table_name, TIMESTAMP '2024-01-30 23:59:59', CAST(null_vectors AS BIGINT),
         CAST(total_rows AS BIGINT), 'text_vector' FROM tnc
)
SELECT table_name, CAST(checked_at AS DATE) AS day, checked_at, null_vectors, total_rows,
  {S.completion_pct('null_vectors', 'total_rows')} AS completion_percentage
FROM (SELECT *, row_number() OVER (PARTITION BY table_name, vector_column, CAST(checked_at AS DATE)
                                   ORDER BY checked_at DESC) AS rn FROM allrows) x
WHERE rn = 1"""
ORACLE["system_health"] = with_(LOG_CTE) + f"""
SELECT count(*) AS total_vectorizations,
  count(*) FILTER (WHERE status = 'success') AS successful,
  count(*) FILTER (WHERE status = 'failed') AS failed,
  count(*) FILTER (WHERE created_at > {_AS_OF} - INTERVAL 1 HOUR) AS last_hour,
  round(avg(processing_time) FILTER (WHERE status = 'success'), 6) AS avg_processing_time_ms,
  max(created_at) AS last_vectorization
FROM log WHERE created_at > {_AS_OF} - INTERVAL 24 HOUR"""
ORACLE["system_health_full"] = with_(LOG_CTE, HISTORY_CTE, DRIFT_CTE, COLL_CTE) + f"""
, nvs AS (SELECT *, {S.completion_pct('null_vectors', 'total_rows')} AS completion_percentage
          FROM history WHERE checked_at > {_AS_OF} - INTERVAL 24 HOUR)
, keys AS (SELECT DISTINCT database_name, schema_name, table_name FROM nvs)
, vl AS (SELECT * FROM log WHERE created_at > {_AS_OF} - INTERVAL 24 HOUR
         AND (database_name, schema_name, table_name) IN (SELECT * FROM keys))
SELECT
  (SELECT count(vector_column) FROM nvs) AS vectors_populated,
  (SELECT count(*) FILTER (WHERE null_vectors > 0) FROM nvs) AS tables_with_nulls,
  (SELECT round(CAST(avg(completion_percentage) AS DOUBLE), 6) FROM nvs) AS avg_completion_percentage,
  (SELECT count(DISTINCT embedding_model) FROM vl) AS unique_models,
  (SELECT count(*) FILTER (WHERE status = 'failed') FROM vl) AS failed_vectorizations,
  (SELECT count(*) FILTER (WHERE status = 'success') FROM vl) AS successful_vectorizations,
  (SELECT round(avg(processing_time) FILTER (WHERE status = 'success'), 6) FROM vl) AS avg_processing_time_ms,
  (SELECT round(quantile_cont(processing_time, 0.95) FILTER (WHERE status = 'success'), 6) FROM vl)
    AS p95_processing_time_ms,
  (SELECT count(*) FILTER (WHERE NOT resolved) FROM drift
   WHERE (database_name, schema_name, table_name) IN (SELECT * FROM keys)) AS unresolved_drift_issues,
  (SELECT count(*) FILTER (WHERE collision_severity = 'critical') FROM coll
   WHERE occurred_at > {_AS_OF} - INTERVAL 7 DAY
     AND (database_name, schema_name, table_name) IN (SELECT * FROM keys)) AS critical_collisions,
  (SELECT max(checked_at) FROM nvs) AS last_null_check,
  (SELECT max(created_at) FROM vl) AS last_vectorization,
  (SELECT max(detected_at) FROM drift
   WHERE (database_name, schema_name, table_name) IN (SELECT * FROM keys)) AS last_drift_detection"""
ORACLE["status_summary"] = with_(LOG_CTE) + """
SELECT table_name, count(*) AS total,
  count(*) FILTER (WHERE status = 'success') AS successful,
  count(*) FILTER (WHERE status = 'failed') AS failed,
  count(*) FILTER (WHERE status = 'retry') AS retried,
  count(*) FILTER (WHERE status = 'skipped') AS skipped,
  count(DISTINCT error_message) FILTER (WHERE status = 'failed') AS n_failure_reasons,
  round(coalesce(count(*) FILTER (WHERE status = 'success') * 100.0 / count(*), 0), 6) AS success_rate
FROM log GROUP BY table_name"""
ORACLE["failure_reasons"] = with_(LOG_CTE) + """
SELECT table_name, coalesce(error_message, '') AS reason, count(*) AS failures
FROM log WHERE status = 'failed' GROUP BY ALL"""
ORACLE["throughput"] = with_(LOG_CTE) + """
SELECT run, processed, successful, round(secs, 6) AS elapsed_s,
  round(CASE WHEN secs > 0 THEN processed / secs END, 6) AS docs_per_s,
  round(successful * 100.0 / processed, 6) AS success_pct
FROM (SELECT CAST(created_at AS DATE) AS run, count(*) AS processed,
             count(*) FILTER (WHERE status = 'success') AS successful,
             (epoch_us(max(created_at)) - epoch_us(min(created_at))) / 1e6 AS secs
      FROM log GROUP BY 1)"""
ORACLE["queue_depth"] = with_(TASKS_CTE) + \
    "SELECT status, priority, count(*) AS tasks FROM tasks GROUP BY ALL"
ORACLE["latest_status"] = with_(LOG_CTE, HISTORY_CTE) + """
SELECT table_name, vector_column, checked_at, null_vectors, total_rows FROM (
  SELECT *, rank() OVER (PARTITION BY database_name, schema_name, table_name, vector_column
                         ORDER BY checked_at DESC) AS r FROM history) x WHERE r = 1"""
ORACLE["completion_summary"] = with_(LOG_CTE, HISTORY_CTE) + f"""
SELECT database_name, schema_name, table_name, vector_column, config_key, null_vectors, total_rows,
  pct AS completion_percentage, last_vectorized_at, checked_at,
  CASE WHEN pct >= 95 THEN 'healthy' WHEN pct >= 80 THEN 'warning' ELSE 'critical' END AS health_status,
  CASE WHEN last_vectorized_at < {_AS_OF} - INTERVAL 1 HOUR THEN 'stale'
       WHEN last_vectorized_at < {_AS_OF} - INTERVAL 10 MINUTE THEN 'recent' ELSE 'current' END
    AS freshness_status
FROM (SELECT *, {S.completion_pct('null_vectors', 'total_rows')} AS pct,
             rank() OVER (PARTITION BY database_name, schema_name, table_name, vector_column
                          ORDER BY checked_at DESC) AS r FROM history) x
WHERE r = 1"""
ORACLE["recent_history"] = with_(LOG_CTE, COLL_CTE) + """
SELECT table_name, rn, occurred_at, desired_column_name, collision_severity FROM (
  SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY occurred_at DESC, desired_column_name)
    AS rn FROM coll) x WHERE rn <= 5"""
ORACLE["next_tasks"] = with_(TASKS_CTE) + f"""
SELECT id, priority, scheduled_at, table_name FROM tasks
WHERE status = 'pending' AND scheduled_at <= {_AS_OF}
ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END,
         scheduled_at, id
LIMIT 50"""
ORACLE["retry_schedule"] = with_(TASKS_CTE) + """
SELECT id, retry_count,
  CASE WHEN retry_count >= 3 THEN 'dead' ELSE 'retry' END AS decision,
  CASE WHEN retry_count < 3 THEN retry_count + 1 END AS next_retry_count,
  CASE WHEN retry_count < 3 THEN 5.0 * pow(2.0, retry_count) END AS delay_s,
  CASE WHEN retry_count < 3
       THEN completed_at + to_microseconds(CAST(5000000 * pow(2, retry_count) AS BIGINT)) END
    AS retry_at
FROM tasks WHERE status = 'failed'"""
ORACLE["dead_letter"] = with_(TASKS_CTE) + """
SELECT id, task_id, table_name, row_id, retry_count FROM tasks
WHERE status = 'failed' AND retry_count >= max_retries"""
ORACLE["attempt_history"] = with_(LOG_CTE) + """
SELECT log_id, table_name, row_id,
  row_number() OVER w AS attempt_no,
  coalesce(sum(CAST(status = 'failed' AS INTEGER)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    AS failures_before
FROM log WINDOW w AS (PARTITION BY table_name, row_id ORDER BY created_at, log_id)"""
ORACLE["embed_deterministic"] = f"""
SELECT doc_id, {derive.DIMENSION} AS dim, {checksum(S.mock_embedding('text', derive.DIMENSION))} AS checksum
FROM documents"""
ORACLE["embed_udf"] = f"""
SELECT doc_id, {derive.DIMENSION} AS dim, {checksum(S.mock_embedding('c', derive.DIMENSION))} AS checksum
FROM (SELECT doc_id, {S.basic_clean('text')} AS c FROM documents)"""
ORACLE["embed_packed"] = ORACLE["embed_udf"]
ORACLE["embed_http"] = ORACLE["embed_udf"]
ORACLE["vectorization_log_append"] = with_(LOG_CTE) + """
SELECT CAST(created_at AS DATE) AS log_date, table_name, status, count(*) AS n,
  max(created_at) AS last
FROM log GROUP BY ALL"""
ORACLE["embed_in_waves"] = ORACLE["embed_udf"]
ORACLE["embed_cached"] = f"""
WITH t AS (SELECT doc_id, source, {S.basic_clean('text')} AS c FROM documents),
old AS (SELECT DISTINCT c FROM t WHERE source <> 'src0')
SELECT doc_id, CASE WHEN old.c IS NULL THEN 'success' ELSE 'hit' END AS outcome,
  CASE WHEN old.c IS NULL THEN 1 ELSE 0 END AS sent,
  {derive.DIMENSION} AS dim, {checksum(S.mock_embedding('t.c', derive.DIMENSION))} AS checksum
FROM t LEFT JOIN old ON t.c = old.c"""
ORACLE["embed_with_failures"] = f"""
SELECT doc_id, CASE length(c) % 50 WHEN 7 THEN 'dead' WHEN 9 THEN 'retry' ELSE 'success' END AS outcome,
  CASE length(c) % 50 WHEN 7 THEN 'HTTP 422: text refused' WHEN 9 THEN 'HTTP 503: busy' END AS message,
  CASE WHEN length(c) % 50 NOT IN (7, 9) THEN {derive.DIMENSION} END AS dim,
  CASE WHEN length(c) % 50 NOT IN (7, 9)
       THEN {checksum(S.mock_embedding('c', derive.DIMENSION))} END AS checksum
FROM (SELECT doc_id, {S.basic_clean('text')} AS c FROM documents)"""
ORACLE["write_back"] = with_(USER_CTE) + f"""
SELECT doc_id,
  CASE WHEN text_vector IS NULL AND c <> '' THEN '{derive.CURRENT_MODEL}' ELSE text_embedding_model END
    AS text_embedding_model,
  CASE WHEN text_vector IS NULL AND c <> '' THEN {_AS_OF} ELSE text_vector_created_at END
    AS text_vector_created_at,
  CASE WHEN text_vector IS NULL AND c <> '' THEN {derive.DIMENSION} ELSE len(text_vector) END AS dim,
  CASE WHEN text_vector IS NULL AND c <> '' THEN {checksum(S.mock_embedding('c', derive.DIMENSION))}
       ELSE {checksum('text_vector')} END AS checksum
FROM (SELECT *, {S.basic_clean('text')} AS c FROM usr)"""
ORACLE["vectorization_log_rows"] = f"""
SELECT '{{"id":' || CAST(doc_id AS VARCHAR) || '}}' AS row_id,
  CASE WHEN c = '' THEN 'skipped' ELSE 'success' END AS status,
  length(text) AS text_length,
  CASE WHEN c = '' THEN NULL ELSE {derive.DIMENSION} END AS vector_dimension,
  '{derive.CURRENT_MODEL}' AS embedding_model
FROM (SELECT d.*, {S.basic_clean('d.text')} AS c FROM documents d
      WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id))"""
ORACLE["vector_validity"] = with_(USER_CTE) + f"""
SELECT {S.vector_status('text_vector', derive.DIMENSION)} AS vector_status, count(*) AS n
FROM usr GROUP BY 1"""
ORACLE["parse_responses"] = f"""
SELECT doc_id, 0 AS pos, 4 AS dim, {checksum(S.mock_embedding('text', 4))} AS checksum
FROM documents"""
ORACLE["parse_errors"] = with_(LOG_CTE) + """
SELECT log_id, CASE WHEN text_length < 90 THEN 'failure ' || CAST(text_length AS VARCHAR)
                    ELSE '{"code":' || CAST(text_length AS VARCHAR) || '}' END AS message
FROM log WHERE status = 'failed'"""
ORACLE["classify_failures"] = with_(LOG_CTE) + """
SELECT log_id, status_code,
  CASE WHEN status_code = 429 THEN 'rate_limit' WHEN status_code IN (401, 403) THEN 'authentication'
       WHEN status_code = 422 THEN 'validation' WHEN status_code = 0 THEN 'network'
       WHEN status_code >= 500 THEN 'server' ELSE 'api' END AS error_class,
  status_code NOT IN (401, 403, 422) AS retryable,
  CASE WHEN status_code = 429 THEN coalesce(retry_after, 60) END AS wait_s
FROM (SELECT log_id,
        CASE WHEN text_length < 10 THEN 429 WHEN text_length < 20 THEN 401 WHEN text_length < 25 THEN 403
             WHEN text_length < 35 THEN 422 WHEN text_length < 60 THEN 500 WHEN text_length < 80 THEN 503
             ELSE 0 END AS status_code,
        CASE WHEN text_length BETWEEN 5 AND 9 THEN text_length END AS retry_after
      FROM log WHERE status = 'failed')"""


# ---------------------------------------------------------------------------
# batch 4: catalog
# ---------------------------------------------------------------------------
_GIVEN = ("region nation customer supplier part orders lineitem events embeddings pages "
          "benchmark labels conversations").split()
_USER_COLS = [("doc_id", "bigint"), ("text", "text"), ("lang", "text"), ("source", "text"),
              ("text_vector", "vector"), ("text_embedding_model", "text"),
              ("text_vector_created_at", "timestamp")]
CAT_CTE = ("cat0 AS (\n  SELECT DISTINCT table_name, column_name, CASE WHEN data_type = 'VARCHAR' THEN 'text' "
           "WHEN data_type = 'INTEGER' THEN 'integer' WHEN data_type = 'BIGINT' THEN 'bigint' "
           "WHEN data_type IN ('TIMESTAMP', 'TIMESTAMP_NS', 'TIMESTAMP_US', 'TIMESTAMP_MS') THEN 'timestamp' "
           "WHEN data_type = 'BOOLEAN' THEN 'boolean' "
           "WHEN data_type IN ('FLOAT[]', 'DOUBLE[]') THEN 'vector' ELSE 'unknown' END AS data_type, "
           "CAST(ordinal_position AS INTEGER) AS ordinal_position\n  FROM information_schema.columns "
           "WHERE table_name IN (" + ", ".join(S.q(t) for t in _GIVEN) + ")\n  UNION ALL SELECT * FROM (VALUES "
           + ", ".join(f"('documents', '{c}', '{t}', {i})" for i, (c, t) in enumerate(_USER_COLS, 1))
           + ") v(table_name, column_name, data_type, ordinal_position)\n), counts AS (\n  "
           + "\n  UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}"
                                  for t in _GIVEN + ["documents"])
           + "\n), dims AS (\n  SELECT 'embeddings' AS table_name, 'embedding' AS column_name, "
           "CASE WHEN min(len(embedding)) = max(len(embedding)) THEN max(len(embedding)) END AS dimension "
           "FROM embeddings\n  UNION ALL SELECT 'documents', 'text_vector', CASE WHEN min(len(e.embedding)) = "
           "max(len(e.embedding)) THEN max(len(e.embedding)) END FROM documents d JOIN embeddings e "
           "ON e.vec_id = d.doc_id\n), cat AS (\n  SELECT '" + derive.DATABASE + "' AS database_name, '"
           + derive.SCHEMA + "' AS schema_name, c.*, n.row_count, c.data_type = 'vector' AS is_vector, "
           "CAST(d.dimension AS INTEGER) AS dimension\n  FROM cat0 c LEFT JOIN counts n USING (table_name) "
           "LEFT JOIN dims d USING (table_name, column_name)\n)")

ORACLE["column_catalog"] = with_(CAT_CTE) + """
SELECT table_name, column_name, data_type, ordinal_position, is_vector, dimension, row_count FROM cat"""
ORACLE["vector_tables"] = with_(CAT_CTE) + """
SELECT table_name, array_to_string(list_sort(list(column_name)), ',') AS vector_columns
FROM cat WHERE is_vector GROUP BY table_name"""
ORACLE["table_status"] = with_(CAT_CTE, FEED_CTE) + """
, conf AS (SELECT DISTINCT table_name FROM (
    SELECT * FROM (VALUES ('documents'), ('pages'), ('conversations'), ('benchmark'), ('part')) v(table_name)
    UNION ALL SELECT "table" FROM feed))
, per AS (SELECT table_name, max(row_count) AS row_count,
                 bool_or(column_name LIKE '%\\_vector' ESCAPE '\\') AS hv FROM cat GROUP BY 1)
SELECT c.table_name, p.row_count IS NOT NULL AS exists, coalesce(p.row_count, 0) AS row_count,
       coalesce(p.hv, FALSE) AS has_vector_column
FROM conf c LEFT JOIN per p USING (table_name)"""
ORACLE["missing_components"] = with_(CAT_CTE, FEED_CTE) + """
SELECT DISTINCT "table" AS table_name FROM feed WHERE "table" NOT IN (SELECT table_name FROM cat)"""

_PATTERNS_RX = "(?i)^(?:" + "|".join(
    [r".*_vector$", r".*_embedding$", r".*_cleaned$", r".*_model$", r".*_created_at$",
     r".*_updated_at$", r".*_vector_v\d+$", r".*_embedding_v\d+$"]) + ")"


def _desired_rows_sql() -> str:
    rows = []
    for (order, db, _pdb, sc, table, text, _id, vec, model, emb, clean, _cfg) in derive.ROUTING_ROWS:
        items = [(vec, "vector"), (model, "model"), (f"{vec}_created_at", "timestamp")]
        if clean:
            items += [(f"{text}_cleaned", "cleaned"), (f"{text}_cleaned_config", "cleaned_config"),
                      (f"{text}_cleaned_at", "cleaned_timestamp")]
        rows += [f"('{db}', '{sc}', '{table}', '{text}', '{emb}', '{c}', '{r}')" for c, r in items]
    return ("desired(database_name, schema_name, table_name, text_column, embedding_config, "
            "column_name, role) AS (VALUES " + ", ".join(rows) + ")")


COLL_CTES = [CAT_CTE, LOG_CTE, COLL_CTE, _desired_rows_sql(), """reg AS (
  SELECT v.database_name, v.schema_name, v.table_name, v.column_name AS original_column_name,
         v.column_name AS actual_column_name, 'vector' AS column_type, v.dimension
  FROM cat v WHERE v.is_vector
  UNION ALL
  SELECT v.database_name, v.schema_name, v.table_name, m.column_name, m.column_name, 'model', NULL
  FROM cat v JOIN cat m ON m.table_name = v.table_name
   AND m.column_name = regexp_replace(v.column_name, '_vector$', '') || '_embedding_model'
  WHERE v.is_vector
)""", """hist AS (
  SELECT DISTINCT schema_name, table_name, column_name FROM (
    SELECT schema_name, table_name, original_column_name AS column_name FROM reg
    UNION ALL SELECT schema_name, table_name, actual_column_name FROM reg
    UNION ALL SELECT schema_name, table_name, desired_column_name FROM coll)
)""", f"""cls0 AS (
  SELECT d.*, c.data_type AS existing_column_type, c.is_vector, c.dimension,
    h.column_name IS NOT NULL AS has_history,
    (SELECT list(column_name) FROM cat x WHERE x.table_name = d.table_name) AS existing
  FROM desired d
  LEFT JOIN cat c ON c.table_name = d.table_name AND c.column_name = d.column_name
  LEFT JOIN hist h ON h.schema_name = d.schema_name AND h.table_name = d.table_name
                  AND h.column_name = d.column_name
), cls1 AS (
  SELECT *, CASE WHEN existing_column_type IS NULL THEN 'no_collision'
                 WHEN is_vector THEN 'existing_vector' WHEN has_history THEN 'previous_vectorizer'
                 WHEN regexp_matches(column_name, {S.q(_PATTERNS_RX)}) THEN 'vectorizer_pattern'
                 ELSE 'unrelated_column' END AS collision_type
  FROM cls0
), cls2 AS (
  SELECT *, CASE collision_type WHEN 'no_collision' THEN 'safe'
                 WHEN 'existing_vector' THEN 'critical' WHEN 'previous_vectorizer' THEN 'critical'
                 WHEN 'vectorizer_pattern' THEN 'warning' ELSE 'info' END AS severity,
    list_filter([column_name || '_v2', column_name || '_v3', column_name || '_v4', column_name || '_v5',
                 column_name || '_v6', column_name || '_v7', column_name || '_v8', column_name || '_v9'],
                lambda x: NOT list_contains(coalesce(existing, []), x))[1:3] AS vers
  FROM cls1
), cls3 AS (
  SELECT *, list_filter([column_name || '_2', column_name || '_3', column_name || '_4', column_name || '_5',
                         column_name || '_6', column_name || '_7', column_name || '_8', column_name || '_9'],
                        lambda x: NOT list_contains(coalesce(existing, []), x) AND NOT list_contains(vers, x))
              [1:5 - len(vers)] AS nums
  FROM cls2
), cls AS (
  SELECT *, CASE WHEN severity IN ('critical', 'warning') THEN list_concat(vers, nums,
      list_filter([column_name || '_new', column_name || '_alt', column_name || '_updated', column_name || '_current'],
                  lambda x: NOT list_contains(coalesce(existing, []), x) AND NOT list_contains(vers, x)
                            AND NOT list_contains(nums, x))[1:7 - len(vers) - len(nums)])
      ELSE [] END AS alts,
    collision_type || coalesce(': ' || existing_column_type, '') AS details
  FROM cls3
), res AS (
  SELECT *, CASE WHEN severity = 'safe' THEN column_name
                 ELSE coalesce(alts[1], column_name || '_v2') END AS resolved_column_name,
    CASE WHEN severity = 'safe' THEN 'none' WHEN alts[1] IS NOT NULL THEN 'alternative_name'
         ELSE 'suffix' END AS resolution_strategy,
    severity = 'critical' AS blocked
  FROM cls
)"""]

_PAT_CASE = "CASE " + " ".join(
    f"WHEN regexp_matches(column_name, {S.q('(?i)^(?:' + p + ')')}) THEN {S.q(p)}"
    for p in [r".*_vector$", r".*_embedding$", r".*_cleaned$", r".*_model$", r".*_created_at$",
              r".*_updated_at$", r".*_vector_v\d+$", r".*_embedding_v\d+$"]) + " END"

ORACLE["classify_collisions"] = with_(*COLL_CTES) + f"""
SELECT table_name, column_name, severity, collision_type,
  CASE WHEN collision_type = 'vectorizer_pattern' THEN {_PAT_CASE} END AS matched_pattern,
  existing_column_type, array_to_string(alts, ',') AS alternatives
FROM cls"""
ORACLE["resolve_columns"] = with_(*COLL_CTES) + """
SELECT table_name, column_name, severity, resolved_column_name, resolution_strategy, blocked FROM res"""
ORACLE["collision_summary"] = with_(*COLL_CTES) + """
SELECT schema_name, table_name, count(*) AS total,
  count(*) FILTER (WHERE severity = 'critical') AS n_critical,
  count(*) FILTER (WHERE severity = 'warning') AS n_warning,
  count(*) FILTER (WHERE severity = 'info') AS n_info,
  count(*) FILTER (WHERE severity = 'safe') AS n_safe,
  count(*) FILTER (WHERE collision_type = 'existing_vector') AS n_existing_vector,
  count(*) FILTER (WHERE collision_type = 'previous_vectorizer') AS n_previous_vectorizer,
  count(*) FILTER (WHERE collision_type = 'vectorizer_pattern') AS n_vectorizer_pattern,
  count(*) FILTER (WHERE collision_type = 'unrelated_column') AS n_unrelated_column,
  count(*) FILTER (WHERE collision_type = 'no_collision') AS n_no_collision,
  coalesce(array_to_string(list_sort(list_distinct(list(column_name) FILTER (WHERE severity = 'critical'))), ','), '')
    AS critical_columns,
  NOT bool_or(severity = 'critical') AS safe_to_proceed
FROM cls GROUP BY schema_name, table_name"""
ORACLE["collision_log_rows"] = with_(*COLL_CTES) + """
SELECT table_name, column_name AS desired_column_name, severity AS collision_severity, collision_type,
  resolution_strategy, resolved_column_name, details
FROM res WHERE severity <> 'safe'"""
ORACLE["column_history"] = with_(*COLL_CTES) + """
SELECT table_name, column_name, role FROM cls0 WHERE has_history"""
ORACLE["column_mapping"] = with_(*COLL_CTES) + """
SELECT d.table_name, d.text_column, d.role, d.column_name,
       coalesce(r.actual_column_name, d.column_name) AS actual_column_name
FROM desired d LEFT JOIN reg r ON r.schema_name = d.schema_name AND r.table_name = d.table_name
  AND (r.column_type = d.role OR (r.column_type LIKE 'cleaned%' AND d.role LIKE 'cleaned%'))
  AND r.original_column_name = d.column_name"""
_ROLE_TYPE = ("CASE role WHEN 'vector' THEN 'vector' WHEN 'model' THEN 'text' WHEN 'timestamp' THEN "
              "'timestamp' WHEN 'cleaned' THEN 'text' WHEN 'cleaned_config' THEN 'text' "
              "WHEN 'cleaned_timestamp' THEN 'timestamp' END")
ORACLE["reconcile_plan"] = with_(*COLL_CTES) + f"""
SELECT r.table_name, r.column_name, r.resolved_column_name,
  'ALTER TABLE ' || r.schema_name || '.' || r.table_name || ' ADD COLUMN ' || r.resolved_column_name
    || ' ' || {_ROLE_TYPE} AS ddl,
  r.blocked,
  coalesce((SELECT max(row_count) FROM cat x WHERE x.table_name = r.table_name), 0) > 1000000 AS large_table
FROM res r
WHERE NOT EXISTS (SELECT 1 FROM cat c WHERE c.table_name = r.table_name
                  AND c.column_name = r.resolved_column_name)"""
ORACLE["schema_drift"] = with_(*COLL_CTES) + f"""
, expd AS (
  SELECT schema_name, table_name, column_name, {_ROLE_TYPE} AS expected_type,
    CASE WHEN role = 'vector' THEN CASE embedding_config WHEN 'openai-small' THEN 1536
      WHEN 'openai-large' THEN 3072 WHEN 'infinity_static' THEN 768 WHEN 'infinity_bge' THEN 1024
      WHEN 'default' THEN 768 ELSE 768 END END AS expected_dimension
  FROM desired)
SELECT * FROM (
  SELECT e.table_name, e.column_name,
    CASE WHEN c.data_type IS NULL THEN 'missing_column' WHEN c.data_type <> e.expected_type THEN 'wrong_type'
         WHEN e.expected_dimension IS NOT NULL AND e.expected_dimension IS DISTINCT FROM c.dimension
         THEN 'dimension_mismatch' END AS drift_type,
    e.expected_type, c.data_type AS actual_type, e.expected_dimension, c.dimension AS actual_dimension
  FROM expd e LEFT JOIN cat c ON c.table_name = e.table_name AND c.column_name = e.column_name
) x WHERE drift_type IS NOT NULL"""

_KNOWN = ", ".join(f"({S.q(m)}, {d})" for m, d in
                   __import__("vecsync.functions.vectors", fromlist=["x"]).KNOWN_MODEL_DIMENSIONS.items())
_CONFIGS = ", ".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in derive.EMBEDDING_CONFIG_ROWS)
ORACLE["model_dimension_check"] = with_(CAT_CTE, ROUTING_CTE) + f"""
, known(model, known_dimension) AS (VALUES {_KNOWN})
, cfg(config_name, provider, model, dimensions) AS (VALUES {_CONFIGS})
, used AS (SELECT r.embedding_config AS config_name, max(c.dimension) AS observed_dimension
           FROM routing r JOIN cat c ON c.table_name = r."table" AND c.column_name = r.vector_column
           WHERE c.is_vector GROUP BY 1)
SELECT g.config_name, g.model, g.dimensions, k.known_dimension, u.observed_dimension,
  CASE WHEN k.known_dimension IS NULL THEN 'unknown' WHEN g.dimensions = k.known_dimension THEN 'ok'
       WHEN starts_with(g.model, 'text-embedding-3') AND g.dimensions > k.known_dimension THEN 'exceeds_max'
       WHEN starts_with(g.model, 'text-embedding-3') THEN 'ok' ELSE 'mismatch' END AS status
FROM cfg g LEFT JOIN known k USING (model) LEFT JOIN used u USING (config_name)"""
ORACLE["add_companions"] = with_(USER_CTE) + """
SELECT doc_id, text_vector IS NOT NULL AS has_vector, text_embedding_model,
  CAST(NULL AS VARCHAR) AS text_cleaned, CAST(NULL AS VARCHAR) AS text_cleaned_config,
  'text_cleaned,text_cleaned_at,text_cleaned_config' AS added_columns
FROM usr"""
ORACLE["registry_upsert"] = with_(*COLL_CTES) + f"""
, allr AS (
  SELECT table_name, original_column_name, actual_column_name, column_type, dimension,
         TIMESTAMP '{derive.VECTORS_CREATED_AT}' AS created_at, database_name, schema_name FROM reg
  UNION ALL
  SELECT table_name, column_name, resolved_column_name,
         CASE WHEN starts_with(role, 'cleaned') THEN 'cleaned' ELSE role END, NULL, {_AS_OF},
         database_name, schema_name
  FROM res WHERE NOT blocked)
SELECT table_name, original_column_name, actual_column_name, column_type, dimension, created_at
FROM (SELECT *, row_number() OVER (PARTITION BY database_name, schema_name, table_name, actual_column_name
                                   ORDER BY created_at DESC) AS rn FROM allr) x WHERE rn = 1"""
ORACLE["all_targets_completion"] = with_(USER_CTE, TEXT_ROWS_CTE, TNC_CTE) + f"""
SELECT table_name, null_vectors, total_rows,
  {S.completion_pct('null_vectors', 'total_rows')} AS completion_percentage FROM tnc"""


# ---------------------------------------------------------------------------
# batch 5: vectors
# ---------------------------------------------------------------------------
def _knn_sql(score: str) -> str:
    return f"""
WITH q AS (SELECT item_id AS query_id,
                  CAST({S.mock_embedding(S.basic_clean('text'), derive.DIMENSION)} AS DOUBLE[]) AS qv
           FROM benchmark),
s AS (SELECT q.query_id, e.vec_id, {score} AS score
      FROM q CROSS JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS ev FROM embeddings) e)
SELECT query_id, rank, vec_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM s) x
WHERE rank <= 10"""


ORACLE["knn_exact"] = _knn_sql("list_distance(ev, qv)")
ORACLE["knn_ivf_full_probe"] = ORACLE["knn_exact"]
ORACLE["knn_exact_cosine"] = _knn_sql("1.0 - list_cosine_similarity(ev, qv)")
ORACLE["knn_ivf_index_exact"] = ORACLE["knn_exact"]
ORACLE["knn_ivf_index_cosine"] = ORACLE["knn_exact_cosine"]
ORACLE["knn_exact_ip"] = _knn_sql("-list_inner_product(ev, qv)")
for _m in ("", "_cosine", "_ip"):
    ORACLE[f"knn_exact_filtered{_m}"] = ORACLE[f"knn_exact{_m}"]
ORACLE["vector_text_roundtrip"] = "SELECT vec_id, len(embedding) AS dim, TRUE AS roundtrip_equal FROM embeddings"
ORACLE["truncate_vectors"] = f"""
SELECT vec_id, {checksum('embedding[1:16]')} AS checksum,
  {checksum('list_transform(embedding[1:16], lambda x: CAST(x / sqrt(list_sum(list_transform(embedding[1:16], lambda y: CAST(y AS DOUBLE) * y))) AS FLOAT))')}
    AS checksum_unit,
  16 AS dim
FROM embeddings"""
ORACLE["dimension_migration"] = with_(USER_CTE) + """
SELECT lang, 'text_vector' AS old_column, max(len(text_vector)) AS old_dimension,
  'text_vector_32' AS new_column, 32 AS new_dimension,
  count(*) FILTER (WHERE text_vector IS NOT NULL AND len(text_vector) <> 32) AS rows_to_migrate,
  count(*) AS total_rows, 0 AS rows_migrated, 'pending' AS status
FROM usr GROUP BY lang"""
ORACLE["migration_progress"] = with_(USER_CTE) + f"""
SELECT lang, rows_migrated, total_rows,
  CASE WHEN rows_migrated = 0 THEN 'pending' WHEN rows_migrated < total_rows THEN 'in_progress'
       ELSE 'completed' END AS status
FROM (SELECT lang, count(*) FILTER (WHERE text_embedding_model = '{derive.CURRENT_MODEL}'
                                    AND text_vector IS NOT NULL) AS rows_migrated,
             count(*) AS total_rows FROM usr GROUP BY lang)"""


# ---------------------------------------------------------------------------
# batch 6: streaming (availableNow result == batch result)
# ---------------------------------------------------------------------------
ORACLE["stream_route"] = ORACLE["route_events"]
ORACLE["stream_dedup"] = ORACLE["debounce_events"]
ORACLE["stream_retry"] = ORACLE["retry_schedule"]
ORACLE["stream_retry_timers"] = ORACLE["retry_schedule"]
ORACLE["feed_outbox"] = ORACLE["feed_parse"]
ORACLE["stream_vectorize"] = with_(ROUTING_CTE, ROUTE_KEYS_CTE, FEED_CTE) + f"""
, rf AS (
  SELECT f.*, k.cleaning_enabled, k.cleaning_config FROM feed f
  JOIN route_keys k ON k._db = f.database AND k.schema = f.schema AND k."table" = f."table"
), need AS (
  SELECT *, {clean_by_config('new_text')} AS clean FROM rf
  WHERE ((operation = 'INSERT' AND NOT has_new_vector)
         OR (operation = 'UPDATE' AND old_text IS DISTINCT FROM new_text))
), latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "table", row_id ORDER BY ts DESC, event_id DESC) AS rn
                 FROM need WHERE {S.basic_clean('new_text')} <> '' AND clean <> '') x WHERE rn = 1
)
SELECT "table", row_id, event_id, '{derive.CURRENT_MODEL}' AS model, {derive.DIMENSION} AS dim,
       {checksum(S.mock_embedding('clean', derive.DIMENSION))} AS checksum
FROM latest"""
ORACLE["stream_late"] = ORACLE["stream_vectorize"]
_head, _, _ = ORACLE["stream_vectorize"].rpartition('SELECT "table", row_id, event_id,')
ORACLE["stream_retries_until_done"] = _head + """
SELECT "table", row_id, event_id,
  CASE WHEN length(clean) % 10 IN (0, 6) THEN 'dead' ELSE 'success' END AS outcome,
  CASE WHEN length(clean) % 10 = 6 THEN 4 ELSE 0 END AS retry_count
FROM latest"""
ORACLE["stream_daily_status"] = with_(LOG_CTE) + """
SELECT table_name, CAST(created_at AS DATE) AS day, count(*) AS total,
  count(*) FILTER (WHERE status = 'success') AS successful,
  count(*) FILTER (WHERE status <> 'success') AS not_vectorized
FROM log GROUP BY 1, 2"""
ORACLE["batch_plan"] = with_(ROUTING_CTE, ROUTE_KEYS_CTE, TEXT_ROWS_CTE) + f"""
, r AS (SELECT t."table", t.row_id, k.config_order FROM text_rows t JOIN route_keys k
        ON k._db = '{derive.DATABASE}' AND k.schema = '{derive.SCHEMA}' AND k."table" = t."table")
SELECT "table", row_id, row_number() OVER (PARTITION BY config_order ORDER BY row_id) AS row_number,
  CAST(floor((row_number() OVER (PARTITION BY config_order ORDER BY row_id) - 1) / 100) AS BIGINT) AS batch_no
FROM r"""
ORACLE["batch_plan_packed"] = with_(ROUTING_CTE, ROUTE_KEYS_CTE, TEXT_ROWS_CTE) + f"""
SELECT t."table", count(*) AS texts,
  CAST(sum(greatest(1, CAST(ceil(length(t.text) / 4.0) AS BIGINT))) AS BIGINT) AS tokens,
  TRUE AS texts_fit, TRUE AS tokens_fit, TRUE AS near_bound
FROM text_rows t JOIN route_keys k ON k._db = '{derive.DATABASE}'
  AND k.schema = '{derive.SCHEMA}' AND k."table" = t."table"
WHERE t.text IS NOT NULL GROUP BY t."table" """
ORACLE["alternative_names"] = with_(CAT_CTE) + """
, a0 AS (SELECT c.table_name, c.column_name,
                (SELECT list(column_name) FROM cat x WHERE x.table_name = c.table_name) AS ex
         FROM cat c)
, a1 AS (SELECT *, list_filter([column_name || '_v2', column_name || '_v3', column_name || '_v4',
                  column_name || '_v5', column_name || '_v6', column_name || '_v7', column_name || '_v8',
                  column_name || '_v9'], lambda x: NOT list_contains(ex, x))[1:3] AS vers FROM a0)
, a2 AS (SELECT *, list_filter([column_name || '_2', column_name || '_3', column_name || '_4',
                  column_name || '_5', column_name || '_6', column_name || '_7', column_name || '_8',
                  column_name || '_9'], lambda x: NOT list_contains(ex, x) AND NOT list_contains(vers, x))
                  [1:5 - len(vers)] AS nums FROM a1)
SELECT table_name, column_name,
  array_to_string(list_concat(vers, nums, list_filter([column_name || '_new', column_name || '_alt',
      column_name || '_updated', column_name || '_current'],
      lambda x: NOT list_contains(ex, x) AND NOT list_contains(vers, x) AND NOT list_contains(nums, x))
      [1:7 - len(vers) - len(nums)]), ',') AS alternatives,
  array_to_string(list_filter(['new_' || column_name, 'alt_' || column_name, 'v2_' || column_name],
      lambda x: NOT list_contains(ex, x))[1:5], ',') AS prefix_alternatives
FROM a2"""

ORACLE["reconcile_summary"] = with_(*COLL_CTES) + """
, plan AS (SELECT r.* FROM res r WHERE NOT EXISTS (SELECT 1 FROM cat c WHERE c.table_name = r.table_name
                                                  AND c.column_name = r.resolved_column_name))
, t AS (SELECT table_name, count(*) AS changes, count(*) FILTER (WHERE NOT blocked) AS ok_changes,
               bool_or(blocked) AS blocked,
               CASE WHEN bool_or(blocked) THEN 'failed' ELSE 'success' END AS status
        FROM plan GROUP BY table_name)
SELECT count(*) AS total_tables, count(*) FILTER (WHERE status = 'success') AS successful,
  count(*) FILTER (WHERE status = 'failed') AS failed, 0 AS partial,
  round(coalesce(count(*) FILTER (WHERE status = 'success') / count(*), 0), 6) AS success_rate,
  sum(changes) AS total_changes,
  sum(CASE WHEN status = 'success' THEN ok_changes ELSE 0 END) AS successful_changes,
  count(*) FILTER (WHERE blocked) AS critical_collisions,
  coalesce(array_to_string(list_sort(list(table_name) FILTER (WHERE status = 'failed')), ','), '')
    AS failed_tables
FROM t"""
ORACLE["completeness_report"] = with_(LOG_CTE, HISTORY_CTE, USER_CTE, TEXT_ROWS_CTE, TNC_CTE) + f"""
, allrows AS (
  SELECT table_name, checked_at, null_vectors, total_rows, vector_column, last_vectorized_at FROM history
  UNION ALL
  SELECT table_name, TIMESTAMP '2024-01-30 23:59:59', CAST(null_vectors AS BIGINT),
         CAST(total_rows AS BIGINT), 'text_vector', CAST(NULL AS TIMESTAMP) FROM tnc
), daily AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_name, vector_column, CAST(checked_at AS DATE)
                                              ORDER BY checked_at DESC) AS rn FROM allrows) x WHERE rn = 1
), latest AS (
  SELECT * FROM (SELECT *, rank() OVER (PARTITION BY table_name, vector_column ORDER BY checked_at DESC) AS r
                 FROM daily) y WHERE r = 1
)
SELECT table_name, vector_column, null_vectors, total_rows,
  {S.completion_pct('null_vectors', 'total_rows')} AS completion_percentage, checked_at,
  CASE WHEN {S.completion_pct('null_vectors', 'total_rows')} >= 95 THEN 'healthy'
       WHEN {S.completion_pct('null_vectors', 'total_rows')} >= 80 THEN 'warning' ELSE 'critical' END
    AS health_status,
  CASE WHEN last_vectorized_at < {_AS_OF} - INTERVAL 1 HOUR THEN 'stale'
       WHEN last_vectorized_at < {_AS_OF} - INTERVAL 10 MINUTE THEN 'recent' ELSE 'current' END
    AS freshness_status
FROM latest"""
