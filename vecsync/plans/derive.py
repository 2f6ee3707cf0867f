"""Domain tables derived by Spark from the given tables.

The given data is a generic corpus; these functions give it the roles the
vectorization pipeline works with.  Everything is a lazy projection / join
over the whole tables, so the work grows with them.

* user table          = ``documents`` (id ``doc_id``, text ``text``) left-joined
                        with ``embeddings`` on ``vec_id = doc_id`` (the vectors
                        already present; the rest are real NULL vectors)
* vectorization log   = ``events`` (event_type error→failed, signup→retry,
                        view→skipped, else success; value→processing_time;
                        ts→created_at)
* change feed         = ``events`` rendered as row-change JSON payloads
* HTML table          = ``pages``;  multi-row text = ``conversations``
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the test mapping.
DATABASE = "appdb"
SCHEMA = "public"
CURRENT_MODEL = "mock-embed-v1"
PREVIOUS_MODEL = "mock-embed-v0"
DIMENSION = 64
VECTORS_CREATED_AT = "2024-01-15 00:00:00"
AS_OF = "2024-01-31 00:00:00"


def user_table(documents: DataFrame, embeddings: DataFrame) -> DataFrame:
    """documents ⟕ embeddings: doc_id, text, lang, source + companion columns
    ``text_vector``, ``text_embedding_model``, ``text_vector_created_at``."""
    vecs = embeddings.select(
        F.col("vec_id").alias("doc_id"),
        F.col("embedding").alias("text_vector"),
        F.when(F.col("label") == 0, F.lit(PREVIOUS_MODEL))
         .otherwise(F.lit(CURRENT_MODEL)).alias("text_embedding_model"),
        F.lit(VECTORS_CREATED_AT).cast("timestamp_ntz").alias("text_vector_created_at"))
    return (documents.select("doc_id", "text", "lang", "source")
            .join(vecs, "doc_id", "left"))


def event_table_name() -> F.Column:
    """Which user table an event belongs to (derived from the user id)."""
    u = F.col("user_id")
    return (F.when(u < 50, F.lit("documents"))
             .when(u < 100, F.lit("pages"))
             .otherwise(F.lit("conversations")))


def vectorization_log(events: DataFrame) -> DataFrame:
    """S5 rows derived from ``events`` (one row per embedding attempt)."""
    et = F.col("event_type")
    status = (F.when(et == "error", "failed").when(et == "signup", "retry")
               .when(et == "view", "skipped").otherwise("success"))
    return events.select(
        F.col("event_id").alias("log_id"),
        F.col("ts").cast("timestamp_ntz").alias("created_at"),
        F.lit(DATABASE).alias("database_name"),
        F.lit(SCHEMA).alias("schema_name"),
        event_table_name().alias("table_name"),
        F.to_json(F.struct(F.col("user_id").alias("id"))).alias("row_id"),
        F.lit("text").alias("text_column"),
        F.lit("text_vector").alias("vector_column"),
        F.when(et == "purchase", F.lit(PREVIOUS_MODEL))
         .otherwise(F.lit(CURRENT_MODEL)).alias("embedding_model"),
        F.col("value").alias("processing_time"),
        status.alias("status"),
        F.when(et == "error", F.lit("embedding request failed")).alias("error_message"),
        F.get_json_object("props", "$.k").cast("int").alias("text_length"),
        F.when(et.isin("click", "purchase"), F.lit(DIMENSION)).alias("vector_dimension"),
        F.col("user_id"),
    )


# --- change feed -------------------------------------------------------------

def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("int")


def change_feed(events: DataFrame) -> DataFrame:
    """``events`` rendered as a row-change feed ``(event_id, ts, value)``.

    table: click/purchase → documents, view → pages, signup →
    conversations, error → audit_log (no routing config).  operation from
    props.k: < 25 INSERT, >= 90 DELETE, else UPDATE.  An UPDATE changes the
    text when k < 60.  k >= 98 yields a payload without its opening brace (invalid
    JSON) and
    k in (96, 97) a payload without its ``table`` key.
    """
    e = events.select("event_id", "ts", "user_id", "event_type", _k().alias("_k"))
    k, et, u = F.col("_k"), F.col("event_type"), F.col("user_id")
    table = (F.when(et.isin("click", "purchase"), "documents").when(et == "view", "pages")
              .when(et == "signup", "conversations").otherwise("audit_log"))
    op = F.when(k < 25, "INSERT").when(k >= 90, "DELETE").otherwise("UPDATE")
    e = e.select("event_id", "ts", "user_id", "_k", table.alias("_table"), op.alias("_op"))
    k, op = F.col("_k"), F.col("_op")
    new_text = F.concat(F.lit("text "), F.floor(k / 3).cast("string"))
    old_text = F.when(k < 60, F.concat(F.lit("text "), (F.floor(k / 3) - 1).cast("string"))) \
                .otherwise(new_text)
    new_vec = F.when((k >= 20) & (k < 25), F.array(F.lit(0.5), F.lit(-0.5)))
    new_row = F.to_json(F.struct(u.alias("id"), new_text.alias("text"),
                                 new_vec.alias("text_vector")))
    old_row = F.to_json(F.struct(u.alias("id"), old_text.alias("text")))
    db = F.when(k < 50, F.lit(DATABASE)).otherwise(F.lit("primary"))
    fields = [db.alias("database"), F.lit(SCHEMA).alias("schema"), F.col("_table").alias("table"),
              op.alias("operation"),
              F.when(op != "DELETE", new_row).alias("id"),
              F.when(op != "INSERT", old_row).alias("old_id"),
              F.lit("default").alias("config_key"),
              F.lit("text_embedding_model").alias("model_column")]
    keep_nulls = {"ignoreNullFields": "false"}
    no_table = [f for i, f in enumerate(fields) if i != 2]
    value = (F.when(k >= 98, F.regexp_replace(F.to_json(F.struct(*fields), keep_nulls), "^[{]", ""))
              .when(k >= 96, F.to_json(F.struct(*no_table), keep_nulls))
              .otherwise(F.to_json(F.struct(*fields), keep_nulls)))
    return e.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), value.alias("value"))


# --- routing configuration -------------------------------------------------------

ROUTING_COLUMNS = ("config_order int, database string, database_name string, schema string, "
                   "table string, text_column string, id_column string, "
                   "vector_column string, model_column string, embedding_config string, "
                   "cleaning_enabled boolean, cleaning_config string")

# Fixed value: the vectorization targets of the test deployment (config input).
ROUTING_ROWS = [
    (1, "primary", DATABASE, SCHEMA, "documents", "text", "id", "text_vector",
     "text_embedding_model", "default", True, "basic_text"),
    (2, "primary", DATABASE, SCHEMA, "documents", "source", "id", "source_vector",
     "source_embedding_model", "default", False, None),
    (3, "primary", DATABASE, SCHEMA, "pages", "text", "id", "text_vector",
     "text_embedding_model", "default", True, "html_to_text"),
    (4, "primary", DATABASE, SCHEMA, "conversations", "text", "id", "text_vector",
     "text_embedding_model", "default", True, "markdown_to_text"),
    (5, "primary", DATABASE, SCHEMA, "benchmark", "text", "item_id", "text_vector",
     "text_embedding_model", "default", False, None),
    (6, "primary", DATABASE, SCHEMA, "part", "p_name", "p_partkey", "p_type",
     "p_name_embedding_model", "default", True, "no_such_preset"),
]


def text_rows(documents: DataFrame, pages: DataFrame, conversations: DataFrame,
              benchmark: DataFrame, part: DataFrame) -> DataFrame:
    """All configured text in long form: (table, row_id string, text)."""
    def part_of(df, table, id_expr, text_col):
        return df.select(F.lit(table).alias("table"), id_expr.cast("string").alias("row_id"),
                         F.col(text_col).alias("text"))
    return (part_of(documents, "documents", F.col("doc_id"), "text")
            .unionByName(part_of(pages, "pages", F.col("page_id"), "html"))
            .unionByName(part_of(conversations, "conversations",
                                 F.concat_ws(":", "conv_id", "turn"), "text"))
            .unionByName(part_of(benchmark, "benchmark", F.col("item_id"), "text"))
            .unionByName(part_of(part, "part", F.col("p_partkey"), "p_name")))


def routing_config(spark) -> DataFrame:
    return spark.createDataFrame(ROUTING_ROWS, ROUTING_COLUMNS)


# --- previous snapshot for change detection --------------------------------------

def old_snapshot(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The previous version of ``documents``: rows of source 'src0' did not
    exist yet, German rows carried a revision note that has since been removed, and the
    ``benchmark`` items were rows that have since been deleted (negative ids)."""
    prev = (documents.filter(F.col("source") != "src0")
            .select("doc_id", F.when(F.col("lang") == "de", F.concat("text", F.lit(" (rev. 1)")))
                    .otherwise(F.col("text")).alias("text")))
    gone = benchmark.select((-F.col("item_id") - 1).alias("doc_id"), "text")
    return prev.unionByName(gone)


def old_user_table(documents: DataFrame, benchmark: DataFrame, embeddings: DataFrame) -> DataFrame:
    """The previous version of the user table: rows of ``old_snapshot``, Spanish ones still
    filed as French, vectors of the previous model only."""
    kept = old_snapshot(documents, benchmark).join(
        documents.select("doc_id", "lang", "source"), "doc_id", "left")
    lang = F.when(F.col("lang") == "es", "fr").otherwise(F.coalesce("lang", F.lit("en")))
    return user_table(kept.withColumn("lang", lang), embeddings.filter(F.col("label") == 0))


def provider_stand_in(url: str, payload: dict, headers: dict, timeout: float):
    """Answers an embeddings request in place of a server: vectors of the test embedder, the
    items of the reply in reverse order (their ``index`` tells which is which)."""
    import json

    from ..operators.embed import MockEmbedder

    vectors = MockEmbedder(dimension=payload["dimensions"]).embed(payload["input"])
    items = [{"index": i, "embedding": v.tolist()} for i, v in enumerate(vectors)]
    return 200, {}, json.dumps({"model": payload["model"], "data": items[::-1]})


# --- task table / status history --------------------------------------------------

def task_table(events: DataFrame) -> DataFrame:
    """pending_tasks rows derived from ``events`` (one task per event)."""
    k, et = _k(), F.col("event_type")
    ts = F.col("ts").cast("timestamp_ntz")
    status = (F.when(et == "view", "completed").when(et == "error", "failed")
               .when(et == "purchase", "processing").otherwise("pending"))
    return events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("t-"), F.col("event_id").cast("string")).alias("task_id"),
        F.lit(DATABASE).alias("database_name"), F.lit(SCHEMA).alias("schema_name"),
        event_table_name().alias("table_name"),
        F.to_json(F.struct(F.col("user_id").alias("id"))).alias("row_id"),
        F.lit("default").alias("config_key"),
        F.when(et == "purchase", "high").when(et == "click", "medium").otherwise("low")
         .alias("priority"),
        F.least(F.floor(k / 25), F.lit(3)).cast("int").alias("retry_count"),
        F.lit(3).alias("max_retries"),
        ts.alias("created_at"),
        (ts + F.make_dt_interval(F.lit(0), F.lit(0), k)).alias("scheduled_at"),
        F.when(status != "pending", ts).alias("started_at"),
        F.when(status.isin("completed", "failed"),
               ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("value")))
         .alias("completed_at"),
        status.alias("status"))


def status_history(events: DataFrame) -> DataFrame:
    """null_vector_status history: one check per (table, day) of the log."""
    log = vectorization_log(events)
    g = log.groupBy("database_name", "schema_name", "table_name", "vector_column",
                    F.to_date("created_at").alias("_day")).agg(
        F.max("created_at").alias("checked_at"),
        F.count_if(F.col("status") != "success").alias("null_vectors"),
        F.count(F.lit(1)).alias("total_rows"),
        F.max(F.when(F.col("status") == "success", F.col("created_at"))).alias("last_vectorized_at"))
    return g.select("checked_at", "database_name", "schema_name", "table_name", "vector_column",
                    F.lit("default").alias("config_key"), "null_vectors", "total_rows",
                    "last_vectorized_at")


def drift_log(events: DataFrame) -> DataFrame:
    """schema_drift_log rows: one per failed attempt of the log's last week."""
    log = vectorization_log(events).filter(F.col("status") == "failed")
    k = F.col("text_length")
    return log.select(
        F.col("created_at").alias("detected_at"), "database_name", "schema_name", "table_name",
        F.when(k < 30, "missing_column").when(k < 60, "wrong_type")
         .otherwise("dimension_mismatch").alias("drift_type"),
        (k >= 50).alias("resolved"))


def collision_log(events: DataFrame) -> DataFrame:
    """collision_log rows: one per retried attempt."""
    log = vectorization_log(events).filter(F.col("status") == "retry")
    k = F.col("text_length")
    return log.select(
        F.col("created_at").alias("occurred_at"), "database_name", "schema_name", "table_name",
        F.concat(F.lit("text_vector_v"), F.col("text_length").cast("string"))
         .alias("desired_column_name"),
        F.when(k < 20, "critical").when(k < 50, "warning").when(k < 80, "info")
         .otherwise("safe").alias("collision_severity"))


# --- embedding configs (config input) ------------------------------------------------

EMBEDDING_CONFIG_COLUMNS = "config_name string, provider string, model string, dimensions int"
# Fixed value: the embedding configs of the test deployment.
EMBEDDING_CONFIG_ROWS = [
    ("default", "mock", CURRENT_MODEL, DIMENSION),
    ("openai-small", "openai", "text-embedding-3-small", 512),
    ("openai-large", "openai", "text-embedding-3-large", 4096),
    ("infinity_bge", "infinity", "BAAI/bge-m3", 1024),
    ("infinity_static", "infinity", "minishlab/potion-multilingual-128M", 512),
]


def embedding_configs(spark) -> DataFrame:
    return spark.createDataFrame(EMBEDDING_CONFIG_ROWS, EMBEDDING_CONFIG_COLUMNS)
