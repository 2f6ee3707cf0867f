"""Change-feed parsing, validation and the malformed side output.

A change event is one JSON document per row change::

    {"database", "schema", "table", "operation",
     "id": <full NEW row>, "old_id": <full OLD row or null>,
     "config_key", "model_column"}

The feed is a DataFrame ``(event_id, ts, value STRING)`` — the shape of a
Kafka / file / outbox source — parsed with ``from_json`` (native, no
Python).  Rows are schemaless, so the row objects are kept as JSON text
and the configured id / text columns are pulled out after routing.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: keys every event must carry (the value may be null).
REQUIRED_FIELDS = ["database", "schema", "table", "operation", "id"]

EVENT_SCHEMA = T.StructType([
    T.StructField("database", T.StringType()),
    T.StructField("schema", T.StringType()),
    T.StructField("table", T.StringType()),
    T.StructField("operation", T.StringType()),
    T.StructField("id", T.StringType()),        # NEW row as JSON text
    T.StructField("old_id", T.StringType()),    # OLD row as JSON text
    T.StructField("config_key", T.StringType()),
    T.StructField("model_column", T.StringType()),
])


def _as_map(value_col: str) -> F.Column:
    """One JSON parse per event: keys, scalar fields and nested row objects
    (kept as JSON text) all come from this map; invalid JSON → NULL."""
    return F.from_json(F.col(value_col), "map<string,string>")


def _validated(feed: DataFrame, value_col: str) -> DataFrame:
    m = feed.select("*", _as_map(value_col).alias("_m"))
    keys = F.map_keys(F.col("_m"))
    missing = F.array_except(F.array(*[F.lit(k) for k in REQUIRED_FIELDS]), keys)
    return (m.withColumn("missing_fields", missing)
             .withColumn("reject_reason",
                         F.when(F.col("_m").isNull(), F.lit("malformed_json"))
                          .when(F.size(F.col("missing_fields")) > 0,
                                F.concat(F.lit("missing_fields:"),
                                         F.array_join(F.col("missing_fields"), ",")))))


def with_validation(feed: DataFrame, value_col: str = "value") -> DataFrame:
    """Adds ``missing_fields`` (array) and ``reject_reason``.

    Invalid JSON → 'malformed_json'; a required key absent →
    'missing_fields:<k1,k2>'; else NULL (valid).  A key that is present with
    a null value is valid, as in the reference.
    """
    return _validated(feed, value_col).drop("_m")


def parse_feed(feed: DataFrame, value_col: str = "value") -> DataFrame:
    """S3 + P4: valid events as typed columns (invalid ones are dropped here
    and kept by ``feed_rejects``).

    The valid rows are emitted through ``inline`` of a 0/1-element array
    instead of a Filter: a Filter on the parse result would be pushed below
    the projection and parse every payload twice.
    """
    v = _validated(feed, value_col)
    keep = [c for c in feed.columns if c != value_col]
    fields = [F.element_at(F.col("_m"), F.lit(f.name)).alias(f.name)
              for f in EVENT_SCHEMA.fields]
    row = F.struct(*[F.col(c) for c in keep], *fields)
    return v.select(F.inline(F.when(F.col("reject_reason").isNull(), F.array(row))))


def feed_rejects(feed: DataFrame, value_col: str = "value") -> DataFrame:
    """Malformed or incomplete events, with the reason, for a side table."""
    return with_validation(feed, value_col).filter(F.col("reject_reason").isNotNull()) \
        .drop("missing_fields")


def row_field(row_json_col: str, field: F.Column | str, cast: str = "string") -> F.Column:
    """Pull one field out of a schemaless row object by (possibly per-row) name."""
    if isinstance(field, str):
        return F.get_json_object(F.col(row_json_col), f"$.{field}").cast(cast)
    as_map = F.from_json(F.col(row_json_col), "map<string,string>")
    return F.element_at(as_map, field).cast(cast)


def with_row_fields(events: DataFrame, id_field: str = "id", text_field: str = "text",
                    vector_field: str = "text_vector") -> DataFrame:
    """``row_id`` (text: ids may be numbers, UUIDs or names), ``new_text``, ``old_text``,
    ``new_vector`` from the NEW / OLD row objects — each is parsed once into a map."""
    x = events.select("*", F.from_json(F.col("id"), "map<string,string>").alias("_new"),
                      F.from_json(F.col("old_id"), "map<string,string>").alias("_old"))
    new, old = F.col("_new"), F.col("_old")
    return x.select(
        *events.columns,
        F.coalesce(F.element_at(new, F.lit(id_field)),
                   F.element_at(old, F.lit(id_field))).alias("row_id"),
        F.element_at(new, F.lit(text_field)).alias("new_text"),
        F.element_at(old, F.lit(text_field)).alias("old_text"),
        F.element_at(new, F.lit(vector_field)).alias("new_vector"))


def wall_clock(instant: F.Column) -> F.Column:
    """An instant as its UTC wall clock (TIMESTAMP_NTZ), whatever the session zone."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant),
                           F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def read_feed_kafka(spark, bootstrap_servers: str, topic: str,
                    starting_offsets: str = "earliest", **options) -> DataFrame:
    """S3 from Kafka: ``(event_id, ts, value)`` in the shape every feed
    operator expects (event_id = partition/offset packed into one long).
    Needs the Spark Kafka connector on the classpath."""
    r = (spark.readStream.format("kafka")
         .option("kafka.bootstrap.servers", bootstrap_servers)
         .option("subscribe", topic).option("startingOffsets", starting_offsets))
    for k, v in options.items():
        r = r.option(k, v)
    return kafka_events(r.load())


def kafka_events(raw: DataFrame) -> DataFrame:
    """The rows of the Kafka source as feed events: partition and offset name an event, its
    time is the record's, its payload the value as text."""
    return raw.select(
        (F.col("partition").cast("long") * F.lit(1 << 40) + F.col("offset")).alias("event_id"),
        wall_clock(F.col("timestamp")).alias("ts"), F.col("value").cast("string").alias("value"))


def with_config_fields(routed: DataFrame) -> DataFrame:
    """After routing: take ``row_id`` / ``new_text`` / ``old_text`` / ``new_vector``
    from the row objects by each event's configured ``id_column``, ``text_column``
    and ``vector_column`` (default ``{text_column}_vector``), one map parse per
    row object."""
    x = routed.select("*", F.from_json(F.col("id"), "map<string,string>").alias("_new"),
                      F.from_json(F.col("old_id"), "map<string,string>").alias("_old"))
    new, old = F.col("_new"), F.col("_old")
    idc, txt = F.col("id_column"), F.col("text_column")
    vec = F.coalesce(F.col("vector_column"), F.concat(txt, F.lit("_vector")))
    return (x.withColumn("row_id", F.coalesce(F.element_at(new, idc), F.element_at(old, idc)))
             .withColumn("new_text", F.element_at(new, txt))
             .withColumn("old_text", F.element_at(old, txt))
             .withColumn("new_vector", F.element_at(new, vec))
             .drop("_new", "_old"))
