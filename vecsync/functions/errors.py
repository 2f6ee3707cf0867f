"""Provider responses, error payloads, failure classes, retry schedule.

All native: ``from_json`` / ``get_json_object`` / CASE.  The same rules are
used in-task by the HTTP embedder (``operators.embed``) on single payloads.
"""
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- F14 -------------------------------------------------------------------------
_DATA_SHAPE = "struct<data: array<struct<index: int, embedding: array<float>>>>"
_EMB_SHAPE = "struct<embeddings: array<array<float>>>"


def parse_embedding_response(body: Column) -> Column:
    """``array<array<float>>`` from any of the four response shapes:
    ``{"data":[{"embedding":[..]}]}``, ``{"embeddings":[[..]]}``, ``[[..]]``,
    or an object with a single key holding a list of vectors or one vector.
    Anything else → NULL (an error upstream)."""
    data = F.from_json(body, _DATA_SHAPE)["data"]
    data_vecs = F.transform(F.array_sort(
        data, lambda a, b: F.when(a["index"] < b["index"], -1)
                            .when(a["index"] > b["index"], 1).otherwise(0)),
        lambda x: x["embedding"])
    emb = F.from_json(body, _EMB_SHAPE)["embeddings"]
    bare = F.from_json(body, "array<array<float>>")
    one_key = F.from_json(body, "map<string,string>")
    single_val = F.when(F.size(F.map_keys(one_key)) == 1, F.map_values(one_key)[0])
    as_list = F.from_json(single_val, "array<array<float>>")
    as_vec = F.from_json(single_val, "array<float>")
    return F.coalesce(data_vecs, emb, bare, as_list,
                      F.when(as_vec.isNotNull(), F.array(as_vec)))


# --- F15 -------------------------------------------------------------------------

def parse_error_message(body: Column) -> Column:
    """``error.message`` / ``error`` (string) / ``message`` / ``detail``
    (string, or first item of a list) / ``description`` / the whole payload."""
    g = lambda p: F.get_json_object(body, p)
    err_obj_msg = g("$.error.message")
    err = g("$.error")
    err_str = F.when(~F.coalesce(err.startswith("{"), F.lit(False)), err)
    detail = g("$.detail")
    detail_first = F.when(detail.startswith("["), g("$.detail[0]")).otherwise(detail)
    return F.coalesce(err_obj_msg, err_str, g("$.message"), detail_first,
                      g("$.description"), body)


# --- F16 -------------------------------------------------------------------------
# Default waits (seconds) when a 429 carries no retry-after: of a hosted API,
# and of self-hosted or custom endpoints.
DEFAULT_RATE_LIMIT_WAIT = 60
SELF_HOSTED_RATE_LIMIT_WAIT = 30


def classify_failure(status: Column, retry_after: Column | None = None,
                     default_wait: int = DEFAULT_RATE_LIMIT_WAIT) -> Column:
    """F16: struct(error_class, retryable, wait_s) from the HTTP status
    (0 / NULL = network error or timeout)."""
    ra = retry_after if retry_after is not None else F.lit(None).cast("int")
    cls = (F.when(status == 429, "rate_limit")
            .when(status.isin(401, 403), "authentication")
            .when(status == 422, "validation")
            .when(status.isNull() | (status == 0), "network")
            .when(status >= 500, "server")
            .otherwise("api"))
    retryable = ~cls.isin("authentication", "validation")
    wait = F.when(status == 429, F.coalesce(ra, F.lit(default_wait)))
    return F.struct(cls.alias("error_class"), retryable.alias("retryable"),
                    wait.cast("int").alias("wait_s"))


# --- F17 -------------------------------------------------------------------------

def call_backoff_delay(retry_delay: float, attempt: Column) -> Column:
    """In-call backoff: ``retry_delay * 2^attempt`` (attempt from 0)."""
    return F.lit(float(retry_delay)) * F.pow(F.lit(2.0), attempt)


def retry_schedule(failed_at: Column, retry_count: Column, retry_delay: float,
                   max_retries: int) -> Column:
    """Task-level retry (F17): next count = count + 1, delay =
    ``retry_delay * 2^(count)`` for the new attempt ``count + 1``; a task whose
    count already reached ``max_retries`` is dead-lettered instead."""
    nxt = retry_count + 1
    delay = F.lit(float(retry_delay)) * F.pow(F.lit(2.0), nxt - 1)
    dead = retry_count >= max_retries
    return F.struct(
        F.when(dead, "dead").otherwise("retry").alias("decision"),
        F.when(~dead, nxt).alias("next_retry_count"),
        F.when(~dead, delay).alias("delay_s"),
        F.when(~dead, failed_at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), delay))
         .alias("retry_at"))
