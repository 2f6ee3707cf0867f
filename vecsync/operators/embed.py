"""UD1 / UD2 / W2: distributed embedding with a pluggable embedder.

``embed_column`` runs one embedder client per task through ``mapInPandas``:
Arrow hands each task record batches, the client embeds them in chunks of
``batch_size`` (W2 — batches form inside the task, no global numbering
or sort), order is preserved, and the count of returned vectors is checked
per chunk (P8's count rule).  Embedders are picked by name from a registry
of picklable classes (``register_provider``).

Embedding calls are side effects: materialise the result once (write or
``checkpoint``, as ``plans.backfill.backfill_write_back`` does) before a
second action; never filter on the UDF output before that point.  Providers
carry a ``deterministic`` flag (False for HTTP) for callers that cache.
"""
import json
import time
import urllib.error
import urllib.request
from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T


class Embedder:
    """Base class: ``embed(texts) -> list of vectors`` in input order."""

    name = "base"
    deterministic = True

    def __init__(self, model: str = "mock", dimension: int = 64, batch_size: int = 32,
                 **options):
        self.model, self.dimension, self.batch_size = model, dimension, batch_size
        self.options = options

    def embed(self, texts: list[str]) -> list[list[float]]:
        raise NotImplementedError

    def embed_single(self, text: str) -> list[float]:
        return self.embed([text])[0]

    def embed_batches(self, texts: list[str]) -> list[list[float]]:
        """Consecutive chunks of ``batch_size``; the last one may be short."""
        if not texts:
            return []
        out: list[list[float]] = []
        for i in range(0, len(texts), self.batch_size):
            chunk = texts[i:i + self.batch_size]
            vecs = self.embed(chunk)
            if len(vecs) != len(chunk):
                raise ValueError(f"expected {len(chunk)} embeddings, got {len(vecs)}")
            out.extend(vecs)
        return out


    def embed_outcomes(self, texts: list[str]) -> list[tuple]:
        """(vector, outcome, message, sent) per text, in order; never raises for a refusal.

        A refused chunk is halved until the refused texts are alone, so one bad text costs
        its neighbours a few more requests and nothing else.  ``outcome`` is 'success',
        'retry' (may work later) or 'dead' (will not); ``sent`` counts a text's requests.
        """
        out: list[tuple] = []
        for i in range(0, len(texts), self.batch_size):
            out += self._halved(texts[i:i + self.batch_size], 1)
        return out

    def _halved(self, texts: list[str], sent: int) -> list[tuple]:
        try:
            vecs = self.embed(texts)
            if len(vecs) != len(texts):
                raise EmbeddingRequestError(
                    200, f"expected {len(texts)} embeddings, got {len(vecs)}", True)
            return [(v, "success", None, sent) for v in vecs]
        except EmbeddingRequestError as e:
            # a rate limit, a lost server or a wrong key concerns every text alike
            if len(texts) == 1 or e.status in (0, 401, 403, 429):
                return [(None, "retry" if e.retryable else "dead", str(e), sent)] * len(texts)
        half = len(texts) // 2
        return self._halved(texts[:half], sent + 1) + self._halved(texts[half:], sent + 1)


class MockEmbedder(Embedder):
    """Deterministic test embedder (F18 formula), vectorised with numpy."""

    name = "mock"

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        i = np.arange(self.dimension, dtype=np.float64) * 0.001
        out = []
        for t in texts:
            cps = np.frombuffer(t.encode("utf-32-le"), dtype="<u4")
            base = float(cps.sum(dtype=np.int64)) / (len(cps) + 1)
            out.append(np.round(np.mod(base + i, 2.0) - 1.0, 6).astype(np.float32))
        return out


class FaultyEmbedder(MockEmbedder):
    """The test embedder with a provider's refusals, by text length: a request with a text
    whose length leaves ``dead`` (or ``busy``) when divided by ``modulus`` is refused for good
    (or for now)."""

    name = "faulty"

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        o = self.options
        rest = [len(t) % int(o.get("modulus", 50)) for t in texts]
        if int(o.get("dead", 7)) in rest:
            raise EmbeddingRequestError(422, "text refused", False)
        if int(o.get("busy", 9)) in rest:
            raise EmbeddingRequestError(503, "busy", True)
        return super().embed(texts)


# --- UD2: HTTP providers -----------------------------------------------------------

def urllib_transport(url: str, payload: dict, headers: dict, timeout: float):
    """POST JSON; returns (status, headers, body_text).  Status 0 = network error."""
    req = urllib.request.Request(url, data=json.dumps(payload).encode(), method="POST",
                                 headers={"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(req, timeout=timeout) as r:
            return r.status, dict(r.headers), r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers or {}), e.read().decode(errors="replace")
    except (urllib.error.URLError, TimeoutError, OSError) as e:
        return 0, {}, str(e)


def parse_response_body(data) -> list[list[float]]:
    """F14 on one decoded payload (same four shapes as the Column version)."""
    if isinstance(data, dict) and isinstance(data.get("data"), list):
        items = sorted(data["data"], key=lambda d: d.get("index", 0))
        return [d["embedding"] for d in items]
    if isinstance(data, dict) and isinstance(data.get("embeddings"), list):
        return data["embeddings"]
    if isinstance(data, list) and data and isinstance(data[0], list):
        return data
    if isinstance(data, dict) and len(data) == 1:
        v = next(iter(data.values()))
        if isinstance(v, list) and v and isinstance(v[0], list):
            return v
        if isinstance(v, list) and v and isinstance(v[0], (int, float)):
            return [v]
    raise ValueError("unrecognised embedding response shape")


def parse_error_body(text: str) -> str:
    """F15 on one payload."""
    try:
        d = json.loads(text)
    except (ValueError, TypeError):
        return text
    if not isinstance(d, dict):
        return text
    e = d.get("error")
    if isinstance(e, dict) and "message" in e:
        return str(e["message"])
    if isinstance(e, str):
        return e
    for k in ("message", "detail", "description"):
        v = d.get(k)
        if isinstance(v, list) and v:
            return str(v[0])
        if v is not None:
            return str(v)
    return text


class EmbeddingRequestError(RuntimeError):
    def __init__(self, status: int, message: str, retryable: bool):
        super().__init__(f"HTTP {status}: {message}")
        self.status, self.retryable = status, retryable


class HttpEmbedder(Embedder):
    """OpenAI-compatible / self-hosted / custom endpoints (UD2).

    Options: ``endpoint``, ``api_key``, ``timeout``, ``max_retries``,
    ``retry_delay``, ``send_dimensions``, ``transport`` (injectable),
    ``sleep`` (injectable).  Retry rules follow F16/F17: 429 waits
    ``retry-after`` (default ``default_wait``), 401/403/422 fail at once, others
    back off ``retry_delay * 2^attempt``.
    """

    # Seconds to wait on a 429 without retry-after; self-hosted and custom
    # endpoints wait less.
    default_wait = 60

    name = "http"
    deterministic = False

    def url(self) -> str:
        """Custom endpoints: used as given when they already name the
        embeddings route, else ``/v1/embeddings`` is appended."""
        ep = self.options.get("endpoint", "").rstrip("/")
        if ep.endswith("/embeddings") or "/v1/embeddings" in ep:
            return ep
        return ep + "/v1/embeddings"

    def embed(self, texts: list[str]) -> list[list[float]]:
        o = self.options
        transport: Callable = o.get("transport", urllib_transport)
        sleep: Callable = o.get("sleep", time.sleep)
        payload = {"model": self.model, "input": texts}
        if o.get("send_dimensions"):
            payload["dimensions"] = self.dimension
        headers = {"Authorization": f"Bearer {o['api_key']}"} if o.get("api_key") else {}
        max_retries, delay = int(o.get("max_retries", 3)), float(o.get("retry_delay", 1.0))
        attempt = 0
        while True:
            status, hdrs, body = transport(self.url(), payload, headers,
                                           float(o.get("timeout", 30)))
            if status == 200:
                return parse_response_body(json.loads(body))
            msg = parse_error_body(body)
            retryable = status not in (401, 403, 422)
            if not retryable or attempt >= max_retries:
                raise EmbeddingRequestError(status, msg, retryable)
            if status == 429:
                lower = {k.lower(): v for k, v in (hdrs or {}).items()}
                sleep(float(lower.get("retry-after", self.default_wait)))
            else:
                sleep(delay * (2 ** attempt))
            attempt += 1


class OpenAIEmbedder(HttpEmbedder):
    """Hosted OpenAI-style API: ``{base_url}/embeddings``."""

    name = "openai"

    def url(self) -> str:
        base = self.options.get("endpoint", "https://api.openai.com/v1").rstrip("/")
        return base + "/embeddings"


class SelfHostedEmbedder(HttpEmbedder):
    """Self-hosted OpenAI-compatible server: ``{endpoint}/v1/embeddings``."""

    name = "infinity"
    default_wait = 30

    def url(self) -> str:
        return self.options.get("endpoint", "").rstrip("/") + "/v1/embeddings"


class CustomEmbedder(HttpEmbedder):
    """A custom endpoint."""

    name = "custom"
    default_wait = 30


class ThrottledEmbedder(MockEmbedder):
    """The test embedder behind a rate limit: of the tasks of a job, the first ``limit`` are
    served at a time and all others refused."""

    name = "throttled"

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        from pyspark import TaskContext

        if TaskContext.get().partitionId() >= int(self.options.get("limit", 8)):
            raise EmbeddingRequestError(429, "too many requests at once", True)
        return super().embed(texts)


PROVIDERS: dict[str, type[Embedder]] = {"mock": MockEmbedder, "http": HttpEmbedder,
                                        "custom": CustomEmbedder, "openai": OpenAIEmbedder,
                                        "infinity": SelfHostedEmbedder,
                                        "faulty": FaultyEmbedder, "throttled": ThrottledEmbedder}


def register_provider(name: str, cls: type[Embedder]) -> None:
    PROVIDERS[name] = cls


def make_embedder(provider: str, **config) -> Embedder:
    return PROVIDERS[provider](**config)


def embed_column(df: DataFrame, text_col: str, out_col: str = "embedding",
                 provider: str = "mock", max_tasks: int | None = None,
                 **config) -> DataFrame:
    """UD1: ``df`` plus ``out_col array<float>`` computed by the named embedder.

    NULL texts give NULL vectors (they are not sent).  One client per task.
    ``max_tasks`` bounds how many tasks call the provider at once (a
    provider's rate limit is global, tasks are not): the rows are spread
    evenly over that many partitions first.
    """
    if max_tasks:
        df = df.repartition(max_tasks)
    schema = T.StructType(df.schema.fields + [
        T.StructField(out_col, T.ArrayType(T.FloatType(), False), True)])
    cls = PROVIDERS[provider]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = cls(**config)
        for pdf in batches:
            texts = pdf[text_col]
            mask = texts.notna().to_numpy()
            vecs = client.embed_batches(texts[mask].tolist())
            col = np.empty(len(pdf), dtype=object)
            for j, v in zip(np.flatnonzero(mask), vecs):
                col[j] = np.asarray(v, dtype=np.float32)
            pdf[out_col] = col
            yield pdf

    return df.mapInPandas(run, schema)


def embed_outcomes(df: DataFrame, text_col: str, provider: str = "mock",
                   vector_col: str = "vector", max_tasks: int | None = None,
                   at_end: Callable[[int, int], None] | None = None, **config) -> DataFrame:
    """UD1 with failures as rows: ``df`` plus the vector, ``outcome`` ('success', 'retry',
    'dead'; 'skipped' for NULL texts), ``message`` and ``sent`` (requests with the text).

    What S5, S7 and F17 read: a text that a provider refuses never ends the job.  ``at_end`` is
    called at the end of each task with its rows and those refused for the rate (429).
    """
    if max_tasks:
        df = df.repartition(max_tasks)
    schema = T.StructType(df.schema.fields + [
        T.StructField(vector_col, T.ArrayType(T.FloatType(), False), True),
        T.StructField("outcome", T.StringType()), T.StructField("message", T.StringType()),
        T.StructField("sent", T.IntegerType())])
    cls = PROVIDERS[provider]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = cls(**config)
        total = refused = 0
        for pdf in batches:
            texts = pdf[text_col]
            there = texts.notna().to_numpy()
            found = iter(client.embed_outcomes(texts[there].tolist()))
            rows = [next(found) if x else (None, "skipped", None, 0) for x in there]
            pdf[vector_col] = [None if r[0] is None else np.asarray(r[0], dtype=np.float32)
                               for r in rows]
            for i, name in enumerate(("outcome", "message", "sent"), 1):
                pdf[name] = [r[i] for r in rows]
            total += len(rows)
            refused += sum(r[1] == "retry" and "429" in r[2] for r in rows)
            yield pdf
        if at_end:
            at_end(total, refused)

    return df.mapInPandas(run, schema)


SAMPLE_KEYS = 8192
MAX_BUCKETS = 512


def key_bounds(df: DataFrame, keys: list[str], buckets: int) -> list[tuple]:
    """Up to ``buckets - 1`` sort keys that cut ``df`` into about equal ranges: quantiles of
    the ``SAMPLE_KEYS`` rows with the lowest hash (a bounded sample)."""
    from pyspark.sql import functions as F

    sample = df.select(*keys).orderBy(F.xxhash64(*keys)).limit(SAMPLE_KEYS).orderBy(*keys)
    rows = [tuple(r) for r in sample.collect()]
    return [rows[i * len(rows) // buckets] for i in range(1, buckets)] if rows else []


def bucket_of(df: DataFrame, keys: list[str], bounds: list[tuple]) -> Column:
    """How many bounds are at or below a row's sort key: a pure function of the row, found
    among every 23rd bound or so first and then among those up to the next one."""
    from pyspark.sql import functions as F

    if not bounds:
        return F.lit(0)
    kinds = [df.schema[k].dataType for k in keys]
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    lit = F.array(*[F.struct(*[F.lit(v).cast(t).alias(f"k{i}")
                               for i, (v, t) in enumerate(zip(b, kinds))]) for b in bounds])
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.array(*[F.get(lit, F.lit(i)) for i in range(0, len(bounds), step)])
    first = F.greatest(F.size(F.filter(coarse, lambda b: b <= key)) - 1, F.lit(0)) * step
    return first + F.size(F.filter(F.slice(lit, first + 1, F.lit(step)), lambda b: b <= key))


def batch_plan(df: DataFrame, group: list[str], order: list[str], batch_size: int
               ) -> DataFrame:
    """W2, table form: ``batch_no = floor((row_number() - 1) / batch_size)``
    per group in ``order`` — computed without a global or per-group window.

    Sort keys sampled once cut the rows into ranges; a row's range is a pure
    function of its key, so it is the same wherever it is computed.  Rows are
    numbered per (group, range), and each range starts after the rows of the
    group in earlier ranges (a table of one row per group and range).  A
    group holding a third of all rows is spread over its ranges.  ``order``
    must identify rows uniquely inside a group (a total order).
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    keys = [*group, *order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    bounds = key_bounds(df, keys, min(MAX_BUCKETS, 2 * parts))
    x = df.withColumn("_range", bucket_of(df, keys, bounds))
    pieces = x.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
                           F.col("_range").alias("_r"),
                           F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group, "_range").orderBy(*order)
    x = x.withColumn("_inside", F.row_number().over(inside))
    same = [x[g].eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    return (x.join(pieces, [*same, x["_range"] == pieces["_r"]])
             .withColumn("row_number", (F.col("_offset") + F.col("_inside")).cast("long"))
             .withColumn("batch_no", F.floor((F.col("row_number") - 1) / batch_size))
             .select(*df.columns, "row_number", "batch_no"))
