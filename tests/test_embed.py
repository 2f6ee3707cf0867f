"""UD1/UD2, F14–F18, W2: embedder, HTTP retry rules with a fake transport."""
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from support import one_col
from vecsync.functions import errors as ER
from vecsync.functions.vectors import mock_embedding
from vecsync.operators import embed as EM


def py_mock(text, dim):
    base = sum(ord(c) for c in text) / (len(text) + 1)
    return [round((base + i * 0.001) % 2.0 - 1.0, 6) for i in range(dim)]


TEXTS = ["Hello world", "", "   ", "Café déjà vu", "line one\nline two", "😀 emoji", "x" * 500,
         "Ünïcödé"]


def test_mock_embedder_matches_formula():
    got = EM.MockEmbedder(dimension=16).embed([t for t in TEXTS])
    for t, v in zip(TEXTS, got):
        assert np.allclose(v, py_mock(t, 16), atol=1.5e-6)


def test_native_and_udf_embedding_agree(spark):
    df = one_col(spark, TEXTS)
    nat = df.select("i", mock_embedding(F.col("t"), 16).alias("v")).orderBy("i").collect()
    udf = EM.embed_column(df, "t", "v", "mock", dimension=16, batch_size=3) \
            .orderBy("i").collect()
    for a, b, t in zip(nat, udf, TEXTS):
        assert np.allclose(a.v, b.v, atol=1.5e-6)
        assert np.allclose(a.v, py_mock(t, 16), atol=1.5e-6)


def test_batches_are_chunked_in_order():
    seen = []

    class Rec(EM.Embedder):
        def embed(self, texts):
            seen.append(list(texts))
            return [[float(len(t))] for t in texts]

    out = Rec(batch_size=3).embed_batches(["a", "bb", "ccc", "dddd", "e"])
    assert seen == [["a", "bb", "ccc"], ["dddd", "e"]]
    assert out == [[1.0], [2.0], [3.0], [4.0], [1.0]]


def test_count_mismatch_is_an_error():
    class Bad(EM.Embedder):
        def embed(self, texts):
            return [[0.0]]

    with pytest.raises(ValueError):
        Bad(batch_size=4).embed_batches(["a", "b"])


def fake(responses):
    calls, sleeps = [], []

    def transport(url, payload, headers, timeout):
        calls.append((url, payload))
        return responses.pop(0)

    return calls, sleeps, transport


def http(transport, sleeps, **kw):
    return EM.HttpEmbedder(model="m", dimension=2, endpoint="http://h:1", transport=transport,
                           sleep=sleeps.append, retry_delay=1.0, max_retries=3, **kw)


def ok(vecs):
    return 200, {}, json.dumps({"data": [{"index": i, "embedding": v} for i, v in enumerate(vecs)]})


def test_rate_limit_waits_retry_after_then_succeeds():
    calls, sleeps, tr = fake([(429, {"Retry-After": "7"}, "{}"), ok([[1, 2]])])
    assert http(tr, sleeps).embed(["a"]) == [[1, 2]]
    assert sleeps == [7.0] and calls[0][0] == "http://h:1/v1/embeddings"


def test_rate_limit_default_wait():
    _, sleeps, tr = fake([(429, {}, "{}"), ok([[1, 2]])])
    http(tr, sleeps).embed(["a"])
    assert sleeps == [60.0]


@pytest.mark.parametrize("status", [401, 403, 422])
def test_no_retry_statuses(status):
    calls, sleeps, tr = fake([(status, {}, json.dumps({"detail": ["bad input", "x"]}))])
    with pytest.raises(EM.EmbeddingRequestError) as e:
        http(tr, sleeps).embed(["a"])
    assert len(calls) == 1 and sleeps == [] and not e.value.retryable


def test_server_errors_back_off_then_give_up():
    err = (500, {}, json.dumps({"error": {"message": "boom"}}))
    calls, sleeps, tr = fake([err, err, err, err])
    with pytest.raises(EM.EmbeddingRequestError) as e:
        http(tr, sleeps).embed(["a"])
    assert sleeps == [1.0, 2.0, 4.0] and len(calls) == 4 and "boom" in str(e.value)


def test_network_error_is_retried():
    _, sleeps, tr = fake([(0, {}, "connection refused"), ok([[0.5, 0.5]])])
    assert http(tr, sleeps).embed(["a"]) == [[0.5, 0.5]]


@pytest.mark.parametrize("body,want", [
    ({"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]}, [[1.0], [2.0]]),
    ({"embeddings": [[1.0], [2.0]]}, [[1.0], [2.0]]),
    ([[1.0], [2.0]], [[1.0], [2.0]]),
    ({"vectors": [[1.0]]}, [[1.0]]),
    ({"vector": [1.0, 2.0]}, [[1.0, 2.0]]),
])
def test_response_shapes_python_and_native(spark, body, want):
    assert EM.parse_response_body(body) == want
    df = spark.createDataFrame([(json.dumps(body),)], "b string")
    got = df.select(ER.parse_embedding_response(F.col("b")).alias("v")).first().v
    assert [list(map(float, v)) for v in got] == want


@pytest.mark.parametrize("body,want", [
    ({"error": {"message": "m1"}}, "m1"), ({"error": "m2"}, "m2"), ({"message": "m3"}, "m3"),
    ({"detail": "m4"}, "m4"), ({"detail": ["m5", "z"]}, "m5"), ({"description": "m6"}, "m6"),
])
def test_error_messages_python_and_native(spark, body, want):
    s = json.dumps(body)
    assert EM.parse_error_body(s) == want
    df = spark.createDataFrame([(s,)], "b string")
    assert df.select(ER.parse_error_message(F.col("b")).alias("m")).first().m == want


def test_provider_url_rules():
    mk = lambda p, ep: EM.make_embedder(p, endpoint=ep)
    assert mk("openai", "https://api.example.com/v1").url() == "https://api.example.com/v1/embeddings"
    assert mk("infinity", "http://h:7997").url() == "http://h:7997/v1/embeddings"
    assert mk("custom", "http://h/api/embeddings").url() == "http://h/api/embeddings"
    assert mk("custom", "http://h/v1/embeddings?x=1").url() == "http://h/v1/embeddings?x=1"
    assert mk("custom", "http://h").url() == "http://h/v1/embeddings"


def test_embed_column_bounded_tasks(spark):
    df = one_col(spark, TEXTS * 5).repartition(6)
    out = EM.embed_column(df, "t", "v", "mock", max_tasks=2, dimension=4)
    assert out.rdd.getNumPartitions() == 2 and out.count() == len(TEXTS) * 5


def test_one_bad_text_costs_only_itself(spark):
    """10,000 texts, one refused for good: 9,999 vectors, and few extra requests."""
    from vecsync.operators.embed import embed_outcomes
    rows = [(i, "x" * (7 if i == 4321 else 10)) for i in range(10_000)]
    df = spark.createDataFrame(rows + [(10_000, None)], "i long, t string")
    got = embed_outcomes(df, "t", "faulty", dimension=4, batch_size=64).collect()
    bad = [r for r in got if r.outcome == "dead"]
    assert [r.i for r in bad] == [4321] and bad[0].message == "HTTP 422: text refused"
    assert bad[0].sent == 7 and bad[0].vector is None      # 64, 32, ... 1
    assert sum(r.outcome == "success" and len(r.vector) == 4 for r in got) == 9_999
    assert sum(r.sent for r in got) < 10_000 + 64 * 7
    assert [r.outcome for r in got if r.i == 10_000] == ["skipped"]


def test_outcomes_of_whole_requests():
    """A wrong count is found and halved; a rate limit or a lost server is not."""
    from vecsync.operators.embed import EmbeddingRequestError, MockEmbedder

    class Short(MockEmbedder):
        def embed(self, texts):
            return super().embed([t for t in texts if t != "gone"])

    got = Short(dimension=2, batch_size=8).embed_outcomes(["a", "gone", "b", "c"])
    assert [g[1] for g in got] == ["success", "retry", "success", "success"]

    class Down(MockEmbedder):
        calls = 0

        def embed(self, texts):
            Down.calls += 1
            raise EmbeddingRequestError(0, "no route", True)

    got = Down(dimension=2, batch_size=8).embed_outcomes(["a"] * 20)
    assert Down.calls == 3 and {g[1] for g in got} == {"retry"}


def test_default_waits_by_provider():
    from vecsync.operators import embed as EM
    waits = []
    for name in ("openai", "infinity", "custom"):
        replies = iter([(429, {}, "{}"), (200, {}, '{"embeddings": [[1.0]]}')])
        EM.make_embedder(name, endpoint="http://e", sleep=waits.append,
                         transport=lambda *a: next(replies)).embed(["x"])
    assert waits == [60.0, 30.0, 30.0]
