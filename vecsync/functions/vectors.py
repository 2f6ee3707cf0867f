"""Vector Column functions: P8 validity, F12 text literal, F13 truncation,
F18 deterministic test embedding, and the similarity kernels used by k-NN.

Vectors are ``array<float>``; Spark has no fixed-length array type, so the
declared dimension travels as a parameter / column metadata and P8 is the
constraint that enforces it.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Known output widths per model, as the providers list them.
KNOWN_MODEL_DIMENSIONS = {
    # self-hosted (OpenAI-compatible) servers
    "minishlab/potion-multilingual-128M": 768,
    "BAAI/bge-m3": 1024,
    "BAAI/bge-base-en-v1.5": 768,
    "BAAI/bge-large-en-v1.5": 1024,
    "sentence-transformers/all-MiniLM-L6-v2": 384,
    "sentence-transformers/all-mpnet-base-v2": 768,
    # hosted API
    "text-embedding-3-small": 1536,
    "text-embedding-3-large": 3072,
    "text-embedding-ada-002": 1536,
}
# Models that may be asked for a narrower vector (never a wider one).
SHORTENABLE_MODEL_PREFIX = "text-embedding-3"
# Default width per named embedding config (768 when the name is unknown).
CONFIG_DEFAULT_DIMENSIONS = {
    "openai-small": 1536,
    "openai-large": 3072,
    "infinity_static": 768,
    "infinity_bge": 1024,
    "default": 768,
}

VECTOR_TYPE = "array<float>"


def vsize(v: Column | str) -> Column:
    """Vector length, NULL for a NULL vector under any ANSI setting
    (legacy ``size(NULL)`` is -1)."""
    c = F.col(v) if isinstance(v, str) else v
    return F.when(c.isNotNull(), F.size(c))


def vector_status(v: Column, dimension: int | Column) -> Column:
    """P8: 'null_vector' | 'wrong_dimension' | 'non_numeric' | 'ok'."""
    dim = dimension if isinstance(dimension, Column) else F.lit(dimension)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x))
    return (F.when(v.isNull(), "null_vector")
             .when(F.size(v) != dim, "wrong_dimension")
             .when(~finite, "non_numeric")
             .otherwise("ok"))


def is_valid_vector(v: Column, dimension: int | Column) -> Column:
    return vector_status(v, dimension) == "ok"


def vector_to_text(v: Column) -> Column:
    """``[0.1,0.2]`` literal (the form pgvector prints)."""
    return F.concat(F.lit("["), F.array_join(v.cast("array<string>"), ","), F.lit("]"))


def text_to_vector(s: Column) -> Column:
    """parse a ``[0.1,0.2]`` literal back to ``array<float>``."""
    return F.from_json(s, VECTOR_TYPE)


def truncate_vector(v: Column, n: int, renormalize: bool = False) -> Column:
    """keep the first ``n`` components (optionally re-normalised to unit length)."""
    t = F.slice(v, 1, n)
    if not renormalize:
        return t
    norm = F.sqrt(F.aggregate(t, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return F.transform(t, lambda x: (x / norm).cast("float"))


def code_point_sum(text: Column) -> Column:
    """Sum of the Unicode code points of a string (``split(s,'')`` is per code point)."""
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda a, ch: a + F.ascii(ch))


def mock_embedding(text: Column, dimension: int) -> Column:
    """deterministic test embedding.

    base = sum(code points) / (len + 1);  v_i = round((base + i*0.001) mod 2 - 1, 6)

    ``base`` is bound once per row through a one-element outer ``transform``;
    written directly inside the inner lambda it would be re-evaluated for
    every component (no common-subexpression elimination inside lambdas).
    """
    t = F.coalesce(text, F.lit(""))
    base = code_point_sum(t) / (F.length(t) + F.lit(1))
    idx = F.sequence(F.lit(0), F.lit(dimension - 1))
    return F.transform(F.array(base), lambda b: F.transform(
        idx, lambda i: F.round(F.pmod(b + i * F.lit(0.001), F.lit(2.0)) - F.lit(1.0), 6)
                        .cast("float")))[0]


def dot(a: Column, b: Column) -> Column:
    """Inner product of two equal-length vectors, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(
        F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double"))
                   * (x.cast("double") - y.cast("double"))),
        F.lit(0.0), lambda acc, x: acc + x))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b) / (l2_norm(a) * l2_norm(b))


def score(metric: str, a: Column, b: Column) -> Column:
    """Distance-like score (smaller is closer) for 'l2', 'ip' (negative inner
    product, as pgvector's <#>) or 'cosine'."""
    if metric == "l2":
        return l2_distance(a, b)
    if metric == "ip":
        return -dot(a, b)
    if metric == "cosine":
        return cosine_distance(a, b)
    raise ValueError(f"unknown metric {metric!r}")
