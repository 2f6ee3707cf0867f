"""W2 by cost: texts are packed into requests under a number of texts and a number of tokens.

Rows fall into groups of about ``GROUP_ROWS`` by a hash of their id; each group is packed on
its own by a best fit that spends tokens and slots evenly (``best_fit``).  A group, the order
in it and the packing depend on the ids and sizes alone, so a retried task, or another run over
the same rows, makes the same requests.  A text above the token limit is a request of its own
(``oversize``).

``lower_bound`` is what no packing can go below: the tokens by the limit, the texts by the
batch size, and the texts of over half the limit, of which no two share a request.
"""
from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .embed import PROVIDERS

GROUP_ROWS = 20_000
#: Tasks that the rows of one ``by`` are dealt to when they learn how many groups it has.
SALTS = 64
#: Rows that a task has in Python objects at a time.
CHUNK_ROWS = 256
CHARS_PER_TOKEN = 4


def estimated_tokens(text: Column) -> Column:
    """One token for every ``CHARS_PER_TOKEN`` characters begun, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / CHARS_PER_TOKEN)).cast("long")


def best_fit(sizes: list[int], batch_size: int, limit: int) -> list[int]:
    """The request of each text.

    A request opens with the largest text left.  While it has slots and room, it takes the
    largest text that is at most its room by its slots left, so that both run out together;
    where all texts are above that, slots are no concern and it takes the largest that fits.
    """
    left = sorted((size, i) for i, size in enumerate(sizes))
    out, request = [0] * len(sizes), 0
    while left:
        size, i = left.pop()
        out[i] = request
        room, slots = limit - size, batch_size - 1
        while slots and left and left[0][0] <= room:
            at = bisect_right(left, (room / slots, len(sizes))) - 1
            if at < 0:
                at = bisect_right(left, (room, len(sizes))) - 1
            size, i = left.pop(at)
            out[i] = request
            room, slots = room - size, slots - 1
        request += 1
    return out


def pack_requests(df: DataFrame, id_col: str, text_col: str, batch_size: int, token_limit: int,
                  by: list[str] | None = None, tokens: Column | None = None) -> DataFrame:
    """``df`` plus tokens, request (a name) and oversize; rows of different ``by`` never share
    a request.  Rows without a text have no request."""
    by = by or []
    size = estimated_tokens(F.col(text_col)) if tokens is None else tokens.cast("long")
    has = F.col(text_col).isNotNull()
    counted = df.filter(has).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    groups = F.greatest(F.lit(1), F.ceil(F.col("_n") / GROUP_ROWS)).cast("long")
    names = [f"_b{i}" for i in range(len(by))]
    named = [F.col(c).alias(n) for c, n in zip(by, names)]
    own = df.select("*", *named, F.when(has, size).alias("tokens"))
    slim = df.filter(has).select(F.col(id_col).alias("_id"), size.alias("tokens"), *named)
    sized = counted.select(*named, groups.alias("_g"))
    if by:
        # neither texts nor all rows of a ``by`` meet in a task
        sized = sized.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        slim = slim.withColumn("_salt", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(SALTS))
                               .cast("int"))
        same = [slim[n].eqNullSafe(sized[n]) for n in names]
        slim = slim.join(sized, [*same, slim["_salt"] == sized["_salt"]]).select(
            slim["_id"], slim["tokens"], *[slim[n] for n in names], "_g")
    else:
        slim = slim.withColumn("_g", F.lit(sized.first()["_g"]))
    key = F.sha2(F.to_json(F.struct(F.lit(0), *[F.col(n) for n in names])), 256)
    slim = slim.select(key.alias("_k"), F.pmod(F.xxhash64("_id"), F.col("_g")).alias("_g"),
                       "_id", "tokens")

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "_id"], ascending=[False, True], kind="stable")
        request = best_fit(pdf["tokens"].tolist(), batch_size, token_limit)
        return pd.DataFrame({"_k": pdf["_k"], "_id": pdf["_id"],
                             "request": [f"{key[0][:12]}-{key[1]}-{r}" for r in request]})

    kind = df.schema[id_col].dataType.simpleString()
    packed = slim.groupBy("_k", "_g").applyInPandas(pack, f"_k string, _id {kind}, request string")
    own = own.withColumn("_k", key)
    return (own.join(packed, (own["_k"] == packed["_k"]) & (own[id_col] == packed["_id"])
                     & has, "left")
            .select(*[own[c] for c in df.columns], own["tokens"], "request",
                    (own["tokens"] > token_limit).alias("oversize")))


def lower_bound(sizes: list[int], batch_size: int, limit: int) -> int:
    """Requests that no packing can go below; texts above the limit have one each."""
    fit = [s for s in sizes if s <= limit]
    if not fit:
        return len(sizes)
    return len(sizes) - len(fit) + max(math.ceil(sum(fit) / limit),
                                       math.ceil(len(fit) / batch_size),
                                       sum(s > limit / 2 for s in fit))


def request_totals(packed: DataFrame, batch_size: int, token_limit: int,
                   by: list[str]) -> DataFrame:
    """Per ``by``: texts, tokens, requests, the bound below them, and the fullest request."""
    fit = ~F.col("oversize")
    each = packed.filter(F.col("request").isNotNull()).groupBy(*by, "request").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"),
        F.max("oversize").alias("oversize"), F.count_if(F.col("tokens") > token_limit / 2)
        .alias("big"))
    return each.groupBy(*by).agg(
        F.sum("n").alias("texts"), F.sum("t").alias("tokens"), F.count(F.lit(1)).alias("requests"),
        (F.count_if("oversize") + F.greatest(
            F.ceil(F.coalesce(F.sum(F.when(fit, F.col("t"))), F.lit(0)) / token_limit),
            F.ceil(F.coalesce(F.sum(F.when(fit, F.col("n"))), F.lit(0)) / batch_size),
            F.coalesce(F.sum(F.when(fit, F.col("big"))), F.lit(0)))).alias("lower_bound"),
        F.max("n").alias("most_texts"), F.max(F.when(fit, F.col("t"))).alias("most_tokens"))


def embed_requests(packed: DataFrame, text_col: str, provider: str = "mock",
                   vector_col: str = "vector", max_tasks: int | None = None,
                   **config) -> DataFrame:
    """UD1 over packed rows: one call for each request, with all its texts and no others; the
    rows as they were plus vector, outcome, message, sent as ``embed.embed_outcomes`` gives."""
    schema = T.StructType(packed.schema.fields + [
        T.StructField(vector_col, T.ArrayType(T.FloatType(), False), True),
        T.StructField("outcome", T.StringType()), T.StructField("message", T.StringType()),
        T.StructField("sent", T.IntegerType())])
    cls = PROVIDERS[provider]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = cls(**{**config, "batch_size": 1 << 30})
        left = None                      # the last request of a batch may go on in the next

        def done(part: pa.Table, names: list) -> Iterator[pa.RecordBatch]:
            texts, rows = part[text_col].to_pylist(), [(None, "skipped", None, 0)] * len(names)
            asked: dict[str, list[int]] = {}
            for i, name in enumerate(names):
                if name is not None:
                    asked.setdefault(name, []).append(i)
            for at in asked.values():
                for i, r in zip(at, client.embed_outcomes([texts[i] for i in at])):
                    rows[i] = r
            vectors = [None if r[0] is None else np.asarray(r[0], dtype=np.float32)
                       for r in rows]
            part = part.append_column(vector_col, pa.array(vectors, pa.list_(pa.float32())))
            for i, (name, kind) in enumerate((("outcome", pa.string()), ("message", pa.string()),
                                              ("sent", pa.int32())), 1):
                part = part.append_column(name, pa.array([r[i] for r in rows], kind))
            yield from part.combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            part = part if left is None else pa.concat_tables([left, part])
            names = part["request"].to_pylist()
            lo = 0
            for hi in range(1, len(names)):
                if hi - lo >= CHUNK_ROWS and (names[hi] is None or names[hi] != names[hi - 1]):
                    yield from done(part.slice(lo, hi - lo), names[lo:hi])
                    lo = hi
            # a copy of the few rows, so that the batch itself can go
            rest = part.slice(lo)
            left = rest.take(pa.array(range(rest.num_rows)))
        if left is not None:
            yield from done(left, left["request"].to_pylist())

    rows = (packed.repartition(max_tasks, "request") if max_tasks
            else packed.repartition("request"))
    return rows.sortWithinPartitions("request").mapInArrow(run, schema)
