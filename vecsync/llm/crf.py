"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line gets features of its own characters and words and of how it resembles its
neighbours.  The field has two states, bad and good; forward-backward gives each line's
marginal probability of good, and their mean, weighted by line length, is the document's
score.  Training takes a document's label for all its lines, maximises the conditional
likelihood by gradient steps (Adam), and sees stretches of lines of at most ``max_docs``
labelled documents, chosen by a hash of the identifier, and ``max_lines`` lines in all (the
documented bounds on the training sample; scoring has none).  Scoring
is one pass over whole texts without a shuffle.

Defined results
    null or empty text     one empty line; its marginal is the score
    nothing to learn from  all weights zero: every score is 0.5
    null label             not learned from
    equal rows             equal scores, one per row
    repeated label rows    each counts as a row to learn from
    empty table            empty result
    very long texts        all lines count; memory grows with one slice of a batch
    extra columns          never read; ``keep_good`` returns them, whatever their names
"""
from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecsync.llm.common import col, crc_of_id, packed, slices, unpacked

# classes of bytes: letters of either case, digits, white space, punctuation, bytes over 127
UP, LOW, DIGIT, SPACE, PUNCT, HIGH = range(6)
CLASS = np.full(256, PUNCT, np.uint8)  # of each byte
CLASS[ord("A"):ord("Z") + 1] = UP
CLASS[ord("a"):ord("z") + 1] = LOW
CLASS[ord("0"):ord("9") + 1] = DIGIT
CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
CLASS[128:] = HIGH
OWN = 19                      # features of a line by itself
NEIGHBOUR = 5                 # of those, the ones also taken from the lines beside it
FEATURES = 1 + OWN + 2 * NEIGHBOUR + 4


def _own(line: bytes) -> tuple:
    """Of a line's words: how many, distinct, repeated in a row, longest, marked, mere marks."""
    w = line.split()
    n = len(w)
    if not n:
        return 0, 0, 0, 0, 0, 0
    same = sum(map(bytes.__eq__, w, w[1:]))
    # words that end in two or more marks, such as "word!!"
    marked = sum(1 for x in w if len(x) > 2 and x[-2] == x[-1] and CLASS[x[-1]] == PUNCT)
    bare = sum(1 for x in w if len(x) == 1 and CLASS[x[0]] == PUNCT)
    return n, len(set(w)), same, max(map(len, w)), marked, bare


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, line lengths, first line of each text) of all lines of some texts."""
    lines = [(t or "").encode("utf-8", "surrogatepass").split(b"\n") for t in texts]
    first = np.cumsum([0] + [len(x) for x in lines])
    flat = [x for own in lines for x in own]
    size = np.fromiter(map(len, flat), np.int64, len(flat))
    n = len(flat)
    data = np.frombuffer(b"\n".join(flat), np.uint8)
    kinds = np.zeros((n, 6))
    at = np.cumsum(size + 1) - size - 1                 # where a line begins
    for k in range(6):
        total = np.r_[0, np.cumsum(CLASS[data] == k, dtype=np.int64)]
        kinds[:, k] = total[at + size] - total[at]
    word = np.array([_own(x) for x in flat], dtype=float).reshape(n, 6)
    chars, words = np.maximum(size, 1), np.maximum(word[:, 0], 1)
    letters = np.maximum(kinds[:, UP] + kinds[:, LOW] + kinds[:, HIGH], 1)
    own = np.column_stack([
        kinds[:, PUNCT] / chars, kinds[:, UP] / letters, kinds[:, DIGIT] / chars,
        word[:, 2] / words, 1 - word[:, 1] / words, kinds[:, SPACE] / chars,
        kinds[:, HIGH] / chars, word[:, 4] / words, np.log1p(size) / 8, np.log1p(word[:, 0]) / 6,
        np.minimum(size / words, 40) / 20, np.minimum(word[:, 3], 80) / 40, size == 0,
        word[:, 0] < 3, kinds[:, PUNCT] / words / 4, word[:, 5] / words,
        word[:, 2] / words > 0.15, word[:, 4] + word[:, 5] > 0.1 * words,
        kinds[:, UP] > 0.5 * letters])
    head, last = np.zeros(n, bool), np.zeros(n, bool)
    head[first[:-1]] = True
    last[first[1:] - 1] = True
    before, after = np.roll(own[:, :NEIGHBOUR], 1, 0), np.roll(own[:, :NEIGHBOUR], -1, 0)
    before[head] = 0
    after[last] = 0
    same = np.fromiter((a == b for a, b in zip(flat, flat[1:])), bool, max(0, n - 1))
    like = np.zeros((n, 2))
    like[1:, 0] = same
    like[:-1, 1] = same
    like[head, 0] = 0
    like[last, 1] = 0
    x = np.column_stack([np.ones(n), own, before, after, like, head, last])
    return x, size, first


@dataclass
class Field:
    """Weights of good against bad for each feature, and of staying against changing state."""

    weight: np.ndarray
    stay: float


def _chains(first: np.ndarray) -> list[np.ndarray]:
    """Lines by their place in a text: element t lists line t of every text so long."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, size = first[:-1][order], size[order]
    return [start[:int((size > t).sum())] + t for t in range(int(size[0]) if len(size) else 0)]


def marginals(x: np.ndarray, first: np.ndarray, field: Field) -> tuple[np.ndarray, ...]:
    """Forward-backward in logarithms: P(good) per line, log Z per text (longest first),
    and the expected number of equal neighbours per text."""
    u = x @ field.weight                               # score of good; bad has 0
    steps = _chains(first)
    fore, back = np.zeros((len(x), 2)), np.zeros((len(x), 2))
    for t, now in enumerate(steps):
        own = np.column_stack([np.zeros(len(now)), u[now]])
        if t:
            p = fore[now - 1]
            own[:, 0] += np.logaddexp(p[:, 0] + field.stay, p[:, 1])
            own[:, 1] += np.logaddexp(p[:, 0], p[:, 1] + field.stay)
        fore[now] = own
    for now in reversed(steps[1:]):
        b0, b1 = back[now, 0], back[now, 1] + u[now]
        back[now - 1] = np.column_stack([np.logaddexp(b0 + field.stay, b1),
                                         np.logaddexp(b0, b1 + field.stay)])
    good = 1 / (1 + np.exp(np.clip(fore[:, 0] + back[:, 0] - fore[:, 1] - back[:, 1], -700, 700)))
    z = np.zeros(len(first) - 1)
    z[:] = np.logaddexp(*(fore + back)[first[:-1]].T) if len(z) else 0
    joined = np.zeros(len(x))
    for now in steps[1:]:
        of = np.logaddexp(*(fore + back)[now].T)
        for s in (0, 1):
            joined[now] += np.exp(fore[now - 1, s] + field.stay + s * u[now] + back[now, s] - of)
    return good, z, joined


def fit(x: np.ndarray, first: np.ndarray, label: np.ndarray, steps: int = 150,
        l2: float = 1e-3) -> Field:
    """Maximum conditional likelihood; ``label`` is 0 or 1 for every text."""
    if not len(label):
        return Field(np.zeros(FEATURES), 0.0)
    scale = np.maximum(x.std(axis=0), 0.02)            # steps of like size for all weights
    scale[0] = 1.0
    x = x / scale
    field = Field(np.zeros(FEATURES), 0.0)
    y = np.repeat(label, np.diff(first)).astype(float)
    inner = np.ones(len(x))
    inner[first[:-1]] = 0
    n, m, v = len(x), np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    for t in range(1, steps + 1):                      # Adam on the exact gradient
        good, _, joined = marginals(x, first, field)
        g = np.r_[x.T @ (y - good) / n - l2 * field.weight,
                  ((inner - joined) * inner).sum() / n - l2 * field.stay]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        field = Field(field.weight + move[:-1], float(np.clip(field.stay + move[-1], -3, 3)))
    return Field(field.weight / scale, field.stay)


def learn(docs: DataFrame, labels: DataFrame, rows: Column, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "quality", max_lines: int = 40_000,
          max_docs: int = 4_000, text_lines: int = 80) -> Field:
    """Fit on the documents that ``rows`` names and that have a label: of those the
    ``max_docs`` with the lowest identifier hash, cut off after ``max_lines`` lines.  A
    training text with over ``text_lines`` lines gives that many in a row, from a place its
    checksum names (``text_lines=0``: all).  Only what is learned from is bounded; scores are
    of whole texts."""
    own = (labels.filter(col(label_col).isNotNull() & rows)
           .select(col(id_col).alias("id"), col(label_col).cast("int").alias("y"))
           .orderBy(F.xxhash64("id"), "id", "y").limit(max_docs))
    named = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))

    def stretch(text: str | None) -> str:
        lines = (text or "").split("\n")
        most = text_lines or len(lines)
        at = zlib.crc32((text or "").encode("utf-8", "surrogatepass")) % max(
            1, len(lines) - most + 1)
        return "\n".join(lines[at:at + most])

    def features(batches):
        for pdf in slices(batches, "text"):
            x, _, first = line_features([stretch(t) for t in pdf["text"]])
            yield pd.DataFrame({"id": pdf["id"], "y": pdf["y"],
                                "n": np.diff(first).astype(np.int32),
                                "x": [x[a:b].astype(np.float32).tobytes()
                                      for a, b in zip(first, first[1:])]})

    kind = docs.schema[id_col].dataType.simpleString()
    # max_docs rows at most, so they may be broadcast
    sample = (named.join(F.broadcast(own), "id")
              .mapInPandas(features, f"id {kind}, y int, n int, x binary")
              .orderBy(F.xxhash64("id"), "id", "y", "n").limit(max_docs))
    spent = F.sum("n").over(_order()) - F.col("n")
    got = (sample.withColumn("spent", spent).filter(F.col("spent") < max_lines)
           .select("y", "n", "x").collect())
    if not got:
        return Field(np.zeros(FEATURES), 0.0)
    x = np.concatenate([np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in got])
    return fit(x.astype(float), np.cumsum([0] + [r.n for r in got]),
               np.array([r.y for r in got]))


def _order():
    from pyspark.sql import Window
    # at most max_docs rows, so one task may order them
    return Window.orderBy(F.xxhash64("id"), "id", "y", "n").rowsBetween(
        Window.unboundedPreceding, 0)


def scores(texts: list[str | None], field: Field) -> np.ndarray:
    """Mean marginal of good per text, weighted by line length (an empty line weighs 1)."""
    x, size, first = line_features(texts)
    good, _, _ = marginals(x, first, field)
    weight = np.maximum(size, 1).astype(float)
    return (np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
            if len(first) > 1 else np.zeros(0))


def score(docs: DataFrame, field: Field, threshold: float = 0.3, id_col: str = "doc_id",
          text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``threshold`` on) per row of ``docs``."""
    src = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"),
                      (F.lit(None).cast("boolean") if held_out is None else held_out)
                      .alias("held_out"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for pdf in slices(batches, "text", 2_000_000):
            s = scores(list(pdf["text"]), field)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"],
                                "score": s, "predicted": (s >= threshold).astype(np.int32)})

    return src.mapInPandas(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, field: Field, threshold: float = 0.3,
              text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with their own columns."""
    @F.pandas_udf("double")
    def own(batches: pd.Series) -> pd.Series:
        frame = pd.DataFrame({"text": batches})
        return pd.Series(np.concatenate([scores(list(x["text"]), field) for x in
                                         slices([frame], "text", 2_000_000)])
                         if len(frame) else np.zeros(0))

    # one evaluation per row: the score is a column before the filter sees it
    scored = docs.select(packed(docs), own(col(text_col).cast("string")).alias("score"))
    return unpacked(scored.filter(F.col("score") >= threshold), docs.columns)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are scored but not learned from: crc32 of the identifier mod 5 is 0."""
    return crc_of_id(id_col) % 5 == 0
