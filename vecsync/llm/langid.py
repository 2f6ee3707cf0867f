"""Language identification by multilingual mixture inference.

Each language is a distribution over letter trigrams (lower case, words bordered by a space,
hashed to ``BUCKETS``), with additive smoothing, learned from all training rows: tasks sum
their counts before the shuffle.  A text is a mixture: expectation-maximisation estimates the
share of each language, and a language is added to a text's set, the most useful first, only
while the log-likelihood grows by more than ``penalty`` * log(number of trigrams).  The
prediction is the language with the largest share, the score that share.

Expectation-maximisation runs until a text's log-likelihood is within ``TOLERANCE`` of its
maximum, which N log(max g / N) bounds (g: a language's gradient, N: the trigrams).  With the
same bound on the likelihood of all languages together, which no smaller set exceeds, texts
that cannot gain enough from a second language are spared the search.

Texts are worked off in slices: all texts of a slice go through an EM step together, as
segment sums over their distinct trigrams.  The model, a row of ``BUCKETS`` numbers for each
language, is what tasks receive; scoring has no shuffle.

Defined results
    null text, or no letter   ``und``, score 0, no shares
    nothing to learn from     ``und``, score 0, no shares
    null language             not learned from
    null identifiers          crc32 of the empty text decides
    ties                      the language that sorts first
    equal rows                equal results, one per row
    empty table               empty result
    very long texts           whole; memory grows with the longest text
    extra columns             never read
"""
from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecsync.llm.common import col, crc_of_id, slices

BUCKETS = 1 << 16
SLICE = 500_000
#: Log-likelihood (nats) that expectation-maximisation may leave to be gained.
TOLERANCE = 0.05
#: Steps between two looks at the bound, and looks after which a text is left as it is.
STEPS, BURSTS = 12, 200
MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint64)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are not learned from: crc32 of the identifier mod 3 is 1."""
    return crc_of_id(id_col) % 3 == 1


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of the distinct trigrams of some texts, in order."""
    lowered = [" " + (t or "").lower() + " " for t in texts]
    size = np.fromiter(map(len, lowered), np.int64, len(lowered))
    c = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(lowered)), size)
    letter = _letters()[c]
    keep = letter | np.r_[True, letter[:-1]]           # letters, and one space after a word
    keep[np.cumsum(size) - size] = True
    c, of, letter = np.where(letter, c, 32)[keep].astype(np.uint64), of[keep], letter[keep]
    if len(c) < 3:
        return (np.zeros(0, np.int64),) * 3
    mid = letter[1:-1]                                  # a letter with what is beside it
    h = (c[:-2] * MIX[0] + c[1:-1] * MIX[1] + c[2:] * MIX[2]) & np.uint64(0xFFFFFFFF)
    key, n = np.unique(of[1:-1][mid] << 16 | (h[mid] >> np.uint64(16)).astype(np.int64),
                       return_counts=True)
    return key >> 16, key & (BUCKETS - 1), n


def learn(docs: DataFrame, rows: Column, lang_col: str = "lang", text_col: str = "text",
          smooth: float = 0.1) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities by language and bucket) of the rows that ``rows`` names."""
    src = (docs.filter(rows & col(lang_col).isNotNull() & col(text_col).isNotNull())
           .select(col(lang_col).cast("string").alias("lang"),
                   col(text_col).cast("string").alias("text")))

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for pdf in slices(batches, "text", SLICE):
            of, bucket, n = trigrams(pdf["text"])
            names, own = np.unique(pdf["lang"].to_numpy(str), return_inverse=True)
            for k, name in enumerate(names):
                mine = own[of] == k
                got = np.bincount(bucket[mine], n[mine], BUCKETS)
                total[name] = total.get(name, 0) + got
        for name, count in total.items():
            used = np.flatnonzero(count)
            if len(used):
                yield pd.DataFrame({"lang": name, "bucket": used,
                                    "n": count[used].astype(np.int64)})

    counted = (src.mapInPandas(run, "lang string, bucket int, n long")
               .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    # BUCKETS rows per language at most
    got = counted.toPandas()
    langs = sorted(got["lang"].unique())
    model = np.zeros((len(langs), BUCKETS))
    for k, name in enumerate(langs):
        own = got[got["lang"] == name]
        model[k, own["bucket"]] = own["n"]
    model += smooth
    return langs, np.log(model / model.sum(axis=1, keepdims=True)).astype(np.float32)


def _fit(p: np.ndarray, n: np.ndarray, start: np.ndarray, share: np.ndarray,
         steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """EM for all texts at once: (shares by text and language, log-likelihood by text)."""
    many = np.diff(np.r_[start, len(n)])
    total = np.add.reduceat(n, start)
    for _ in range(steps):
        each = p * np.repeat(share, many, axis=0)
        each *= (n / each.sum(axis=1))[:, None]
        share = np.add.reduceat(each, start, axis=0) / total[:, None]
    mix = (p * np.repeat(share, many, axis=0)).sum(axis=1)
    return share, np.add.reduceat(n * np.log(mix), start)


def _above(p: np.ndarray, n: np.ndarray, start: np.ndarray, share: np.ndarray,
           on: np.ndarray) -> np.ndarray:
    """How far the maximum over mixtures of the languages ``on`` may be above ``share``'s
    log-likelihood, by text."""
    many, total = np.diff(np.r_[start, len(n)]), np.add.reduceat(n, start)
    mix = (p * np.repeat(share, many, axis=0)).sum(axis=1)
    slope = np.add.reduceat(p * (n / mix)[:, None], start, axis=0)
    return total * np.log(np.maximum(1.0, np.where(on, slope, 0).max(axis=1) / total))


def _maximum(p: np.ndarray, n: np.ndarray, start: np.ndarray, on: np.ndarray,
             enough: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mixtures of the languages ``on``, from equal shares: (shares, log-likelihood, what may be
    missing).  A text is done within ``TOLERANCE`` of its maximum, or as soon as that is known
    to be at most ``enough``."""
    share = on / on.sum(axis=1, keepdims=True)
    out, best, gap = share.copy(), np.zeros(len(on)), np.zeros(len(on))
    text, many = np.arange(len(on)), np.diff(np.r_[start, len(n)])
    for _ in range(BURSTS):
        share, ll = _fit(p, n, start, share)
        more = _above(p, n, start, share, on)
        out[text], best[text], gap[text] = share, ll, more
        todo = more > TOLERANCE
        if enough is not None:
            todo &= ll + more > enough[text]
        if not todo.any():
            break
        if not todo.all():                             # go on with the others only
            rows = np.repeat(todo, many)
            p, n, share, on, text, many = (p[rows], n[rows], share[todo], on[todo], text[todo],
                                           many[todo])
            start = np.cumsum(many) - many
    return out, best, gap


def mixtures(texts, model: np.ndarray, penalty: float = 3.0) -> np.ndarray:
    """Shares by text and language; zero rows where a text has no letter."""
    of, bucket, n = trigrams(texts)
    out = np.zeros((len(texts), len(model)))
    if not len(of) or not len(model):
        return out
    n = n.astype(float)
    start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    who, size = of[start], np.diff(np.r_[start, len(of)])
    logp = model[:, bucket].T.astype(float)
    single = np.add.reduceat(logp * n[:, None], start, axis=0)
    best = single.argmax(axis=1)
    chosen = np.zeros(single.shape, bool)
    chosen[np.arange(len(who)), best] = True
    out[who, best] = 1
    cost = penalty * np.log(np.add.reduceat(n, start) + 1)
    have = single.max(axis=1)
    # subtracting the best language's own log-probability leaves shares as they are
    p = np.exp(np.clip(logp - logp[np.arange(len(of)), np.repeat(best, size)][:, None], -50, 50))
    base = have.copy()
    _, full, gap = _maximum(p, n, start, np.ones(single.shape, bool), have + cost - base)
    todo = np.flatnonzero(base + full + gap - have > cost)     # where a set may gain enough
    while len(todo):
        at = np.concatenate([np.arange(start[d], start[d] + size[d]) for d in todo])
        begin = np.cumsum(size[todo]) - size[todo]
        gain = np.full((len(todo), len(model)), -np.inf)
        shares = np.zeros((len(todo), len(model), len(model)))
        for k in range(len(model)):
            new = ~chosen[todo, k]
            on = chosen[todo].copy()
            on[:, k] = True
            share, ll, _ = _maximum(p[at], n[at], begin, on)
            gain[new, k] = (base[todo] + ll)[new]
            shares[:, k] = share
        pick = gain.argmax(axis=1)
        rows = np.arange(len(todo))
        better = gain[rows, pick] - have[todo] > cost[todo]
        sel, row = todo[better], rows[better]
        chosen[sel, pick[better]] = True
        have[sel] = gain[row, pick[better]]
        out[who[sel]] = shares[row, pick[better]]
        todo = sel[~chosen[sel].all(axis=1)]
    return out


def identify(docs: DataFrame, langs: list[str], model: np.ndarray, held: Column | None = None,
             id_col: str = "doc_id", text_col: str = "text",
             penalty: float = 3.0) -> DataFrame:
    """doc_id, held_out, lang_pred, score, shares (by language, those above zero) per row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"),
                      (F.lit(None).cast("boolean") if held is None else held).alias("held_out"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for pdf in slices(batches, "text", SLICE):
            share = mixtures(list(pdf["text"]), sent.value, penalty)
            top = share.argmax(axis=1) if len(langs) else np.zeros(len(pdf), int)
            score = share.max(axis=1) if len(langs) else np.zeros(len(pdf))
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].to_numpy(), "held_out": pdf["held_out"].to_numpy(),
                "lang_pred": [langs[k] if s > 0 else "und" for k, s in zip(top, score)],
                "score": np.clip(score, 0, 1),
                "shares": [{langs[k]: float(x[k]) for k in np.flatnonzero(x > 0)}
                           for x in share]})

    return src.mapInPandas(run, f"doc_id {kind}, held_out boolean, lang_pred string, "
                                "score double, shares map<string, double>")
