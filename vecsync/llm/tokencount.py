"""Token counts of fields and sections by offset-mapped attribution.

A document is encoded once, as a whole, so counts are those of the text as a model would see
it.  The spans of characters that the tokenizer gives with its ids are joined with the spans
of the sections (a sorted interval join within the document), and a token that crosses a
border is allocated by a rule:

    "start"      to the section with its first character
    "majority"   to the section with most of its characters, the earlier of equals
    "share"      to each section by its share of the characters (fractional counts)

Under each rule the counts of a document's sections add up to its tokens.

Defined results
    null or empty text     one section without characters or tokens
    empty sections         no tokens
    split characters       tokens of one character's bytes all have its span
    equal rows             equal results, one set per row
    empty table            empty result
    very long texts        encoded whole, a slice of a batch at a time
    extra columns          never read
"""
from __future__ import annotations

import os
import re
from array import array
from itertools import accumulate, chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, processors

from vecsync.llm.bpe import UNSAFE
from vecsync.llm.common import BYTE_LETTER, Recent, byte_letters, col, slices

RULES = ("start", "majority", "share")
SLICE = 1_500_000


def allocate(start: np.ndarray, end: np.ndarray, border: np.ndarray,
             rule: str = "majority") -> np.ndarray:
    """Tokens of each section: section i has the characters border[i] to border[i + 1]."""
    many = len(border) - 1
    first = np.clip(np.searchsorted(border, start, "right") - 1, 0, many - 1)
    last = np.clip(np.searchsorted(border, np.maximum(end - 1, start), "right") - 1, 0, many - 1)
    whole = (first == last) | (rule == "start")
    out = np.bincount(first[whole], minlength=many).astype(float)
    for s, e, a, b in zip(start[~whole], end[~whole], first[~whole], last[~whole]):
        own = np.minimum(border[a + 1:b + 2], e) - np.maximum(border[a:b + 1], s)
        if rule == "share":
            out[a:b + 1] += own / (e - s)
        else:
            out[a + int(own.argmax())] += 1
    return out


class Spans:
    """Spans of the tokens of whole texts by the tokenizers library.

    The tokenizer's pattern lets no token cross the cut before a single space or beside a
    single line feed: the library encodes what stands between, in batches, and the spans it
    gave are remembered, within bounds.  Texts with other white space are encoded as they are.
    """

    MARKS = frozenset(".,;:!?")
    #: everything beyond the Latin letters of one or two bytes
    BEYOND = staticmethod(re.compile("[\u0300-\U0010ffff]").search)

    def __init__(self, path: str, remember: int = 300_000):
        # Spark gives a task its core; the library's own threads would take others'
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_file(path)
        # strings of special tokens are ordinary text; spans keep their spaces
        tokenizer.encode_special_tokens = True
        tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
        self.batch = tokenizer.encode_batch
        self.merges = tokenizer.model.tokenize
        self.spans = Recent(lambda text: self._coded([text])[0], remember)

    def _plain(self, text: str) -> list[int] | None:
        """First and last-but-one-past characters of the tokens of Latin letters, after one
        space or none: one match of the tokenizer's pattern, so the library's merges suffice."""
        word = text[1:] if text[:1] == " " else text
        if not word.isalpha():
            return None
        if text.isascii():
            out, at = [], 0
            for t in self.merges(text if word is text else BYTE_LETTER[32] + word):
                end = at + len(t.value)
                out += (at, end)
                at = end
            return out
        if self.BEYOND(word):
            return None
        ends = list(accumulate(len(t.value) for t in self.merges(byte_letters(text))))
        # ends count bytes: a token has every character that one of its bytes belongs to
        of = [i for i, c in enumerate(text) for _ in range(1 + (c > "\x7f"))]
        return list(chain.from_iterable((of[a], of[b - 1] + 1) for a, b in zip([0, *ends], ends)))

    def _coded(self, texts: list[str]) -> list[bytes]:
        """First and last-but-one-past character of every token, four bytes each.  Letters take
        the merges alone, with one mark after them (a token of its own) or none; all others the
        library's whole path."""
        out, rest = [b""] * len(texts), []
        for i, text in enumerate(texts):
            marked = text[-1] in self.MARKS
            own = self._plain(text[:-1] if marked else text)
            if own is None:
                rest.append(i)
                continue
            if marked:
                own += (len(text) - 1, len(text))
            out[i] = array("i", own).tobytes()
        for i, e in zip(rest, self.batch([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = array("i", chain.from_iterable(e.offsets)).tobytes()
        return out

    @staticmethod
    def _cut(text: str) -> list[str]:
        out = []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            out += ["\n", head]
            out += [" " + x for x in rest]
        return [x for x in out[1:] if x]

    def __call__(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        parts = [[t] if UNSAFE.search(t) else self._cut(t) for t in texts]
        known, local, new = self.spans, {}, []
        for x in set().union(*parts):                  # each distinct stretch is looked up once
            coded = known.get(x)
            if coded is None:
                coded = known.old.get(x)
                if coded is not None:
                    known.put(x, coded)
            if coded is None:
                new.append(x)
            else:
                local[x] = coded
        for at in range(0, len(new), 5_000):
            for x, coded in zip(new[at:at + 5_000], self._coded(new[at:at + 5_000])):
                local[x] = coded
                if len(x) < 1_000:
                    known.put(x, coded)
        out = []
        for own in parts:
            found = list(map(local.__getitem__, own))
            size = np.fromiter(map(len, own), np.int64, len(own))
            many = np.fromiter(map(len, found), np.int64, len(found)) // 8
            flat = np.frombuffer(b"".join(found), np.int32).astype(np.int64).reshape(-1, 2)
            flat = flat + np.repeat(np.cumsum(size) - size, many)[:, None]
            out.append((flat[:, 0], flat[:, 1]))
        return out


_spans: dict[str, Spans] = {}


def spans(path: str, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """By the worker's one tokenizer for the vocabulary."""
    if path not in _spans:
        _spans[path] = Spans(path)
    return _spans[path](texts)


def line_borders(text: str, separator: str = "\n") -> np.ndarray:
    """Sections end after each separator; the last is left out if it would be empty."""
    size = np.fromiter(map(len, text.split(separator)), np.int64) + len(separator)
    border = np.r_[0, np.minimum(np.cumsum(size), len(text))]
    return border[:-1] if len(border) > 2 and border[-1] == border[-2] else border


def section_counts(docs: DataFrame, path: str, separator: str = "\n", rule: str = "majority",
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, section, char_start, char_end, n_tokens, doc_tokens: a row per section."""
    return _counted(docs.select(col(id_col).alias("doc_id"),
                                col(text_col).cast("string").alias("text")),
                    path, rule, lambda text, _: line_borders(text, separator))


def field_counts(rows: DataFrame, path: str, fields: list[str], joint: str = "\n",
                 rule: str = "majority", id_col: str = "doc_id") -> DataFrame:
    """The same for the columns ``fields`` joined by ``joint``: section i is field i and the
    joint after it; a null field is empty."""
    each = [F.coalesce(col(f).cast("string"), F.lit("")) for f in fields]
    src = rows.select(col(id_col).alias("doc_id"), F.concat_ws(joint, *each).alias("text"),
                      F.array(*[F.char_length(x) for x in each]).alias("sizes"))

    def borders(text, sizes):
        end = np.cumsum(np.asarray(sizes, dtype=np.int64) + len(joint))
        return np.r_[0, np.minimum(end, len(text))]

    return _counted(src, path, rule, borders)


def _counted(src: DataFrame, path: str, rule: str, borders) -> DataFrame:
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    kind, number = src.schema["doc_id"].dataType.simpleString(), (
        "double" if rule == "share" else "long")

    def run(batches):
        for pdf in slices(batches, "text", SLICE):
            texts = [t or "" for t in pdf["text"]]
            sizes = pdf["sizes"] if "sizes" in pdf else [None] * len(pdf)
            border = [borders(t, s) for t, s in zip(texts, sizes)]
            token = spans(path, texts)
            count = [allocate(a, b, c, rule) for (a, b), c in zip(token, border)]
            many = [len(c) for c in count]
            out = np.concatenate(count)
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].repeat(many).to_numpy(),
                "section": np.concatenate([np.arange(m) for m in many]),
                "char_start": np.concatenate([b[:-1] for b in border]),
                "char_end": np.concatenate([b[1:] for b in border]),
                "n_tokens": out if rule == "share" else out.astype(np.int64),
                "doc_tokens": np.repeat([len(a) for a, _ in token], many)})

    return src.mapInPandas(run, f"doc_id {kind}, section long, char_start long, char_end long, "
                                f"n_tokens {number}, doc_tokens long")
