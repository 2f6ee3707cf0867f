"""Byte-level BPE encoding and decoding by backtracking over longest matches.

The vocabulary's tokens, bytes mapped to Latin-1 characters, form an Aho-Corasick trie that
names the longest token starting at a byte of a piece.  The encoder takes it when
the pair with the token before it is compatible (the merges of the two tokens' joined bytes
end in just these two; remembered by pair), else the next shorter token that is a prefix,
and steps back when none is left, marking that end as impossible.  A sequence whose
adjacent pairs are all compatible is the one that the merges give, and each position is
given up at most once, so the work is linear in the bytes of a piece.

Pieces are the matches of the pattern, which has to be of the usual kind: letters with a
space before them, digits, marks, white space.  A text is first cut before single spaces and
beside single line feeds, where every match ends anyway, and what stands between cuts is
remembered, within bounds.

Defined results
    null text            empty: no ids, digests of the empty string
    equal rows           equal results, one per row
    empty table          empty result
    very long pieces     linear, whatever their length
    extra columns        never read; only the identifier is carried
"""
from __future__ import annotations

import base64
import hashlib
import re
from array import array

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from vecsync.llm.common import Recent, per_text

#: White space beside a line feed, or on both sides of a space (the end counts): only there
#: may a match span a cut before the space or beside the line feed.
UNSAFE = re.compile(r"\s (?:\s|\Z)|\s\n|\n\s")
MARKS = frozenset(".,;:!?")


class Codec:
    """Encoder and decoder for a rank file and a pattern; equal to the merges by rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remember: int = 600_000):
        self.ranks = ranks
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for tok, rank in ranks.items():
            self.token[rank] = tok
        self.length = [len(t) for t in self.token]
        self.name = [str(i) for i in range(len(self.token))]
        self.matches = regex.compile(pattern).findall
        self.ids = {tok.decode("latin-1"): rank for tok, rank in ranks.items()}
        self.most = max(self.length, default=1)
        self.automaton = ahocorasick.Automaton()
        for tok, rank in self.ids.items():
            self.automaton.add_word(tok, rank)
        self.automaton.make_automaton()
        self.shorter = [next((ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ranks),
                             None) for t in self.token]
        self.compatible = Recent(self._compatible, remember)
        self.first = Recent(self._chunk, remember)
        self.spaced = Recent(self._spaced, remember)

    @classmethod
    def load(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return cls(ranks, pattern)

    def merged(self, data: bytes, border: int = 0) -> list[int]:
        """The merges themselves, for short inputs: lowest rank first, leftmost among equals.
        Ends with no ids as soon as a merge crosses ``border``."""
        none = len(self.token)
        get = self.ranks.get
        cut = list(range(len(data) + 1))
        rank = [get(data[i:i + 2], none) for i in range(len(data) - 1)]
        while rank and (low := min(rank)) < none:
            i = rank.index(low)
            if cut[i + 1] == border:
                return []
            del cut[i + 1], rank[i]
            if i < len(rank):
                rank[i] = get(data[cut[i]:cut[i + 2]], none)
            if i:
                rank[i - 1] = get(data[cut[i - 1]:cut[i + 1]], none)
        return [self.ranks[data[a:b]] for a, b in zip(cut, cut[1:])]

    def _compatible(self, pair: int) -> bool:
        a, b = pair >> 32, pair & 0xFFFFFFFF
        if a == len(self.token):                        # the start: do merges give b at all?
            return self.merged(self.token[b]) == [b]
        return self.merged(self.token[a] + self.token[b], self.length[a]) == [a, b]

    def _longest(self, data: str, at: int) -> int | None:
        """The longest token that starts at a place: down from the longest path there."""
        head = data[at:at + self.most]
        get = self.ids.get
        for k in range(self.automaton.longest_prefix(head), 0, -1):
            tok = get(head[:k])
            if tok is not None:
                return tok
        return None

    def piece(self, data: str) -> list[int]:
        """The ids of a piece, its bytes given as Latin-1."""
        whole = self.ids.get(data)
        if whole is not None:
            return [whole]
        n, length, fits, longest = len(data), self.length, self.compatible, self._longest
        # the longest matches one after the other, as far as they are compatible
        out: list[int] = []
        at, before = 0, len(self.token)
        for _, tok in self.automaton.iter_long(data):
            if not fits[before << 32 | tok]:
                break
            out.append(tok)
            at += length[tok]
            before = tok
        if at == n:
            return out
        closed: set[int] = set()
        tok = longest(data, at)
        while True:
            while tok is not None and (at + length[tok] in closed
                                       or not fits[before << 32 | tok]):
                tok = self.shorter[tok]
            if tok is not None:
                out.append(tok)
                at += length[tok]
                if at == n:
                    return out
                before, tok = tok, longest(data, at)
            elif out:
                closed.add(at)
                tok = out.pop()
                at -= length[tok]
                before, tok = (out[-1] if out else len(self.token)), self.shorter[tok]
            else:
                raise ValueError("the vocabulary lacks a byte of the text")

    def _chunk(self, text: str) -> bytes:
        """The ids of a stretch of text, four bytes each."""
        return b"".join(map(self._coded, self.matches(text)))

    def _coded(self, match: str) -> bytes:
        return array("I", self.piece(match if match.isascii()
                                     else match.encode().decode("latin-1"))).tobytes()

    def _spaced(self, word: str) -> bytes:
        """The ids of a space and a word."""
        if word.isalpha():                              # with the space, one match
            return self._coded(" " + word)
        if word[-1:] in MARKS and word[:-1].isalpha():
            return self.spaced[word[:-1]] + self.first[word[-1]]
        return self._chunk(" " + word)

    def encode(self, text: str) -> list[int]:
        if UNSAFE.search(text):
            coded = self._chunk(text)
        else:
            spaced, coded = self.spaced, []
            for line in text.split("\n"):
                head, *rest = line.split(" ")
                coded += [self.first["\n"], self.first[head]]
                coded += [spaced[x] for x in rest]
            coded = b"".join(coded[1:])
        return np.frombuffer(coded, dtype=np.uint32).tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per worker and vocabulary."""
    key = (path, pattern)
    if key not in _codecs:
        _codecs[key] = Codec.load(path, pattern)
    return _codecs[key]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text", ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array, optional), ids_sha256, decoded_sha256 per row; the last
    is the digest of the bytes that the ids decode to."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = codec(path, pattern)
        n, listed, coded, back = [], [], [], []
        for text in pdf["text"]:
            own = c.encode(text) if text else []
            n.append(len(own))
            coded.append(hashlib.sha256(",".join(map(c.name.__getitem__, own)).encode())
                         .hexdigest())
            back.append(hashlib.sha256(c.decode(own)).hexdigest())
            if ids:
                listed.append(np.array(own, dtype=np.int32))
        out = {"doc_id": pdf["doc_id"], "n_tokens": n, "ids_sha256": coded,
               "decoded_sha256": back}
        return pd.DataFrame(out | ({"ids": listed} if ids else {}))

    return per_text(docs, id_col, text_col, run, schema + (", ids array<int>" if ids else ""))


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
           ids_col: str = "ids") -> DataFrame:
    """doc_id and text of encoded rows; null ids give the empty text, bytes that are not
    UTF-8 (ids cut inside a character) become replacement characters."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        c = codec(path, pattern)
        for pdf in batches:
            text = [c.decode(x).decode("utf-8", "replace") if x is not None else ""
                    for x in pdf[ids_col]]
            yield pd.DataFrame({"doc_id": pdf[id_col], "text": text})

    return encoded.select(id_col, ids_col).mapInPandas(run, f"doc_id {kind}, text string")
