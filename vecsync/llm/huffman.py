"""Token-id output: canonical length-limited Huffman coding in independent blocks.

Ids are written once as they come, their global counts give the code lengths
(package-merge, at most ``LIMIT`` bits), and documents in ascending identifier order are
coded into blocks of whole documents.  The format is a folder with two Parquet tables:

    codebook   id, bits                 canonical codes follow from the lengths
    blocks     shard, block, start      start: ids before it in its shard
               doc_ids, n_tokens        the documents of the block, in order
               marks                    bit offset of every ``EVERY``-th id
               payload                  the codes, most significant bit first

Shards are ranges of identifiers in ascending order, one per task that writes.  Decoding is
driven by a table of all ``LIMIT``-bit windows and runs from all marks of a block at once, so
blocks, and stretches of a block, need nothing else.

Defined results
    null or empty text     just the end id
    null identifiers       first in the order
    equal identifiers      next to each other, by length and checksum of their ids
    empty table            no blocks, an empty codebook, an empty result
    very long texts        a block of their own
    extra columns          never read
"""
from __future__ import annotations

import os
import re
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vecsync.llm.common import (Recent, byte_letters, materialise, per_text,
                                shuffle_partitions)
from vecsync.session import checkpoint_dir

LIMIT = 18
EVERY = 256
BLOCK_IDS = 1 << 18


# -- code ---------------------------------------------------------------------------------

def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for unused ids."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(float)
    row, leaf = weight, [np.ones(len(order), bool)]
    for _ in range(limit - 1):
        even = len(row) // 2 * 2
        both = np.concatenate([weight, row[0:even:2] + row[1:even:2]])
        at = np.argsort(both, kind="stable")
        row = both[at]
        leaf.append(at < len(order))
    take = 2 * len(order) - 2
    for own in reversed(leaf):
        symbols = int(own[:take].sum())
        out[order[:symbols]] += 1
        take = 2 * (take - symbols)
    return out


def canonical(bits: np.ndarray) -> np.ndarray:
    """Codes that count up within a length, ids in ascending order."""
    codes = np.zeros(len(bits), np.uint64)
    code, last = 0, 0
    for size in range(1, int(bits.max(initial=0)) + 1):
        own = np.flatnonzero(bits == size)
        code <<= size - last
        codes[own] = np.arange(code, code + len(own), dtype=np.uint64)
        code, last = code + len(own), size
    return codes


def decode_table(bits: np.ndarray) -> tuple[np.ndarray, int]:
    """32 times the id and the length of the code at the head of every window of the longest
    length, in one number."""
    most = int(bits.max(initial=1))
    order = np.lexsort((np.arange(len(bits)), bits))
    order = order[bits[order] > 0]
    each = 1 << (most - bits[order])
    both = np.repeat(order << 5 | bits[order], each)
    rest = (1 << most) - len(both)                     # unused windows of a lone symbol
    return np.r_[both, np.ones(rest, both.dtype)].astype(np.uint32), most


def pack(ids: np.ndarray, bits: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(payload, bit offset of every ``EVERY``-th id)."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    size, code = bits[ids], codes[ids]
    end = np.cumsum(size)
    # a code stands in the word of its last bit; what does not fit there goes before it
    word = (end - 1) >> 6
    shift = -end & 63
    low = code << shift.view(np.uint64)
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    words = np.zeros(int(word[-1]) + 1, np.uint64)
    words[word[first]] = np.bitwise_or.reduceat(low, first)
    over = np.flatnonzero(size + shift > 64)
    words[word[over] - 1] |= code[over] >> (64 - shift[over]).astype(np.uint64)
    marks = end[::EVERY] - size[::EVERY]
    return words.astype(">u8").tobytes()[:(int(end[-1]) + 7) // 8], marks


def unpack(payload: bytes, n: int, marks: np.ndarray, table: tuple) -> np.ndarray:
    """``n`` ids, decoded from all marks at once."""
    both, most = table
    if not n:
        return np.zeros(0, np.uint32)
    # from the last mark on, codes may be read that are not there
    data = np.frombuffer(payload + b"\0" * (EVERY * most // 8 + 8), np.uint8).astype(np.uint32)
    window = data[:-3] << 24
    for k in (1, 2, 3):
        window |= data[k:len(data) - 3 + k] << (24 - 8 * k)
    out = np.zeros((EVERY, len(marks)), np.uint32)
    at = marks.astype(np.int64)
    for k in range(min(EVERY, n)):
        head = window[at >> 3]
        head <<= (at & 7).astype(np.uint32)
        head >>= 32 - most
        out[k] = got = both[head]
        at += got & 31
    out >>= 5
    return out.T.ravel()[:n]


# -- tokenising ---------------------------------------------------------------------------

#: Latin characters as byte-level vocabularies spell them
LATIN = tuple(byte_letters(chr(c)) for c in range(0x300))


def _latin(kind: str) -> str:
    """The Latin characters of a Unicode category."""
    return "".join(c for c in map(chr, range(0x300)) if unicodedata.category(c)[0] == kind)


class WordIds:
    """Ids of whole texts by the tokenizers library, for vocabularies whose tokenizer puts
    texts into lower case and drops white space.

    There no token crosses a space or line feed, nor, in Latin texts, the end of a run of
    letters.  Of equal words between these one is looked up for all texts of a call; the library
    encodes those not known, and what it gave is remembered, within bounds.
    """

    #: the tokenizer's pattern over Latin characters in lower case
    PIECES = staticmethod(re.compile(
        "'s|'t|'re|'ve|'m|'ll|'d|[{0}]+|[{1}]|[^\t-\r \x85\xa0{0}{1}]+".format(
            _latin("L"), _latin("N"))).findall)
    #: the end of a run of letters where no space follows, for Arrow
    RUN_END = "([{0}])([^\\t-\\r \\x{{85}}\\x{{A0}}{0}])".format(_latin("L"))
    #: dotted capital I, and everything beyond the Latin characters
    BEYOND = staticmethod(re.compile("[\u0130\u0300-\U0010ffff]").search)

    def __init__(self, path: str, remember: int = 300_000):
        # Spark gives a task its core; the library's own threads would take others'
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_file(path)
        self.batch = tokenizer.encode_batch_fast
        self.model = tokenizer.model.tokenize
        self.ids = Recent(self._one, remember)

    def _merged(self, match: str) -> bytes:
        """Of one match of the tokenizer's pattern: the library's merges suffice."""
        return array("I", [t.id for t in self.model(match)]).tobytes()

    def _lower(self, text: str) -> str | None:
        """A Latin text as the tokenizer puts it; None where letters beyond Latin, whose lower
        case and composed characters depend on each other, or a special token may stand."""
        if "<|" in text:
            return None
        low = text.lower()
        if text.isascii():
            return low
        try:
            text.encode("latin-1")                     # and so is its lower case
        except UnicodeEncodeError:
            return None if self.BEYOND(text) or self.BEYOND(low) else low
        return low

    def _one(self, word: str) -> bytes:
        """Latin words by the matches of the tokenizer's pattern; all others take the library's
        whole path."""
        if word.isascii() and word.isalpha() and word.islower():
            return self._merged(word)
        low = self._lower(word)
        if low is None:
            return array("I", self.batch([word], add_special_tokens=False)[0].ids).tobytes()
        pieces = [low] if low.isalpha() else self.PIECES(low)
        if len(pieces) == 1:
            return self._merged(pieces[0].translate(LATIN))
        return b"".join([self.ids[p] for p in pieces])

    def words(self, texts: list[str | None]) -> pa.Array:
        """A list of words for each text."""
        texts = [t or "" for t in texts]
        lower = [self._lower(t) for t in texts]
        plain = pa.array([t if low is None else low for t, low in zip(texts, lower)],
                         pa.large_string())
        cut = pc.if_else(pa.array([low is not None for low in lower], pa.bool_()),
                         pc.replace_substring_regex(plain, self.RUN_END, "\\1 \\2"), plain)
        return pc.split_pattern(pc.replace_substring(cut, "\n", " "), " ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        words = self.words(texts)
        first = words.offsets.to_numpy()
        each = words.flatten().dictionary_encode()
        del words
        known = map(self.ids.__getitem__, each.dictionary.to_numpy(zero_copy_only=False))
        every = pa.array(list(known), pa.large_binary()).take(each.indices)
        _, ends, data = every.buffers()
        cut = np.frombuffer(ends, np.int64, len(every) + 1)[first].tolist()
        data = memoryview(data or b"")
        return [data[x:y].tobytes() for x, y in zip(cut, cut[1:])]


_tokenizers: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One per worker and vocabulary."""
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def token_ids(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """(doc_id, n, crc, ids): ids of whole texts and the end id; crc is that of the ids as
    little-endian 32-bit integers."""
    end = np.array([end_id], dtype="<u4").tobytes()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        press = zstandard.ZstdCompressor(level=1).compress
        raw = [own + end for own in word_ids(path).encode(list(pdf["text"]))]
        end_at = np.cumsum([len(r) // 4 for r in raw]).tolist()
        planes = _planes(np.frombuffer(b"".join(raw), "<u4"))
        return pd.DataFrame({"doc_id": pdf["doc_id"], "n": [len(r) // 4 for r in raw],
                             "crc": [zlib.crc32(r) for r in raw],
                             "ids": [press(b"".join([p[x:y] for p in planes]))
                                     for x, y in zip([0] + end_at, end_at)]})

    return per_text(docs, id_col, text_col, run,
                    f"doc_id {kind}, n long, crc long, ids binary")


def _planes(ids: np.ndarray) -> list[bytes]:
    """The lowest bytes of all ids, then the next ones, as many as the largest id has: apart
    from each other they compress better."""
    width = (int(ids.max(initial=1)).bit_length() + 7) // 8
    return [(ids >> 8 * k).astype(np.uint8).tobytes() for k in range(width)]


def _ids(blobs, sizes) -> Iterator[np.ndarray]:
    """The ids of each row, from its ``ids`` and ``n``."""
    plain = zstandard.ZstdDecompressor().decompress
    for blob, n in zip(blobs, sizes):
        planes = np.frombuffer(plain(blob), np.uint8).reshape(-1, n)
        own = planes[0].astype(np.uint32)
        for k in range(1, len(planes)):
            own |= planes[k].astype(np.uint32) << 8 * k
        yield own


# -- files --------------------------------------------------------------------------------

def id_counts(coded: DataFrame) -> DataFrame:
    """(id, n): how often each id occurs, summed in each task before the shuffle."""
    def run(batches):
        total, held, many = np.zeros(0, np.int64), [], 0

        def added(total):
            own = np.bincount(np.concatenate(held))
            if len(own) < len(total):
                own, total = total, own
            own[:len(total)] += total
            return own

        for pdf in batches:
            for own in _ids(pdf["ids"], pdf["n"]):
                held.append(own)
                many += len(own)
                if many > 1_000_000:
                    total, held, many = added(total), [], 0
        if held:
            total = added(total)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"id": used, "n": total[used]})

    return (coded.select("n", "ids").mapInPandas(run, "id long, n long")
            .groupBy("id").agg(F.sum("n").alias("n")))


def write(coded: DataFrame, path: str, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of ``coded`` (doc_id, n, crc, ids) as ``path``/codebook and /blocks."""
    spark = coded.sparkSession
    # one row per id of the vocabulary at most
    counted = id_counts(coded).toPandas()
    counts = np.zeros(int(counted["id"].max()) + 1 if len(counted) else 0, np.int64)
    counts[counted["id"]] = counted["n"]
    bits = code_lengths(counts)
    used = np.flatnonzero(bits)
    spark.createDataFrame(pd.DataFrame({"id": used, "bits": bits[used]}),
                          "id long, bits long").coalesce(1).write.parquet(f"{path}/codebook")
    sent = spark.sparkContext.broadcast((bits, canonical(bits)))
    kind = coded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bits, codes = sent.value
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        names, sizes, held, many = [], [], [], 0

        def flush():
            payload, marks = pack(np.concatenate(held), bits, codes)
            return pd.DataFrame({"shard": [shard], "block": [block], "start": [start],
                                 "doc_ids": [names], "n_tokens": [sizes],
                                 "marks": [marks.tolist()], "payload": [payload]})

        for pdf in batches:
            for name, own in zip(pdf["doc_id"], _ids(pdf["ids"], pdf["n"])):
                names.append(name)
                sizes.append(len(own))
                held.append(own)
                many += len(own)
                if many >= block_ids:
                    yield flush()
                    block, start = block + 1, start + many
                    names, sizes, held, many = [], [], [], 0
        if names:
            yield flush()

    ordered = (coded.repartitionByRange(shuffle_partitions(spark), "doc_id", "n", "crc")
               .sortWithinPartitions("doc_id", "n", "crc"))
    (ordered.select("doc_id", "n", "ids")
     .mapInPandas(run, f"shard int, block int, start long, doc_ids array<{kind}>, "
                       "n_tokens array<int>, marks array<long>, payload binary")
     .write.option("compression", "none").parquet(f"{path}/blocks"))


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Rows of the files: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 and, if asked for, ids."""
    book = spark.read.parquet(f"{path}/codebook").toPandas()
    bits = np.zeros(int(book["id"].max()) + 1 if len(book) else 1, np.int64)
    bits[book["id"]] = book["bits"]
    sent = spark.sparkContext.broadcast(bits)
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        table = decode_table(sent.value)
        for pdf in batches:
            for b in pdf.itertuples(index=False):
                many = np.asarray(b.n_tokens, dtype=np.int64)
                end = np.cumsum(many)
                got = unpack(b.payload, int(end[-1]), np.asarray(b.marks), table)
                got = got.astype("<u4", copy=False)
                own = [got[x:y] for x, y in zip(end - many, end)]
                frame = {"doc_id": list(b.doc_ids), "shard": b.shard,
                         "inside": b.start + end - many, "n_tokens": many,
                         "ids_crc32": [zlib.crc32(x) for x in own]}
                yield pd.DataFrame(frame | ({"ids": own} if ids else {}))

    rows = blocks.mapInPandas(run, f"doc_id {kind}, shard int, inside long, n_tokens long, "
                                   "ids_crc32 long" + (", ids array<long>" if ids else ""))
    # one row per shard, that is per task that wrote
    each = blocks.groupBy("shard").agg(F.sum(F.aggregate(
        "n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = each.select("shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    return (rows.join(before, "shard")
            .select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens",
                    "ids_crc32", *(["ids"] if ids else [])))


def round_trip(docs: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id",
               text_col: str = "text", ids: bool = False) -> DataFrame:
    """Encode, write into the shared folder, and give what the files hold."""
    spark = docs.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/token-ids-{uuid.uuid4().hex}"
    write(materialise(token_ids(docs, path, end_id, id_col, text_col), "token-ids"), folder)
    return read(spark, folder, ids)
