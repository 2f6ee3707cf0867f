import base64
import hashlib
import heapq
import random
import zlib

import cases
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import zstandard
from tokenizers import Tokenizer, processors

from vecsync.llm import bpe, huffman, tokencount

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
PIECES = [" ", "  ", "\n", "\t", "a", "the", "É", "ß", "1", "23", "'s", "'re", "!", "!!", "\xa0",
          "　", "ñ", "字", "😀", "\r\n", "zzzz", "\x85", "\x1c", "Σ", "<|endoftext|>", "é"]


@pytest.fixture(scope="module")
def real():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def mixed(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(PIECES, k=rnd.randint(0, 14))) for _ in range(n)]


def test_bpe_equals_the_library(real):
    c = bpe.codec(RANKS, P.PATTERN)
    rnd = random.Random(2)
    hard = ["a" * 20_000, " " * 5_000, "ab" * 9_000, "".join(rnd.choices("abcdef", k=20_000)),
            "x\n" * 2_000, "a\n \nb", "a   b ", "a \n"]
    for text in mixed(4000, 1) + hard + [r[1] or "" for r in cases.rows()]:
        assert c.encode(text) == real.encode_ordinary(text), repr(text[:50])
        assert c.decode(c.encode(text)) == text.encode()


def test_bpe_on_small_vocabularies_equals_the_merges():
    """Random vocabularies, with tokens that no merge reaches."""
    rnd = random.Random(4)
    for _ in range(60):
        words = {bytes([b]) for b in b"abc"}
        while len(words) < 14:
            words.add(bytes(rnd.choices(b"abc", k=rnd.randint(2, 5))))
        tokens = sorted(words, key=len)[:3] + rnd.sample(sorted(words, key=len)[3:], 11)
        c = bpe.Codec({t: i for i, t in enumerate(tokens)}, r".+")
        for _ in range(60):
            data = "".join(rnd.choices("abc", k=rnd.randint(1, 15)))
            whole = c.ranks.get(data.encode())
            assert c.piece(data) == ([whole] if whole is not None else c.merged(data.encode()))


def test_bpe_table(spark, real):
    docs = cases.clashing(cases.frame(spark))
    got = bpe.encode(docs, RANKS, P.PATTERN)
    want = sorted([(r[0] is None, r[0], r[1] or "") for r in cases.rows()], key=str)
    rows = got.collect()
    assert len(rows) == len(want)
    by = {r.doc_id: r for r in rows}
    for _, i, text in want:
        ids = real.encode_ordinary(text)
        assert by[i].ids == ids and by[i].n_tokens == len(ids)
        assert by[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert by[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe.decode(got, RANKS, P.PATTERN).collect()}
    assert all(back[i] == text for _, i, text in want)
    assert bpe.encode(cases.frame(spark, []), RANKS, P.PATTERN).count() == 0


def test_recent_memory_is_bounded():
    m = bpe.Recent(lambda k: k * 2, 10)
    assert [m[i] for i in range(100)] == [2 * i for i in range(100)]
    assert len(m) <= 10 and len(m.old) <= 10 and m[3] == 6


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(0)
    counts = (rng.pareto(0.9, 200) * 10).astype(np.int64) + 1
    heap = [(int(x), i, (i,)) for i, x in enumerate(counts)]
    heapq.heapify(heap)
    plain, k = np.zeros(200, int), 200
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            plain[s] += 1
        heapq.heappush(heap, (a[0] + b[0], k, a[2] + b[2]))
        k += 1
    assert (huffman.code_lengths(counts, 40) * counts).sum() == (plain * counts).sum()
    for n, limit in ((5, 3), (300, 9), (1, 4), (2, 4), (512, 9)):
        counts = (rng.pareto(0.4, n) * 10).astype(np.int64) + 1
        bits = huffman.code_lengths(counts, limit)
        assert bits.max() <= limit and sum(0.5 ** bits) <= 1 + 1e-9
        ids = rng.choice(n, size=3001)
        payload, marks = huffman.pack(ids, bits, huffman.canonical(bits))
        assert (huffman.unpack(payload, len(ids), marks, huffman.decode_table(bits)) == ids).all()


def test_words_equal_the_library():
    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rnd = random.Random(6)
    cased = ["a" + chr(c) + " " + chr(c) + "\u0301\n" + chr(c) + "," for c in
             list(range(1, 0x3000)) + rnd.sample(range(0x3000, 0xd800), 3000)
             + rnd.sample(range(0xe000, 0x110000), 3000)]
    texts = mixed(3000, 3) + cased + ["The<|ENDOFTEXT|> Words.\nAnd, more!! (x). don't DON'T."]
    for text, got in zip(texts, huffman.word_ids(path).encode(texts)):
        want = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want, repr(text)


def test_files_round_trip(spark, tmp_path):
    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    coded = huffman.token_ids(cases.clashing(cases.frame(spark)), path, 1)
    huffman.write(coded, str(tmp_path / "f"), block_ids=500)
    assert spark.read.parquet(str(tmp_path / "f" / "blocks")).count() > 5
    rows = huffman.read(spark, str(tmp_path / "f")).orderBy("start").collect()
    at, last, want = 0, -1, {}
    for r in cases.rows():
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [1]
        want.setdefault(r[0], []).append(ids)
    assert len(rows) == len(cases.rows())
    for r in rows:
        ids = want[r.doc_id].pop()
        assert r.start == at and r.n_tokens == len(ids) and r.ids == ids
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (r.doc_id if r.doc_id is not None else -1) >= last
        at, last = at + len(ids), r.doc_id if r.doc_id is not None else -1
    none = huffman.round_trip(cases.frame(spark, []), path)
    assert none.count() == 0


@pytest.mark.parametrize("rule", tokencount.RULES)
def test_allocation_against_brute_force(rule):
    rnd = random.Random(1)
    for _ in range(200):
        n = rnd.randint(1, 30)
        border = np.array(sorted([0, n] + [rnd.randint(0, n) for _ in range(rnd.randint(0, 5))]))
        cuts = sorted({0, n} | {rnd.randint(0, n) for _ in range(rnd.randint(0, 9))})
        token = list(zip(cuts, cuts[1:]))
        want = np.zeros(len(border) - 1)
        for s, e in token:
            own = [len(set(range(s, e)) & set(range(a, b))) for a, b in zip(border, border[1:])]
            if rule == "share":
                want += np.array(own) / (e - s)
            elif rule == "majority":
                want[own.index(max(own))] += 1
            else:
                want[[a <= s < b for a, b in zip(border, border[1:])].index(True)] += 1
        got = tokencount.allocate(np.array([s for s, _ in token]), np.array([e for _, e in token]),
                                  border, rule)
        assert np.allclose(got, want)


def test_spans_equal_the_library():
    """Spans from remembered stretches are those of the text encoded as a whole."""
    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    texts = mixed(3000, 8) + [r[1] or "" for r in cases.rows()] + ["a\nb c\n\nd", "x \ny", "\n"]
    for text, (start, end) in zip(texts, tokencount.spans(path, texts)):
        assert list(zip(start, end)) == t.encode(text, add_special_tokens=False).offsets, repr(text)


def test_sections_and_fields(spark):
    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    docs = cases.clashing(cases.frame(spark))
    for rule in tokencount.RULES:
        rows = tokencount.section_counts(docs, path, rule=rule).collect()
        by = {}
        for r in rows:
            by.setdefault(r.doc_id, []).append(r)
        for i, text in {r[0]: r[1] or "" for r in cases.rows()}.items():
            own = sorted(by[i], key=lambda r: (r.section, r.char_start))
            copies = sum(r[0] == i for r in cases.rows())
            total = len(t.encode(text, add_special_tokens=False).ids)
            assert abs(sum(r.n_tokens for r in own) - copies * total) < 1e-6
            assert own[0].doc_tokens == total
            if copies == 1:
                assert "".join(text[r.char_start:r.char_end] for r in own) == text
                assert len(own) == max(1, len(text.splitlines()) if text.strip() else len(own))
    f = tokencount.field_counts(docs, path, ["source", "lang", "text"]).collect()
    assert len(f) == 3 * len(cases.rows()) and {r.section for r in f} == {0, 1, 2}
    assert tokencount.section_counts(cases.frame(spark, []), path).count() == 0
    with pytest.raises(ValueError):
        tokencount.section_counts(docs, path, rule="all")


def test_plain_words_with_marks_and_numbers_need_no_whole_path(monkeypatch):
    """op10_huffman_ids: such words are cut into matches of the tokenizer's pattern."""
    path = P.path("word_bpe_49k.json")
    t, w = Tokenizer.from_file(path), huffman.WordIds(path)
    rnd = random.Random(8)
    letters = "abdelmrstv'019.,;:!?-_<>()[]{}@#$%^&*+=~`\"\\/"
    plain = ["don't", "''s", "'tis", "rock'n'roll's", "1'd", "'", "<", "a<b", "42.", "x-9,"] + [
        "".join(rnd.choices(letters, k=rnd.randint(1, 12))) for _ in range(5_000)]
    monkeypatch.setattr(w, "batch", None)
    for text, got in zip(plain, w.encode(plain)):
        want = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want, repr(text)
    assert w.encode(["", None, " \n "]) == [b"", b"", b""]


def test_equal_words_of_a_call_are_looked_up_once(monkeypatch):
    """op10_huffman_ids: runs of letters and what follows them are words of their own."""
    path = P.path("word_bpe_49k.json")
    t, w = Tokenizer.from_file(path), huffman.WordIds(path)
    asked = []

    class Asked(type(w.ids)):
        def __getitem__(self, key):
            asked.append(key)
            return super().__getitem__(key)

    monkeypatch.setattr(w, "ids", Asked(w._one, 1_000))
    texts = ["Wort, wort. ÉTÉ, été; don't\nWORT 7,7x (wort)"] * 200
    want = t.encode(texts[0], add_special_tokens=False).ids
    assert all(np.frombuffer(x, "<u4").tolist() == want for x in w.encode(texts))
    assert len(asked) < 30


def test_words_of_mixed_characters_equal_the_library():
    path = P.path("word_bpe_49k.json")
    t, w = Tokenizer.from_file(path), huffman.WordIds(path)
    rnd = random.Random(9)
    letters = "aZéßÑªʰ'ſsTdre.,!<|>7²½_- \t\n\r\x00\x1c\x85\xa0\xad"
    odd = letters + "İȺΣσ̸́— ‍K中😀"
    texts = ["".join(rnd.choices(kind, k=rnd.randint(0, 20))) for kind in (letters, odd)
             for _ in range(4_000)] + [None, "a<|endoftext|>b", "x|>"]
    for text, got in zip(texts, w.encode(texts)):
        want = t.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want, repr(text)
    assert w.encode([]) == []


def test_words_of_latin_letters_need_no_pattern(monkeypatch):
    """op10_huffman_ids: letters of Latin-1 are neither searched for others nor cut."""
    path = P.path("word_bpe_49k.json")
    t, w = Tokenizer.from_file(path), huffman.WordIds(path)
    for name in ("batch", "PIECES", "BEYOND"):
        monkeypatch.setattr(w, name, None)
    texts = ["Élève été, ÇÀ", "Straße\nÜBUNG ªº µ", "naïve ÿ"]
    for text, got in zip(texts, w.encode([x.replace(",", "") for x in texts])):
        want = t.encode(text.replace(",", ""), add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want, repr(text)


def test_ids_lie_in_as_many_planes_as_they_have_bytes(spark):
    """op10_huffman_ids: the vocabulary needs two bytes of the four."""
    for r in huffman.token_ids(cases.frame(spark), P.path("word_bpe_49k.json"), 1).collect():
        assert len(zstandard.ZstdDecompressor().decompress(r.ids)) <= 2 * r.n
        own = next(huffman._ids([r.ids], [r.n]))
        assert zlib.crc32(own.astype("<u4").tobytes()) == r.crc
    for top in (0, 255, 256, 65_535, 65_536, 1 << 24, (1 << 32) - 1):
        ids = np.array([top, 1, top // 2], "<u4")
        blob = zstandard.ZstdCompressor().compress(b"".join(huffman._planes(ids)))
        assert next(huffman._ids([blob], [3])).tolist() == ids.tolist()


def test_codes_stand_bit_after_bit():
    """op10_huffman_ids: payload and marks as strings of bits give them."""
    rnd = np.random.default_rng(4)
    for limit, many in ((18, 5_000), (12, 700), (18, 1)):
        counts = (rnd.pareto(0.6, 3_000) * 20).astype(np.int64)[:many] + 1
        bits = huffman.code_lengths(counts, limit)
        codes, ids = huffman.canonical(bits), rnd.integers(0, len(counts), many)
        each = [f"{int(codes[i]):0{bits[i]}b}" for i in ids]
        plain = "".join(each)
        plain += "0" * (-len(plain) % 8)
        payload, marks = huffman.pack(ids, bits, codes)
        assert payload == int(plain, 2).to_bytes(len(plain) // 8, "big")
        assert marks.tolist() == [sum(map(len, each[:i])) for i in range(0, many, huffman.EVERY)]
        assert (huffman.unpack(payload, many, marks, huffman.decode_table(bits)) == ids).all()
