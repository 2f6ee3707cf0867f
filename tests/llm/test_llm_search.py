"""Lexical search, Lempel-Ziv fingerprints and source divergence against plain versions."""
import collections
import hashlib
import math
import random
import re

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from vecsync.llm import divergence, lexical, lzprint

SEARCH = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").findall
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+").findall


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_search(docs, items, k):
    """(item, rank, doc, score) by scoring everything; equal rows in any order."""
    bags = [(r[0], collections.Counter(SEARCH(low(r[1])))) for r in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n, total = len(bags), sum(b[2] for b in bags)
    df = collections.Counter(t for _, b, _ in bags for t in b)
    asked = collections.defaultdict(set)
    for item, text in items:
        asked[item] |= set(SEARCH(low(text)))
    out = []
    for item, terms in asked.items():
        found = []
        for doc, bag, size in bags:
            m = 100 - 90 + 90 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                        * (1000000000 * bag[t] // (1000 * bag[t] + 8 * m))
                        for t in terms if t in bag)
            if score > 0:
                found.append((-score, doc is None, doc))
        found.sort(key=lambda x: (x[0], x[1], x[2] if x[2] is not None else 0))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def items_of(docs, seed=2):
    rnd = random.Random(seed)
    words = [w for r in docs for w in (r[1] or "").split()]
    items = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 25)))) for i in range(12)]
    return items + [(50, None), (51, ""), (52, "zzz-not-there"), (53, docs[3][1]),
                    (53, "word x"), (None, docs[4][1]), (0, items[0][1])]


@pytest.mark.parametrize("cell,block", [(4096, 64), (8, 3), (1, 1)])
def test_search_against_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(lexical, "CELL_DOCS", cell)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
    docs = cases.rows(120)
    items = items_of(docs)
    queries = spark.createDataFrame(items, "item_id long, text string").withColumn(
        "doc_id", F.lit("extra")).withColumn("score", F.lit(None).cast("int"))
    got = lexical.search(cases.clashing(cases.frame(spark, docs)), queries, k=10)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_search(docs, items, 10)


def test_search_in_groups_of_queries_and_with_text_ids(spark, monkeypatch):
    monkeypatch.setattr(lexical, "QUERY_TERMS", 30)
    docs = [(f"d{r[0]}", *r[1:]) for r in cases.rows(40) if r[0] is not None]
    frame = spark.createDataFrame(docs, cases.SCHEMA.replace("doc_id long", "doc_id string"))
    items = [x for x in items_of(cases.rows(40)) if x[0] is not None]
    got = lexical.search(frame, spark.createDataFrame(items, "item_id long, text string"), k=4)
    want = brute_search(docs, items, 4)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_blocks_are_summarised_and_skipped(spark, monkeypatch):
    """Documents of six kinds: summaries are the largest impacts of a block's documents, and
    most blocks stay unread."""
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 16)
    rnd = random.Random(4)
    kinds = [[f"k{k}w{j}" for j in range(30)] for k in range(6)]
    docs = [(i, " ".join(rnd.choices(kinds[i % 6], k=40) + ["common"] * 3), None, None, 0)
            for i in range(1500)]
    frame = cases.frame(spark, docs)
    items = [" ".join(rnd.sample(kinds[k], 6) + ["common"]) for k in range(6)]
    place = {t: i for i, t in enumerate(sorted({w.encode() for x in items for w in x.split()}))}
    found = lexical.postings(frame, place, "doc_id", "text").cache()
    n, total = found.agg(F.count("row"), F.sum("n")).first()
    frequency = np.zeros(len(place), dtype=np.int64)
    for t, f in found.select(F.explode("terms")).groupBy("col").count().collect():
        frequency[t] = f
    asked = [{place[w.encode()] for w in x.split()} for x in items]
    rank = lexical.Ranking(asked, frequency, n, total)
    sample = [(r["n"], r["terms"], r["tfs"]) for r in found.orderBy("row").limit(100).collect()]
    placed = lexical.vectors(found, rank, sample)
    index = lexical.cells(placed, len(place)).cache()
    stored = lexical.blocks(index, rank).cache()
    cell = {r["cell"]: r for r in index.collect()}
    for b in stored.collect():
        c, coords = cell[b["cell"]], rank.lists[b["term"]][0]
        ends = np.cumsum(c["sizes"])
        top = collections.Counter()
        for d in b["docs"]:
            own = slice(ends[d] - c["sizes"][d], ends[d])
            assert b["term"] in c["terms"][own]
            for t, x in zip(c["terms"][own], c["impacts"][own]):
                top[t] = max(top[t], x)
        assert b["summary"] == [top[t] for t in coords.tolist()]
    best = brute_search(docs, list(enumerate(items)), 10)
    least = [min(s for i, _, _, s in best if i == q) for q in range(6)]
    every = lexical.open_blocks(stored, rank, [0] * 6).count()
    assert lexical.open_blocks(stored, rank, least).count() < every / 2
    got = lexical.search(frame, spark.createDataFrame(list(enumerate(items)),
                                                      "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == best


def test_search_in_empty_tables(spark):
    none, some = cases.frame(spark, []), cases.frame(spark)
    asks = spark.createDataFrame([(1, "abc")], "item_id long, text string")
    assert lexical.search(none, asks).count() == 0
    assert lexical.search(some, asks.limit(0)).count() == 0
    blank = cases.frame(spark, [(1, None, None, None, 0), (2, " ,. ", None, None, 0)])
    assert lexical.search(blank, asks).count() == 0


def brute_phrases(data):
    """LZ78 by slices: the longest known phrase plus one byte."""
    known, at = set(), 0
    for end in range(1, len(data) + 1):
        if data[at:end] not in known:
            known.add(data[at:end])
            at = end
    return known


def test_phrases_are_those_of_slices():
    rnd = random.Random(3)
    for n in (0, 1, 2, 50, 3000):
        data = bytes(rnd.choices(range(256), k=n)) if n % 2 else b"ab" * n
        read = lzprint.Phrases().read(data)
        assert len(read.child) == len(brute_phrases(data)) == len(read.hashes) - 1
        cut = n // 3
        twice = lzprint.Phrases().read(data[:cut]).copy().read(data[cut:])
        assert twice.hashes == read.hashes


def test_likeness_is_the_jaccard_likeness():
    rnd = random.Random(9)
    base = " ".join("".join(rnd.choices("abcdefgh", k=5)) for _ in range(60)).encode()
    a, b = base + b"one end", base + b" another end of it"
    x, y = brute_phrases(a), brute_phrases(b)
    sa, sb = (lzprint.Phrases().read(t).signature(10_000) for t in (a, b))
    assert lzprint.likeness(sa, sb, 20_000) == pytest.approx(len(x & y) / len(x | y))
    long = [" ".join("".join(rnd.choices("abcdefgh", k=5)) for _ in range(4000)).encode()
            for _ in range(2)]
    long.append(long[0][:15_000] + long[1][:8_000])
    for s, t in ((0, 1), (0, 2), (1, 2)):
        x, y = brute_phrases(long[s]), brute_phrases(long[t])
        got = lzprint.likeness(*(lzprint.Phrases().read(long[i]).signature() for i in (s, t)))
        assert abs(got - len(x & y) / len(x | y)) < 0.17        # four standard errors


@pytest.mark.parametrize("ranges", [1, 7, 512])
def test_edited_neighbours_against_brute_force(spark, monkeypatch, ranges):
    monkeypatch.setattr(lzprint, "MAX_BUCKETS", ranges)
    data = cases.rows(90)
    frame = cases.clashing(cases.frame(spark, data)).repartition(5)
    rows = lzprint.edited_neighbours(frame).collect()
    x64 = {r[0]: r[1] for r in frame.select(F.coalesce("text", F.lit("")),
                                            F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    data.sort(key=lambda r: (r[0] is not None, r[0] or 0, x64[r[1] or ""]))
    sign = lambda t: lzprint.Phrases().read(t.encode()).signature()
    want = []
    for i, r in enumerate(data):
        text, after = r[1] or "", data[(i + 1) % len(data)][1] or ""
        cut = len(text) // 4
        edited = text[:len(text) - cut] + after[:cut]
        want.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(),
                     lzprint.text_of(sign(text)), lzprint.text_of(sign(edited)),
                     lzprint.likeness(sign(text), sign(edited)),
                     lzprint.likeness(sign(text), sign(after))))
    assert collections.Counter(map(tuple, rows)) == collections.Counter(want)
    alone = {r.doc_id: r.fingerprint for r in lzprint.fingerprints(frame).collect()}
    assert all(alone[r.doc_id] == r.fingerprint for r in rows)


def test_edited_neighbours_of_few_documents(spark):
    assert lzprint.edited_neighbours(cases.frame(spark, [])).count() == 0
    one = lzprint.edited_neighbours(cases.frame(spark, [(7, "abcdefgh", None, None, 8)])).collect()
    assert [(r.doc_id, r.n_chars, r.near_next) for r in one] == [(7, 8, 1.0)]
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    big = 2 ** 60 + 1                                   # identifiers beyond a double, and null
    two = lzprint.edited_neighbours(cases.frame(spark, [(big, "x", None, None, 1),
                                                        (None, None, None, None, 0)])).collect()
    assert {r.doc_id for r in two} == {big, None}


def brute_divergence(data, least, top):
    langs = collections.defaultdict(list)
    for r in data:
        langs[r[2] or ""].append((r[3] or "", LETTERS(low(r[1]))))
    out = []
    for lang, docs in langs.items():
        df = collections.Counter(t for _, terms in docs for t in set(terms))
        kept = sorted(t for t, n in df.items() if n >= least)
        count = collections.defaultdict(collections.Counter)
        for source, terms in docs:
            count[source].update(t for t in terms if t in set(kept))
        whole = sum(count.values(), collections.Counter())

        def share(c):
            n = sum(c.values())
            return {t: 1 + 10 ** 9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        for s in count:
            far = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in count if o != s]
            own = [(p[s][t] - q[t], t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, rows in (("pair", far), ("term", own)):
                rows.sort(key=lambda x: (-x[0], x[1].encode()))
                rows = rows if part == "pair" else rows[:top]
                out += [(lang, s, part, o, v, i) for i, (v, o) in enumerate(rows, 1)]
    return collections.Counter(out)


@pytest.mark.parametrize("bucket,block,room,least", [(1024, 256, 400_000, 3), (2, 2, 5, 3),
                                                     (7, 1, 1, 1), (1024, 256, 400_000, 10 ** 6)])
def test_divergence_against_brute_force(spark, monkeypatch, bucket, block, room, least):
    for name, value in (("BUCKET_TERMS", bucket), ("BLOCK_SOURCES", block), ("ROOM", room)):
        monkeypatch.setattr(divergence, name, value)
    data = cases.rows(80)
    data += [(500 + i, data[i % 9][1], ["en", "de", None][i % 3], f"src{i % 5}", 1)
             for i in range(60)]                        # identical texts in several sources
    data += [(900, "", "xx", "only", 0), (901, None, "xx", None, 0)]
    got = divergence.divergence(cases.clashing(cases.frame(spark, data)), least, 5)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert collections.Counter(map(tuple, got.collect())) == brute_divergence(data, least, 5)


def test_identical_texts_are_cut_once(spark):
    data = [(i, "same text Here", "en", f"s{i % 3}", 1) for i in range(300)]
    data += [(300, "Same text here", "en", "s0", 1)]
    rows = divergence.collapse(cases.frame(spark, data)).collect()
    assert sorted((r.text, sorted((h.source, h.n) for h in r.held)) for r in rows) == [
        ("Same text here", [("s0", 1)]), ("same text Here", [("s0", 100), ("s1", 100),
                                                             ("s2", 100)])]


def test_divergence_of_an_empty_table(spark):
    assert divergence.divergence(cases.frame(spark, [])).count() == 0
