import collections
import itertools
import math
import pickle
import random
import tracemalloc
import zlib

import cases
import numpy as np
import pytest

from vecsync.llm import crf, decontam, kdshard, langid, ppm

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# -- PPM ----------------------------------------------------------------------------------

def brute_ppm(texts, train, order):
    count = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    seqs = [[256] * order + list((t or "").encode().lower()) + [256] for t in texts]
    for s in itertools.compress(seqs, train):
        for i in range(order, len(s)):
            for k in range(order + 1):
                count[k][tuple(s[i - k:i])][s[i]] += 1
    for s in seqs:
        total = 0.0
        for i in range(order, len(s)):
            p, out = 1.0, set()
            for k in range(order, -1, -1):
                own = count[k].get(tuple(s[i - k:i]), {})
                left = {a: n for a, n in own.items() if a not in out}
                n = sum(left.values())
                if s[i] in left:
                    p *= (left[s[i]] - 0.5) / n
                    break
                p *= 0.5 * len(left) / n if left else 1
                out |= set(own)
            else:
                p /= 257 - len(out)
            total += math.log10(p)
        yield total


@pytest.mark.parametrize("words,grams", [(1 << 17, 1 << 21), (3, 40), (0, 0)])
def test_ppm_and_base_against_brute_force(spark, words, grams):
    """Whatever is sent to the tasks, the results are the same."""
    data = [r[:1] + ((r[1] or "")[:300] if r[1] else r[1],) + r[2:] for r in cases.rows(40)]
    train = [zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 5 != 1 for r in data]
    got = ppm.scores(cases.clashing(cases.frame(spark, data)), hot_words=words,
                     hot_grams=grams).collect()
    count = collections.Counter()
    for r in itertools.compress(data, train):
        count.update((r[1] or "").encode().lower().split() + [b""])
    n, v = sum(count.values()), len(count)
    want = collections.Counter()
    for r, t, score in zip(data, train, brute_ppm([r[1] for r in data], train, ppm.ORDER)):
        own = (r[1] or "").encode().lower().split() + [b""]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        want[r[0], not t, len(own), sum(count[w] > 0 for w in own), n, round(base, 6),
             round(score, 6)] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens,
                                round(r.base_score, 6), round(r.score, 6)) for r in got) == want


def test_ppm_is_a_distribution(spark):
    """The probabilities of all 257 symbols after a context add up to one."""
    ctx = [256] * ppm.ORDER
    docs = spark.createDataFrame([(0, "abcab"), (2, "abd")], "doc_id long, text string")
    counts = ppm.gram_counts(ppm._source(docs, "doc_id", "text", ppm.held_out()))
    for context in (ctx, ctx[1:] + [97], ctx[2:] + [97, 98], [1, 2, 3, 97, 98][-ppm.ORDER:]):
        code = 0
        for c in context:
            code = code << 9 | c
        every = spark.createDataFrame([(code << 9 | s, 0, 1) for s in range(257)],
                                      "gram long, learned long, seen long")
        lp = ppm.log_probabilities(counts.unionByName(every).groupBy("gram").sum(
            "learned", "seen").toDF("gram", "learned", "seen"))
        got = [r.lp for r in lp.collect() if r.gram >> 9 == code]
        assert len(got) == 257 and abs(sum(10 ** x for x in got) - 1) < 1e-9


def test_ppm_with_nothing_to_learn_from(spark):
    from pyspark.sql import functions as F
    got = ppm.scores(cases.frame(spark), held=F.lit(True)).collect()
    by = {r.doc_id: r for r in got}
    assert abs(by[61].score + math.log10(257)) < 1e-9 and by[61].base_score == 0
    assert by[61].n_known == 0 and by[61].train_tokens == 0
    assert ppm.scores(cases.frame(spark, [])).count() == 0


# -- language -----------------------------------------------------------------------------

def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    langs, model = langid.learn(docs, ~langid.held_out())
    got = langid.identify(docs, langs, model, langid.held_out()).toPandas()
    both = got.merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = both[both.held_out]
    assert len(held) > 200 and (held.lang == held.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()
    text = {k: docs.filter(f"lang = '{k}' and n_chars > 2000").first().text for k in ("de", "fr")}
    share = dict(zip(langs, langid.mixtures([text["de"][:1500] + " " + text["fr"][:500]],
                                            model)[0]))
    assert abs(share["de"] - 0.75) < 0.08 and abs(share["fr"] - 0.25) < 0.08


def test_em_climbs_and_single_language_wins_without_gain():
    rng = np.random.default_rng(0)
    p = rng.random((50, 3)) + 0.01
    n = rng.integers(1, 5, 50).astype(float)
    last = -np.inf
    for steps in (1, 2, 5, 20):
        share, ll = langid._fit(p, n, np.array([0]), np.full((1, 3), 1 / 3), steps)
        assert ll[0] >= last - 1e-9 and abs(share.sum() - 1) < 1e-9
        last = ll[0]


def brute_mixture(counts, model, penalty):
    """One text, language by language: EM run very long, the best further language if its gain
    exceeds the cost."""
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], dtype=float)
    p = np.exp(model[:, keys].T.astype(float))

    def best_of(langs):
        share = np.full(len(langs), 1 / len(langs))
        for _ in range(20_000):
            each = p[:, langs] * share
            new = ((n / each.sum(axis=1))[:, None] * each).sum(axis=0) / n.sum()
            if np.abs(new - share).max() < 1e-13:
                break
            share = new
        return (n * np.log((p[:, langs] * share).sum(axis=1))).sum(), share

    single = [best_of([k])[0] for k in range(len(model))]
    chosen = [int(np.argmax(single))]
    have, share = max(single), np.ones(1)
    while len(chosen) < len(model):
        tries = [(best_of(chosen + [k]), k) for k in range(len(model)) if k not in chosen]
        (ll, new), k = max(tries, key=lambda x: (x[0][0], -x[1]))
        if ll - have <= penalty * math.log(n.sum() + 1):
            break
        chosen, have, share = chosen + [k], ll, new
    out = np.zeros(len(model))
    out[chosen] = share
    return out


@pytest.mark.parametrize("languages", [2, 5, 24])
def test_mixtures_against_brute_force(languages):
    """Synthetic languages, texts of one to three of them: no second language is refused that a
    search of all sets grants."""
    rnd = random.Random(languages)
    letters = "abcdefghijklmnopqrstuvwxyz"
    lexicon = [["".join(rnd.choices(letters[k % 13:k % 13 + 9], k=rnd.randint(2, 6)))
                for _ in range(30)] for k in range(languages)]
    model = np.full((languages, langid.BUCKETS), 0.1)
    for k, words in enumerate(lexicon):
        _, bucket, n = langid.trigrams([" ".join(rnd.choices(words, k=800))])
        model[k, bucket] += n
    model = np.log(model / model.sum(axis=1, keepdims=True)).astype(np.float32)
    texts, mixed = [], 0
    for i in range(40):
        own = rnd.sample(range(languages), min(languages, 1 + i % 3))
        texts.append(" ".join(w for k in own for w in rnd.choices(lexicon[k],
                                                                  k=rnd.choice([2, 6, 15]))))
    got = langid.mixtures(texts, model)
    for text, share in zip(texts, got):
        _, bucket, n = langid.trigrams([text])
        want = brute_mixture(dict(zip(bucket.tolist(), n.tolist())), model, 3.0)
        assert (share > 0).tolist() == (want > 0).tolist()
        assert np.abs(share - want).max() < 0.05
        mixed += (want > 0).sum() > 1
    assert mixed > 5


def test_language_ties_go_to_the_first():
    model = np.log(np.full((3, langid.BUCKETS), 1 / langid.BUCKETS)).astype(np.float32)
    assert langid.mixtures(["some words", "", None], model).tolist() == [
        [1, 0, 0], [0, 0, 0], [0, 0, 0]]


def test_the_bound_on_the_maximum_holds():
    rng = np.random.default_rng(3)
    p = rng.random((60, 5)) ** 3 + 1e-3
    n = rng.integers(1, 9, 60).astype(float)
    start, on = np.array([0, 17]), np.ones((2, 5), bool)
    _, far = langid._fit(p, n, start, np.full((2, 5), 0.2), 20_000)
    for steps in (0, 1, 3, 12, 100):
        share, ll = langid._fit(p, n, start, np.full((2, 5), 0.2), steps)
        assert (ll + langid._above(p, n, start, share, on) >= far - 1e-6).all()
    _, ll, gap = langid._maximum(p, n, start, on)
    assert (gap <= langid.TOLERANCE).all() and (far - ll <= langid.TOLERANCE).all()


def test_language_edge_cases(spark):
    docs = cases.clashing(cases.frame(spark))
    langs, model = langid.learn(docs, ~langid.held_out())
    assert langs == ["de", "en"]
    rows = langid.identify(docs, langs, model, langid.held_out()).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(cases.rows())
    assert [(by[i].lang_pred, by[i].score) for i in (60, 61, 62)] == [("und", 0.0)] * 3
    assert all(r.lang_pred in ("de", "en", "und") for r in rows)
    from pyspark.sql import functions as F
    langs, model = langid.learn(docs, F.lit(False))
    assert {r.lang_pred for r in langid.identify(docs, langs, model).collect()} == {"und"}
    none = cases.frame(spark, [])
    assert langid.identify(none, *langid.learn(none, F.lit(True))).count() == 0


# -- quality ------------------------------------------------------------------------------

def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    field = crf.Field(rng.normal(size=crf.FEATURES), 0.7)
    sizes = [1, 4, 2, 6]
    x = rng.normal(size=(sum(sizes), crf.FEATURES))
    first = np.cumsum([0] + sizes)
    good, z, joined = crf.marginals(x, first, field)
    for d, n in enumerate(sizes):
        u = x[first[d]:first[d + 1]] @ field.weight
        total, mark, same = 0.0, np.zeros(n), 0.0
        for y in itertools.product((0, 1), repeat=n):
            stays = sum(a == b for a, b in zip(y, y[1:]))
            w = math.exp(sum(u[i] for i in range(n) if y[i]) + field.stay * stays)
            total += w
            mark += w * np.array(y)
            same += w * stays
        assert abs(z[d] - math.log(total)) < 1e-9
        assert np.allclose(good[first[d]:first[d + 1]], mark / total)
        assert abs(joined[first[d]:first[d + 1]].sum() - same / total) < 1e-9


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    field = crf.learn(docs, labels, ~crf.held_out())
    got = crf.score(docs, field, held_out=crf.held_out()).toPandas()
    both = got.merge(labels.toPandas(), on="doc_id")
    held = both[both.held_out]
    assert len(held) > 40 and (held.predicted == held.quality).mean() > 0.95
    kept = crf.keep_good(docs, field)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == set(
        got[got.predicted == 1].doc_id)


def test_score_is_the_length_weighted_mean_of_line_marginals():
    """Marginals by enumeration of all labellings of a text's lines, weighted by length; ties
    at the threshold count as good."""
    rng = np.random.default_rng(5)
    field = crf.Field(rng.normal(size=crf.FEATURES) / 4, 0.6)
    texts = ["one line", "a b c\n\nTHE 123 !!\nlast of these lines here", "", None, "x\ny\nz"]
    for text, got in zip(texts, crf.scores(texts, field)):
        x, size, first = crf.line_features([text])
        lines = (text or "").split("\n")
        assert size.tolist() == [len(x) for x in lines]
        each, total = np.zeros(len(lines)), 0.0
        for y in itertools.product((0, 1), repeat=len(lines)):
            w = math.exp(sum(x[i] @ field.weight for i in range(len(y)) if y[i])
                         + field.stay * sum(a == b for a, b in zip(y, y[1:])))
            each += w * np.array(y)
            total += w
        weight = np.array([max(1, len(x)) for x in lines])
        assert got == pytest.approx((each / total) @ weight / weight.sum())


def test_threshold_and_training_stretch(spark):
    from pyspark.sql import functions as F
    docs = cases.frame(spark, [(i, "\n".join(f"line {i} {j}" for j in range(200)), None, None, 0)
                               for i in range(6)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    some, more, every = (crf.learn(docs, labels, F.lit(True), text_lines=n) for n in (80, 150, 0))
    assert not np.allclose(some.weight, every.weight)
    assert not np.allclose(more.weight, every.weight)
    blank = crf.Field(np.zeros(crf.FEATURES), 0.0)      # every score is 0.5
    assert {r.predicted for r in crf.score(docs, blank, 0.5).collect()} == {1}
    assert crf.keep_good(docs, blank, 0.5).count() == 6


def test_quality_edge_cases(spark):
    from pyspark.sql import functions as F
    docs = cases.clashing(cases.frame(spark))
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, None), (None, 1), (999, 0)],
                                   "doc_id long, quality int")
    field = crf.learn(docs, labels, F.lit(True), max_lines=30, max_docs=3)
    rows = crf.score(docs, field, held_out=crf.held_out()).collect()
    assert len(rows) == len(cases.rows()) and all(0 <= r.score <= 1 for r in rows)
    assert crf.keep_good(docs, field).columns == docs.columns
    blank = crf.learn(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in crf.score(docs, blank).collect()} == {0.5}
    none = cases.frame(spark, [])
    assert crf.score(none, field).count() == 0 and crf.keep_good(none, field).count() == 0
    x, size, first = crf.line_features(["a b\n\nc", "", None])
    assert x.shape == (5, crf.FEATURES) and size.tolist() == [3, 0, 1, 0, 0]
    assert first.tolist() == [0, 3, 4, 5]


# -- benchmark decontamination --------------------------------------------------------------

def brute_tiles(doc, item, shortest):
    on_d, on_i, covered = set(), set(), 0
    while True:
        best, hits = 0, []
        for a, b in itertools.product(range(len(doc)), range(len(item))):
            k = 0
            while (a + k < len(doc) and b + k < len(item) and doc[a + k] == item[b + k]
                   and a + k not in on_d and b + k not in on_i):
                k += 1
            if k > best:
                best, hits = k, []
            if k == best:
                hits.append((a, b))
        if best < shortest:
            return covered
        for a, b in hits:
            own_d, own_i = set(range(a, a + best)), set(range(b, b + best))
            if not own_d & on_d and not own_i & on_i:
                on_d |= own_d
                on_i |= own_i
                covered += best


def test_tiles_against_brute_force():
    rnd = random.Random(0)
    for _ in range(150):
        doc = [rnd.randint(0, 2) for _ in range(rnd.randint(0, 30))]
        item = [rnd.randint(0, 2) for _ in range(rnd.randint(0, 20))]
        if len(item) > 10:
            half = len(item) // 2
            doc = doc[:8] + item[half:] + doc[8:12] + item[:half] + doc[12:]
        got = decontam.tiles(np.array(doc, np.int64), np.array(item, np.int64), 3)
        assert sum(t[2] for t in got) == brute_tiles(doc, item, 3)
        assert all(doc[a:a + n] == item[b:b + n] for a, b, n in got)


def test_running_hashes():
    ids = np.random.default_rng(0).integers(0, 50, 120)
    for width in (1, 5, 16, 17, 60, 120):
        want = [sum((int(v) + 1) * pow(int(decontam.BASE), width - 1 - k, 1 << 64)
                    for k, v in enumerate(ids[i:i + width])) % (1 << 64)
                for i in range(len(ids) - width + 1)]
        assert decontam.running(ids, width).tolist() == want


def test_leaks_whole_reordered_partial(spark):
    words = [f"w{i}" for i in range(400)]
    item, other = words[:40], words[100:140]
    docs = [(1, " ".join(words[300:330] + item + words[330:350])),
            (2, " ".join(item[20:] + ["X"] + words[200:220] + item[:20]).upper()),
            (3, " ".join(item[:20])), (4, " ".join(words[200:260])),
            (5, " ".join(item + other) + "."), (6, None), (7, ""),
            (8, ", ".join(item[:33] + ["no"] + item[34:])), (1, " ".join(item))]
    docs = cases.clashing(spark.createDataFrame(docs, "doc_id long, text string"))
    bench = spark.createDataFrame([(10, " ".join(item)), (11, " ".join(other)), (12, None),
                                   (13, "w1 w2"), (10, " ".join(item))],
                                  "item_id long, text string")
    want = [(1, 10)] * 4 + [(2, 10)] * 2 + [(5, 10)] * 2 + [(5, 11)] + [(8, 10)] * 2
    want += [(i, 13) for i in (1, 1, 2, 3, 5, 8)]      # an item of two words, found whole
    for size in (8_000_000, 100):                      # one block, or a block for each item
        got = decontam.leaks(docs, bench, block_bytes=size).collect()
        assert sorted((r.doc_id, r.item_id) for r in got) == sorted(want)
        assert all(0.8 <= r.coverage <= 1 and sum(t.words for t in r.tiles) == r.covered_words
                   for r in got)
        clean = decontam.decontaminate(docs, bench, block_bytes=size)
        assert clean.columns == docs.columns
        assert sorted(r.doc_id for r in clean.collect()) == [4, 6, 7]
    assert decontam.leaks(docs, bench.limit(0)).count() == 0
    assert decontam.decontaminate(docs, bench.limit(0)).count() == 9
    assert decontam.leaks(docs.limit(0), bench).count() == 0


def brute_leaks(docs, items, threshold, shortest=5):
    """Pairs by word lists: short items by every window, others by plain greedy tiling."""
    out = []
    for doc, text in docs:
        d = decontam.tokens((text or "").lower())
        for item, own in items:
            w = decontam.tokens((own or "").lower())
            if not w:
                continue
            if len(w) < shortest:
                covered = len(w) * any(d[i:i + len(w)] == w for i in range(len(d)))
            else:
                covered = brute_tiles(d, w, shortest)
            if covered and covered >= threshold * len(w):
                out.append((doc, item, len(w), covered))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [8_000_000, 60])
def test_leaks_against_brute_force(spark, size):
    """Short items, scripts without spaces, null ids and texts, repeats, a very long text."""
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    han = "".join(chr(0x4e00 + rnd.randrange(300)) for _ in range(40))
    thai = "".join(chr(0x0e01 + rnd.randrange(40)) for _ in range(20))
    items = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 12)))) for i in range(25)]
    items += [(40, han[:25]), (41, thai), (42, None), (43, " ,"), (None, "Only Words Here now"),
              (45, items[3][1]), (46, items[3][1]), (47, han[3:5])]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 60)))) for i in range(60)]
    docs += [(i + 100, " ".join(rnd.choices(words, k=9)) + " " + (items[i][1] or ""))
             for i in range(25)]
    docs += [(200, "x" + han + "y"), (201, han[12:25] + "," + han[:12]), (202, thai + thai),
             (None, "and only words here NOW."), (None, None), (205, ""), (206, "w1 " * 30_000),
             docs[61]]
    frame = cases.clashing(spark.createDataFrame(docs, "doc_id long, text string"))
    bench = cases.clashing(spark.createDataFrame(items, "item_id long, text string"))
    got = decontam.leaks(frame, bench, 0.8, block_bytes=size).collect()
    want = brute_leaks(docs, items, 0.8)
    pairs = [(r.doc_id, r.item_id, r.item_words) for r in got]
    assert sorted(pairs, key=str) == [x[:3] for x in want]
    assert {(200, 40), (201, 40), (202, 41), (200, 47)} <= {x[:2] for x in pairs}
    kept = decontam.decontaminate(frame, bench, 0.8, block_bytes=size)
    bad = {x[0] for x in want if x[0] is not None}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(
        i for i, _ in docs if i is not None and i not in bad)


# -- shards -------------------------------------------------------------------------------

def test_shards_hold_equal_bytes(spark):
    rnd = random.Random(3)
    data = [(i if i % 3 else 7, "x" * rnd.randint(0, 200), rnd.choice(["a", "b", None]),
             f"s{rnd.randint(0, 4)}", rnd.randint(0, 99)) for i in range(3000)]
    docs = cases.clashing(cases.frame(spark, data))
    got = kdshard.assign(docs, 7, ["n_chars", "source", "lang", "doc_id"]).toPandas()
    assert len(got) == 3000 and set(got.shard) == set(range(7))
    size = got.groupby("shard")["size"].sum()
    assert size.max() - size.min() <= 4 * got["size"].max()
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    want = collections.Counter((r[0], len(r[1]) + 16, zlib.crc32(r[1].encode())) for r in data)
    assert collections.Counter(zip(got.doc_id, got["size"], got.text_crc32)) == want


def test_shards_of_equal_rows_odd_rows_and_none(spark):
    same = cases.frame(spark, [(1, "same", "a", "s", 4)] * 400)
    size = kdshard.assign(same, 5, ["doc_id", "lang"]).groupBy("shard").count().collect()
    assert len(size) == 5 and {r["count"] for r in size} <= {79, 80, 81}
    odd = kdshard.assign(cases.clashing(cases.frame(spark)), 4, ["n_chars", "source"])
    assert odd.count() == len(cases.rows())
    assert kdshard.assign(cases.frame(spark, []), 4, ["n_chars"]).count() == 0
    few = kdshard.assign(cases.frame(spark, [(1, "a", "x", "s", 1)]), 4, ["n_chars"]).collect()
    assert len(few) == 1 and 0 <= few[0].shard < 4 and few[0].slot == 0


def brute_tree(keys, size, shards):
    """Shard of every row: nodes split one by one, at the weighted quantile of sorted keys."""
    out = np.zeros(len(keys), int)
    wide = {}

    def go(own, first, last):
        if last - first == 1 or not len(own):
            out[own] = first
            return
        span = (keys[own].max(axis=0) >> 32) - (keys[own].min(axis=0) >> 32)
        if not wide:
            wide.update(enumerate(np.maximum(span, 1)))
        dim = max(range(keys.shape[1]), key=lambda d: (span[d] / wide[d], -d))
        k = keys[own, dim]
        order = np.argsort(k, kind="stable")
        upto = np.cumsum(size[own][order])
        need = upto[-1] * ((last - first) // 2) / (last - first)
        at = min(int(np.searchsorted(upto, need)), len(own) - 1)
        before = upto[at] - size[own][order][at]
        take = upto[at] - need <= need - before
        cut = k[order][at] if take else k[order][at] - 1
        half = first + (last - first) // 2
        go(own[k <= cut], first, half)
        go(own[k > cut], half, last)

    go(np.arange(len(keys)), 0, shards)
    return out


@pytest.mark.parametrize("shards,dims", [(2, 1), (7, 2), (40, 3)])
def test_tree_against_brute_force(spark, shards, dims):
    """Every row in the shard that recursive splitting of sorted lists gives; a null dimension
    (code 0) and a hot value among them."""
    rnd = random.Random(shards)
    rows = []
    for i in range(1500):
        codes = [0 if rnd.random() < 0.2 else 77 if rnd.random() < 0.4
                 else rnd.randrange(1, 1 << 31) for _ in range(dims)]
        rows.append(([c << 32 | rnd.getrandbits(32) for c in codes], rnd.choice([16, 50, 900])))
    frame = spark.createDataFrame(rows, "keys array<long>, size long").repartition(3)
    tree = kdshard.grow(frame, dims, shards)
    keys, size = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    got = np.array([s[0] for s in tree.shards])[tree.leaf_of(keys)]
    assert (got == brute_tree(keys, size, shards)).all()


def test_ppm_lookup_takes_little_more_than_half_full_tables():
    """op1_ppm: the table of 2 million contexts, and what building it takes beside it."""
    rnd = np.random.default_rng(5)
    keys = np.unique(rnd.integers(0, 1 << 53, 2_000_000))
    values = rnd.random(len(keys))
    tracemalloc.start()
    look = ppm.Lookup(keys, values)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90e6
    assert (look(keys) == values).all()
    assert np.isnan(look(np.setdiff1d(rnd.integers(0, 1 << 53, 10_000), keys))).all()


def test_ppm_tables_arrive_in_little_more_than_their_arrays():
    """op1_ppm: words and contexts as a worker gets them."""
    rnd = np.random.default_rng(7)
    keys = np.unique(rnd.integers(0, 1 << 53, 2_000_000))
    values = rnd.random(len(keys))
    data = pickle.dumps(ppm.Sent({b"a": -1.0}, keys, values), 5)
    tracemalloc.start()
    known, look = pickle.loads(data)
    now, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 70e6 and now < 55e6
    assert known == {b"a": -1.0} and (look(keys) == values).all()
    assert np.isnan(ppm.Lookup(keys[:0], values[:0])(keys[:10])).all()


def test_ppm_counts_merge_in_little_more_than_they_take():
    """op1_ppm: what a task holds while it merges counts of contexts."""
    rnd = np.random.default_rng(8)
    kept = [np.unique(rnd.integers(0, 5_000_000, 300_000), return_counts=True) for _ in range(7)]
    tracemalloc.start()
    code, many = ppm.merged(kept)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    want = np.zeros(5_000_000, np.int64)
    for own, n in kept:
        want[own] += n
    assert (code == np.flatnonzero(want)).all() and (many == want[code]).all()
