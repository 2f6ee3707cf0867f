import collections
import hashlib
import random

import cases
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vecsync.llm import components, exact_dedup, simhash

UP = bytes(range(65, 91))
LOW = bytes(range(97, 123))


def norm(text):
    return (text or "").encode().translate(bytes.maketrans(UP, LOW))


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_against_brute_force(spark, keep):
    data = cases.rows()
    got = exact_dedup.exact_dedup(cases.clashing(cases.frame(spark)), keep=keep).collect()
    groups = collections.defaultdict(list)
    for r in data:
        groups[norm(r[1])].append(r[0])
    want = []
    for r in data:
        ids = [i for i in groups[norm(r[1])] if i is not None]
        best = (min if keep == "min" else max)(ids) if ids else None
        want.append((r[0], best, len(groups[norm(r[1])]), r[0] == best,
                     hashlib.sha256(norm(r[1])).hexdigest()))
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)


def test_exact_keeps_one_row_per_text_with_its_columns(spark):
    docs = cases.clashing(cases.frame(spark))
    kept = exact_dedup.deduplicate(docs, keep="max")
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert len(rows) == len({norm(r[1]) for r in cases.rows()})
    assert len({norm(r["text"]) for r in rows}) == len(rows)
    assert max(r["doc_id"] for r in rows if norm(r["text"]) == norm(cases.rows()[3][1])) == 64


def test_exact_hot_text_and_levels(spark):
    """Half of all rows share a text: at every level a run has one entry of it."""
    data = [(i, "same" if i % 2 else f"t{i}", None, None, 1) for i in range(3000)]
    rows, levels = exact_dedup.digest_groups(cases.frame(spark, data), fan_in=4)
    for level in levels:
        assert level.groupBy("range", "run", *exact_dedup.KEY).count().filter("count > 1").count() == 0
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(cases.frame(spark, data)).collect()}
    assert got[2999].keep_id == 1 and got[2999].group_size == 1500 and got[2].group_size == 1


def test_runs_are_sorted_and_merged_in_order(spark):
    """Every round sorts and aggregates along the order; the way down reads each level and the
    rows once; levels are written in order."""
    data = [(i, f"t{i % 700}", None, None, 1) for i in range(2000)]
    rows, levels = exact_dedup.digest_groups(cases.frame(spark, data), fan_in=4)
    parents = levels[0].withColumn("run", F.floor(F.col("run") / 4))
    plan = exact_dedup._merge(parents, "max", 8)._jdf.queryExecution().executedPlan().toString()
    assert "Sort [range" in plan and "SortAggregate" in plan and "HashAggregate" not in plan
    assert plan.count("Exchange") == 1
    down = exact_dedup.exact_dedup(cases.frame(spark, data), fan_in=4)
    plan = down._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == len(levels) + 1
    for level in levels:
        assert all(e.count() == 1 for e in [level.groupBy("range").agg(
            F.count_distinct("run").alias("n")).agg(F.max("n")).limit(1)])
        for part in level.withColumn("f", F.input_file_name()).toPandas().groupby("f"):
            own = [(r.range, r.run, bytes(r.sha)) for r in part[1].itertuples()]
            assert own == sorted(own)
    assert levels[-1].select("run").distinct().count() == 1


def test_one_row_of_equal_ones_whatever_the_order(spark):
    """Equal identifiers and texts, other columns: the same row stays however rows are dealt."""
    data = [(1, "AB" if i % 2 else "ab", None, f"s{i}", i) for i in range(50)]
    data += [(None, "xy", None, f"s{i}", i) for i in range(20)]
    for drop in (lambda d: exact_dedup.deduplicate(d, keep="max"), simhash.deduplicate):
        kept = {tuple(sorted(map(str, drop(cases.frame(spark, data).repartition(n, F.rand(n)))
                                 .collect()))) for n in (1, 3, 7)}
        assert len(kept) == 1 and len(next(iter(kept))) == 2


def test_prefixes_that_too_many_share_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 20)
    monkeypatch.setattr(simhash, "ROOM", 4_000)
    rnd = random.Random(7)
    base = rnd.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rnd.sample(range(30), rnd.randint(0, 6)))
           for _ in range(150)} | {rnd.getrandbits(64) for _ in range(50)}
    fps = sorted(fps)
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    assert len(simhash._prefixes(df, 6, 2)) > 2
    links = simhash.ball_links(df, 4).collect()
    got = {r.node: r.root for r in components.components(
        spark.createDataFrame([tuple(x) for x in links], "u long, v long")).collect()}
    by = collections.defaultdict(set)
    for i, x in brute_components(fps, 4).items():
        by[x].add(got.get(signed[i], signed[i]))
    assert all(len(v) == 1 for v in by.values())
    assert len(by) == len({got.get(x, x) for x in signed})


def test_a_dense_cluster_stays_within_memory():
    """200,000 fingerprints that agree but for 18 bits, in one task: links are folded as they
    are found, so what grows is a few arrays of their number."""
    import tracemalloc
    rng = np.random.default_rng(2)
    own = np.unique(rng.integers(0, 1 << 18, 420_000).astype(np.uint64)) << np.uint64(20)
    own = own[:200_000]
    root = np.arange(len(own))
    tracemalloc.start()
    simhash._meet(own, root.copy(), np.full(len(own), 2), 64, 4, root)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(np.unique(root)) == 1 and peak < 600e6


def test_empty_tables(spark):
    none = cases.frame(spark, [])
    assert exact_dedup.exact_dedup(none).count() == 0
    assert exact_dedup.deduplicate(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.deduplicate(none).count() == 0


def brute_fp(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h))


def brute_components(fps, radius):
    """Smallest index reachable, by breadth first search."""
    n, root = len(fps), {}
    for i in range(n):
        if i in root:
            continue
        todo, root[i] = [i], i
        while todo:
            a = todo.pop()
            for b in range(n):
                if b not in root and (fps[a] ^ fps[b]).bit_count() <= radius:
                    root[b] = i
                    todo.append(b)
    return root


def test_simhash_against_brute_force(spark):
    data = cases.rows()
    base = data[1][1].split()
    for k in range(25):                                 # near copies, in chains
        own = list(base)
        own[k % len(own)] = f"new{k}"
        data.append((1000 + k, " ".join(own + base * 4), None, None, 0))
    got = simhash.near_duplicates(cases.clashing(cases.frame(spark, data))).collect()
    fps = [brute_fp(r[1]) for r in data]
    root = brute_components(fps, 4)
    low = collections.defaultdict(list)
    for i, r in enumerate(data):
        if r[0] is not None:
            low[root[i]].append(r[0])
    want = collections.Counter((r[0], f"{fps[i]:016x}", min(low[root[i]], default=None))
                               for i, r in enumerate(data))
    assert collections.Counter(map(tuple, got)) == want
    kept = simhash.deduplicate(cases.clashing(cases.frame(spark, data)))
    assert kept.columns == cases.clashing(cases.frame(spark, data)).columns
    rows = kept.collect()
    assert len(rows) == len(set(root.values()))
    assert {r.doc_id for r in rows if r.doc_id is not None} <= {min(v) for v in low.values() if v}


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_ball_links_are_exact(spark, radius, monkeypatch):
    """Clusters far denser than a task's room: every component, no other links."""
    monkeypatch.setattr(simhash, "ROOM", 40_000)
    rnd = np.random.default_rng(1)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        centre = int(rnd.integers(0, 1 << 63))
        for _ in range(25):
            x = centre
            for b in rnd.choice(64, rnd.integers(0, 5), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    root = brute_components(fps, radius)
    links = simhash.ball_links(df, radius).collect()
    for a, b in links:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 64
    got = {r.node: r.root for r in components.components(
        spark.createDataFrame([tuple(x) for x in links], "u long, v long")).collect()}
    by = collections.defaultdict(set)
    for i, x in enumerate(signed):
        by[root[i]].add(got.get(x, x))
    assert all(len(v) == 1 for v in by.values()) and len(by) == len(set(root.values()))


def test_odd_radius_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.near_duplicates(cases.frame(spark), radius=3)


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    edges = spark.createDataFrame(path + star + [(5, 5)] + path[:3], "u long, v long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}
