"""Snapshot differences by digest tree: equal to the full comparison, and narrow."""
import pytest
from pyspark.sql import functions as F

from vecsync.operators import detect, digest_tree as DT
from vecsync.streaming.jobs import scratch


def table(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"id {kind}, t string").repartition(5)


def stored(spark, df, **shape):
    return DT.write_snapshot(df, "id", "t", scratch(spark, "tree"), **shape)


def rows(df):
    return sorted(map(tuple, df.select("id", "operation", "old_text", "new_text").collect()),
                  key=str)


@pytest.mark.parametrize("shape", [{"fan_out": 4, "depth": 3}, {"fan_out": 2, "depth": 1}, {}])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_changes_equal_the_full_comparison(spark, shape, kind):
    own = (lambda i: i) if kind == "long" else (lambda i: f"k{i}")
    old = [(own(i), f"text {i}") for i in range(900)] + [(own(900), None), (own(901), "")]
    new = [(own(i), f"text {i}" + (" changed" if i % 150 == 7 else "")) for i in range(50, 905)
           if i not in (900, 901)] + [(own(900), ""), (own(901), None)]
    a, b = table(spark, old, kind), table(spark, new, kind)
    want = detect.snapshot_diff(a, b, "id", "t")
    sa, sb = stored(spark, a, **shape), stored(spark, b, **shape)
    got = DT.snapshot_changes(sa, sb, "id")
    assert rows(got) == rows(want.filter("operation <> 'UNCHANGED'"))
    every = DT.snapshot_changes(sa, sb, "id", unchanged=True)
    key = lambda r: (str(r[0]), r[1], r[2], r[3])
    lens = want.select("id", "operation", F.length("old_text"), F.length("new_text"))
    assert sorted(map(key, every.select("id", "operation", "old_len", "new_len").collect()),
                  key=str) == sorted(map(key, lens.collect()), key=str)


def test_only_unequal_buckets_are_read(spark):
    old = table(spark, [(i, f"text {i}") for i in range(4000)])
    new = old.withColumn("t", F.when(F.col("id").isin(17, 1234), "other").otherwise(F.col("t")))
    a, b = (stored(spark, x, fan_out=8, depth=3) for x in (old, new))
    buckets = DT.unequal_buckets(a, b)
    own = b.rows().filter(F.col("id").isin(17, 1234)).select("bucket", "folder").collect()
    assert buckets == sorted({r.bucket for r in own})
    some = b.rows(buckets)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [folder" in plan and "PushedFilters: [" in plan
    assert {r.folder for r in some.select("folder").distinct().collect()} \
        == {r.folder for r in own}
    files = lambda df: df.select(F.input_file_name().alias("f")).distinct().count()
    assert files(some) < files(b.rows()) / 2
    assert some.count() < 4000 / 100                    # of 512 buckets, two
    got = DT.snapshot_changes(a, b, "id").collect()
    assert sorted((r.id, r.operation) for r in got) == [(17, "UPDATE"), (1234, "UPDATE")]


def test_equal_and_empty_snapshots(spark):
    some, none = table(spark, [(1, "a"), (None, "no id")]), table(spark, [])
    a, b, c = (stored(spark, x, fan_out=4, depth=2) for x in (some, some, none))
    assert DT.unequal_buckets(a, b) == [] and DT.snapshot_changes(a, b, "id").count() == 0
    assert [r.operation for r in DT.snapshot_changes(a, b, "id", True).collect()] == ["UNCHANGED"]
    assert [r.operation for r in DT.snapshot_changes(c, a, "id").collect()] == ["INSERT"]
    assert [r.operation for r in DT.snapshot_changes(a, c, "id").collect()] == ["DELETE"]
    assert DT.snapshot_changes(c, c, "id", True).count() == 0
    with pytest.raises(ValueError):
        DT.unequal_buckets(a, stored(spark, some, fan_out=2, depth=2))


def test_order_and_repeats_do_not_matter(spark):
    """Digests are of the set of rows, wherever they lie; two equal rows do not cancel out."""
    some = [(i, f"t{i}") for i in range(200)]
    a = stored(spark, table(spark, some), fan_out=4, depth=2)
    b = stored(spark, table(spark, some[::-1]).repartition(1), fan_out=4, depth=2)
    twice = stored(spark, table(spark, some + [some[3]] * 2), fan_out=4, depth=2)
    assert DT.unequal_buckets(a, b) == [] and len(DT.unequal_buckets(a, twice)) == 1


def test_narrow_difference(spark):
    old = table(spark, [(1, "a"), (2, "b"), (3, None), (4, "gone"), (6, "")])
    new = table(spark, [(1, "a"), (2, "c"), (3, ""), (5, "new"), (6, None)])
    got = {r.id: tuple(r)[1:] for r in detect.snapshot_diff_narrow(old, new, "id", "t", True)
           .collect()}
    assert got == {1: ("UNCHANGED", 1, 1, None), 2: ("UPDATE", 1, 1, "c"),
                   3: ("UPDATE", None, 0, ""), 4: ("DELETE", 4, None, None),
                   5: ("INSERT", None, 3, "new"), 6: ("UPDATE", 0, None, None)}
    narrow = detect.snapshot_diff_narrow(old, new, "id", "t")
    plan = narrow._jdf.queryExecution().optimizedPlan().toString()
    assert "new_text" not in plan and "md5" in plan
