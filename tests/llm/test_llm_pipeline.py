import importlib

import duckdb
import pytest

import __spark_entry__ as E
import cases

SF001 = "/root/testdata/sf0.001"


def test_all_ten_and_the_pipeline_are_registered():
    names = set(E.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert "pipeline" in names and "op6_exact_dedup" in E.oracle_sql()


def test_stages_run_one_after_the_other(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        before = {tuple(r) for r in kept.collect()}
        kept = spark.createDataFrame(stage(spark, kept, SF001).collect(), docs.schema)
        after = [tuple(r) for r in kept.collect()]
        assert set(after) <= before and len(after) == len(set(after)), name
        assert len(after) < len(before) or name == "simhash_near_dedup"
    last = pipeline.STAGES[-1][1](spark, kept, SF001)
    whole = pipeline.run(spark, SF001)
    assert sorted(r.doc_id for r in last.collect()) == sorted(r.doc_id for r in whole.collect())


@pytest.mark.parametrize("k", range(5))
def test_stages_take_any_rows(spark, k):
    from pyspark.sql import functions as F
    pipeline = importlib.import_module("corpus_pipeline")
    docs = cases.clashing(cases.frame(spark))
    out = pipeline.STAGES[k][1](spark, docs, SF001)
    assert out.count() <= docs.count()
    assert k == 4 or out.columns == docs.columns
    assert pipeline.STAGES[k][1](spark, docs.filter(F.lit(False)), SF001).count() == 0


def test_plans_of_the_native_operator_have_no_python(spark):
    from vecsync.llm import exact_dedup
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    for df in (exact_dedup.exact_dedup(docs), exact_dedup.deduplicate(docs)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "InPandas" not in plan and "Arrow" not in plan


def test_exact_dedup_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF001}/documents.parquet'")
    cur = con.execute(E.oracle_sql()["op6_exact_dedup"])
    names = [d[0] for d in cur.description]
    got = E.queries()["op6_exact_dedup"](spark, SF001).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(cur.fetchall())
