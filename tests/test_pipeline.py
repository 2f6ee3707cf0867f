"""Goldens for completion, backoff, dead letter, blank skipping, write-back idempotence."""
import datetime as dt

from pyspark.sql import functions as F

from vecsync.functions import errors as ER
from vecsync.operators import monitor as M
from vecsync.operators import writeback as WB
from vecsync.plans.backfill import backfill_vectors


def test_completion_goldens(spark):
    df = spark.createDataFrame([(50, 100), (0, 0), (1, 3), (0, 7)], "n long, t long")
    got = [str(r.p) for r in df.select(M.completion_pct(F.col("n"), F.col("t")).alias("p")).collect()]
    assert got == ["50.00", "100.00", "66.67", "100.00"]


def test_backoff_and_dead_letter(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 5.0), (2, 1.0)], "rc int, d double")
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for r in df.collect():
        s = ER.retry_schedule(F.lit(t0), F.lit(r.rc), r.d, 2)
        rows.append(spark.range(1).select(s.alias("s")).first().s)
    assert (rows[0].decision, rows[0].next_retry_count, rows[0].delay_s) == ("retry", 2, 2.0)
    assert (rows[1].decision, rows[1].delay_s) == ("retry", 5.0)
    assert rows[2].decision == "dead" and rows[2].delay_s is None
    assert rows[1].retry_at == dt.datetime(2024, 1, 1, 0, 0, 5)


TEXTS = ["Hello world", "", "   \n\t ", "Café déjà vu", "line one\nline two", "😀", "x y z",
         "multi\n\nparagraph"]


def user(spark):
    return spark.createDataFrame(
        [(i, t, None, None, None) for i, t in enumerate(TEXTS)],
        "doc_id long, text string, text_vector array<float>, text_embedding_model string, "
        "text_vector_created_at timestamp_ntz")


def test_blank_texts_are_skipped(spark):
    out = backfill_vectors(user(spark), dimension=8)
    st = [r.backfill_status for r in out.orderBy("doc_id").collect()]
    assert st.count("skipped") == 2 and st.count("created") == 6


def test_write_back_is_idempotent(spark):
    u = user(spark)
    upd = spark.createDataFrame(
        [(0, [1.0, 2.0], "m", dt.datetime(2024, 1, 2)), (99, [3.0], "m", dt.datetime(2024, 1, 2))],
        "doc_id long, new_vector array<float>, new_model string, new_created_at timestamp_ntz")
    once = WB.write_back(u, upd, "doc_id", "text_vector", "text_embedding_model",
                         "text_vector_created_at")
    twice = WB.write_back(once, upd, "doc_id", "text_vector", "text_embedding_model",
                          "text_vector_created_at")
    a = sorted(map(tuple, once.collect()))
    b = sorted(map(tuple, twice.collect()))
    assert a == b and len(a) == len(TEXTS)        # missing id 99 skipped
    assert [r for r in a if r[0] == 0][0][2] == [1.0, 2.0]


def test_stale_update_loses(spark):
    u = spark.createDataFrame([(1, [9.0], "new", dt.datetime(2024, 1, 5))],
                              "doc_id long, text_vector array<float>, text_embedding_model string, "
                              "text_vector_created_at timestamp_ntz")
    upd = spark.createDataFrame([(1, [1.0], "old", dt.datetime(2024, 1, 1))],
                                "doc_id long, new_vector array<float>, new_model string, "
                                "new_created_at timestamp_ntz")
    r = WB.write_back(u, upd, "doc_id", "text_vector", "text_embedding_model",
                      "text_vector_created_at").first()
    assert r.text_vector == [9.0] and r.text_embedding_model == "new"


def test_merge_write_back_needs_a_row_level_table(spark):
    import pytest
    from vecsync.operators.writeback import merge_vectors_into
    spark.createDataFrame([(1, None, None, None)],
                          "doc_id long, v array<float>, m string, c timestamp_ntz") \
        .write.mode("overwrite").saveAsTable("merge_target_v1")
    upd = spark.createDataFrame([(1, [1.0], "x", None)],
                                "doc_id long, new_vector array<float>, new_model string, "
                                "new_created_at timestamp_ntz")
    with pytest.raises(Exception, match="MERGE"):
        merge_vectors_into(upd, "merge_target_v1", "doc_id", "v", "m", "c")


def test_call_level_backoff(spark):
    df = spark.range(4).select(ER.call_backoff_delay(1.5, F.col("id")).alias("d"))
    assert [r.d for r in df.collect()] == [1.5, 3.0, 6.0, 12.0]


def test_null_counts_text_only_flag(spark):
    df = spark.createDataFrame([(None, None), ("a", None), ("b", [1.0])],
                               "text string, v array<float>")
    all_rows = M.null_vector_counts(df, "v").first()
    text_rows = M.null_vector_counts(df, "v", text_col="text", text_only=True).first()
    assert (all_rows.null_vectors, all_rows.total_rows) == (2, 3)
    assert (text_rows.null_vectors, text_rows.total_rows) == (1, 2)


def test_companion_columns_ddl_is_idempotent(spark):
    from vecsync.operators.catalog import alter_table_add_columns
    spark.createDataFrame([(1, "a")], "id long, text string").write.mode("overwrite") \
        .saveAsTable("companions_t")
    want = {"text_vector": "array<float>", "text_embedding_model": "string",
            "text_vector_created_at": "timestamp_ntz"}
    first = alter_table_add_columns(spark, "companions_t", want)
    second = alter_table_add_columns(spark, "companions_t", want)
    assert len(first) == 1 and second == []
    assert set(want) <= set(spark.table("companions_t").columns)


def test_approx_percentile_variant_is_close(spark):
    from support import SF001
    from vecsync.plans import derive
    from vecsync.sources.tables import read_table
    ev = read_table(spark, SF001, "events")
    args = (derive.status_history(ev), derive.vectorization_log(ev), derive.drift_log(ev),
            derive.collision_log(ev), derive.AS_OF)
    exact = M.system_health_full(*args).first()
    approx = M.system_health_full(*args, approx_percentile=True).first()
    assert exact.successful_vectorizations == approx.successful_vectorizations
    # the sketch answers with a data value next to the exact (interpolated) rank
    a = F.lit(derive.AS_OF).cast("timestamp_ntz")
    vals = sorted(r.processing_time for r in args[1].filter(
        (F.col("created_at") > a - F.expr("INTERVAL 24 HOURS"))
        & (F.col("status") == "success")).collect())
    if vals:
        pos = 0.95 * (len(vals) - 1)
        lo, hi = vals[max(0, int(pos) - 1)], vals[min(len(vals) - 1, int(pos) + 2)]
        assert lo <= approx.p95_processing_time_ms <= hi
        assert vals[int(pos)] <= exact.p95_processing_time_ms <= vals[min(len(vals) - 1, int(pos) + 1)]


def test_exact_percentile_narrows_to_the_value(spark, monkeypatch):
    """All latencies distinct, many equal, few, none: as ``percentile`` gives it."""
    import random

    from pyspark.sql import functions as F
    from vecsync.operators import monitor as M
    monkeypatch.setattr(M, "NARROW", 20)
    rnd = random.Random(1)
    for values in ([rnd.random() * 1e6 for _ in range(5000)], [1.5] * 400 + [2.5] * 90 + [9.0],
                   [3.0], [1.0, 2.0], [-1e300, 0.0, 1e300] * 50,
                   [rnd.choice([1.0, 2.0, 3.0]) + rnd.random() * 1e-9 for _ in range(3000)]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
        for q in (0.0, 0.5, 0.95, 1.0):
            want = df.agg(F.percentile("x", F.lit(q))).first()[0]
            got = M.exact_percentile(df, "x", q)
            assert got == want or abs(got - want) <= 1e-9 * abs(want), (q, got, want)
    assert M.exact_percentile(df.limit(0), "x", 0.95) is None


def test_registered_names_reach_the_mapping(spark):
    """K2 then K3: a renamed cleaned-text column is found again."""
    from vecsync.operators import catalog as K
    want = spark.createDataFrame([("s", "t", "cleaned_config", "text_cleaned_config"),
                                  ("s", "t", "vector", "text_vector")],
                                 "schema_name string, table_name string, role string, "
                                 "column_name string")
    reg = want.select("schema_name", "table_name", K.role_family(want.role).alias("column_type"),
                      want.column_name.alias("original_column_name")).selectExpr(
        "*", "original_column_name || '_v2' AS actual_column_name")
    got = {r.column_name: r.actual_column_name for r in K.column_mapping(want, reg).collect()}
    assert got == {"text_cleaned_config": "text_cleaned_config_v2", "text_vector": "text_vector_v2"}


def test_counts_beyond_the_int_range(spark):
    from vecsync.operators import writeback as WB
    cols = "database_name string, schema_name string, table_name string, vector_column string, " \
           "checked_at timestamp_ntz, null_vectors long, total_rows long"
    df = spark.sql("SELECT 'd' AS database_name, 's' AS schema_name, 't' AS table_name, 'v' AS "
                   "vector_column, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS checked_at, "
                   "3000000000L AS null_vectors, 4000000000L AS total_rows")
    out = WB.upsert_daily_status(spark.createDataFrame([], cols), df).first()
    assert (out.null_vectors, out.total_rows) == (3_000_000_000, 4_000_000_000)
