"""P1, J2, J1/J3, P11 on small fixtures (reference rules)."""
from pyspark.sql import functions as F

from vecsync.operators import detect, routing as R
from vecsync.plans import derive


def test_needs_vectorization_rule(spark):
    rows = [("INSERT", None, None, "a", True), ("INSERT", "[1]", None, "a", False),
            ("UPDATE", None, "a", "b", True), ("UPDATE", None, "a", "a", False),
            ("UPDATE", "[1]", None, "b", True), ("DELETE", None, "a", None, False)]
    df = spark.createDataFrame(rows, "op string, v string, old string, new string, want boolean")
    got = df.select(detect.needs_vectorization(F.col("op"), F.col("v"), F.col("old"),
                                               F.col("new")).alias("g"), "want").collect()
    assert [r.g for r in got] == [r.want for r in got]


def test_snapshot_diff_classes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d")], "id long, t string")
    new = spark.createDataFrame([(1, "a"), (2, "B"), (3, None), (5, "e")], "id long, t string")
    got = {r.id: r.operation for r in detect.snapshot_diff(old, new, "id", "t").collect()}
    assert got == {1: "UNCHANGED", 2: "UPDATE", 3: "UNCHANGED", 4: "DELETE", 5: "INSERT"}


def test_routing_first_config_wins_and_aliases(spark):
    routing = derive.routing_config(spark)
    ev = spark.createDataFrame(
        [(1, "primary", "public", "documents"), (2, derive.DATABASE, "public", "documents"),
         (3, "other", "public", "documents"), (4, "primary", "public", "audit_log")],
        "event_id long, database string, schema string, table string")
    routed = {r.event_id: (r.config_order, r.text_column)
              for r in R.route_events(ev, routing).collect()}
    assert routed == {1: (1, "text"), 2: (1, "text")}
    assert sorted(r.event_id for r in R.unrouted_events(ev, routing).collect()) == [3, 4]


def test_desired_columns_defaults(spark):
    cfg = spark.createDataFrame(
        [(1, "db", "db", "s", "t", "content", "id", None, None, "default", False, None)],
        derive.ROUTING_COLUMNS)
    got = [(r.column_name, r.role) for r in R.desired_columns(cfg).collect()]
    assert got == [("content_vector", "vector"), ("content_embedding_model", "model"),
                   ("content_vector_created_at", "timestamp")]
