"""F9–F11 goldens: alternatives, name patterns, collision scenario."""
from pyspark.sql import functions as F

from vecsync.operators import catalog as K


def alts(spark, name, existing):
    df = spark.createDataFrame([(name, existing)], "n string, e array<string>")
    return df.select(K.alternative_names(F.col("n"), F.col("e")).alias("a")).first().a


def test_alternatives_none_existing(spark):
    sfx = [a[len("content_vector"):] for a in alts(spark, "content_vector", [])]
    assert sfx == ["_v2", "_v3", "_v4", "_2", "_3", "_new", "_alt"]


def test_alternatives_skip_existing(spark):
    got = alts(spark, "content_vector", ["content_vector_v2", "content_vector_v3"])
    assert [a[len("content_vector"):] for a in got] == ["_v4", "_v5", "_v6", "_2", "_3", "_new", "_alt"]


def test_name_patterns(spark):
    yes = ["content_vector", "title_embedding", "description_cleaned", "text_vector_model",
           "content_embedding_created_at", "A_VECTOR_V12"]
    no = ["content", "title", "description", "user_id", "created_at", "status"]
    df = spark.createDataFrame([(n,) for n in yes + no], "n string")
    got = [r.m for r in df.select(K.matches_vectorizer_pattern(F.col("n")).alias("m")).collect()]
    assert got == [True] * len(yes) + [False] * len(no)


def test_collision_scenario(spark):
    cat = spark.createDataFrame(
        [("db", "public", "t", "title_vector", "vector", True, 768, 10),
         ("db", "public", "t", "old_embedding", "text", False, None, 10),
         ("db", "public", "t", "title", "text", False, None, 10)],
        "database_name string, schema_name string, table_name string, column_name string, "
        "data_type string, is_vector boolean, dimension int, row_count long")
    want = ["title_vector", "description_vector", "title_embedding", "old_embedding", "title"]
    desired = spark.createDataFrame([("db", "public", "t", c) for c in want],
                                    "database_name string, schema_name string, table_name string, "
                                    "column_name string")
    out = K.resolve_columns(K.classify_collisions(desired, cat, None))
    got = {r.column_name: (r.severity, r.resolved_column_name, r.blocked) for r in out.collect()}
    assert got["title_vector"] == ("critical", "title_vector_v2", True)
    assert got["description_vector"] == ("safe", "description_vector", False)
    assert got["title_embedding"] == ("safe", "title_embedding", False)
    assert got["old_embedding"] == ("warning", "old_embedding_v2", False)
    assert got["title"] == ("info", "title_v2", False)
