"""S2, S3, S8, P4 edge cases."""
import json

from vecsync.sources import feed as FD
from vecsync.sources.tables import scan_multi_target


def test_required_keys_present_with_null_values_are_valid(spark):
    ok = {"database": "d", "schema": "s", "table": "t", "operation": "DELETE", "id": None}
    missing = {"database": "d", "schema": "s", "operation": "UPDATE"}
    rows = [(1, json.dumps(ok)), (2, json.dumps(missing)), (3, "not json"), (4, "[1, 2]")]
    df = spark.createDataFrame(rows, "event_id long, value string")
    got = {r.event_id: r.reject_reason for r in FD.with_validation(df).collect()}
    assert got[1] is None
    assert got[2] == "missing_fields:table,id"
    assert got[3] == "malformed_json" and got[4] == "malformed_json"
    parsed = FD.parse_feed(df).collect()
    assert [(r.event_id, r.operation, r.id) for r in parsed] == [(1, "DELETE", None)]
    rejects = sorted(r.event_id for r in FD.feed_rejects(df).collect())
    assert rejects == [2, 3, 4]


def test_row_objects_are_read_by_configured_names(spark):
    ev = {"database": "d", "schema": "s", "table": "t", "operation": "UPDATE",
          "id": {"pk": 7, "body": "new"}, "old_id": {"pk": 7, "body": "old"}}
    df = FD.parse_feed(spark.createDataFrame([(1, json.dumps(ev))], "event_id long, value string"))
    df = df.selectExpr("*", "'pk' AS id_column", "'body' AS text_column",
                       "CAST(NULL AS STRING) AS vector_column")
    r = FD.with_config_fields(df).first()
    assert (r.row_id, r.new_text, r.old_text) == ("7", "new", "old")


def test_multi_target_unpivot(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", None)],
                               "conv_id long, turn long, role string, text string")
    got = sorted(tuple(r) for r in scan_multi_target(df, ["conv_id", "turn"],
                                                     ["role", "text"]).collect())
    assert got == [(1, 0, "role", "user"), (1, 0, "text", "hi"),
                   (1, 1, "role", "assistant"), (1, 1, "text", None)]


def test_ids_of_any_kind_and_vectors_by_the_configured_column(spark):
    rows = [({"id": "6f1c-uuid", "p_name": "n", "p_type": "[1,2]"}, "p_type"),
            ({"id": 9, "p_name": "m", "p_type": None}, "p_type"),
            ({"id": "x", "p_name": "o", "p_name_vector": "[3]"}, None)]
    ev = [(i, json.dumps({"database": "d", "schema": "s", "table": "part", "operation": "INSERT",
                          "id": r, "old_id": None}), v) for i, (r, v) in enumerate(rows)]
    df = FD.parse_feed(spark.createDataFrame(ev, "event_id long, value string, vc string"))
    df = df.selectExpr("*", "'id' AS id_column", "'p_name' AS text_column", "vc AS vector_column")
    got = FD.with_config_fields(df).orderBy("event_id").collect()
    assert [r.row_id for r in got] == ["6f1c-uuid", "9", "x"]
    assert [r.new_vector for r in got] == ["[1,2]", None, "[3]"]


def test_feed_times_do_not_depend_on_the_session_zone(spark):
    from pyspark.sql import functions as F
    keep = spark.conf.get("spark.sql.session.timeZone")
    seen = set()
    for zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        df = spark.range(1).select(FD.wall_clock(F.timestamp_micros(F.lit(1_700_000_000_123_456))))
        seen.add(str(df.first()[0]))
    spark.conf.set("spark.sql.session.timeZone", keep)
    assert seen == {"2023-11-14 22:13:20.123456"}
