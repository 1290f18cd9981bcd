import os

import pytest

from catalens import shared


def test_numbers_are_gapless_in_order(spark):
    df = spark.range(5000).selectExpr("id % 7 AS k", "id")
    rows = sorted(shared.numbered(df, ["k", "id"]).collect(), key=lambda r: r["idx"])
    assert [r["idx"] for r in rows] == list(range(5000)) and [(r["k"], r["id"]) for r in rows] == sorted((i % 7, i) for i in range(5000))
    assert shared.numbered(df.limit(0), ["id"]).count() == 0


def test_tables_are_written_and_released(spark):
    before = shared.written()
    t = shared.materialize(spark.range(3), "three")
    path = t.inputFiles()[0]
    assert t.count() == 3 and path.removeprefix("file:").lstrip("/").startswith(shared.shared_folder(spark).removeprefix("file:").lstrip("/"))
    shared.release(before, shared.written())
    assert not os.path.exists("/" + path.removeprefix("file:").lstrip("/"))


def session(master, folder):
    conf = type("Conf", (), {"get": lambda self, key, default: folder or default})()
    return type("Session", (), {"conf": conf, "sparkContext": type("Context", (), {"master": master})()})()


def test_the_named_folder_is_used():
    assert shared.shared_folder(session("spark://host:7077", "hdfs:///shared/")) == "hdfs:///shared"
    assert shared.shared_folder(session("local[4]", None)) == shared.LOCAL_SHARED


def test_a_cluster_needs_a_folder():
    with pytest.raises(RuntimeError):
        shared.shared_folder(session("spark://host:7077", None))


def test_small_tables_are_marked(spark):
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(shared.small(spark.range(5), 5)) and "broadcast" not in plan(shared.small(spark.range(6), 5))
