import os

import pytest

from catalens.sources import objects

SCHEMA = "schema string, kind string, name string, body string"


def files(root):
    return sorted(os.path.join(d, f) for d, _, found in os.walk(root) for f in found)


def actions(df):
    return {(r["schema"], r["name"]): (r["action"], r["held_by"]) for r in df.collect()}


def test_only_what_differs_is_written(spark, tmp_path):
    root = str(tmp_path / "d")
    rows = [("a", "table", "t", "one"), ("a", "table", "u", None), ("b", "view", "v", "three"), ("b", "view", "v", "three")]
    assert actions(objects.sync(spark.createDataFrame(rows, SCHEMA), root)) == {("a", "t"): ("new", 1), ("a", "u"): ("new", 1), ("b", "v"): ("new", 1)}
    before = files(root)
    assert {x for x, _ in actions(objects.sync(spark.createDataFrame(rows, SCHEMA), root)).values()} == {"unchanged"} and files(root) == before
    rows = [("a", "table", "t", "one"), ("a", "table", "u", "two"), ("c", "view", "v", "three")]
    got = actions(objects.sync(spark.createDataFrame(rows, SCHEMA), root))
    assert got == {("a", "t"): ("unchanged", 1), ("a", "u"): ("changed", 2), ("b", "v"): ("deleted", 2), ("c", "v"): ("new", 2)}
    assert sorted(map(tuple, objects.read(spark, root).collect())) == rows
    assert len(objects.read(spark, root, 1).collect()) == 3
    assert {x for x, _ in actions(objects.sync(spark.createDataFrame([], SCHEMA), root)).values()} == {"deleted"} and objects.read(spark, root).count() == 0


def test_a_stopped_run_is_never_read(spark, tmp_path):
    root = str(tmp_path / "d")
    rows = [("a", "table", "t", "one")]
    objects.sync(spark.createDataFrame(rows, SCHEMA), root)
    # a run that was stopped after its bodies, and one within its manifest
    for n in (2, 3):
        objects.put(spark, f"{root}/claims/run={n}", "", new=True)
        spark.createDataFrame([("a", "table", "t", "half")], SCHEMA).drop("run").write.parquet(f"{root}/objects/run={n}")
    spark.createDataFrame([("a", "table", "t", "x", 3)], objects.MANIFEST).write.parquet(f"{root}/manifests/run=3")
    os.unlink(f"{root}/manifests/run=3/_SUCCESS")
    assert objects.runs(spark, root) == [1] and [tuple(r) for r in objects.read(spark, root).collect()] == rows
    assert actions(objects.sync(spark.createDataFrame([("a", "table", "t", "two")], SCHEMA), root)) == {("a", "t"): ("changed", 4)}
    assert [r["body"] for r in objects.read(spark, root).collect()] == ["two"]


def test_wrong_objects_are_refused(spark, tmp_path):
    root = str(tmp_path / "d")
    for rows in ([("a", "table", "t", "one"), ("a", "table", "t", "two")], [("a", None, "t", "one")]):
        with pytest.raises(ValueError):
            objects.sync(spark.createDataFrame(rows, SCHEMA), root)
    assert not os.path.exists(root) and objects.read(spark, root).count() == 0


def test_many_objects(spark, tmp_path):
    root = str(tmp_path / "d")
    many = spark.range(100_000).selectExpr("concat('s', id % 50) AS schema", "'table' AS kind", "concat('t', id) AS name", "concat('body ', id, repeat(' x', id % 40)) AS body")
    assert objects.sync(many, root).filter("action = 'new'").count() == 100_000
    before = files(root)
    assert objects.sync(many, root).filter("action <> 'unchanged'").isEmpty() and files(root) == before
    assert objects.read(spark, root).exceptAll(many).isEmpty()
