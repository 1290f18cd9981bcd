import csv
import glob
import os
import tracemalloc

import pytest

from catalens.plans import entry
from catalens.sources import results, sinks


def read(path):
    with open(path, newline="", encoding="utf-8") as f:
        return list(csv.reader(f))


@pytest.fixture
def odd_cells(spark):
    return spark.sql("""SELECT * FROM VALUES (1, 'a,b', CAST(NULL AS STRING), array(1, 2), X'0aff'), (2, 'say "x"', '', array(), NULL), (3, 'two
lines', ' ', NULL, X''), (4, 'hush hush', 'plain', array(9), X'00') AS t(`a,b`, `s`, `S`, l, b)""")


def test_cells(odd_cells, tmp_path):
    done = results.stream(odd_cells.coalesce(1).sort("`a,b`"), tmp_path / "x.csv", None, ["hush"])
    text = (tmp_path / "x.csv").read_text()
    assert (done.rows, done.truncated) == (4, False) and text.startswith('"a,b",s,S,l,b\n1,"a,b",,"[1,2]",\\x0aff\n')
    assert '""' in text and "hush" not in text and "[REDACTED] [REDACTED]" in text
    assert read(tmp_path / "x.csv")[2:4] == [["2", 'say "x"', "", "[]", ""], ["3", "two\nlines", " ", "", "\\x"]]
    assert os.listdir(tmp_path) == ["x.csv"]


def test_cut(spark, tmp_path):
    for limit, rows, cut in ((5, 5, True), (9, 9, False), (10, 9, False), (None, 9, False)):
        done = results.stream(spark.range(9).coalesce(2), tmp_path / "n.csv", limit)
        assert (done.rows, done.truncated, len(read(tmp_path / "n.csv"))) == (rows, cut, rows + 1)
    assert results.stream(spark.range(60), tmp_path / "n.csv", 50).first == sinks.csv_text(["id"], [(i,) for i in range(19)]).splitlines()


def test_nothing_is_left_of_a_failed_run(spark, tmp_path):
    bad = spark.range(9).selectExpr("IF(id < 5, id, CAST(raise_error('x') AS long)) AS n")
    with pytest.raises(Exception):
        results.stream(bad, tmp_path / "bad.csv", None)
    assert os.listdir(tmp_path) == []


def test_memory_does_not_grow(spark, tmp_path):
    peaks = []
    for n in (20_000, 400_000):
        tracemalloc.start()
        assert results.stream(spark.range(n).selectExpr("id", "repeat('x', 40) AS s").repartition(8), tmp_path / "m.csv", None).rows == n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 20e6


def test_parts_in_order(spark, tmp_path):
    path = results.claim(spark, str(tmp_path), "SELECT 1")
    done = results.write_parts(spark.range(5000).repartition(7).sort("id"), path)
    assert done.rows == 5000
    joined = "".join(open(p).read() for p in sorted(glob.glob(f"{path}/[0p]*")))
    assert joined == sinks.csv_text(["id"], [(i,) for i in range(5000)])
    assert results.claim(spark, str(tmp_path), "SELECT 1") != path


def test_query_without_a_limit(spark, tmp_path):
    spark.range(300).selectExpr("id", "'hush' AS s").createOrReplaceTempView("many")
    (tmp_path / "d/shop").mkdir(parents=True)
    out = entry.run_query(spark, "SELECT id, s FROM many ORDER BY id", str(tmp_path / "d"), str(tmp_path / "out"), no_limit=True, secrets=["hush"])
    assert out.exit_code == entry.OK and "rows: 300\ntruncated: false\nlimit: none" in open(f"{out.path}.meta").read()
    rows = [x for p in sorted(glob.glob(f"{out.path}/[0p]*")) for x in read(p)]
    assert rows[0] == ["id", "s"] and rows[-1] == ["299", "[REDACTED]"] and len(rows) == 301
    failed = entry.run_query(spark, "SELECT 1 / (id - 299) AS x FROM many ORDER BY id", str(tmp_path / "d"), str(tmp_path / "bad"), no_limit=True)
    assert failed.exit_code == entry.FAILED and not glob.glob(f"{tmp_path}/bad/*.csv*")
    text = entry.run_query(spark, "SELECT id FROM many ORDER BY id", str(tmp_path / "d"), str(tmp_path / "out"), no_limit=True, form="text")
    assert open(text.path).read() == "".join(f"{i}\n" for i in range(300))
