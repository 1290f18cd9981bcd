import json
import os

from catalens.__main__ import main
from catalens.plans import entry

SMALL = "/root/testdata/sf0.001"


def test_query_to_files(spark, tmp_path):
    spark.read.parquet(f"{SMALL}/nation.parquet").createOrReplaceTempView("nation")
    run = lambda sql, **k: entry.run_query(spark, sql, str(tmp_path / "dictionary"), str(tmp_path / "out"), **k)
    assert run("SELECT 1").exit_code == entry.HUMAN
    (tmp_path / "dictionary/shop").mkdir(parents=True)
    out = run("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey", limit=3)
    assert out.exit_code == 0 and open(out.path).read().count("\n") == 4 and "truncated: true" in open(out.path + ".meta").read() and "… (truncated" in out.text
    assert run("DROP TABLE nation").exit_code == entry.REFUSED and run("SELECT nope FROM nation").exit_code == entry.FAILED
    shown = run("EXPLAIN SELECT * FROM nation")
    assert shown.exit_code == 0 and shown.path.endswith(".txt") and "format: text" in shown.meta
    assert "[REDACTED]" in open(run("SELECT 'hush' AS s", secrets=["hush"]).path).read()


def test_check_to_files(spark, tmp_path):
    out = entry.run_check(spark, "SELECT nope", str(tmp_path))
    assert out.exit_code == 4 and json.load(open(out.path))["sqlstate"] == "42703"
    assert entry.run_check(spark, "SELECT 1 AS one", str(tmp_path)).text == "ok: int"


def test_command_line(spark, tmp_path, capsys):
    assert main(["guard", "--sql", "SELECT 1", "--limit", "5"]) == 0
    assert json.loads(capsys.readouterr().out)["wrapped"].endswith("LIMIT 6")
    os.makedirs(tmp_path / "d/s")
    assert main(["query", "--sql", "SELECT count(*) AS n FROM nation", "--tables", SMALL, "--dictionary", str(tmp_path / "d"), "--out", str(tmp_path / "o")]) == 0
    assert "25" in capsys.readouterr().out
    assert main(["check", "--sql", "SELECT x FROM nation", "--tables", SMALL, "--out", str(tmp_path / "o")]) == 4
