from concurrent.futures import ThreadPoolExecutor

import pytest

from catalens.plans import check, session
from catalens.plans.queries import HOSTILE, TABLES, refusal, register
from catalens.operators import collect, candidates
from catalens.sources.fixture import facts

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    register(spark, SMALL)
    return spark


def test_limit_and_truncation(tables):
    rows, cut, ms = session.fetch(session.query(tables, "SELECT * FROM nation ORDER BY n_nationkey", 10))
    assert len(rows) == 10 and cut and ms >= 0
    rows, cut, _ = session.fetch(session.query(tables, "SELECT * FROM nation", 25))
    assert len(rows) == 25 and not cut


@pytest.mark.parametrize("sql, reason", [
    ("WITH a AS (SELECT 1 AS i) INSERT INTO sink SELECT i FROM a", "not-read-only"), ("SELECT java_method('java.lang.System', 'getProperty', 'user.dir')", "function-not-allowed"), ("SELECT reflect('java.lang.Math', 'abs', -1)", "function-not-allowed"),
    ("SELECT * FROM region r WHERE EXISTS (WITH region AS (SELECT 1 AS x) SELECT * FROM region)", "relation-not-allowed"), ("WITH nation AS (SELECT 1 AS x), b AS (SELECT * FROM region) SELECT * FROM b", "relation-not-allowed"),
    ("SELECT * FROM (WITH region AS (SELECT 1 AS x) SELECT * FROM region) a JOIN region b ON true", "relation-not-allowed"), ("WITH region AS (SELECT * FROM region) SELECT * FROM region", "relation-not-allowed"),
    ("EXPLAIN SELECT * FROM region", "relation-not-allowed"), ("EXPLAIN SELECT reflect('java.lang.Math', 'abs', -1)", "function-not-allowed"), ("EXPLAIN INSERT INTO sink VALUES (1)", "not-read-only"),
    ("SHOW COLUMNS IN region", "relation-not-allowed"), ("SHOW CREATE TABLE nation", "not-read-only"), ("SHOW TBLPROPERTIES nation", "not-read-only"), ("SELECT * FROM IDENTIFIER('reg' || 'ion')", "function-not-allowed"),
    ("SELECT * FROM secret_table", "relation-not-allowed"), ("SELECT * FROM nation WHERE n_nationkey IN (SELECT x FROM other)", "relation-not-allowed"), ("SELECT 1; SELECT 2", "multi-statement"),
])
def test_refused(tables, sql, reason):
    with pytest.raises(session.Refused) as e:
        session.query(tables, sql, relations=[t for t in TABLES if t != "region"])
    assert e.value.reason == reason


@pytest.mark.parametrize("sql", [
    "WITH region AS (SELECT 1 AS x) SELECT * FROM region", "WITH a AS (SELECT 1 AS x), b AS (SELECT * FROM a) SELECT * FROM b JOIN nation ON true", "SELECT * FROM (WITH a AS (SELECT 1 AS x) SELECT x FROM a WHERE EXISTS (SELECT * FROM a)) q",
    "WITH RECURSIVE n(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM n WHERE i < 4) SELECT * FROM n", "EXPLAIN SELECT * FROM nation", "SHOW TABLES", "SHOW COLUMNS IN nation",
])
def test_taken(tables, sql):
    assert session.query(tables, sql, relations=["nation"]).df.count() >= 1


def test_files_are_not_tables(tables):
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND|relation-not-allowed"):
        session.query(tables, "SELECT * FROM text.`/etc/hostname`")
    assert tables.conf.get("spark.sql.runSQLOnFiles") == "true"


@pytest.mark.parametrize("sql, reason", HOSTILE)
def test_hostile(tables, sql, reason):
    assert refusal(tables, sql) == reason


@pytest.mark.parametrize("sql", [
    "SELECT left(n_name, 2), url_encode(n_name), date_add(current_date(), 1), try_divide(1, 0), any_value(n_name), percentile_approx(n_nationkey, 0.5) FROM nation GROUP BY ALL", "SELECT * FROM nation LATERAL VIEW explode(array(1, 2)) t AS x",
    "SELECT transform(array(1, 2), x -> x + 1), named_struct('a', 1).a, map('a', 1)['a'] FROM nation", "SELECT * FROM (SELECT n_name, n_regionkey FROM nation) PIVOT (count(n_name) FOR n_regionkey IN (1, 2))", "SELECT * EXCEPT (n_name) FROM nation",
    "SELECT /*+ BROADCAST(b) */ * FROM nation a JOIN nation b USING (n_nationkey)", "SELECT * FROM nation UNPIVOT (v FOR k IN (n_nationkey, n_regionkey))", "SELECT n_name COLLATE UTF8_BINARY, trim(BOTH 'A' FROM n_name), extract(year FROM date'2020-01-01') FROM nation", "SELECT * FROM range(5)",
])
def test_reading_is_listed(tables, sql):
    assert session.query(tables, sql, relations=["nation"]).df.columns


def test_views_are_their_makers_word(tables):
    """What a view holds may be what a statement may not."""
    tables.sql("CREATE OR REPLACE TEMPORARY VIEW by_script AS SELECT version() AS v FROM nation")
    try:
        assert session.query(tables, "SELECT v FROM by_script", relations=["by_script"]).df.count() == 25
    finally:
        tables.catalog.dropTempView("by_script")


def test_two_threads_leave_settings(tables):
    """No thread sees files as tables, or leaves the session's setting changed, whatever the other does."""
    def work(k):
        for _ in range(6):
            if k % 2:
                assert session.query(tables, "SELECT * FROM nation").df.columns
            else:
                with pytest.raises(session.Refused, match="relation-not-allowed"):
                    session.query(tables, "SELECT * FROM text.`/etc/hostname`")
            assert tables.conf.get("spark.sql.runSQLOnFiles") == "true"

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(work, range(4)))


def test_check_reads_no_file(tables):
    assert check.check(tables, "SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`").exit_code == check.GUARD


def test_insert_below_with_writes_nothing(tables, tmp_path):
    tables.sql(f"CREATE TABLE IF NOT EXISTS sink (i INT) USING parquet LOCATION '{tmp_path}/sink'")
    try:
        with pytest.raises(session.Refused):
            session.query(tables, "WITH a AS (SELECT 1 AS i) INSERT INTO sink SELECT i FROM a")
        assert check.check(tables, "INSERT INTO sink VALUES (1)").exit_code == 0
        assert tables.table("sink").count() == 0
    finally:
        tables.sql("DROP TABLE sink")


def test_check_tells_names_and_places(tables):
    f = facts(tables)
    names = candidates.column_names(collect.columns(f))
    d = check.check(tables, "SELECT emial FROM customer", columns=names)
    assert d.exit_code == 4 and d.sqlstate == "42703" and d.position == {"line": 1, "column": 8}
    assert d.candidates[0] == {"name": "shop.users.email", "similarity": 0.6}
    d = check.check(tables, "SELECT 1 FROM userz", tables=candidates.table_names(collect.tables(f), collect.views(f)))
    assert d.sqlstate == "42P01" and d.candidates[0]["name"] == "shop.users"
    assert check.check(tables, "SELECT FROM FROM").sqlstate in ("42601", "42703")
    d = check.check(tables, "SELECT n_name, n_nationkey FROM nation")
    assert (d.exit_code, d.result_types, d.parameter_types, d.candidates) == (0, ["string", "int"], [], None)
    assert check.check(tables, "SELECT * FROM nation WHERE n_nationkey = ?").exit_code == 1
    assert check.check(tables, "CREATE TABLE x (i INT)").sqlstate == "42601"
    assert check.check(tables, "  ").sqlstate == "42601"


@pytest.mark.parametrize("state, code", [("42703", 4), ("42P01", 4), ("42883", 4), ("42601", 4), ("42P18", 1), ("21S01", 4), ("08006", 1), (None, 1)])
def test_triage(state, code):
    assert check.triage(state) == code
    assert (check.triage("42501"), check.triage("42501", False)) == (2, 1)


def test_type_arrays():
    assert check.parse_type_array('{integer,"character varying","a\\"b"}') == ["integer", "character varying", 'a"b']
    assert check.parse_type_array("{}") == []
