import pytest

from catalens.plans import check, entry, parameters
from catalens.plans.queries import PARAMETERS, register


@pytest.mark.parametrize("sql, names", [
    ("SELECT ?, :a, ? FROM t WHERE x = :a", ["1", "a", "2", "a"]), ("SELECT '?', \":a\" -- ? :b\n/* :c */ FROM t", []), ("SELECT x::int, v:field, a[1]:f FROM t", []), ("SELECT 1", []), ("SELECT(:a)", ["a"]),
])
def test_places(sql, names):
    assert [n for *_, n in parameters.places(sql)] == names


def test_bound():
    assert parameters.bound("SELECT :a + ? FROM t LIMIT ?", {"a": "int"}) == "SELECT CAST(NULL AS int) + NULL FROM t LIMIT 1"


@pytest.mark.parametrize("sql, code, types", PARAMETERS)
def test_types(spark, sql, code, types):
    register(spark, "/root/testdata/sf0.001")
    d = check.check(spark, sql, infer=True)
    assert d.exit_code == code
    if code != check.INVALID:
        assert ",".join(d.parameter_types) == (types or "")
    if code == check.HARD:
        assert d.sqlstate == "42P18"


def test_types_of_inserts(spark, tmp_path):
    spark.sql(f"CREATE TABLE IF NOT EXISTS bought (id BIGINT, day DATE) USING parquet LOCATION '{tmp_path}/bought'")
    try:
        d = check.check(spark, "INSERT INTO bought VALUES (:id, :day)", infer=True)
        assert d.exit_code == 0 and d.parameter_types == ["bigint", "date"]
        assert entry.run_check(spark, "SELECT * FROM bought WHERE day > ?", str(tmp_path)).exit_code == 0
    finally:
        spark.sql("DROP TABLE bought")
