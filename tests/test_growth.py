"""Queries whose work must not grow faster than their tables."""

import random
import threading
from datetime import datetime, timedelta

import duckdb
import pytest

from catalens import registry
from catalens.operators import candidates, ordered
from catalens.plans import queries
from tests.test_candidates import distance

DAY = datetime(2024, 3, 31)


@pytest.fixture
def limited(spark):
    """Jobs are cancelled after a minute, so that pairs of all rows fail."""
    timer = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    timer.start()
    yield
    timer.cancel()


def oracle(name, **tables):
    con = duckdb.connect()
    for table, path in tables.items():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    return con.execute(queries.ORACLES[name]).fetchall()


@pytest.fixture
def business(spark, tmp_path):
    """Writes customers and suppliers by (key, nation); the other tables are empty."""

    def write(customers, suppliers):
        customers.write.parquet(str(tmp_path / "customer.parquet"))
        suppliers.write.parquet(str(tmp_path / "supplier.parquet"))
        for name in set(queries.TABLES) - {"customer", "supplier"}:
            spark.range(0).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


def test_full_join_of_odd_nations(spark, business):
    draw = random.Random(1)
    some = lambda n, nations: [(draw.choice([None, *range(n)]), draw.choice(nations)) for _ in range(2 * n)]
    d = business(spark.createDataFrame(some(50, [None, 1, 2, 3]), "c_custkey long, c_nationkey int"), spark.createDataFrame(some(20, [None, 2, 3, 4]) + [(None, 5)], "s_suppkey long, s_nationkey int"))
    want = oracle("del_join_full", customer=f"{d}/customer.parquet", supplier=f"{d}/supplier.parquet")
    df = queries.QUERIES["del_join_full"](spark, d)
    assert sorted(map(tuple, df.select("k", "c", "s").collect()), key=repr) == sorted(want, key=repr) and len(want) == 6


def test_full_join_of_one_nation(spark, business, limited):
    d = business(spark.range(60_000).selectExpr("id AS c_custkey", "1 AS c_nationkey"), spark.range(60_000).selectExpr("id AS s_suppkey", "1 AS s_nationkey"))
    assert [tuple(r) for r in queries.QUERIES["del_join_full"](spark, d).select("k", "c", "s").collect()] == [(1, 60_000, 60_000)]


@pytest.mark.parametrize("parts, width", [(None, 20), (1, 20), (7, 20), (60, 0)])
def test_counts_of_interval_pairs(spark, parts, width):
    draw = random.Random(3)
    rows = [(draw.choice([None, *range(150)]), draw.choice([1, 1, 1, 2, None]), draw.choice([None, *[DAY + timedelta(minutes=draw.randint(0, 300)) for _ in range(9)]])) for _ in range(400)]
    rows += [(900 + i, 1, DAY) for i in range(60)] + [(None, 7, DAY)]
    left = spark.createDataFrame(rows, "a long, k long, at timestamp")
    right = left.filter("a IS NULL OR a % 3 > 0").selectExpr("a AS b", "k", "at AS then")
    found = ordered.counts_within(left, right, ["k"], "at", "then", width * 60_000_000, ["a"], "b", parts=parts)
    want = {}
    for a, k, s in rows:
        for b, m, u in rows:
            if (b is None or b % 3) and k is not None and k == m and s and u and s <= u <= s + timedelta(minutes=width):
                want[a] = want.get(a, 0) + (b is not None)
    assert {r["a"]: r["n"] for r in found.collect()} == want and found.count() == len(want)
    assert ordered.counts_within(left, right.limit(0), ["k"], "at", "then", 5, ["a"], "b", parts=parts).count() == 0


def test_interval_counts_of_one_user(spark, tmp_path, limited):
    """All events of an hour: 1,600,000,000 pairs."""
    spark.range(0, 120_000, 3).selectExpr("id AS event_id", "1L AS user_id", f"timestamp_seconds(1700000000 + id % 600) AS ts").write.parquet(str(tmp_path / "events.parquet"))
    found = queries.QUERIES["del_interval_hot"](spark, str(tmp_path))
    assert found.selectExpr("count(*)", "min(n)", "max(n)").first()[:] == (40_000, 200, 40_000)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_names_of_one_edit(spark, letters):
    """Exactly the pairs of one edit meet: what only shares pieces does not."""
    draw = random.Random(2)
    name = lambda: "".join(draw.choice(letters) for _ in range(draw.randint(0, 6)))
    wanted, known = ({name() for _ in range(n)} for n in (60, 90))
    frame = lambda names, c: spark.createDataFrame([(x,) for x in sorted(names)], f"{c} string")
    found = candidates.one_edit(frame(wanted, "_a"), frame(known, "_b")).collect()
    assert sorted(map(tuple, found)) == sorted((a, b) for a in wanted for b in known if distance(a, b) <= 1)


def test_links_of_one_start(spark, tmp_path, limited):
    """40,000 identifiers and 400,000 names, all close: 16,000,000,000 pairs."""
    spark.range(400_000).selectExpr("concat('Customer#', lpad(id, 9, '0')) AS c_name").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(40_000).selectExpr("concat('Supplier#', lpad(id, 9, '0')) AS s_name").write.parquet(str(tmp_path / "supplier.parquet"))
    found = registry.QUERIES["jn_fuzzy"](spark, str(tmp_path))
    assert found.selectExpr("count(*)", "min(names)", "sum(names)").first()[:] == (40_000, 400_000, 16_000_000_000)
