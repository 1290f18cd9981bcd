import random
from datetime import datetime, timedelta

import pytest

from catalens.operators import ordered

DAY = datetime(2024, 3, 31)


@pytest.fixture(scope="module")
def rows():
    """Times with many ties and a key of more than a third of all rows; some nulls."""
    draw = random.Random(3)
    out = [(i, draw.choice([1, 1, 1, 2, 3, None]), draw.choice([None, *[DAY + timedelta(minutes=draw.randint(0, 300)) for _ in range(9)]])) for i in range(400)]
    return out + [(900 + i, 1, DAY) for i in range(60)]


@pytest.mark.parametrize("kind, hot", [("timestamp", 10_000), ("timestamp_ntz", 5), ("timestamp", 1)])
def test_interval_join(spark, rows, kind, hot):
    a = spark.createDataFrame(rows, "a long, k long, at timestamp_ntz").selectExpr("a", "k", f"cast(at AS {kind}) AS at").repartition(3)
    found = ordered.within(a, a.selectExpr("a AS b", "k", "at AS then"), ["k"], "at", "then", 20 * 60_000_000, hot=hot)
    wanted = [(x, y) for x, k, s in rows for y, m, u in rows if k is not None and k == m and s and u and s <= u <= s + timedelta(minutes=20)]
    assert sorted((r["a"], r["b"]) for r in found.collect()) == sorted(wanted)
    pairs = ordered.within(a, a.selectExpr("a AS b", "k", "at AS then"), ["k"], "at", "then", 0, hot=hot)
    assert pairs.count() == sum(k is not None and k == m and s is not None and s == u for _, k, s in rows for _, m, u in rows)
    assert ordered.within(a, a.selectExpr("a AS b", "k", "at AS then").limit(0), ["k"], "at", "then", 5).count() == 0


@pytest.mark.parametrize("parts", [None, 1, 7, 60])
def test_as_of_join(spark, rows, parts):
    left = spark.createDataFrame(rows, "a long, k long, at timestamp_ntz")
    right = left.filter("a % 4 = 0").selectExpr("k", "at AS since", "a AS r", "'x' AS extra")
    found = ordered.as_of(left, right, ["k"], "at", "since", "r", parts)
    wanted = []
    for a, k, s in rows:
        before = [(u, b) for b, m, u in rows if b % 4 == 0 and k is not None and k == m and s and u and u <= s]
        wanted.append((a, max(before)[1] if before else None))
    assert sorted((r["a"], r["_met"] and r["_met"]["r"]) for r in found.collect()) == sorted(wanted)
    none = ordered.as_of(left, right.limit(0), ["k"], "at", "since", "r", parts)
    assert none.count() == len(rows) and none.filter("_met IS NOT NULL").count() == 0


@pytest.mark.parametrize("parts", [None, 1, 9, 40])
def test_running_values(spark, rows, parts):
    df = spark.createDataFrame([(a, k, 2 * a) for a, k, _ in rows], "a long, k long, v long")
    df.createOrReplaceTempView("for_running")
    own = ordered.running(df, ["a"], {"total": "v"}, tiles=8, parts=parts)
    assert "SinglePartition" not in own._jdf.queryExecution().executedPlan().toString()
    windows = spark.sql("SELECT a, k, v, row_number() OVER w AS row_number, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, sum(v) OVER w AS total, ntile(8) OVER w AS ntile FROM for_running WINDOW w AS (ORDER BY a)")
    assert sorted(map(tuple, own.select(*windows.columns).collect())) == sorted(map(tuple, windows.collect()))
    tied = ordered.running(df, ["k"], parts=parts).select("a", "rank", "dense_rank")
    windows = spark.sql("SELECT a, rank() OVER (ORDER BY k) AS rank, dense_rank() OVER (ORDER BY k) AS dense_rank FROM for_running")
    assert sorted(map(tuple, tied.collect())) == sorted(map(tuple, windows.collect()))
    assert ordered.running(df.limit(0), ["a"], {"total": "v"}, tiles=3).count() == 0


@pytest.mark.parametrize("parts", [None, 1, 25])
def test_percentiles(spark, parts):
    draw = random.Random(8)
    rows = [(draw.choice(["hot", "hot", "a", "b", None]), draw.choice([None, 1.0, 2.5, *[draw.uniform(-9, 9) for _ in range(20)]])) for _ in range(500)] + [("none", None), ("one", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    df.createOrReplaceTempView("for_percentiles")
    found = ordered.percentiles(df, ["k"], "v", [0.0, 0.25, 0.5, 0.99, 1.0], parts)
    wanted = spark.sql("SELECT k, percentile(v, 0.0) AS p0, percentile(v, 0.25) AS p1, percentile(v, 0.5) AS p2, percentile(v, 0.99) AS p3, percentile(v, 1.0) AS p4 FROM for_percentiles GROUP BY k")
    told = lambda df: sorted((tuple(None if x is None else x if isinstance(x, str) else round(x, 9) for x in r) for r in df.collect()), key=str)
    assert told(found) == told(wanted)
    assert ordered.percentiles(df.limit(0), ["k"], "v", [0.5]).count() == 0


@pytest.mark.parametrize("before, after, hot", [(2, 1, 10_000), (0, 0, 20), (3, -1, 1), (-1, 4, 20), (500, 500, 10_000)])
def test_group_frames(spark, rows, monkeypatch, before, after, hot):
    """Frames of whole peer groups against brute force, with ties over partitions, nulls and a hot group."""
    monkeypatch.setattr(ordered, "HOT", hot)
    given = [(i, at, None if i % 11 == 0 else i) for i, _, at in rows]
    df = spark.createDataFrame(given, "id long, at timestamp_ntz, v long")
    groups = sorted({at for _, at, _ in given}, key=lambda x: (x is not None, x or DAY))
    want = []
    for i, at, v in given:
        k = groups.index(at)
        frame = set(groups[max(k - before, 0) : max(k + after + 1, 0)])
        found = [x for _, g, x in given if g in frame]
        numbers = [x for x in found if x is not None]
        want.append((i, at, v, len(found), sum(numbers) if numbers else None))
    got = ordered.peer_frames(df, ["at"], before, after, {"total": "v"}, parts=5)
    assert sorted(map(tuple, got.collect())) == sorted(want, key=lambda r: r[0])
    assert ordered.peer_frames(df.filter("false"), ["at"], before, after, {"total": "v"}).count() == 0


def test_group_frames_refuse(spark):
    with pytest.raises(ValueError):
        ordered.peer_frames(spark.range(3), ["id"], 1, -2, {})
