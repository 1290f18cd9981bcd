import random

import duckdb
import pytest

from catalens.operators import candidates


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def closest(asked, names, threshold, most):
    out = []
    for a in sorted(set(asked)):
        best = {}
        for candidate, local in names:
            x, y = a.rsplit(".", 1)[-1].lower(), local.lower()
            similar = 1.0 if not x and not y else 1.0 - distance(x, y) / max(len(x), len(y))
            if similar >= threshold:
                best[candidate] = max(best.get(candidate, 0), similar)
        ordered = sorted(best.items(), key=lambda c: (-c[1], c[0]))[:most]
        out += [(a, c, round(s, 4), k + 1) for k, (c, s) in enumerate(ordered)]
    return sorted(out)


@pytest.mark.parametrize("threshold, few", [(0.6, 0), (0.6, 100), (0.9, 0), (0.3, 0)])
def test_all_that_are_close(spark, monkeypatch, threshold, few):
    monkeypatch.setattr(candidates, "FEW", few)
    draw = random.Random(5)
    words = ["customer", "order", "name", "id", "key", "total", "price", "date", "line", "ship", "x", ""]
    names = [(f"t{k}.{n}", n) for k in range(60) for n in ["_".join(draw.sample(words, draw.randint(1, 4)))]]
    names += [(f"s{k}.id", "id") for k in range(9)] + [("t0.both", "id"), ("t0.both", "key_id")]
    asked = ["", "a.idd"]
    for _, n in draw.sample(names, 30):
        letters = list(n)
        for _ in range(draw.randint(0, 4)):
            at = draw.randint(0, len(letters))
            letters[at : at + draw.randint(0, 1)] = draw.choice(["", "q", "er"])
        asked.append("".join(letters))
    found = candidates.rank(spark.createDataFrame([(a,) for a in asked], "identifier string"), spark.createDataFrame(names, "candidate string, local string"), threshold, 5)
    assert sorted(tuple(r) for r in found.collect()) == closest(asked, names, threshold, 5)


def test_nothing_asked_or_known(spark):
    none = spark.createDataFrame([], "identifier string")
    names = spark.createDataFrame([("t.id", "id"), ("t.none", None)], "candidate string, local string")
    assert candidates.rank(none, names).count() == 0
    assert candidates.rank(spark.createDataFrame([("idd",), (None,)], "identifier string"), names.limit(0)).count() == 0
    assert [r["candidate"] for r in candidates.rank(spark.createDataFrame([("idd",), (None,)], "identifier string"), names).collect()] == ["t.id"]


def test_command_line_suggests(spark, tmp_path, capsys):
    from catalens.__main__ import main

    spark.createDataFrame([(1, "a")], "n_nationkey int, n_name string").write.parquet(str(tmp_path / "tables" / "nation.parquet"))
    assert main(["check", "--sql", "SELECT n_nam FROM nation", "--tables", str(tmp_path / "tables"), "--out", str(tmp_path / "out")]) == 4
    assert "close: nation.n_name" in capsys.readouterr().out
    assert main(["check", "--sql", "SELECT 1 FROM natoin", "--tables", str(tmp_path / "tables"), "--out", str(tmp_path / "out")]) == 4
    assert "close: nation (0.6667)" in capsys.readouterr().out


def runs(asked, names, threshold):
    """All close names of each identifier, those that follow each other by length and letters as (first, last, how many)."""
    places = {}
    for candidate, local in names:
        if local is not None:
            places.setdefault((len(local), local.lower()), []).append(candidate)
    out = []
    for a in sorted({a for a in asked if a is not None}):
        x, last = a.rsplit(".", 1)[-1].lower(), None
        for at, (n, y) in enumerate(sorted(places)):
            if 1.0 - distance(x, y) / max(len(x), n, 1) >= threshold:
                here = places[n, y]
                if last != at - 1:
                    out.append([a, min(here), None, 0])
                out[-1][2:], last = [min(here), out[-1][3] + len(here)], at
    return sorted(map(tuple, out))


@pytest.mark.parametrize("threshold, alike", [(0.6, 1), (0.6, 16), (0.9, 2), (0.3, 4)])
def test_all_links(spark, monkeypatch, threshold, alike):
    monkeypatch.setattr(candidates, "ALIKE", alike)
    monkeypatch.setattr(candidates, "DEALT", 7)
    draw = random.Random(6)
    words = ["customer", "order", "name", "id", "key", "total", "x", ""]
    local = ["_".join(draw.sample(words, draw.randint(1, 4))) for _ in range(60)] + [f"customer_{k:03}" for k in range(150)] + ["", "a", "b", "Id", "ID", "a\u0001\u0001"]
    names = [(f"t{k}.{n}", n) for k, n in enumerate(local)] + [("t1.both", "id"), ("t1.both", "id"), ("t0.none", None)]
    asked = [None, "", "a.", "idd", "ID", "s.customr_01", "CUSTOMER_0999", "cust", "\u0001\u0001", "custom\u0001\u0001\u0001", "zzzzzzzz", *draw.sample(local, 12)]
    found = candidates.links(spark.createDataFrame([(a,) for a in asked], "identifier string"), spark.createDataFrame(names, "candidate string, local string"), threshold)
    assert sorted(map(tuple, found.collect())) == runs(asked, names, threshold)


def test_no_links(spark):
    none = spark.createDataFrame([], "identifier string")
    names = spark.createDataFrame([("t.id", "id"), ("t.none", None)], "candidate string, local string")
    assert candidates.links(none, names).count() == 0
    asked = spark.createDataFrame([("idd",), (None,)], "identifier string")
    assert candidates.links(asked, names.limit(0)).count() == 0
    assert [tuple(r) for r in candidates.links(asked, names).collect()] == [("idd", "t.id", "t.id", 1)]


def test_query_links_names_of_many_edits(spark, tmp_path):
    """Not only those of one edit, nor the first few."""
    from catalens import registry

    known = [f"Customer#{k:09}" for k in (*range(40), *range(123_456_700, 123_456_740), 999_999_999)] + ["customer#000000007", "Nobody"]
    spark.createDataFrame([(n,) for n in known], "c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(f"Supplier#{k:09}",) for k in (3, 3, 1_234_567, 9_999_999)] + [(None,)], "s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    found = sorted(map(tuple, registry.QUERIES["jn_fuzzy"](spark, str(tmp_path)).collect()))
    asked = [f"Customer#0{k:07}" for k in (3, 1_234_567, 9_999_999)]
    assert found == runs(asked, [(n, n) for n in known], 0.6)
    assert {a: sum(r[3] for r in found if r[0] == a) for a in asked} == {asked[0]: 42, asked[1]: 45, asked[2]: 5}
    con = duckdb.connect()
    for name in ("customer", "supplier"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert found == sorted(con.execute(registry.ORACLES["jn_fuzzy"]).fetchall())
