import random

import pytest

from catalens.operators import reach


def reached(edges):
    after = {}
    for m, r in edges:
        after.setdefault(m, set()).add(r)
    out = set()
    for m in after:
        todo, seen = [m], set()
        while todo:
            for r in after.get(todo.pop(), ()):
                if r not in seen:
                    seen.add(r)
                    todo.append(r)
        out |= {(m, r) for r in seen if r != m}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_every_path(spark, seed):
    draw = random.Random(seed)
    edges = [(f"r{draw.randint(0, 60)}", f"r{draw.randint(0, 60)}") for _ in range(70)]  # with cycles and loops
    edges += [(f"d{i}", f"d{i + 1}") for i in range(40)] + [(f"x{i}", "d0") for i in range(30)] + [("d3", "d4"), (None, "d1"), ("d1", None)]
    df = spark.createDataFrame(edges, "member string, role string")
    found = [tuple(r) for r in reach.closure(df).collect()]
    assert len(found) == len(set(found)) and set(found) == reached([e for e in edges if None not in e])


def test_rights_of_all(spark):
    members = spark.createDataFrame([("a", "b"), ("b", "c"), ("z", "c")], "member string, role string")
    acl = spark.createDataFrame([("c", "t1"), ("b", "t2"), ("PUBLIC", "t3"), ("q", "t4")], "grantee string, object_id string")
    roles = spark.createDataFrame([("a",), ("b",), ("lonely",)], "rolname string")
    found = {(r["role"], r["grantee"], r["object_id"]) for r in reach.effective(acl, members, roles).collect()}
    assert found == {("a", "c", "t1"), ("a", "b", "t2"), ("a", "PUBLIC", "t3"), ("b", "c", "t1"), ("b", "b", "t2"), ("b", "PUBLIC", "t3"), ("lonely", "PUBLIC", "t3")}
    assert reach.closure(members.limit(0)).count() == 0
