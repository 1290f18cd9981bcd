import pytest
from hypothesis import given
from hypothesis import strategies as st

from catalens.plans.guard import evaluate, mask, positive


@pytest.mark.parametrize("sql, reason", [
    ("SELECT 1;", None), ("SELECT 1; -- done", None), ("SELECT 1; /* x */ ", None), ("SELECT 1; DROP TABLE t", "multi-statement"), ("SELECT '; ' || $a$ ; $a$", None), ("SELECT a$b$c; SELECT 1", "multi-statement"),
    ("SELECT 1 -- ; \n", None), ("SELECT 1 /* a /* b */ ; */", None), ("SELECT \\gexec", "meta-command"), ("SELECT '\\'", None), ("SELECT E'\\' ; '", None), ("SELECT note'\\'", None), ("\\copy t", "meta-command"),
    ("select Set_Config('x','y',true)", "not-whitelisted"), ('select "SET_CONFIG"(1)', None), ("select 'set_config(1)'", None), ("explain analyze select 1", "not-whitelisted"), ("explain (analyze) select 1", "not-whitelisted"),
    ("explain (verbose, analyze true) select 1", "not-whitelisted"), ("explain (analyze off, costs) select 1", None), ("explain (analyze 0) select 1", None), ("explain select 'explain analyze'", None), ("update t set a = 1", "not-whitelisted"), ("", "not-whitelisted"),
    ("-- only a note", "not-whitelisted"), ("with a as (select 1) select * from a", None), ("show tables", None), ("values (1)", "not-whitelisted"),
])
def test_verdict(sql, reason):
    v = evaluate(sql)
    assert (v.ok, v.reason) == (reason is None, reason)


@pytest.mark.parametrize("limit, n", [(1, 1), (" 7 ", 7), ("0", None), (-3, None), ("x", None), (None, None), (2**63 - 1, 2**63 - 1), (2**63, None), ("1.5", None)])
def test_limits(limit, n):
    assert positive(limit) == n


def test_wrapping():
    assert evaluate("SELECT 1 -- note", 5).wrapped == "SELECT * FROM (SELECT 1 -- note\n) _q LIMIT 6"
    assert evaluate("SHOW TABLES", 5).wrapped == "SHOW TABLES"
    assert evaluate("SELECT 1", no_limit=True).wrapped == "SELECT 1"
    assert evaluate("SELECT 1").sha8 == "e004ebd5"
    assert evaluate("INSERT INTO t VALUES (1)", mode="prepare").kind == "insert"
    assert evaluate("SELECT 1", "no").kind == "select"


@given(st.text(alphabet=["a", "b", "'", '"', "$", "-", "/", "*", "\\", ";", "\n", "E", " "], max_size=40))
def test_mask_keeps_the_length_and_lines(sql):
    m = mask(sql)
    assert len(m) == len(sql)
    assert [i for i, c in enumerate(m) if c == "\n"] == [i for i, c in enumerate(sql) if c == "\n"]
    assert "'" not in m
