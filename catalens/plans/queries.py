"""Registered statements over the business tables, all through the guarded read path."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens.operators import candidates, collect, ordered
from catalens.plans import check, entry, guard, session
from catalens.shared import passing, shared_folder
from catalens.sources import documents, objects, results, sinks
from catalens.sources.fixture import facts

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(spark: SparkSession, sf_dir: str) -> None:
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def add(name: str, sql: str, oracle: str | None = None, **limits) -> None:
    limits = limits or {"no_limit": True}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir)
        return session.query(spark, sql, relations=TABLES, **limits).df

    QUERIES[name] = run
    ORACLES[name] = oracle or sql


FLAGSHIP = "SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total_price FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"
add("qry_session", FLAGSHIP)
add("lim_wrap", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey -- the dearest", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 11", limit=10)
add("lim_default", "SELECT o_orderkey FROM orders ORDER BY o_orderkey", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 201", limit=session.DEFAULT_LIMIT)
add("tpch_q1", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
add("tpch_q3", "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10")
add("tpch_q5", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name")
add("tpch_q6", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.06 AND l_quantity < 24")
add("del_join_left", "SELECT n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_name")
add("del_join_full", "SELECT coalesce(c_nationkey, s_nationkey) AS k, count(DISTINCT c_custkey) AS c, count(DISTINCT s_suppkey) AS s FROM customer FULL JOIN supplier ON c_nationkey = s_nationkey GROUP BY coalesce(c_nationkey, s_nationkey)")
_GUARDED = QUERIES["del_join_full"]


def _join_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statement's rows by joining one row a nation of each side: its counts of distinct keys are the same without the pairs of a nation."""
    _GUARDED(spark, sf_dir)  # judged and analysed as any other, not run
    counted = lambda name, key, nation, n: spark.table(name).groupBy(nation).agg(F.count_distinct(key).alias(n))
    both = counted("customer", "c_custkey", "c_nationkey", "_c").join(counted("supplier", "s_suppkey", "s_nationkey", "_s"), F.col("c_nationkey") == F.col("s_nationkey"), "full")
    # Two rows have no nation at most, one of each side: null meets nothing.
    return both.groupBy(F.coalesce("c_nationkey", "s_nationkey").alias("k")).agg(*[F.sum(F.coalesce(n, F.lit(0).cast("long"))).alias(n[1:]) for n in ("_c", "_s")])


QUERIES["del_join_full"] = _join_full
add("del_join_semi", "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
add("del_join_anti", "SELECT n_nationkey, n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)")
add("del_join_right", "SELECT n_name, count(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON n_nationkey = s_nationkey AND s_acctbal > 9000 GROUP BY n_name")
add("del_join_natural", "SELECT r_name, count(*) AS n FROM (SELECT n_regionkey AS r_regionkey, n_name FROM nation) x NATURAL JOIN region GROUP BY r_name")
add("del_join_cross", "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")
add("del_join_theta", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
add("del_join_using", "SELECT l_orderkey, count(*) AS n FROM lineitem JOIN (SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderstatus = 'F') x USING (l_orderkey) GROUP BY l_orderkey")
add("del_lateral", "SELECT n_name, t.top FROM nation, LATERAL (SELECT max(c_acctbal) AS top FROM customer WHERE c_nationkey = n_nationkey) t")
add("del_lag", "SELECT user_id, event_id, prev_id FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_id FROM events) x")
# The last purchase of the user at or before each view: both inputs go through one window, so no pair is made but the wanted one.
add("del_asof", """SELECT event_id, bought, value FROM (
  SELECT event_id, event_type, last_value(IF(event_type = 'purchase', event_id, NULL)) IGNORE NULLS OVER w AS bought, last_value(IF(event_type = 'purchase', value, NULL)) IGNORE NULLS OVER w AS value
  FROM (SELECT min(event_id) AS event_id, user_id, ts, event_type, max_by(value, -event_id) AS value FROM events GROUP BY user_id, ts, event_type) e WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) x WHERE event_type = 'view'""",
    """WITH e AS (SELECT min(event_id) AS event_id, user_id, ts, event_type, arg_min(value, event_id) AS value FROM events GROUP BY user_id, ts, event_type)
SELECT v.event_id, p.event_id AS bought, p.value FROM (SELECT * FROM e WHERE event_type = 'view') v ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'purchase') p ON v.user_id = p.user_id AND v.ts >= p.ts""")
add("del_interval_join", "SELECT a.event_id AS a, count(b.event_id) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL '1' HOUR GROUP BY a.event_id")
add("del_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus) AS g FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
add("del_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
add("del_rollup", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
add("del_filter_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS c, count(*) FILTER (WHERE o_totalprice > 100000) AS dear FROM orders GROUP BY o_orderstatus")
add("del_having", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 5")
add("del_statistics", "SELECT c_mktsegment, round(stddev_samp(c_acctbal), 4) AS sd, round(var_pop(c_acctbal), 2) AS vp, round(corr(c_acctbal, c_nationkey), 6) AS r, min(c_acctbal) AS low, max(c_acctbal) AS high, bool_and(c_acctbal > 0) AS every, bool_or(c_acctbal > 0) AS some FROM customer GROUP BY c_mktsegment")
add("del_percentile", "SELECT l_returnflag, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity), 4) AS med FROM lineitem GROUP BY l_returnflag")
add("del_string_agg", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
add("del_array_agg", "SELECT n_regionkey, array_join(array_sort(array_agg(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(array_agg(n_name)), ',') AS names FROM nation GROUP BY n_regionkey")
add("del_window_rank", "SELECT s_suppkey, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS r, dense_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS d, ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS q, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS rn FROM supplier")
add("del_window_offset", "SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev, lead(o_totalprice, 1, 0.0) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS first FROM orders")
add("del_window_frame", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM events")
add("del_window_range", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_totalprice RANGE BETWEEN 10000 PRECEDING AND 10000 FOLLOWING) AS n, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM orders")
add("del_topk_group", "SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) x WHERE rn <= 3")
add("del_nulls_order", "SELECT s_suppkey, nullif(s_nationkey, 3) AS k FROM supplier ORDER BY nullif(s_nationkey, 3) ASC NULLS LAST, s_suppkey LIMIT 20 OFFSET 5")
add("del_distinct_on", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) x WHERE rn = 1", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
add("del_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
add("del_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
add("del_union_all", "SELECT c_nationkey AS k, 'c' AS of FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier")
add("del_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
add("del_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
add("del_recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")
add("del_cte", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE total > 500000) SELECT count(*) AS n, round(avg(total), 2) AS mean FROM top")
add("del_values", "SELECT * FROM (VALUES (1, 'a'), (2, NULL)) AS t(i, s)")
add("del_predicates", "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9) AND p_type LIKE '%BRASS%' AND p_brand IS DISTINCT FROM 'Brand#13' AND p_retailprice BETWEEN 900 AND 1500 AND lower(p_name) ILIKE '%A%'")
add("del_patterns", "SELECT p_partkey FROM part WHERE p_name RLIKE '^[a-m].* (blue|red|green)' OR p_type LIKE ANY ('%BRASS', '%TIN') OR p_name LIKE ALL ('%a%', '%e%', '%i%', '%o%')", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^[a-m].* (blue|red|green)') OR p_type LIKE '%BRASS' OR p_type LIKE '%TIN' OR (p_name LIKE '%a%' AND p_name LIKE '%e%' AND p_name LIKE '%i%' AND p_name LIKE '%o%')")
add("del_quantified", "SELECT c_custkey FROM customer c WHERE c_acctbal >= (SELECT max(s_acctbal) FROM supplier WHERE s_nationkey = c_nationkey) OR c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9900)",
    "SELECT c_custkey FROM customer c WHERE c_acctbal >= ALL (SELECT s_acctbal FROM supplier WHERE s_nationkey = c_nationkey) AND EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey) OR c_nationkey = ANY (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9900)")
add("del_strings", "SELECT c_custkey, upper(substring(c_name, 1, 4)) AS a, length(c_name) AS n, replace(c_name, '#', '-') AS b, trim(concat('  ', c_mktsegment, ' ')) AS c, lpad(CAST(c_nationkey AS STRING), 3, '0') AS d, position('#' IN c_name) AS p, regexp_replace(c_name, '[0-9]+', 'N') AS e FROM customer",
    "SELECT c_custkey, upper(substring(c_name, 1, 4)) AS a, length(c_name) AS n, replace(c_name, '#', '-') AS b, trim(concat('  ', c_mktsegment, ' ')) AS c, lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS d, position('#' IN c_name) AS p, regexp_replace(c_name, '[0-9]+', 'N') AS e FROM customer")
add("del_dates", "SELECT extract(YEAR FROM o_orderdate) AS y, extract(MONTH FROM o_orderdate) AS m, date_trunc('quarter', o_orderdate) AS q, count(*) AS n FROM orders GROUP BY 1, 2, 3", "SELECT extract(YEAR FROM o_orderdate) AS y, extract(MONTH FROM o_orderdate) AS m, CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS q, count(*) AS n FROM orders GROUP BY 1, 2, 3")
add("del_math", "SELECT s_suppkey, abs(s_acctbal) AS a, round(sqrt(abs(s_acctbal)), 6) AS r, ceil(s_acctbal) AS c, floor(s_acctbal) AS f, s_suppkey % 7 AS m, sign(s_acctbal) AS s, round(ln(s_suppkey + 1), 6) AS l FROM supplier", "SELECT s_suppkey, abs(s_acctbal) AS a, round(sqrt(abs(s_acctbal)), 6) AS r, CAST(ceil(s_acctbal) AS BIGINT) AS c, CAST(floor(s_acctbal) AS BIGINT) AS f, s_suppkey % 7 AS m, CAST(sign(s_acctbal) AS DOUBLE) AS s, round(ln(s_suppkey + 1), 6) AS l FROM supplier")
add("del_json", "SELECT event_id, get_json_object(props, '$.k') AS k FROM events", "SELECT event_id, props->>'$.k' AS k FROM events")
add("del_case", "SELECT CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 150000 THEN 'mid' ELSE 'high' END AS bucket, count(*) AS n, coalesce(nullif(min(o_orderstatus), 'F'), '-') AS s FROM orders GROUP BY 1")
add("del_arrays", "SELECT event_type, size(collect_set(user_id)) AS users, array_contains(collect_set(user_id), CAST(1 AS BIGINT)) AS one FROM events GROUP BY event_type", "SELECT event_type, len(list_distinct(list(user_id))) AS users, list_contains(list(user_id), 1) AS one FROM events GROUP BY event_type")
add("del_scalar_subquery", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")


def _rows(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    return spark.createDataFrame(rows, columns)


_CASES = [
    ("SELECT 1; SELECT 2", "query"), ("SELECT ';' ; -- end", "query"), ("SELECT 1 /* ; /* nested */ ; */", "query"), ("\\! ls", "query"), ("SELECT set_config('a', 'b', false)", "query"), ('SELECT "set_config"(1)', "query"), ("EXPLAIN ANALYZE SELECT 1", "query"),
    ("EXPLAIN (ANALYZE false) SELECT 1", "query"), ("EXPLAIN (COSTS, ANALYZE) SELECT 1", "query"), ("INSERT INTO t VALUES (1)", "query"), ("INSERT INTO t VALUES (1)", "prepare"), ("SHOW TABLES", "query"), ("", "query"), ("SELECT $$ ; $$", "query"), ("SELECT E'\\'; x'", "query"),
]
_EXPECTED = ["multi-statement", None, None, "meta-command", "not-whitelisted", "not-whitelisted", "not-whitelisted", None, "not-whitelisted", "not-whitelisted", None, None, "not-whitelisted", None, None]


def _sql_rows(rows: list[tuple], names: str) -> str:
    lit = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS t({names})"


def _fixed(name: str, run: Callable[[SparkSession, str], DataFrame], expected: list[tuple], names: str) -> None:
    QUERIES[name] = run
    ORACLES[name] = _sql_rows(expected, names)


_fixed("grd_verdict", lambda s, d: _rows(s, [(i, guard.evaluate(q, mode=m).ok, guard.evaluate(q, mode=m).reason) for i, (q, m) in enumerate(_CASES)], "i int, ok boolean, reason string"), [(i, e is None, e) for i, e in enumerate(_EXPECTED)], "i, ok, reason")
for _name, _reason in (("grd_multi", "multi-statement"), ("grd_meta", "meta-command"), ("grd_whitelist", "not-whitelisted")):
    _fixed(_name, lambda s, d, r=_reason: _rows(s, [(i,) for i, (q, m) in enumerate(_CASES) if guard.evaluate(q, mode=m).reason == r], "i int"), [(i,) for i, e in enumerate(_EXPECTED) if e == _reason], "i")
_fixed("grd_mask", lambda s, d: _rows(s, [(guard.mask("a -- x\nb /* y */ 'z' \"q\""),)], "m string"), [("a" + " " * 5 + "\nb" + " " * 16,)], "m")
_fixed("grd_set_config", lambda s, d: _rows(s, [(guard.evaluate("SELECT SET_CONFIG ('a')").ok, guard.evaluate("SELECT 'set_config('").ok)], "bare boolean, quoted boolean"), [(False, True)], "bare, quoted")
_fixed("grd_explain_analyze", lambda s, d: _rows(s, [(guard.evaluate("EXPLAIN(ANALYZE off) SELECT 1").ok, guard.evaluate("explain (analyze) select 1").ok)], "off boolean, bare boolean"), [(True, False)], "off, bare")
_fixed("grd_limit", lambda s, d: _rows(s, [(str(x), guard.evaluate("SELECT 1", limit=x).reason) for x in (5, "0", "-1", "abc", 2**63)], "x string, reason string"), [("5", None), ("0", "bad-limit"), ("-1", "bad-limit"), ("abc", "bad-limit"), (str(2**63), "bad-limit")], "x, reason")
_fixed("lim_validate", QUERIES["grd_limit"], [("5", None), ("0", "bad-limit"), ("-1", "bad-limit"), ("abc", "bad-limit"), (str(2**63), "bad-limit")], "x, reason")


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    statements = ["SELECT c_custkey, c_name FROM customer", "SELECT nope FROM customer", "SELECT 1 FROM missing", "SELEC 1", "DROP TABLE customer", "SELECT nofn(1)", "SELECT 1; SELECT 2", "INSERT INTO customer VALUES (1)"]
    found = [check.check(spark, x) for x in statements]
    return spark.createDataFrame([(i, x.exit_code, x.sqlstate, ",".join(x.result_types) if x.result_types else None) for i, x in enumerate(found)], "i int, code int, state string, types string")


_fixed("chk_triage", _checked, [(0, 0, None, "bigint,string"), (1, 4, "42703", None), (2, 4, "42P01", None), (3, 4, "42601", None), (4, 4, "42601", None), (5, 4, "42883", None), (6, 3, None, None), (7, 4, "21S01", None)], "i, code, state, types")


#: Statements that reach beyond reading the given tables, and what the read path says of each.
HOSTILE = [
    ("SELECT TRANSFORM(n_name) USING 'cat' AS (b STRING) FROM nation", "not-listed"), ("SELECT * FROM (SELECT TRANSFORM(n_name) USING 'sh -c id' AS (b STRING) FROM nation) x", "not-listed"),
    ("WITH a AS (SELECT TRANSFORM(n_name) USING 'cat' AS (b STRING) FROM nation) SELECT * FROM a", "not-listed"), ("SELECT * FROM region WHERE r_name IN (SELECT TRANSFORM(n_name) USING 'cat' AS (b STRING) FROM nation)", "not-listed"),
    ("SELECT (SELECT max(b) FROM (SELECT TRANSFORM(n_name) USING 'cat' AS (b STRING) FROM nation) y) AS m FROM region", "not-listed"), ("SELECT * FROM (MAP n_name USING 'cat' AS b FROM nation) x", "not-listed"),
    ("SELECT * FROM (REDUCE n_name USING 'cat' AS b FROM nation) x", "not-listed"), ("SELECT n_name FROM nation UNION ALL SELECT TRANSFORM(r_name) USING 'cat' AS (b STRING) FROM region", "not-listed"),
    ("EXPLAIN SELECT TRANSFORM(n_name) USING 'cat' AS (b STRING) FROM nation", "not-listed"), ("SELECT reflect('java.lang.System', 'getenv', 'HOME') FROM nation", "function-not-allowed"),
    ("SELECT n_name FROM nation ORDER BY java_method('java.lang.Math', 'abs', -1)", "function-not-allowed"), ("SELECT `try_reflect`('java.lang.Math', 'abs', -1) FROM nation", "function-not-allowed"),
    ("SELECT input_file_name() FROM nation", "not-listed"), ("SELECT n_name FROM nation WHERE current_user() <> ''", "not-listed"), ("SELECT raise_error('x') FROM nation", "not-listed"), ("SELECT version() FROM nation", "not-listed"),
    ("SELECT aes_decrypt(n_name, n_name) FROM nation", "not-listed"), ("SELECT xpath('<a/>', 'a') FROM nation", "not-listed"), ("SELECT unknown_udf(n_name) FROM nation", "not-listed"), ("SELECT * FROM unknown_tables(1)", "not-listed"),
    ("SELECT * FROM parquet.`/etc`", "relation-not-allowed"), ("SELECT * FROM nation n JOIN text.`/etc/hostname` h ON true", "relation-not-allowed"), ("SELECT * FROM secrets", "relation-not-allowed"), ("SELECT * FROM IDENTIFIER('nat' || 'ion')", "function-not-allowed"),
    ("WITH a AS (SELECT 1 AS i) INSERT INTO nation SELECT i FROM a", "not-read-only"), ("SELECT * FROM nation; DROP TABLE nation", "multi-statement"), ("SET spark.sql.ansi.enabled = false", "not-whitelisted"), ("ADD JAR 'x.jar'", "not-whitelisted"),
]


def refusal(spark: SparkSession, sql: str) -> str | None:
    try:
        session.query(spark, sql, no_limit=True, relations=TABLES)
    except session.Refused as e:
        return e.reason
    return None


_fixed("qry_refused", lambda s, d: (register(s, d), _rows(s, [(i, refusal(s, q)) for i, (q, _) in enumerate(HOSTILE)], "i int, reason string"))[1], [(i, r) for i, (_, r) in enumerate(HOSTILE)], "i, reason")


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    found = [check.check(spark, x).position for x in ("SELECT c_custkey,\n  nope FROM customer", "SELECT FROM WHERE")]
    return spark.createDataFrame([(p["line"], p["column"]) for p in found[:1]], "line int, col int")


_fixed("chk_position", _positions, [(2, 3)], "line, col")
QUERIES["qry_show"] = lambda s, d: (register(s, d), session.query(s, "SHOW TABLES").df.filter("isTemporary").select(F.col("tableName").alias("name")).filter(F.col("name").isin(*TABLES)))[1]
ORACLES["qry_show"] = _sql_rows([(t,) for t in TABLES], "name")


def _diagnosed(sql: str, *fields: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir)
        f = facts(spark)
        d = check.check(spark, sql, candidates.column_names(collect.columns(f)), candidates.table_names(collect.tables(f), collect.views(f)))
        values = {**d.as_dict(), "result_types": ",".join(d.result_types) if d.result_types is not None else None, "first": d.candidates[0]["name"] if d.candidates else None, "hinted": d.suggestion is not None}
        return spark.createDataFrame([tuple(values[x] for x in fields)], ", ".join(f"{x} {'int' if x == 'exit_code' else 'boolean' if x == 'hinted' else 'string'}" for x in fields))

    return run


_fixed("chk_prepare", _diagnosed("INSERT INTO nation SELECT * FROM nation", "exit_code", "result_types"), [(0, None)], "exit_code, result_types")
_fixed("chk_snapshot", _diagnosed("SELECT n_name, count(*) AS n FROM nation GROUP BY n_name", "exit_code", "result_types"), [(0, "string,bigint")], "exit_code, result_types")
_fixed("chk_sqlstate", _diagnosed("SELECT n_name FROM nation GROUP BY n_regionkey", "exit_code", "sqlstate"), [(4, "42803")], "exit_code, sqlstate")
_fixed("chk_hint", _diagnosed("SELECT n_nam FROM nation", "sqlstate", "hinted"), [("42703", True)], "sqlstate, hinted")
_fixed("chk_suggests_column", _diagnosed("SELECT emial FROM nation", "sqlstate", "first"), [("42703", "shop.users.email")], "sqlstate, first")
_fixed("chk_suggests_table", _diagnosed("SELECT 1 FROM userz", "sqlstate", "first"), [("42P01", "shop.users")], "sqlstate, first")
_fixed("chk_empty_snapshot", _diagnosed("SELECT 1", "exit_code", "sqlstate"), [(0, None)], "exit_code, sqlstate")
_fixed("chk_version", lambda s, d: _rows(s, [(v, entry.version_ok(v)) for v in ("3.4.1", "3.5.0", "4.1.2")], "v string, ok boolean"), [("3.4.1", False), ("3.5.0", True), ("4.1.2", True)], "v, ok")
_fixed("src_sql", lambda s, d: _rows(s, [(guard.evaluate(" SELECT 1 ; ").sql,)], "sql string"), [("SELECT 1",)], "sql")
_fixed("src_config", lambda s, d: _rows(s, sorted(documents.settings("PGPORT=6\n# note\nPGPORT=7\nNOPE=1").items()), "k string, v string"), [("LOCAL_PORT", "15432"), ("PGPORT", "7"), ("RO_DEFAULT_LIMIT", "200"), ("SSH_PORT", "22")], "k, v")
_fixed("src_confirmed", lambda s, d: documents.confirmed(s, "# by hand\n- source: a.b.c\n  target: d.e.f\n- source: a.b.c\n  target: d.e.f\n- source: x.y\n  target: d.e.f\n- source: g.h.i\n  target: d.e.f\n  ignore: true\n")[0], [("a.b.c", "d.e.f", False), ("g.h.i", "d.e.f", True)], "source, target, ignored")
_fixed("src_csv_stream", lambda s, d: _rows(s, [sinks.cut_csv('a\n"x\ny"\n', 5)[1:]], "n int, truncated boolean"), [(1, False)], "n, truncated")
_fixed("snk_csv", lambda s, d: _rows(s, [(sinks.csv_text(["a", "b"], [(1, None), (2, "")]),)], "text string"), [('a,b\n1,\n2,""\n',)], "text")
_fixed("snk_text", lambda s, d: _rows(s, [sinks.cut_lines("plan\nmore\n", 1)], "text string, n int, truncated boolean"), [("plan\n", 1, True)], "text, n, truncated")
_fixed("snk_preview", lambda s, d: _rows(s, [(sinks.preview("f.csv", "h\n1\n", True),)], "text string"), [("f.csv\nh\n1\n… (truncated, see .meta)\n",)], "text")
_fixed("snk_diag", lambda s, d: _rows(s, [(entry.told(check.Diagnosis(4, "42703", "no column", position={"line": 2, "column": 3}, candidates=[{"name": "a.b", "similarity": 0.8}])),)], "text string"), [("42703: no column\nat line 2, column 3\nclose: a.b (0.8)",)], "text")
_fixed("snk_object_file", lambda s, d: _rows(s, [(sinks.merged(sinks.merged(None, "-- h\n", {"a": "1\n"}) + "-- mine\n", "-- h\n", {"a": "2\n", "b": "3\n"}),)], "text string"), [("-- h\n" + sinks.block("a", "2\n") + "-- mine\n" + sinks.block("b", "3\n"),)], "text")
_fixed("snk_orphan", lambda s, d: _rows(s, [(sinks.notes("-- h\n" + sinks.block("a", "1\n") + "-- mine\n", "-- h\n"), sinks.notes("-- h\n" + sinks.block("a", "1\n"), "-- h\n"))], "kept string, none string"), [("-- mine", "")], "kept, none")


# --- Orders and intervals over events of which one user has a third, and over all orders ---------------------------
HOUR = 3_600_000_000
_events = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("user_id", F.expr("IF(event_id % 3 = 0, 1, user_id)"))
_EVENTS = "WITH e AS (SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS user_id) FROM events) "


def _interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    later = events.select("user_id", F.col("event_id").alias("b"), F.col("ts").alias("then"))
    return ordered.counts_within(events.select("user_id", F.col("event_id").alias("a"), "ts"), later, ["user_id"], "ts", "then", HOUR, ["a"], "b")


def _as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    bought = events.filter("event_type = 'purchase'").select("user_id", "event_id", "ts", "value")
    found = ordered.as_of(events.filter("event_type = 'view'").select("user_id", "event_id", "ts"), bought, ["user_id"], "ts", "ts", "event_id", parts=16)
    return found.select("event_id", F.col("_met.event_id").alias("bought"), F.col("_met.value").alias("value"))


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return ordered.running(orders, ["o_orderdate", "o_orderkey"], {"so_far": "cents"}, tiles=7).select("o_orderkey", "row_number", "so_far", "ntile")


QUERIES["del_interval_hot"] = _interval
ORACLES["del_interval_hot"] = _EVENTS + "SELECT a.event_id AS a, count(b.event_id) AS n FROM e a JOIN e b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL '1' HOUR GROUP BY a.event_id"
QUERIES["del_asof_hot"] = _as_of
ORACLES["del_asof_hot"] = _EVENTS + """, p AS (SELECT user_id, ts, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM e WHERE event_type = 'purchase' GROUP BY user_id, ts)
SELECT v.event_id, p.event_id AS bought, p.value FROM (SELECT * FROM e WHERE event_type = 'view') v ASOF LEFT JOIN p ON v.user_id = p.user_id AND v.ts >= p.ts"""
QUERIES["del_window_whole"] = _whole
ORACLES["del_window_whole"] = "SELECT o_orderkey, row_number() OVER w AS row_number, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER w AS BIGINT) AS so_far, ntile(7) OVER w AS ntile FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey)"
QUERIES["del_rank_whole"] = lambda s, d: ordered.running(s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey"), ["o_custkey"]).select("o_orderkey", "rank", "dense_rank")
ORACLES["del_rank_whole"] = "SELECT o_orderkey, rank() OVER (ORDER BY o_custkey) AS rank, dense_rank() OVER (ORDER BY o_custkey) AS dense_rank FROM orders"
QUERIES["del_groups_frame"] = lambda s, d: ordered.peer_frames(s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents")), ["o_orderdate"], 30, 2, {"total": "cents"}).select("o_orderkey", "n", "total")
ORACLES["del_groups_frame"] = "SELECT o_orderkey, count(*) OVER w AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER w AS BIGINT) AS total FROM orders WINDOW w AS (ORDER BY o_orderdate GROUPS BETWEEN 30 PRECEDING AND 2 FOLLOWING)"

QUERIES["snk_csv_records"] = lambda s, d: results.records(s.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey", "concat(c_name, ',', c_mktsegment) AS named", "nullif(c_mktsegment, 'BUILDING') AS segment", "IF(c_nationkey < 9, '', concat('a \"', c_nationkey, '\"')) AS nation"))
ORACLES["snk_csv_records"] = """SELECT c_custkey || ',"' || c_name || ',' || c_mktsegment || '",' || coalesce(nullif(c_mktsegment, 'BUILDING'), '') || ',' || CASE WHEN c_nationkey < 9 THEN '""' ELSE '"a ""' || c_nationkey || '""' || '"' END AS record FROM customer"""
# A return flag that a third more of the lines have.
QUERIES["del_percentile_hot"] = lambda s, d: ordered.percentiles(s.read.parquet(f"{d}/lineitem.parquet").selectExpr("IF(l_orderkey % 3 = 0, 'N', l_returnflag) AS flag", "l_extendedprice"), ["flag"], "l_extendedprice", [0.1, 0.5, 0.99], parts=32).selectExpr("flag", *[f"round(p{i}, 4) AS p{i}" for i in range(3)])
ORACLES["del_percentile_hot"] = "SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'N' ELSE l_returnflag END AS flag, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.1), 4) AS p0, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.5), 4) AS p1, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.99), 4) AS p2 FROM lineitem GROUP BY 1"



def _generations(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """An object for each order, twice: later some are gone, some are new and some have another body."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    made = lambda body: [F.col("o_orderpriority").alias("schema"), F.lit("order").alias("kind"), F.concat(F.lit("o"), "o_orderkey").alias("name"), F.expr(body).alias("body")]
    body = "concat('customer ', o_custkey, ' status ', o_orderstatus)"
    return [orders.filter("o_orderkey % 10 <> 0").select(*made(body)), orders.filter("o_orderkey % 7 <> 0").select(*made(f"concat({body}, IF(o_orderkey % 5 = 0, ' paid', ''))"))]


def _synced(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    root = passing(spark, f"{shared_folder(spark)}/dictionary-{uuid.uuid4().hex}")
    first, second = _generations(spark, sf_dir)
    objects.sync(first, root)
    return root, objects.sync(second, root)


_GENERATIONS = """WITH made AS (SELECT o_orderkey AS k, o_orderpriority AS schema, 'o' || o_orderkey AS name, 'customer ' || o_custkey || ' status ' || o_orderstatus AS body FROM orders),
a AS (SELECT schema, name, body FROM made WHERE k % 10 <> 0), b AS (SELECT schema, name, body || CASE WHEN k % 5 = 0 THEN ' paid' ELSE '' END AS body FROM made WHERE k % 7 <> 0) """
QUERIES["snk_object_sync"] = lambda s, d: _synced(s, d)[1].drop("kind")
ORACLES["snk_object_sync"] = _GENERATIONS + """SELECT schema, name, sha256(coalesce(b.body, a.body)) AS sha256, CASE WHEN b.body IS NOT NULL AND a.body = b.body THEN 1 ELSE 2 END AS held_by,
CASE WHEN b.name IS NULL THEN 'deleted' WHEN a.name IS NULL THEN 'new' WHEN a.body <> b.body THEN 'changed' ELSE 'unchanged' END AS action FROM a FULL JOIN b USING (schema, name)"""
QUERIES["snk_object_read"] = lambda s, d: objects.read(s, _synced(s, d)[0]).drop("kind")
ORACLES["snk_object_read"] = _GENERATIONS + "SELECT * FROM b"

#: Statements with parameters over the given tables, the exit code of their check, and the parameters' types.
PARAMETERS = [
    ("SELECT * FROM nation WHERE n_nationkey = ?", 0, "int"), ("SELECT * FROM nation WHERE n_name = :name", 0, "string"), ("SELECT * FROM orders WHERE o_orderdate >= :since", 0, "timestamp_ntz"), ("SELECT * FROM customer WHERE c_acctbal BETWEEN ? AND ?", 0, "double,double"),
    ("SELECT * FROM nation WHERE n_nationkey IN (?, 3, :k)", 0, "int,int"), ("SELECT substring(n_name, ?, ?) AS s FROM nation", 0, "int,int"), ("SELECT upper(:t) AS u FROM region", 0, "string"), ("SELECT n_name FROM nation WHERE n_name LIKE ? LIMIT ?", 0, "string,int"),
    ("SELECT c_acctbal * :rate AS x FROM customer", 0, "double"), ("SELECT * FROM nation WHERE n_nationkey = :a AND :a = :b", 0, "int,int"), ("SELECT CASE WHEN ? THEN 1 ELSE 2 END AS c FROM region", 0, "boolean"), ("SELECT n_name AS x FROM nation WHERE n_name = '?' -- :no", 0, None),
    ("SELECT ? AS x FROM region", 1, "unknown"), ("SELECT * FROM region WHERE ? IS NULL", 1, "unknown"), ("SELECT * FROM region WHERE :a = :b", 1, "unknown,unknown"), ("SELECT nope FROM nation WHERE n_nationkey = ?", 4, None), ("SELECT * FROM orders JOIN customer ON o_custkey = c_custkey WHERE coalesce(c_mktsegment, ?) = :s", 0, "string,string"),
]


def _parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    found = [check.check(spark, sql, infer=True) for sql, *_ in PARAMETERS]
    return _rows(spark, [(i, d.exit_code, ",".join(d.parameter_types) if d.parameter_types and d.exit_code != check.INVALID else None) for i, d in enumerate(found)], "i int, code int, types string")


_fixed("chk_parameters", _parameters, [(i, code, types) for i, (_, code, types) in enumerate(PARAMETERS)], "i, code, types")
