"""Registered queries of statements as text, of files that the driver writes, and of rules that are broken."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens.functions import text as T
from catalens.operators import collect, ddl, dictionary, validate
from catalens.operators.queries import _CONSTRAINTS, _OPTIONS, _cat, _p
from catalens.plans import entry, queries as statements
from catalens.sources import documents, sinks
from catalens.sources.fixture import facts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Callable[[SparkSession, str], DataFrame], oracle: str) -> None:
    QUERIES[name], ORACLES[name] = query, oracle


def _values(names: str, *rows: tuple) -> str:
    quote = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + f") AS t({names})"


# --- Statements as text, told again for DuckDB -------------------------------
_WORDS = "', '".join(T.QUOTED_WORDS)
_LABELS = " ".join(f"WHEN n < {m} THEN '{x}'" for m, x in T.ROW_LABELS) + f" ELSE '{T.ROW_LABEL_ABOVE}'"
_WRAPPED = "array_to_string(list_transform({}, lambda o: split_part(o, '=', 1) || ' ' || chr(39) || replace(substr(o, strpos(o, '=') + 1), chr(39), chr(39) || chr(39)) || chr(39)), ', ')"


def _q(name: str) -> str:
    return f"""CASE WHEN regexp_full_match({name}, '[a-z_][a-z0-9_]*') AND {name} NOT IN ('{_WORDS}') THEN {name} ELSE '"' || replace({name}, '"', '""') || '"' END"""


def _said(kind: str, target: str, comment: str) -> str:
    return f"CASE WHEN trim(coalesce({comment}, '')) <> '' THEN 'COMMENT ON {kind} ' || {target} || ' IS ' || chr(39) || replace(trim({comment}), chr(39), chr(39) || chr(39)) || chr(39) || ';' END"


_TRIGGERS = r"""
trg AS (SELECT t.schema, t.name AS "table", g.tgname AS name, g.definition, g.tgenabled AS enabled, split_part(split_part(split_part(g.definition, ' EXECUTE ', 2), '(', 1), ' ', 2) AS raw FROM pg_trigger g JOIN tabs t ON t.oid = g.tgrelid WHERE NOT tgisinternal),
called AS (SELECT *, CASE WHEN contains(raw, '.') THEN split_part(raw, '.', 1) ELSE schema END AS fs, split_part(raw, '.', -1) AS fn FROM trg),
trl AS (SELECT schema, "table", string_agg('-- calls ' || CASE WHEN (fs, fn) NOT IN (SELECT (schema, name) FROM fns) THEN raw WHEN fs = schema THEN '../functions/' || fn || '.sql' ELSE '../../' || fs || '/functions/' || fn || '.sql' END || chr(10) || definition || ';'
  || CASE enabled WHEN 'D' THEN chr(10) || 'ALTER TABLE ' || schema || '.' || "table" || ' DISABLE TRIGGER ' || name || ';' WHEN 'A' THEN chr(10) || 'ALTER TABLE ' || schema || '.' || "table" || ' ENABLE ALWAYS TRIGGER ' || name || ';'
    WHEN 'R' THEN chr(10) || 'ALTER TABLE ' || schema || '.' || "table" || ' ENABLE REPLICA TRIGGER ' || name || ';' ELSE '' END, chr(10) ORDER BY name) AS triggers FROM called GROUP BY schema, "table")"""
add("ddl_trigger_state", _p(lambda p: ddl.trigger_lines(p["triggers"], p["functions"])), _cat(f', {_TRIGGERS} SELECT schema, "table", triggers FROM trl'))

_TABLE = rf""", {_TRIGGERS},
seq AS (SELECT schema, "table", string_agg('CREATE SEQUENCE IF NOT EXISTS ' || s || ';', chr(10) ORDER BY position) AS lines FROM (SELECT schema, "table", position, CASE WHEN contains(r, '.') THEN r ELSE schema || '.' || r END AS s FROM (SELECT *, regexp_extract("default", 'nextval\(''([^'']+)''', 1) AS r FROM cols WHERE "default" LIKE 'nextval(%')) GROUP BY ALL),
body AS (SELECT schema, "table", string_agg('  ' || concat_ws(' ', {_q("name")}, type, CASE WHEN len(fdw_options) > 0 THEN 'OPTIONS (' || {_WRAPPED.format("fdw_options")} || ')' END, 'DEFAULT ' || nullif("default", ''), CASE WHEN NOT nullable THEN 'NOT NULL' END), ',' || chr(10) ORDER BY position) AS lines FROM cols GROUP BY ALL),
con AS ({_CONSTRAINTS}),
idx AS (SELECT t.schema, t.name AS "table", string_agg(i.definition || ';' || coalesce(chr(10) || 'ALTER INDEX ' || t.schema || '.' || c.relname || ' SET TABLESPACE ' || s.spcname || ';', ''), chr(10) ORDER BY c.relname) AS lines FROM pg_index i JOIN tabs t ON t.oid = i.indrelid JOIN pg_class c ON c.oid = i.indexrelid LEFT JOIN pg_tablespace s ON s.oid = c.reltablespace
  WHERE i.indisvalid AND c.oid NOT IN (SELECT inhrelid FROM pg_inherits) AND (t.oid, c.relname) NOT IN (SELECT (conrelid, conname) FROM pg_constraint WHERE contype IN ('p', 'u', 'x')) GROUP BY ALL),
com AS (SELECT schema, "table", string_agg(line, chr(10) ORDER BY position) AS lines FROM (SELECT schema, "table", position, {_said("COLUMN", '''schema || '.' || "table" || '.' || name''', "comment")} AS line FROM cols) WHERE line IS NOT NULL GROUP BY ALL),
kid AS (SELECT t.oid, t.schema, t.name, t.partition_of FROM tabs t WHERE t.partition_of IS NOT NULL AND (t.schema, t.name) NOT IN (SELECT (schema, name) FROM top)),
fact AS (SELECT k.oid, 0 AS o, '--   index ' || c.relname || ': ' || i.definition AS d FROM kid k JOIN pg_index i ON i.indrelid = k.oid AND i.indisvalid JOIN pg_class c ON c.oid = i.indexrelid WHERE c.oid NOT IN (SELECT inhrelid FROM pg_inherits)
  UNION ALL SELECT k.oid, 1, '--   constraint ' || conname || ': ' || definition FROM kid k JOIN pg_constraint ON conrelid = k.oid WHERE contype <> 'n' AND conislocal AND coninhcount = 0
  UNION ALL SELECT k.oid, 2, '--   options ' || array_to_string(t.options, ', ') FROM kid k JOIN tabs t USING (oid) WHERE len(t.options) > 0 UNION ALL SELECT k.oid, 2, '--   tablespace ' || t.tablespace FROM kid k JOIN tabs t USING (oid) WHERE t.tablespace IS NOT NULL),
kids AS (SELECT schema, partition_of AS "table", '-- partitions (' || count(*) || '): ' || string_agg(name, ', ' ORDER BY name) || coalesce(chr(10) || string_agg('-- ' || name || chr(10) || own, chr(10) ORDER BY name), '') AS lines FROM (SELECT k.*, (SELECT string_agg(d, chr(10) ORDER BY o, d) FROM fact WHERE fact.oid = k.oid) AS own FROM kid k) GROUP BY ALL),
whole AS (SELECT t.schema, t.name, concat_ws(chr(10) || chr(10),
    concat_ws(chr(10), CASE WHEN t.partition_of IS NOT NULL THEN '-- partition of ' || t.partition_of || ', which is no top-level table of this schema' END, '-- rows, by order of magnitude: ' || (SELECT CASE {_LABELS} END FROM (SELECT t.reltuples AS n)) || CASE kind WHEN 'partitioned_table' THEN ' (without partitions)' ELSE '' END),
    CASE WHEN kind <> 'foreign_table' THEN seq.lines END,
    CASE kind WHEN 'foreign_table' THEN 'CREATE FOREIGN TABLE ' ELSE 'CREATE TABLE ' END || t.schema || '.' || t.name || ' (' || chr(10) || coalesce(body.lines, '') || chr(10) || ')' || CASE kind WHEN 'foreign_table' THEN ' SERVER ' || server || CASE WHEN len(foreign_options) > 0 THEN ' OPTIONS (' || {_WRAPPED.format("foreign_options")} || ')' ELSE '' END
      ELSE coalesce(' PARTITION BY ' || partition_key, '') || CASE WHEN coalesce(access_method, 'heap') <> 'heap' THEN ' USING ' || access_method ELSE '' END || CASE WHEN len(options) > 0 THEN ' WITH (' || {_OPTIONS.format("options")} || ')' ELSE '' END || coalesce(' TABLESPACE ' || tablespace, '') END || ';',
    con.constraints, idx.lines, trl.triggers, concat_ws(chr(10), {_said("TABLE", "t.schema || '.' || t.name", "t.comment")}, com.lines), kids.lines) AS text
  FROM top t LEFT JOIN seq ON seq.schema = t.schema AND seq."table" = t.name LEFT JOIN body ON body.schema = t.schema AND body."table" = t.name LEFT JOIN con ON con.schema = t.schema AND con."table" = t.name LEFT JOIN idx ON idx.schema = t.schema AND idx."table" = t.name
    LEFT JOIN trl ON trl.schema = t.schema AND trl."table" = t.name LEFT JOIN com ON com.schema = t.schema AND com."table" = t.name LEFT JOIN kids ON kids.schema = t.schema AND kids."table" = t.name)
SELECT schema, name, regexp_replace(text, '\n{{3,}}', chr(10) || chr(10), 'g') || chr(10) AS ddl FROM whole"""
add("ddl_table", _p(ddl.table_ddl), _cat(_TABLE))
add("ddl_view", _p(lambda p: ddl.view_ddl(p["views"], p["view_columns"], p["view_indexes"])), _cat(rf""",
own AS (SELECT r.oid, r.schema, r.relname AS name, relkind = 'm' AS mat, r.description AS comment, r.viewdef, r.relispopulated AS filled, ts.spcname AS space, list_sort(list_concat(coalesce(r.reloptions, []), coalesce((SELECT list_transform(t.reloptions, lambda x: 'toast.' || x) FROM pg_class t WHERE t.oid = r.reltoastrelid), []))) AS options,
    CASE relkind WHEN 'm' THEN 'MATERIALIZED VIEW' ELSE 'VIEW' END AS kind FROM rel r LEFT JOIN pg_tablespace ts ON ts.oid = r.reltablespace WHERE relkind IN ('v', 'm')),
notes AS (SELECT attrelid AS oid, string_agg(line, chr(10) ORDER BY attnum) AS lines FROM (SELECT attrelid, attnum, {_said("COLUMN", "o.schema || '.' || o.name || '.' || attname", "description")} AS line FROM pg_attribute JOIN own o ON o.oid = attrelid WHERE attnum > 0 AND NOT attisdropped) WHERE line IS NOT NULL GROUP BY attrelid),
shown AS (SELECT o.*, concat_ws(chr(10), {_said("' || kind || '", "o.schema || '.' || o.name", "o.comment")}, notes.lines) AS said, (SELECT string_agg(i.definition || ';' || coalesce(chr(10) || 'ALTER INDEX ' || o.schema || '.' || c.relname || ' SET TABLESPACE ' || s.spcname || ';', ''), chr(10) ORDER BY c.relname) FROM pg_index i JOIN pg_class c ON c.oid = i.indexrelid LEFT JOIN pg_tablespace s ON s.oid = c.reltablespace WHERE i.indrelid = o.oid AND i.indisvalid) AS built
  FROM own o LEFT JOIN notes USING (oid))
SELECT schema, name, concat_ws(chr(10), 'CREATE ' || kind || ' ' || schema || '.' || name || CASE WHEN len(options) > 0 THEN ' WITH (' || {_OPTIONS.format("options")} || ')' ELSE '' END || CASE WHEN mat THEN coalesce(' TABLESPACE ' || space, '') ELSE '' END || ' AS',
  CASE WHEN mat AND NOT filled THEN rtrim(viewdef, ';') || chr(10) || 'WITH NO DATA;' ELSE viewdef END, CASE WHEN mat THEN built END) || CASE WHEN said <> '' THEN chr(10) || chr(10) || said ELSE '' END || chr(10) AS ddl FROM shown"""))
add("ddl_function", _p(lambda p: ddl.function_ddl(p["functions"], p["triggers"])), _cat(rf""", {_TRIGGERS},
used AS (SELECT f.schema, f.name, f.identity_args, string_agg(DISTINCT '-- ' || c.definition, chr(10) ORDER BY '-- ' || c.definition) AS lines FROM called c JOIN fns f ON f.schema = c.fs AND f.name = c.fn AND (f.identity_args = '' OR NOT EXISTS (SELECT 1 FROM fns z WHERE z.schema = f.schema AND z.name = f.name AND z.identity_args = '')) GROUP BY ALL)
SELECT f.schema, f.name, f.identity_args, concat_ws(chr(10) || chr(10), rtrim(f.definition, chr(10)) || ';', {_said("FUNCTION", "f.schema || '.' || f.name || '(' || f.identity_args || ')'", "f.comment")}, '-- called by triggers:' || chr(10) || coalesce(u.lines, '-- (none)')) || chr(10) AS ddl
FROM fns f LEFT JOIN used u ON u.schema = f.schema AND u.name = f.name AND u.identity_args = f.identity_args"""))


# --- Files that the driver writes ----------------------------------------------
def document_text(spark: SparkSession) -> str:
    return collect.document(facts(spark)).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0]


def _in_folder(make: Callable[[SparkSession, str, Path], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Rows of what ``make`` did in a folder of its own; they are collected before the folder goes."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with tempfile.TemporaryDirectory() as folder:
            made = make(spark, sf_dir, Path(folder))
            return spark.createDataFrame(made.collect(), made.schema)

    return run


def _run(spark: SparkSession, sf_dir: str, folder: Path) -> DataFrame:
    """Every file of a dictionary, and whether a second run would write it."""
    text = document_text(spark)
    dictionary.run(spark, text, str(folder))
    again = set(dictionary.run(spark, text, str(folder))["written"])
    return spark.createDataFrame([(str(p.relative_to(folder)), str(p) in again) for p in sorted(folder.rglob("*")) if p.is_file()], "path string, again boolean")


_FILES = "SELECT schema || '/tables/' || name || '.sql' AS path FROM top UNION ALL SELECT schema || '/views/' || name || '.sql' FROM vws UNION ALL SELECT DISTINCT schema || '/functions/' || name || '.sql' FROM fns"
add("run", _in_folder(_run), _cat(f"""SELECT path, false AS again FROM ({_FILES} UNION ALL SELECT DISTINCT schema || '/' || f FROM tabs, (VALUES ('README.md'), ('_collect.json')) AS x(f) UNION ALL SELECT * FROM (VALUES ('README.md'), ('_candidates.yaml'), ('_pending.sql'), ('_relations.md'), ('_gaps.md')))"""))


def _whole(spark: SparkSession, sf_dir: str, folder: Path) -> DataFrame:
    """Files that are written whole, as text."""
    dictionary.run(spark, document_text(spark), str(folder), "- source: shop.order_items.order_id\n  target: shop.orders.id\n")
    return spark.createDataFrame([(n, (folder / n).read_text()) for n in ("_gaps.md", "_pending.sql", "README.md")], "path string, text string")


_MISSING = r"""SELECT 'table' AS kind, schema || '.' || name AS name FROM top WHERE trim(coalesce(comment, '')) = '' UNION SELECT 'column', schema || '.' || "table" || '.' || name FROM tcols WHERE trim(coalesce(comment, '')) = '' UNION
SELECT 'function', schema || '.' || name || '(' || identity_args || ')' FROM fns WHERE trim(coalesce(comment, '')) = '' UNION SELECT 'sensitive', schema || '.' || "table" || '.' || name FROM tcols WHERE regexp_matches(name, 'password|passwd|pwd|token|secret|mobile|phone|email|id_card|idcard', 'i') AND NOT coalesce(regexp_matches(comment, '脱敏|密文|哈希|加密|hash|encrypt', 'i'), false)"""
add("snk_whole_file", _in_folder(_whole), _cat(f"""SELECT '_gaps.md' AS path, '# Gaps' || chr(10) || chr(10) || string_agg('- ' || kind || ': ' || name || chr(10), '' ORDER BY kind, name) AS text FROM ({_MISSING})
UNION ALL SELECT '_pending.sql', 'COMMENT ON COLUMN shop.order_items.order_id IS ''逻辑关联 shop.orders.id'';' || chr(10)
UNION ALL SELECT 'README.md', '# Schemas' || chr(10) || chr(10) || '| schema | tables | views | functions |' || chr(10) || '|-|-|-|-|' || chr(10) || string_agg('| ' || schema || ' | ' || t || ' | ' || v || ' | ' || f || ' |' || chr(10), '' ORDER BY schema)
FROM (SELECT s.schema, (SELECT count(*) FROM top t WHERE t.schema = s.schema) AS t, (SELECT count(*) FROM vws v WHERE v.schema = s.schema) AS v, (SELECT count(DISTINCT name) FROM fns f WHERE f.schema = s.schema) AS f FROM (SELECT DISTINCT schema FROM tabs) s)"""))


def _object_dir(spark: SparkSession, sf_dir: str, folder: Path) -> DataFrame:
    """What syncing a folder does: to a new file, an equal one, one whose object is gone, and one that holds a note."""
    step = lambda objects: {k: [Path(p).stem for p in v] for k, v in sinks.sync_folder(folder, "s", "table", objects).items()}
    done = [step({"a": {"t": "1\n"}, "b": {"t": "2\n"}, "c": {"t": "3\n"}})]
    noted = folder / "s/tables/c.sql"
    noted.write_text(noted.read_text() + "-- mine\n")
    done += [step({"a": {"t": "1\n"}, "b": {"t": "9\n"}}), step({"a": {"t": "1\n"}, "b": {"t": "9\n"}, "c": {"t": "3\n"}})]
    rows = [(i, state, name) for i, d in enumerate(done) for state, names in d.items() for name in names] + [(3, "kept", "c")] * ("-- mine" in noted.read_text())
    return spark.createDataFrame(rows, "step int, state string, name string")


add("snk_object_dir", _in_folder(_object_dir), _values("step, state, name", (0, "written", "a"), (0, "written", "b"), (0, "written", "c"), (1, "unchanged", "a"), (1, "written", "b"), (1, "unchanged", "c"), (2, "unchanged", "a"), (2, "unchanged", "b"), (2, "written", "c"), (3, "kept", "c")))


def _collapse(spark: SparkSession, sf_dir: str, folder: Path) -> DataFrame:
    """What is left of a schema that is gone: the file with a note only."""
    dictionary.run(spark, document_text(spark), str(folder))
    noted = folder / "shop_ext/tables/widgets.sql"
    noted.write_text(noted.read_text() + "-- mine\n")
    for schema in ("shop", "shop_ext"):
        sinks.collapse(folder, schema)
    left = [(str(p.relative_to(folder)), "CREATE" in p.read_text()) for p in sorted(folder.glob("*/**/*")) if p.is_file()]
    return spark.createDataFrame([*left, ("shop", (folder / "shop").exists())], "path string, has boolean")


add("snk_schema_collapse", _in_folder(_collapse), _values("path, has", ("shop_ext/tables/widgets.sql", False), ("shop", False)))


def _names(spark: SparkSession, sf_dir: str, folder: Path) -> DataFrame:
    dictionary.run(spark, document_text(spark), str(folder))
    return documents.names_from_files(spark, str(folder))


# The files of foreign tables tell no columns, as their statement is another one.
add("src_dict_files", _in_folder(_names), _cat("""SELECT t.schema, t.name AS "table", c.name AS "column" FROM top t LEFT JOIN cols c ON c.schema = t.schema AND c."table" = t.name AND t.kind <> 'foreign_table' UNION ALL SELECT schema, name, NULL FROM vws"""))


def _document(spark: SparkSession, sf_dir: str, folder: Path) -> DataFrame:
    """Columns that a document tells when it was written to a file and read again."""
    path = folder / "collected.json"
    size = sinks.document(path, document_text(spark))
    parts = documents.parts(documents.parse(spark, path.read_text()))
    return parts["columns"].groupBy("schema", "table").agg(F.count("*").alias("n")).withColumn("whole", F.lit(size == path.stat().st_size and not list(folder.glob("tmp*"))))


add("snk_document", _in_folder(_document), _cat('SELECT schema, "table", count(*) AS n, true AS whole FROM cols GROUP BY ALL'))


def _claimed(spark: SparkSession, sf_dir: str, folder: Path) -> DataFrame:
    """Names of three results of one statement in one second, without their time."""
    from datetime import UTC, datetime

    now = datetime(2026, 1, 2, 3, 4, 5, tzinfo=UTC)
    return spark.createDataFrame([(sinks.claim(folder, "SELECT 1", "csv", now).name,) for _ in range(3)], "name string")


add("snk_result_name", _in_folder(_claimed), "SELECT '20260102T030405Z-' || left(sha256('SELECT 1'), 8) || x || '.csv' AS name FROM (VALUES (''), ('-2'), ('-3')) AS t(x)")


def _entry(spark: SparkSession, sf_dir: str, folder: Path) -> DataFrame:
    """Exit codes, what was written and what was told, for each kind of statement."""
    statements.register(spark, sf_dir)
    (folder / "dictionary/shop").mkdir(parents=True)
    cases = [("SELECT n_name FROM nation ORDER BY n_nationkey", 3, "dictionary"), ("SELECT n_name FROM nation ORDER BY n_nationkey", 3, "none"), ("DROP TABLE nation", 3, "dictionary"), ("SELECT nope FROM nation", 3, "dictionary"), ("SELECT * FROM secret", 3, "dictionary"), ("SHOW TABLES", 3, "dictionary")]
    rows = []
    for i, (sql, limit, root) in enumerate(cases):
        out = entry.run_query(spark, sql, str(folder / root), str(folder / "out"), limit, relations=statements.TABLES)
        rows.append((i, out.exit_code, Path(out.path).suffix if out.path else None, Path(out.path).read_text() if out.path and out.path.endswith("csv") else None, "truncated: true" in (out.meta or "")))
    return spark.createDataFrame(rows, "i int, code int, suffix string, text string, cut boolean")


add("qry_entry", _in_folder(_entry), "SELECT 0 AS i, 0 AS code, '.csv' AS suffix, 'n_name' || chr(10) || string_agg(n_name || chr(10), '' ORDER BY n_nationkey) AS text, true AS cut FROM nation WHERE n_nationkey < 3 UNION ALL VALUES (1, 2, NULL, NULL, false), (2, 3, NULL, NULL, false), (3, 1, NULL, NULL, false), (4, 3, NULL, NULL, false), (5, 0, '.txt', NULL, false)")


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a plan tells: the scan, its columns and the filter that it is given."""
    statements.register(spark, sf_dir)
    plan = statements.session.query(spark, "EXPLAIN SELECT n_name FROM nation WHERE n_regionkey = 2").df
    has = lambda *words: F.max(F.array_min(F.array(*[F.contains("plan", F.lit(w)) for w in words])))
    return plan.agg(has("FileScan parquet", "nation.parquet").alias("scanned"), has("EqualTo(n_regionkey,2)").alias("pushed"), has("ReadSchema: struct<n_name:string,n_regionkey:int>").alias("pruned"))


add("qry_explain", _explained, "SELECT true AS scanned, true AS pushed, true AS pruned")


# --- Rules that are broken --------------------------------------------------------
def broken_document(spark: SparkSession) -> str:
    """The fixture's document with one thing wrong for each rule."""
    doc = json.loads(document_text(spark))
    shop = next(s for s in doc["schemas"] if s["schema"] == "shop")
    table = {t["name"]: t for t in shop["tables"]}
    table["users"]["name"] = ".."
    table["categories"]["comment"] = "x\n--} catalens table:a\ny"
    shop["tables"].append({**table["metrics"], "name": "METRICS", "columns": [], "indexes": [], "constraints": [], "triggers": [], "options": ["a)b=1"]})
    table["payments"]["tablespace"], table["order_items"]["access_method"], table["products"]["kind"] = "", "", "foreign_table"
    remote = next(t for t in shop["tables"] if t["name"] == "remote_items")
    remote["foreign"]["options"] = ["novalue"]
    table["change_notes"]["columns"][0]["type"] = ""
    next(x for x in shop["functions"] if x["name"] == "plain_fn")["definition"] = "  "
    return json.dumps(doc)


add("val_cases", lambda s, d: validate.violations(documents.parts(documents.parse(s, broken_document(s))), ["shop"]), _values(
    "rule, owner, detail", ("identifier", "shop...", "table"), ("case", "shop.metrics", "METRICS, metrics"), ("definition", "shop.plain_fn", "x integer"), ("marker", "shop.categories", "comment"), ("option", "shop.METRICS", "a)b=1"), ("wrapper_option", "shop.remote_items", "novalue"),
    ("access_method", "shop.order_items", "empty"), ("tablespace", "shop.payments", "empty"), ("foreign", "shop.products", "foreign_table"), ("named", "shop.change_notes", "1"), ("scope", "shop_ext", "not requested"),
))


def _refused(spark: SparkSession, sf_dir: str, folder: Path) -> DataFrame:
    """A broken document writes nothing."""
    try:
        dictionary.run(spark, broken_document(spark), str(folder))
        said = None
    except validate.CatalogInvalid as e:
        said = str(e).split(":")[0]
    return spark.createDataFrame([(said, len(list(folder.iterdir())))], "rule string, files int")


add("val_refused", _in_folder(_refused), _values("rule, files", ("access_method", 0)))
