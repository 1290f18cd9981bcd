"""Registered queries over the fixture catalog, and what DuckDB must return for the same facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalens.functions import text as T
from catalens.operators import audit, candidates, collect, ddl, inference, provision, reach, semantics, validate
from catalens.operators.dictionary import parts_of
from catalens.sources import documents, fixture, sinks
from catalens.sources.fixture import facts, with_facts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_FACTS = [n for n in fixture.FACTS if n not in ("roles", "members", "in_scope", "acl", "secdef_functions", "default_acl", "confirmed")]
_AUDIT = ["roles", "members", "in_scope", "acl", "secdef_functions", "default_acl", "pg_class", "pg_namespace", "pg_proc", "pg_foreign_server"]

_CATALOG = r"""
ext AS (SELECT d.classid, d.objid FROM pg_depend d JOIN pg_extension e ON d.refobjid = e.oid WHERE d.refclassid = 'pg_extension' AND d.deptype = 'e'),
rel AS (SELECT c.*, n.nspname AS schema FROM pg_class c JOIN pg_namespace n ON c.relnamespace = n.oid
  WHERE n.nspname NOT IN ('pg_catalog', 'information_schema') AND n.nspname NOT LIKE 'pg\_%' ESCAPE '\' AND NOT EXISTS (SELECT 1 FROM ext WHERE classid = 'pg_class' AND objid = c.oid)),
tabs AS (SELECT r.oid, r.schema, r.relname AS name, CASE relkind WHEN 'r' THEN 'table' WHEN 'p' THEN 'partitioned_table' ELSE 'foreign_table' END AS kind, r.description AS comment,
    CAST(greatest(r.reltuples, 0) AS BIGINT) AS reltuples, am.amname AS access_method, ts.spcname AS tablespace, r.partkey AS partition_key,
    (SELECT p.relname FROM pg_inherits i JOIN pg_class p ON i.inhparent = p.oid WHERE i.inhrelid = r.oid AND r.relispartition) AS partition_of, s.srvname AS server, ft.ftoptions AS foreign_options,
    list_sort(list_concat(coalesce(r.reloptions, []), coalesce((SELECT list_transform(t.reloptions, lambda x: 'toast.' || x) FROM pg_class t WHERE t.oid = r.reltoastrelid), []))) AS options
  FROM rel r LEFT JOIN pg_am am ON am.oid = r.relam LEFT JOIN pg_tablespace ts ON ts.oid = r.reltablespace LEFT JOIN pg_foreign_table ft ON ft.ftrelid = r.oid LEFT JOIN pg_foreign_server s ON s.oid = ft.ftserver
  WHERE relkind IN ('r', 'p', 'f')),
cols AS (SELECT t.schema, t.name AS "table", a.attnum AS position, a.attname AS name, a.atttype AS type, d.expr AS "default", NOT a.attnotnull AS nullable, a.description AS comment, a.attfdwoptions AS fdw_options
  FROM pg_attribute a JOIN tabs t ON a.attrelid = t.oid LEFT JOIN pg_attrdef d ON d.adrelid = a.attrelid AND d.adnum = a.attnum WHERE a.attnum > 0 AND NOT a.attisdropped),
vws AS (SELECT r.schema, r.relname AS name, CASE relkind WHEN 'v' THEN 'view' ELSE 'materialized_view' END AS kind, r.description AS comment, r.viewdef AS definition, r.relispopulated AS populated FROM rel r WHERE relkind IN ('v', 'm')),
fns AS (SELECT n.nspname AS schema, p.proname AS name, p.identity_args, p.result_type, l.lanname AS language, p.description AS comment, p.definition FROM pg_proc p JOIN pg_namespace n ON p.pronamespace = n.oid JOIN pg_language l ON l.oid = p.prolang
  WHERE p.prokind = 'f' AND n.nspname NOT LIKE 'pg\_%' ESCAPE '\' AND NOT EXISTS (SELECT 1 FROM ext WHERE classid = 'pg_proc' AND objid = p.oid)),
top AS (SELECT * FROM tabs WHERE partition_of IS NULL OR (schema, partition_of) NOT IN (SELECT (schema, name) FROM tabs WHERE partition_of IS NULL)),
tcols AS (SELECT c.* FROM cols c JOIN top t ON t.schema = c.schema AND t.name = c."table"),
ann AS (SELECT DISTINCT schema || '.' || "table" || '.' || name AS source, unnest(regexp_extract_all(comment, '逻辑关联\s+([A-Za-z0-9_]+\.[A-Za-z0-9_]+\.[A-Za-z0-9_]+)', 1)) AS target FROM tcols),
stems AS (SELECT schema || '.' || "table" || '.' || name AS source, name AS col, left(name, length(name) - 3) AS stem FROM tcols WHERE name LIKE '%\_id' ESCAPE '\' AND length(name) > 3),
hits AS (SELECT s.*, t.schema AS ts, t.name AS tn FROM stems s JOIN top t ON t.name = s.stem UNION ALL
  SELECT s.*, t.schema, t.name FROM stems s JOIN top t ON t.name = s.stem || 's' WHERE NOT EXISTS (SELECT 1 FROM top x WHERE x.name = s.stem)),
byname AS (SELECT source, target FROM (SELECT h.source, h.ts || '.' || h.tn || '.' || CASE WHEN bool_or(c.name = 'id') THEN 'id' ELSE h.col END AS target FROM hits h JOIN tcols c ON c.schema = h.ts AND c."table" = h.tn AND c.name IN ('id', h.col) GROUP BY h.source, h.ts, h.tn, h.col) WHERE source <> target),
said AS (SELECT schema || '.' || "table" || '.' || name AS source, regexp_replace(comment, '逻辑关联\s+([A-Za-z0-9_]+\.[A-Za-z0-9_]+\.[A-Za-z0-9_]+)', '', 'g') AS comment FROM tcols WHERE comment IS NOT NULL),
lone AS (SELECT name, min(schema) AS schema FROM top GROUP BY name HAVING count(DISTINCT schema) = 1),
bycomment AS (SELECT DISTINCT source, target FROM (
  SELECT s.source, t.schema || '.' || t.name || '.id' AS target FROM (SELECT source, unnest(regexp_extract_all(comment, '[a-z_][a-z0-9_]*\.[a-z_][a-z0-9_]*')) AS q FROM said) s JOIN top t ON t.schema || '.' || t.name = s.q UNION ALL
  SELECT s.source, l.schema || '.' || l.name || '.id' FROM (SELECT source, unnest(regexp_extract_all(comment, '[a-z_][a-z0-9_]*')) AS q FROM said) s JOIN lone l ON l.name = s.q) WHERE source <> target)
"""


def _cat(body: str, *more: str) -> str:
    return with_facts("WITH " + _CATALOG + "\n" + body, *_FACTS, *more)


def _f(rows) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rows(facts(spark))


def _p(rows) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rows(parts_of(facts(spark)))


def _fp(rows) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = facts(spark)
        return rows(f, parts_of(f))

    return run


def add(name: str, query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


_join = lambda c: F.array_join(c, ",")
_top = lambda p: semantics.top_level(p["tables"])
_cols = lambda p: semantics.top_columns(p["tables"], p["columns"])

# --- Collection ------------------------------------------------------------
add("col_ext_relations", _f(collect.ext_relations), _cat("SELECT classid, objid FROM ext"))
add("col_schemas", _f(lambda f: collect.schemas(f).select("schema", "comment")), _cat("SELECT n.nspname AS schema, n.description AS comment FROM pg_namespace n WHERE n.nspname IN (SELECT schema FROM rel WHERE relkind IN ('r','p','f','v','m') UNION ALL SELECT schema FROM fns)"))
add("src_scope", _f(lambda f: collect.schemas(f, " shop_ext , ").select("schema")), _cat("SELECT 'shop_ext' AS schema"))
add("col_tables", _f(lambda f: collect.tables(f).select("schema", "name", "kind", "comment", "reltuples", "access_method", "server", "tablespace", "partition_key", "partition_of")),
    _cat("SELECT schema, name, kind, comment, reltuples, access_method, server, tablespace, partition_key, partition_of FROM tabs"))
add("col_columns", _f(lambda f: collect.columns(f).select("schema", "table", "position", "name", "type", "default", "nullable", "comment")), _cat('SELECT schema, "table", position, name, type, "default", nullable, comment FROM cols'))
add("col_indexes", _f(lambda f: collect.indexes(f).select("schema", "table", "name", "definition", "inherited_from", "tablespace", _join("options").alias("options"))), _cat(
    """SELECT t.schema, t.name AS "table", c.relname AS name, i.definition, p.relname AS inherited_from, ts.spcname AS tablespace, array_to_string(coalesce(c.reloptions, []), ',') AS options
    FROM pg_index i JOIN tabs t ON t.oid = i.indrelid JOIN pg_class c ON c.oid = i.indexrelid LEFT JOIN pg_inherits h ON h.inhrelid = c.oid LEFT JOIN pg_class p ON p.oid = h.inhparent LEFT JOIN pg_tablespace ts ON ts.oid = c.reltablespace WHERE i.indisvalid"""))
add("col_constraints", _f(lambda f: collect.constraints(f).select("schema", "table", "name", "type", "definition", "is_local")), _cat(
    """SELECT t.schema, t.name AS "table", conname AS name, contype AS type, definition, conislocal AND coninhcount = 0 AS is_local FROM pg_constraint JOIN tabs t ON t.oid = conrelid WHERE contype <> 'n'"""))
add("col_triggers", _f(lambda f: collect.triggers(f).select("schema", "table", "name", "enabled", "inherited_from")), _cat(
    """SELECT t.schema, t.name AS "table", g.tgname AS name, g.tgenabled AS enabled, p.tgname AS inherited_from FROM pg_trigger g JOIN tabs t ON t.oid = g.tgrelid LEFT JOIN pg_trigger p ON p.oid = g.tgparentid WHERE NOT g.tgisinternal"""))
add("col_options", _f(lambda f: collect.tables(f).select("schema", "name", _join("options").alias("options"))), _cat("SELECT schema, name, array_to_string(options, ',') AS options FROM tabs"))
add("col_foreign", _f(lambda f: collect.foreign(f).select("oid", "server", F.posexplode("foreign_options").alias("at", "option"))), _cat("SELECT oid, server, k - 1 AS \"at\", foreign_options[k] AS option FROM (SELECT *, unnest(range(1, len(foreign_options) + 1)) AS k FROM tabs WHERE server IS NOT NULL)"))
add("col_partition_of", _f(lambda f: collect.partition_of(f)), _cat("SELECT oid, partition_of FROM tabs WHERE partition_of IS NOT NULL"))
add("col_partition_key", _f(lambda f: collect.tables(f).filter("partition_key IS NOT NULL").select("schema", "name", "partition_key")), _cat("SELECT schema, name, partition_key FROM tabs WHERE partition_key IS NOT NULL"))
add("col_views", _f(lambda f: collect.views(f).select("schema", "name", "kind", "comment", "definition", "populated")), _cat("SELECT schema, name, kind, comment, definition, populated FROM vws"))
add("col_functions", _f(lambda f: collect.functions(f).select("schema", "name", "identity_args", "result_type", "language", "comment")), _cat("SELECT schema, name, identity_args, result_type, language, comment FROM fns"))
add("col_document", _f(lambda f: collect.document(f).select("collect_version", "database", F.explode("schemas").alias("s")).select("collect_version", "database", "s.schema", F.size("s.tables").alias("n_tables"), F.size("s.views").alias("n_views"), F.size("s.functions").alias("n_functions"), F.aggregate("s.tables", F.lit(0), lambda a, t: a + F.size(t["columns"])).alias("n_columns"))),
    _cat("SELECT 1 AS collect_version, 'app' AS database, s.schema, (SELECT count(*) FROM tabs t WHERE t.schema = s.schema) AS n_tables, (SELECT count(*) FROM vws v WHERE v.schema = s.schema) AS n_views, (SELECT count(*) FROM fns f WHERE f.schema = s.schema) AS n_functions, (SELECT count(*) FROM cols c WHERE c.schema = s.schema) AS n_columns FROM (SELECT DISTINCT schema FROM tabs) s"))
add("src_document", lambda spark, d: documents.parts(documents.parse(spark, collect.document(facts(spark)).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0]))["columns"].select("schema", "table", "position", "name", "type", "nullable"),
    _cat('SELECT schema, "table", position, name, type, nullable FROM cols'))
add("snk_slice", lambda spark, d: documents.slices(collect.document(facts(spark))).select("schema", F.contains("json", F.lit("reltuples")).alias("has_rows")), _cat("SELECT DISTINCT schema, false AS has_rows FROM tabs"))
def _catalogued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the business tables as Spark's own catalog tells them."""
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)
    return documents.spark_catalog(spark)["columns"].filter(F.col("table").isin(*names)).select("table", "position", "name")


add("src_catalog", _catalogued, """SELECT table_name AS "table", ordinal_position AS position, column_name AS name FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events')""")


# --- Predicates and projections --------------------------------------------
add("flt_system_schemas", _f(lambda f: f["pg_namespace"].filter(collect.not_system(F.col("nspname"))).select("nspname")), with_facts(r"SELECT nspname FROM pg_namespace WHERE nspname NOT IN ('pg_catalog', 'information_schema') AND nspname NOT LIKE 'pg\_%' ESCAPE '\'", "pg_namespace"))
add("flt_scope", _f(lambda f: f["pg_namespace"].filter(collect.in_scope(F.col("nspname"), "shop, shop_ext")).select("nspname")), with_facts("SELECT nspname FROM pg_namespace WHERE nspname IN ('shop', 'shop_ext')", "pg_namespace"))
add("flt_out_of_scope", _f(lambda f: f["pg_namespace"].filter(~collect.in_scope(F.col("nspname"), "shop")).select("nspname")), with_facts("SELECT nspname FROM pg_namespace WHERE nspname <> ALL(['shop'])", "pg_namespace"))
add("flt_relkind", _f(lambda f: collect.of_kinds(f, collect.TABLE_KINDS).select("relname", "relkind")), with_facts("SELECT relname, relkind FROM pg_class WHERE relkind IN ('r', 'p', 'f')", "pg_class"))
add("flt_live_columns", _f(lambda f: collect.live_columns(f).select("attrelid", "attname")), with_facts("SELECT attrelid, attname FROM pg_attribute WHERE attnum > 0 AND NOT attisdropped", "pg_attribute"))
add("flt_valid_index", _f(lambda f: collect.valid_indexes(f).select("indexrelid")), with_facts("SELECT indexrelid FROM pg_index WHERE indisvalid", "pg_index"))
add("flt_constraint", _f(lambda f: collect.real_constraints(f).select("conname", "conrelid")), with_facts("SELECT conname, conrelid FROM pg_constraint WHERE contype <> 'n'", "pg_constraint"))
add("flt_trigger", _f(lambda f: collect.user_triggers(f).select("tgname")), with_facts("SELECT tgname FROM pg_trigger WHERE NOT tgisinternal", "pg_trigger"))
add("flt_inherit_guard", _f(lambda f: collect.indexes(f).filter("inherited_from IS NOT NULL").select("name", "inherited_from")), with_facts("SELECT c.relname AS name, p.relname AS inherited_from FROM pg_inherits i JOIN pg_class c ON c.oid = i.inhrelid JOIN pg_class p ON p.oid = i.inhparent WHERE c.relkind IN ('i', 'I') AND p.relkind IN ('i', 'I')", "pg_inherits", "pg_class"))
add("flt_top_level", _p(lambda p: _top(p).select("schema", "name")), _cat("SELECT schema, name FROM top"))
add("prj_kind", _f(lambda f: f["pg_class"].select("relname", collect._mapped("relkind", collect.TABLE_KINDS | collect.VIEW_KINDS).alias("kind"))), with_facts("SELECT relname, CASE relkind WHEN 'r' THEN 'table' WHEN 'p' THEN 'partitioned_table' WHEN 'f' THEN 'foreign_table' WHEN 'v' THEN 'view' WHEN 'm' THEN 'materialized_view' END AS kind FROM pg_class", "pg_class"))
add("prj_is_local", _f(lambda f: f["pg_constraint"].select("conname", "conrelid", collect.is_local().alias("is_local"))), with_facts("SELECT conname, conrelid, conislocal AND coninhcount = 0 AS is_local FROM pg_constraint", "pg_constraint"))
add("prj_rowest", _f(lambda f: f["pg_class"].select("relname", collect.row_estimate().alias("n"))), with_facts("SELECT relname, CAST(greatest(reltuples, 0) AS BIGINT) AS n FROM pg_class", "pg_class"))
add("prj_zero_null", _f(lambda f: f["pg_class"].select("relname", collect.zero_is_none("reltablespace").alias("space"))), with_facts("SELECT relname, nullif(reltablespace, 0) AS space FROM pg_class", "pg_class"))
add("prj_strip_stats", _f(lambda f: collect.tables(f).drop("reltuples").select("schema", "name", "kind")), _cat("SELECT schema, name, kind FROM tabs"))

_OPTIONS = "array_to_string(list_transform({}, lambda o: split_part(o, '=', 1) || '=' || chr(39) || split_part(o, '=', 2) || chr(39)), ', ')"
_CONSTRAINTS = f"""SELECT t.schema, t.name AS "table", string_agg('ALTER TABLE ' || t.schema || '.' || t.name || ' ADD CONSTRAINT ' || conname || ' ' || k.definition || ';' || coalesce(chr(10) || 'ALTER INDEX ' || t.schema || '.' || conname || ' SET TABLESPACE ' || spcname || ';', '')
  || CASE WHEN len(c.reloptions) > 0 THEN chr(10) || 'ALTER INDEX ' || t.schema || '.' || conname || ' SET (' || {_OPTIONS.format("c.reloptions")} || ');' ELSE '' END, chr(10) ORDER BY conname) AS constraints
FROM pg_constraint k JOIN tabs t ON t.oid = k.conrelid LEFT JOIN pg_index i ON i.indrelid = t.oid AND contype IN ('p', 'u', 'x') AND i.indisvalid AND i.indexrelid IN (SELECT oid FROM pg_class WHERE relname = conname) LEFT JOIN pg_class c ON c.oid = i.indexrelid LEFT JOIN pg_tablespace ts ON ts.oid = c.reltablespace
WHERE contype <> 'n' GROUP BY t.schema, t.name"""

# --- Joins -----------------------------------------------------------------
add("jn_ext", QUERIES["col_ext_relations"], ORACLES["col_ext_relations"])
add("jn_not_ext", _f(lambda f: collect.own(f, f["pg_class"], "pg_class").select("relname")), with_facts("SELECT relname FROM pg_class c WHERE NOT EXISTS (SELECT 1 FROM pg_depend d JOIN pg_extension e ON e.oid = d.refobjid WHERE d.classid = 'pg_class' AND d.objid = c.oid AND d.deptype = 'e')", "pg_class", "pg_depend", "pg_extension"))
add("jn_schema_has_obj", QUERIES["col_schemas"], ORACLES["col_schemas"])
add("jn_index", _f(lambda f: collect.indexes(f).select("table", "name")), _cat('SELECT t.name AS "table", c.relname AS name FROM pg_index i JOIN pg_class c ON c.oid = i.indexrelid JOIN tabs t ON t.oid = i.indrelid WHERE i.indisvalid'))
add("jn_default", _f(lambda f: collect.columns(f).select("oid", "name", "default")), _cat('SELECT a.attrelid AS oid, a.attname AS name, d.expr AS "default" FROM pg_attribute a JOIN tabs t ON t.oid = a.attrelid LEFT JOIN pg_attrdef d ON d.adrelid = a.attrelid AND d.adnum = a.attnum WHERE a.attnum > 0 AND NOT a.attisdropped'))
add("jn_fdw", _f(lambda f: collect.foreign(f).select("oid", "server")), with_facts("SELECT ftrelid AS oid, srvname AS server FROM pg_foreign_table JOIN pg_foreign_server ON ftserver = oid", "pg_foreign_table", "pg_foreign_server"))
add("jn_lang", _f(lambda f: collect.functions(f).select("schema", "name", "identity_args", "language")), _cat("SELECT schema, name, identity_args, language FROM fns"))
add("jn_parent", _f(lambda f: collect.tables(f).filter("partition_of IS NOT NULL").select("schema", "name", "partition_of")), _cat("SELECT t.schema, t.name, p.relname AS partition_of FROM tabs t JOIN pg_inherits i ON i.inhrelid = t.oid JOIN pg_class p ON p.oid = i.inhparent"))
add("jn_trg_parent", _f(lambda f: collect.triggers(f).select("name", "inherited_from")), _cat("SELECT g.tgname AS name, p.tgname AS inherited_from FROM pg_trigger g LEFT JOIN pg_trigger p ON p.oid = g.tgparentid WHERE NOT g.tgisinternal"))
add("jn_toast", _f(lambda f: collect.options(f).select("oid", F.explode("options").alias("option")).filter("option LIKE 'toast.%'")), with_facts("SELECT c.oid, 'toast.' || unnest(t.reloptions) AS option FROM pg_class c JOIN pg_class t ON t.oid = c.reltoastrelid", "pg_class"))
add("jn_corr_nest", _f(lambda f: collect._nested(collect.columns(f), ["schema", "table"], ["position"], ["name"], "c").select("schema", "table", F.array_join(F.transform("c", lambda x: x["name"]), ",").alias("columns"))), _cat("""SELECT schema, "table", string_agg(name, ',' ORDER BY position) AS columns FROM cols GROUP BY ALL"""))
add("jn_members", _f(lambda f: audit.grantees(f, "reader")), with_facts("WITH reach(grantee) AS (SELECT 'reader' UNION SELECT m.role FROM members m JOIN reach r ON m.member = r.grantee) SELECT grantee FROM reach UNION ALL SELECT 'PUBLIC'", "members"))
add("jn_stem", _p(lambda p: inference.by_name(_top(p), _cols(p))), _cat("SELECT source, target FROM byname"))
add("jn_qualified_ref", _p(lambda p: _cols(p).select(semantics.qualified().alias("source"), F.explode(T.qualified_tokens(T.without_relations(F.col("comment")))).alias("q")).select("source", F.col("q.schema").alias("schema"), F.col("q.table").alias("name")).join(_top(p).select("schema", "name"), ["schema", "name"], "left_semi")),
    _cat("SELECT s.source, t.schema, t.name FROM (SELECT source, unnest(regexp_extract_all(comment, '[a-z_][a-z0-9_]*\\.[a-z_][a-z0-9_]*')) AS q FROM said) s JOIN top t ON t.schema || '.' || t.name = s.q"))
add("jn_bare_ref", _p(lambda p: inference.by_comment(_top(p), _cols(p))), _cat("SELECT source, target FROM bycomment"))
add("jn_trigger_fn", _p(lambda p: semantics.trigger_functions(p["triggers"], p["functions"]).select("schema", "table", "trigger", "function_schema", "function", "identity_args")), _cat(
    """SELECT x.schema, x."table", x.trigger, x.fs AS function_schema, x.fn AS function, f.identity_args FROM (
      SELECT schema, "table", trigger, CASE WHEN contains(raw, '.') THEN split_part(raw, '.', 1) ELSE schema END AS fs, CASE WHEN contains(raw, '.') THEN split_part(raw, '.', 2) ELSE raw END AS fn FROM (
        SELECT t.schema, t.name AS "table", g.tgname AS trigger, split_part(split_part(split_part(g.definition, ' EXECUTE ', 2), '(', 1), ' ', 2) AS raw FROM pg_trigger g JOIN tabs t ON t.oid = g.tgrelid WHERE NOT g.tgisinternal) WHERE raw <> '') x
    LEFT JOIN fns f ON f.schema = x.fs AND f.name = x.fn AND (f.identity_args = '' OR NOT EXISTS (SELECT 1 FROM fns z WHERE z.schema = f.schema AND z.name = f.name AND z.identity_args = ''))""".replace("\\\\", "\\")))
add("jn_constraint_index", _p(lambda p: ddl.constraint_lines(p["constraints"], p["indexes"])), _cat(_CONSTRAINTS))
add("jn_confirm_excl", _fp(lambda f, p: inference.candidates(_top(p), _cols(p), f["confirmed"], semantics.annotated(_cols(p)))), _cat(
    """SELECT source, target, CASE WHEN min(p) = 0 THEN 'column_name' ELSE 'comment_ref' END AS signal FROM (SELECT source, target, 0 AS p FROM byname UNION ALL SELECT source, target, 1 FROM bycomment) x
    WHERE (source, target) NOT IN (SELECT (source, target) FROM confirmed) AND (source, target) NOT IN (SELECT (source, target) FROM ann) GROUP BY source, target""", "confirmed"))
add("jn_stale_confirm", _fp(lambda f, p: inference.stale(_cols(p), f["confirmed"])), _cat("""SELECT source, target FROM confirmed WHERE source NOT IN (SELECT schema || '.' || "table" || '.' || name FROM tcols)""", "confirmed"))

# --- Aggregates ------------------------------------------------------------
add("agg_array_ordered", QUERIES["jn_corr_nest"], ORACLES["jn_corr_nest"])
add("agg_array", _f(lambda f: collect._nested(collect.constraints(f), ["schema", "table"], ["name"], ["name"], "c").select("schema", "table", F.array_join(F.transform("c", lambda x: x["name"]), ",").alias("names"))), _cat("""SELECT t.schema, t.name AS "table", string_agg(conname, ',' ORDER BY conname) AS names FROM pg_constraint JOIN tabs t ON t.oid = conrelid WHERE contype <> 'n' GROUP BY ALL"""))
add("agg_distinct", _p(lambda p: validate._named(p).select("schema", "kind").distinct()), _cat("SELECT schema, 'table' AS kind FROM tabs UNION SELECT schema, 'view' FROM vws UNION SELECT schema, 'function' FROM fns"))
add("agg_gap_counts", _p(lambda p: semantics.schema_counts(p["schemas"], p["tables"], p["views"], p["functions"])), _cat(
    "SELECT s.schema, (SELECT count(*) FROM top t WHERE t.schema = s.schema) AS n_tables, (SELECT count(*) FROM vws v WHERE v.schema = s.schema) AS n_views, (SELECT count(DISTINCT name) FROM fns f WHERE f.schema = s.schema) AS n_functions FROM (SELECT DISTINCT schema FROM tabs) s"))
add("agg_children", _p(lambda p: semantics.children_counts(p["tables"])), _cat("SELECT t.schema, t.name, (SELECT count(*) FROM tabs c WHERE c.schema = t.schema AND c.partition_of = t.name AND t.partition_of IS NULL) AS children FROM top t"))
add("agg_min_label", _p(lambda p: semantics.diagram(semantics.annotated(_cols(p))).select("from_node", "to_node", "label")), _cat(
    "SELECT split_part(source, '.', 1) || '_' || split_part(source, '.', 2) AS from_node, split_part(target, '.', 1) || '_' || split_part(target, '.', 2) AS to_node, min(split_part(source, '.', 3)) AS label FROM ann GROUP BY 1, 2"))
add("agg_first_wins", _p(lambda p: inference.candidates(_top(p), _cols(p), semantics.annotated(_cols(p)).limit(0), semantics.annotated(_cols(p)))), _cat(
    "SELECT source, target, CASE WHEN min(p) = 0 THEN 'column_name' ELSE 'comment_ref' END AS signal FROM (SELECT source, target, 0 AS p FROM byname UNION ALL SELECT source, target, 1 FROM bycomment) x WHERE (source, target) NOT IN (SELECT (source, target) FROM ann) GROUP BY source, target"))
add("agg_targets", _fp(lambda f, p: semantics.merged_relations(semantics.annotated(_cols(p)), f["confirmed"]).groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("target")), ",").alias("targets"))), _cat("SELECT source, string_agg(DISTINCT target, ',' ORDER BY target) AS targets FROM (SELECT source, target FROM ann UNION ALL SELECT source, target FROM confirmed WHERE NOT ignored) GROUP BY source", "confirmed"))
add("agg_seq_dedupe", _p(lambda p: semantics.sequences(p["columns"]).select("schema", "table", "sequence")), _cat("""SELECT * FROM (VALUES ('shop', 'users', 'shop.users_id_seq'), ('shop', 'orders', 'shop.order_seq'), ('shop', 'dialled_meters', 'shop."Odd seq"')) AS t(schema, "table", sequence)"""))

# --- Semantics and inference -----------------------------------------------
add("rel_partition_fold", _p(lambda p: semantics.folded(p["tables"]).select("schema", "name", "folded", "note_parent")), _cat("SELECT t.schema, t.name, x.name IS NULL AS folded, CASE WHEN x.name IS NOT NULL THEN t.partition_of END AS note_parent FROM tabs t LEFT JOIN top x ON x.schema = t.schema AND x.name = t.name"))
add("rel_children_detail", _p(lambda p: semantics.own_details(p["tables"], p["indexes"], p["constraints"])), _cat("SELECT 'shop' AS schema, 'events_2026_08' AS name, 'events' AS partition_of"))
add("sem_relations", _p(lambda p: semantics.annotated(_cols(p))), _cat("SELECT source, target FROM ann"))
add("sem_enums", _p(lambda p: semantics.enums(_cols(p))), _cat(r"""SELECT DISTINCT "column", trim(split_part(e, '=', 1)) AS value, trim(split_part(e, '=', 2)) AS meaning FROM (SELECT schema || '.' || "table" || '.' || name AS "column", unnest(regexp_extract_all(comment, '-?[0-9]+\s*=\s*[^,;，；/\s)）]+')) AS e FROM tcols)"""))
add("sem_sensitive", _p(lambda p: semantics.sensitive(_cols(p))), _cat(r"""SELECT DISTINCT schema || '.' || "table" || '.' || name AS "column", coalesce(regexp_matches(comment, '脱敏|密文|哈希|加密|hash|encrypt', 'i'), false) AS declared_safe FROM tcols WHERE regexp_matches(name, 'password|passwd|pwd|token|secret|mobile|phone|email|id_card|idcard', 'i')"""))
add("sem_er_diagram", _p(lambda p: semantics.diagram(semantics.annotated(_cols(p))).select("line")), _cat("""SELECT '    ' || split_part(target, '.', 1) || '_' || split_part(target, '.', 2) || ' ||--o{ ' || split_part(source, '.', 1) || '_' || split_part(source, '.', 2) || ' : "' || min(split_part(source, '.', 3)) || '"' AS line FROM ann GROUP BY split_part(source, '.', 1), split_part(source, '.', 2), split_part(target, '.', 1), split_part(target, '.', 2)"""))
add("sem_report", _fp(lambda f, p: semantics.merged_relations(semantics.annotated(_cols(p)), f["confirmed"])), _cat("SELECT source, target FROM ann UNION SELECT source, target FROM confirmed WHERE NOT ignored", "confirmed"))
add("inf_column_name", QUERIES["jn_stem"], ORACLES["jn_stem"])
add("inf_comment_ref", QUERIES["jn_bare_ref"], ORACLES["jn_bare_ref"])
add("inf_candidates", QUERIES["jn_confirm_excl"], ORACLES["jn_confirm_excl"])
add("inf_pending_sql", _fp(lambda f, p: inference.pending(_cols(p), f["confirmed"])), _cat("""SELECT c.source, 'COMMENT ON COLUMN ' || c.source || ' IS ''逻辑关联 ' || c.target || ''';' AS statement FROM confirmed c JOIN tcols t ON t.schema || '.' || t."table" || '.' || t.name = c.source WHERE NOT c.ignored AND (c.source, c.target) NOT IN (SELECT (source, target) FROM ann)""", "confirmed"))
add("gap_report", _p(lambda p: semantics.gaps(p["tables"], p["columns"], p["functions"])), _cat(
    r"""SELECT 'table' AS kind, schema || '.' || name AS name FROM top WHERE trim(coalesce(comment, '')) = '' UNION SELECT 'column', schema || '.' || "table" || '.' || name FROM tcols WHERE trim(coalesce(comment, '')) = '' UNION
    SELECT 'function', schema || '.' || name || '(' || identity_args || ')' FROM fns WHERE trim(coalesce(comment, '')) = '' UNION
    SELECT 'sensitive', schema || '.' || "table" || '.' || name FROM tcols WHERE regexp_matches(name, 'password|passwd|pwd|token|secret|mobile|phone|email|id_card|idcard', 'i') AND NOT coalesce(regexp_matches(comment, '脱敏|密文|哈希|加密|hash|encrypt', 'i'), false)"""))
add("idx_trigger_refs", _p(lambda p: semantics.trigger_functions(p["triggers"], p["functions"]).filter("identity_args IS NOT NULL").groupBy("function_schema", "function", "identity_args").agg(F.countDistinct("definition").alias("n"))), _cat("SELECT * FROM (VALUES ('shop', 'noop_trigger', '', 3), ('shop', 'fmt', 'x integer', 1), ('shop', 'fmt', 'x text', 1)) AS t(function_schema, function, identity_args, n)"))
add("idx_schema_readme", _p(lambda p: ddl.schema_index(p).select("schema", "kind", "name", "file")), _cat("SELECT schema, 'table' AS kind, name, 'tables/' || name || '.sql' AS file FROM top UNION ALL SELECT schema, 'view', name, 'views/' || name || '.sql' FROM vws UNION ALL SELECT DISTINCT schema, 'function', name, 'functions/' || name || '.sql' FROM fns"))
add("idx_root_readme", QUERIES["agg_gap_counts"], ORACLES["agg_gap_counts"])
add("ddl_column_line", _p(lambda p: p["columns"].filter("schema = 'shop_ext'").select("table", "name", ddl.column_line().alias("line"))), _cat("""SELECT "table", name, '  ' || name || ' ' || type || CASE WHEN nullable THEN '' ELSE ' NOT NULL' END AS line FROM cols WHERE schema = 'shop_ext'"""))
add("val_rules", _p(lambda p: validate.violations(p)), _cat("SELECT NULL AS rule, NULL AS owner, NULL AS detail WHERE false"))
add("set_subset_check", _p(lambda p: validate.scope(p, ["shop"])), _cat("SELECT 'scope' AS rule, 'shop_ext' AS owner, 'not requested' AS detail"))

# --- Set operations and order ----------------------------------------------
add("set_union_all", _p(validate._named), _cat("SELECT 'table' AS kind, schema, name FROM tabs UNION ALL SELECT 'view', schema, name FROM vws UNION ALL SELECT 'function', schema, name FROM fns"))
add("set_union_distinct", QUERIES["sem_report"], ORACLES["sem_report"])
add("set_difference", _fp(lambda f, p: inference.stale(_cols(p), f["confirmed"]).select("source")), _cat("""SELECT source FROM confirmed EXCEPT SELECT schema || '.' || "table" || '.' || name FROM tcols""", "confirmed"))
add("set_intersect", _f(lambda f: provision.scope_of(f, ["shop", "gone"]).intersect(collect.schemas(f).select("schema"))), _cat("SELECT schema FROM tabs INTERSECT SELECT unnest(['shop', 'gone'])"))
add("srt_all", _p(lambda p: ddl.schema_index(p).select("schema", "kind", "name").withColumn("at", F.row_number().over(Window.orderBy("schema", "kind", "name")))), _cat("""SELECT row_number() OVER (ORDER BY schema, kind, name) AS "at", schema, kind, name FROM (SELECT schema, 'table' AS kind, name FROM top UNION ALL SELECT schema, 'view', name FROM vws UNION ALL SELECT DISTINCT schema, 'function', name FROM fns)"""))

# --- Scalar functions, over a table of strings -------------------------------
_STRINGS = ["users", "Users", "order", "a b", 'q"t', "x_id", "_id", "1st", "..", "a.b.c", "it's", "back\\slash", "a|b", "user_token", "Phone"]


def _strings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in _STRINGS], "s string")


def _strings_sql(expr: str) -> str:
    return f"SELECT s, {expr} FROM (VALUES " + ", ".join("('" + s.replace("'", "''") + "')" for s in _STRINGS) + ") AS t(s)"


def _fn(name: str, column, sql: str) -> None:
    add(name, lambda spark, d: _strings(spark).select("s", column(F.col("s")).alias("v")), _strings_sql(sql + " AS v"))


_words = "', '".join(T.QUOTED_WORDS)
_fn("fn_levenshtein", lambda s: F.levenshtein(s, F.lit("user")), "levenshtein(s, 'user')")
_fn("fn_similarity", lambda s: F.round(T.similarity(s, F.lit("user")), 6), "round(1 - levenshtein(lower(s), 'user') / greatest(length(s), 4)::DOUBLE, 6)")
_fn("fn_local_name", T.local_name, "list_last(string_split(s, '.'))")
_fn("fn_quote_ident", T.quote_ident, f"""CASE WHEN regexp_full_match(s, '[a-z_][a-z0-9_]*') AND s NOT IN ('{_words}') THEN s ELSE '"' || replace(s, '"', '""') || '"' END""")
_fn("fn_sql_literal", T.sql_literal, r"""CASE WHEN contains(s, '\') THEN 'E''' || replace(replace(s, '''', ''''''), '\', '\\') || '''' ELSE '''' || replace(s, '''', '''''') || '''' END""")
_fn("fn_sh_ident", T.always_quoted, """'"' || replace(s, '"', '""') || '"'""")
_fn("fn_comment_lines", T.comment_lines, "'-- ' || s")
_fn("fn_escape_cell", T.escape_cell, r"""replace(replace(s, '|', '\|'), chr(10), ' ')""")
_fn("fn_meta_escape", T.escape_meta, r"""replace(s, '\', '\\')""")
_fn("fn_strip_suffix", T.id_stem, r"CASE WHEN s LIKE '%\_id' ESCAPE '\' AND length(s) > 3 THEN left(s, length(s) - 3) END")
_fn("fn_ends_with", lambda s: F.endswith(s, F.lit("_id")), "suffix(s, '_id')")
_fn("fn_sensitive", T.is_sensitive, "regexp_matches(s, 'password|passwd|pwd|token|secret|mobile|phone|email|id_card|idcard', 'i')")
_fn("fn_identifier_ok", T.identifier_ok, r"regexp_full_match(s, '[A-Za-z0-9_.]+') AND NOT regexp_full_match(s, '\.+')")
_fn("fn_three_segment", T.three_segments, r"regexp_full_match(s, '[A-Za-z0-9_]+\.[A-Za-z0-9_]+\.[A-Za-z0-9_]+')")
_fn("fn_token_regex", lambda s: F.array_join(T.tokens(s), ","), "array_to_string(regexp_extract_all(s, '[a-z_][a-z0-9_]*'), ',')")
_fn("fn_sha8", T.sha8, "left(sha256(s), 8)")
_fn("fn_rel_link", lambda s: T.function_link(F.lit("users"), s, F.lit("f")), "CASE WHEN s = 'users' THEN '../functions/f.sql' ELSE '../../' || s || '/functions/f.sql' END")
_fn("fn_format_IL", lambda s: provision.quoted_pair(s, F.lit("v")), """'"' || replace(s, '"', '""') || '" = ''v'''""")
_fn("fn_concat", lambda s: F.concat(s, F.lit("-"), F.array_join(F.split(s, "_"), "/")), "s || '-' || array_to_string(string_split(s, '_'), '/')")
add("snk_redact", lambda s, d: s.createDataFrame([(x, sinks.redact(x, ["user", "", "users"])) for x in _STRINGS], "s string, v string"), _strings_sql("replace(replace(s, 'users', '[REDACTED]'), 'user', '[REDACTED]') AS v"))
add("fn_relation_regex", QUERIES["sem_relations"], ORACLES["sem_relations"])
add("fn_enum_regex", QUERIES["sem_enums"], ORACLES["sem_enums"])
add("fn_qualified_regex", QUERIES["jn_qualified_ref"], ORACLES["jn_qualified_ref"])
add("fn_relation_strip", _p(lambda p: _cols(p).filter("comment IS NOT NULL").select(semantics.qualified().alias("source"), T.without_relations(F.col("comment")).alias("comment"))), _cat("SELECT source, comment FROM said"))
add("fn_nextval", QUERIES["agg_seq_dedupe"], ORACLES["agg_seq_dedupe"])
add("fn_trigger_fn", _f(lambda f: f["pg_trigger"].select("tgname", T.trigger_function(F.col("definition")).alias("fn"))), with_facts(r"SELECT tgname, nullif(split_part(split_part(split_part(definition, ' EXECUTE ', 2), '(', 1), ' ', 2), '') AS fn FROM pg_trigger", "pg_trigger"))
add("fn_option_kv", _f(lambda f: f["pg_class"].filter("reloptions IS NOT NULL").select("relname", T.storage_options(F.col("reloptions")).alias("v"))), with_facts("SELECT relname, array_to_string(list_transform(reloptions, lambda o: split_part(o, '=', 1) || '=''' || split_part(o, '=', 2) || ''''), ', ') AS v FROM pg_class WHERE reloptions IS NOT NULL", "pg_class"))
_labels = " ".join(f"WHEN n < {m} THEN '{x}'" for m, x in T.ROW_LABELS)
add("fn_row_bucket", _f(lambda f: f["pg_class"].select("relname", T.row_label(F.col("reltuples")).alias("rows"))), with_facts(f"SELECT relname, CASE {_labels} ELSE '{T.ROW_LABEL_ABOVE}' END AS rows FROM (SELECT relname, greatest(reltuples, 0) AS n FROM pg_class)", "pg_class"))
add("fn_round4", lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.round(F.col("p_retailprice") / 7, 4).alias("v")), "SELECT p_partkey, round(p_retailprice / 7, 4) AS v FROM part")

# --- Names at table scale ----------------------------------------------------
_MISSPELT = ["emial", "userz", "orde", "produkt_id", "shop.mertics", "zzzzzz"]


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in _MISSPELT], "identifier string")


def _rank_sql(names: str) -> str:
    asked = ", ".join(f"('{x}')" for x in _MISSPELT)
    return f"""SELECT identifier, candidate, round(sim, 4) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY identifier ORDER BY sim DESC, candidate) AS rank FROM (
      SELECT identifier, candidate, max(1 - levenshtein(lower(l), lower(loc)) / greatest(length(l), length(loc))::DOUBLE) AS sim FROM (SELECT identifier, list_last(string_split(identifier, '.')) AS l FROM (VALUES {asked}) AS t(identifier)) a, ({names}) n GROUP BY ALL) WHERE sim >= 0.6) WHERE rank <= 5"""


add("chk_candidates_column", lambda s, d: candidates.rank(_asked(s), candidates.column_names(collect.columns(facts(s)))), _cat(_rank_sql("""SELECT schema || '.' || "table" || '.' || name AS candidate, name AS loc FROM cols""")))
add("chk_candidates_table", lambda s, d: candidates.rank(_asked(s), candidates.table_names(collect.tables(facts(s)), collect.views(facts(s)))), _cat(_rank_sql("SELECT schema || '.' || name AS candidate, name AS loc FROM (SELECT schema, name FROM tabs UNION ALL SELECT schema, name FROM vws) UNION ALL SELECT DISTINCT schema, schema FROM tabs")))
add("topk_candidates", QUERIES["chk_candidates_column"], ORACLES["chk_candidates_column"])
add("agg_max_per_key", QUERIES["chk_candidates_table"], ORACLES["chk_candidates_table"])
_fuzzy = lambda least, most: f"""SELECT identifier, candidate, round(sim, 4) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY identifier ORDER BY sim DESC, candidate) AS rank FROM (
  SELECT identifier, c_name AS candidate, 1 - levenshtein(lower(identifier), lower(c_name)) / greatest(length(identifier), length(c_name))::DOUBLE AS sim FROM (SELECT DISTINCT 'Customer#0' || right(s_name, 7) AS identifier FROM supplier), customer) WHERE sim >= {least}) WHERE rank <= {most}"""  # noqa: E731
add("jn_fuzzy", lambda s, d: candidates.links(s.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("Customer#0"), F.substring("s_name", -7, 7)).alias("identifier")), s.read.parquet(f"{d}/customer.parquet").select(F.col("c_name").alias("candidate"), F.col("c_name").alias("local"))),
    """WITH asked AS (SELECT DISTINCT 'Customer#0' || right(s_name, 7) AS identifier, lower(list_last(string_split('Customer#0' || right(s_name, 7), '.'))) AS l FROM supplier),
    known AS (SELECT lower(c_name) AS loc, min(c_name) AS candidate, count(*) AS n, row_number() OVER (ORDER BY length(lower(c_name)), lower(c_name)) AS place FROM customer WHERE c_name IS NOT NULL GROUP BY 1),
    pairs AS (SELECT identifier, candidate, n, place, place - row_number() OVER (PARTITION BY identifier ORDER BY place) AS run FROM asked, known WHERE 1 - levenshtein(l, loc) / greatest(length(l), length(loc), 1)::DOUBLE >= 0.6)
    SELECT identifier, arg_min(candidate, place) AS from_name, arg_max(candidate, place) AS to_name, CAST(sum(n) AS BIGINT) AS names FROM pairs GROUP BY identifier, run""")
add("jn_fuzzy_default", lambda s, d: candidates.rank(s.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("Customer#0"), F.substring("s_name", -7, 7)).alias("identifier")), s.read.parquet(f"{d}/customer.parquet").select(F.col("c_name").alias("candidate"), F.col("c_name").alias("local"))), _fuzzy(0.6, 5))

# --- Privilege audit ---------------------------------------------------------
_RIGHTS = "['SELECT', 'INSERT', 'UPDATE', 'DELETE', 'TRUNCATE', 'REFERENCES', 'TRIGGER']"


def _eff(role: str) -> str:
    """What a role may do, for DuckDB: grants of all roles that it reaches, and what owners and superusers may without."""
    return rf"""reach(grantee) AS (SELECT '{role}' UNION SELECT m.role FROM members m JOIN reach r ON m.member = r.grantee), who AS (SELECT grantee FROM reach UNION ALL SELECT 'PUBLIC'),
users AS (SELECT oid, nspname, nspowner FROM pg_namespace WHERE nspname NOT IN ('pg_catalog', 'information_schema') AND nspname NOT LIKE 'pg\_%' ESCAPE '\'),
things AS (SELECT CASE relkind WHEN 'S' THEN 'sequence' ELSE 'table' END AS object_kind, nspname AS schema, relname AS object_id, relowner AS owner, CASE relkind WHEN 'S' THEN ['USAGE', 'SELECT', 'UPDATE'] ELSE {_RIGHTS} END AS rights FROM pg_class c JOIN users n ON n.oid = c.relnamespace WHERE relkind IN ('r', 'p', 'f', 'v', 'm', 'S')
  UNION ALL SELECT 'schema', nspname, nspname, nspowner, ['USAGE', 'CREATE'] FROM users UNION ALL SELECT 'server', NULL, srvname, NULL, ['USAGE'] FROM pg_foreign_server UNION ALL SELECT 'database', NULL, 'app', NULL, ['CONNECT', 'CREATE', 'TEMP']
  UNION ALL SELECT 'function', schema, signature, owner, ['EXECUTE'] FROM (SELECT n.nspname AS schema, proname || '(' || identity_args || ')' AS signature, proowner AS owner FROM pg_proc p JOIN users n ON n.oid = p.pronamespace WHERE prokind = 'f' UNION SELECT schema, signature, owner FROM secdef_functions)),
eff AS (SELECT object_kind, schema, object_id, grantee, privilege FROM acl JOIN who USING (grantee) UNION SELECT object_kind, schema, object_id, owner, unnest(rights) FROM things WHERE owner IN (SELECT grantee FROM reach)
  UNION SELECT object_kind, schema, object_id, '{role}', unnest(rights) FROM things WHERE EXISTS (SELECT 1 FROM roles WHERE rolname = '{role}' AND super))"""


_SAID = "SELECT severity, privilege || ' on {low} ' || CASE WHEN object_kind IN ('table', 'sequence', 'function') THEN schema || '.' ELSE '' END || object_id || ' by ' || grantee AS description, 'REVOKE ' || privilege || ' ON {kind} ' || CASE WHEN object_kind IN ('table', 'sequence', 'function') THEN '\"' || schema || '\".' ELSE '' END || CASE object_kind WHEN 'function' THEN object_id ELSE '\"' || object_id || '\"' END || ' FROM ' || CASE grantee WHEN 'PUBLIC' THEN 'PUBLIC' ELSE '\"' || grantee || '\"' END || ';' AS fix FROM ({rows})"
_granted = lambda kind, rows: _SAID.format(low=kind.lower(), kind=kind, rows=rows)
#: rule -> what it finds, for DuckDB; @ is the role.
_RULES = {
    "flags": "SELECT 'block' AS severity, 'role attribute ' || word AS description, 'ALTER ROLE \"@\" NO' || word || ';' AS fix FROM roles, (VALUES (1, 'SUPERUSER'), (2, 'CREATEDB'), (3, 'BYPASSRLS'), (4, 'REPLICATION'), (5, 'CREATEROLE')) AS k(i, word) WHERE rolname = '@' AND CASE i WHEN 1 THEN super WHEN 2 THEN createdb WHEN 3 THEN bypassrls WHEN 4 THEN replication ELSE createrole END",
    "membership": "SELECT 'block' AS severity, 'member of ' || role AS description, 'REVOKE \"' || role || '\" FROM \"' || member || '\";' AS fix FROM members WHERE member = '@'",
    "schema_create": _granted("SCHEMA", "SELECT *, 'block' AS severity FROM eff WHERE object_kind = 'schema' AND privilege = 'CREATE'"),
    "database": _granted("DATABASE", "SELECT *, CASE privilege WHEN 'CREATE' THEN 'block' ELSE 'report' END AS severity FROM eff WHERE object_kind = 'database' AND object_id = 'app' AND privilege IN ('CREATE', 'TEMP')"),
    "table_write": _granted("TABLE", "SELECT *, 'block' AS severity FROM eff WHERE object_kind = 'table' AND privilege IN ('INSERT', 'UPDATE', 'DELETE', 'TRUNCATE', 'REFERENCES', 'TRIGGER')"),
    "sequence": _granted("SEQUENCE", "SELECT *, 'block' AS severity FROM eff WHERE object_kind = 'sequence' AND privilege IN ('USAGE', 'UPDATE')"),
    "out_usage": _granted("SCHEMA", "SELECT *, CASE schema WHEN 'public' THEN 'report' ELSE 'block' END AS severity FROM eff WHERE object_kind = 'schema' AND privilege = 'USAGE' AND schema NOT IN (SELECT nspname FROM in_scope)"),
    "out_select": _granted("TABLE", "SELECT *, 'block' AS severity FROM eff WHERE object_kind = 'table' AND privilege = 'SELECT' AND schema NOT IN (SELECT nspname FROM in_scope)"),
    "ownership": "SELECT 'block' AS severity, 'owns ' || what AS description, '-- give ' || what || ' another owner' AS fix FROM (SELECT nspname || '.' || relname AS what FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace WHERE relowner = '@' UNION ALL SELECT schema || '.' || signature FROM secdef_functions WHERE owner = '@')",
    "escape": _granted("FUNCTION", "SELECT *, 'block' AS severity FROM eff WHERE object_kind = 'function' AND privilege = 'EXECUTE' AND starts_with(object_id, 'dblink')") + " UNION ALL " + _granted("FOREIGN SERVER", "SELECT *, 'block' AS severity FROM eff WHERE object_kind = 'server' AND privilege = 'USAGE'"),
    "secdef": _granted("FUNCTION", "SELECT e.*, CASE WHEN e.schema IN (SELECT nspname FROM in_scope) THEN 'report' ELSE 'block' END AS severity FROM eff e JOIN secdef_functions s ON s.schema = e.schema AND s.signature = e.object_id AND s.secdef WHERE object_kind = 'function' AND privilege = 'EXECUTE'"),
    "default_acl": "SELECT CASE WHEN schema IN (SELECT nspname FROM in_scope) THEN 'report' ELSE 'block' END AS severity, 'default privileges in ' || coalesce(schema, 'the database') || ' of ' || owner || ' for ' || grantee AS description, 'ALTER DEFAULT PRIVILEGES FOR ROLE \"' || owner || '\"' || coalesce(' IN SCHEMA \"' || schema || '\"', '') || ' REVOKE ALL ON ' || CASE objtype WHEN 'S' THEN 'SEQUENCES' ELSE 'TABLES' END || ' FROM ' || CASE grantee WHEN 'PUBLIC' THEN 'PUBLIC' ELSE '\"' || grantee || '\"' END || ';' AS fix FROM default_acl WHERE grantee IN ('@', 'PUBLIC')",
    "connect": _granted("DATABASE", "SELECT *, 'report' AS severity FROM eff WHERE object_kind = 'database' AND privilege = 'CONNECT' AND object_id <> 'app'"),
    "owner_gap": "SELECT 'report' AS severity, 'new tables of ' || relowner || ' in ' || nspname AS description, 'ALTER DEFAULT PRIVILEGES FOR ROLE \"' || relowner || '\" IN SCHEMA \"' || nspname || '\" GRANT SELECT ON TABLES TO \"@\";' AS fix FROM (SELECT DISTINCT n.nspname, c.relowner FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace WHERE relkind IN ('r', 'p', 'f', 'v', 'm') AND n.nspname IN (SELECT nspname FROM in_scope)) o WHERE NOT EXISTS (SELECT 1 FROM default_acl d WHERE d.schema = o.nspname AND d.owner = o.relowner AND d.grantee = '@' AND d.objtype = 'r')",
}


def _found(role: str, *rules: str) -> str:
    each = [f"SELECT '{r}' AS rule, severity, description, fix FROM ({_RULES[r].replace('@', role)})" for r in rules or _RULES]
    return f"WITH {_eff(role)}, found AS ({' UNION ALL '.join(each)})"


for _name in _RULES:
    for _role, _mark in (("reader", ""), ("root", "_root"), ("owner_a", "_owner")):
        if not _mark or _name in ("table_write", "schema_create", "ownership", "sequence", "escape"):
            add(f"aud_{_name}{_mark}", _f(lambda f, r=audit.RULES[_name], who=_role: r(f, who)), with_facts(_found(_role, _name) + " SELECT rule, severity, description, fix FROM found", *_AUDIT))
add("jn_defacl", _f(lambda f: audit.default_acl(f, "reader").select("severity", "description")), with_facts(_found("reader", "default_acl") + " SELECT severity, description FROM found", *_AUDIT))
add("jn_owner_gap", QUERIES["aud_owner_gap"], ORACLES["aud_owner_gap"])
for _role in ("reader", "root", "owner_a", "clean"):
    add("aud_effective" if _role == "reader" else f"aud_effective_{_role}", _f(lambda f, who=_role: audit.effective(f, who)), with_facts(f"WITH {_eff(_role)} SELECT object_kind, schema, object_id, grantee, privilege FROM eff", *_AUDIT))
    add("aud_verdict" if _role == "clean" else f"aud_verdict_{_role}", _f(lambda f, who=_role: audit.verdict(f, who)), with_facts(_found(_role) + " SELECT count(*) FILTER (severity = 'block') AS n_block, count(*) FILTER (severity = 'report') AS n_report, CASE WHEN bool_or(severity = 'block') THEN 2 ELSE 0 END AS exit_code FROM found", *_AUDIT))
add("aud_fixes", _f(lambda f: audit.mends(f, "reader")), with_facts(_found("reader") + " SELECT DISTINCT fix FROM found WHERE severity = 'block'", *_AUDIT))


def _quiet(f: dict) -> dict:
    """The facts without what PUBLIC may do and without its default privileges: nothing blocks the role ``clean``."""
    return f | {"acl": f["acl"].filter("grantee <> 'PUBLIC'"), "default_acl": f["default_acl"].filter("grantee <> 'PUBLIC'")}


def _failing() -> bool:
    raise ConnectionError("no session")


def _probed(f: dict) -> DataFrame:
    cases = [("blocked", f, lambda: True), ("answered", _quiet(f), lambda: True), ("refused", _quiet(f), lambda: False), ("unreachable", _quiet(f), _failing)]
    out = [audit.verdict(g, "clean", probe).select(F.lit(name).alias("probe"), (F.col("n_block") > 0).alias("blocked"), "exit_code") for name, g, probe in cases]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def _chained(f: dict) -> DataFrame:
    """Who a role is by a chain of fifty memberships."""
    chain = f["members"].sparkSession.createDataFrame([(f"r{i + 1}", f"r{i}") for i in range(50)], "role string, member string")
    return audit.grantees(f | {"members": chain}, "r0")


add("aud_verdict_probe", _f(_probed), with_facts(_found("clean") + " SELECT 'blocked' AS probe, bool_or(severity = 'block') AS blocked, CASE WHEN bool_or(severity = 'block') THEN 2 ELSE 0 END AS exit_code FROM found UNION ALL VALUES ('answered', false, 0), ('refused', false, 1), ('unreachable', false, 1)", *_AUDIT))
# Parts as a tree of roles, customers as their members, and a third of all suppliers in one role; every part's role may read its brand.
_MEMBERS_SQL = """members AS (SELECT 'p' || p_partkey AS member, 'p' || (p_partkey // 2) AS role FROM part WHERE p_partkey > 1 UNION ALL SELECT 'c' || c_custkey, 'p' || (c_custkey % 97 + 1) FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'p' || CASE WHEN s_suppkey % 3 = 0 THEN 5 ELSE s_suppkey END FROM supplier UNION ALL SELECT 'p1', 'p7'),
reach AS (SELECT member, role FROM members UNION SELECT r.member, m.role FROM reach r JOIN members m ON m.member = r.role)"""


def _members(spark, sf_dir):
    part, customer, supplier = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "customer", "supplier"))
    rows = part.filter("p_partkey > 1").selectExpr("concat('p', p_partkey) AS member", "concat('p', p_partkey div 2) AS role").unionByName(customer.selectExpr("concat('c', c_custkey) AS member", "concat('p', c_custkey % 97 + 1) AS role"))
    return rows.unionByName(supplier.selectExpr("concat('s', s_suppkey) AS member", "concat('p', IF(s_suppkey % 3 = 0, 5, s_suppkey)) AS role")).unionByName(spark.createDataFrame([("p1", "p7")], "member string, role string"))


def _brands(spark, sf_dir):
    acl = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("concat('p', p_partkey) AS grantee", "p_brand AS object_id", "'SELECT' AS privilege")
    roles = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("concat('c', c_custkey) AS rolname")
    return reach.effective(acl, _members(spark, sf_dir), roles).groupBy("role").agg(F.count_distinct("object_id").alias("brands"), F.count("*").alias("grants"))


add("aud_reach", lambda s, d: reach.closure(_members(s, d)), f"WITH RECURSIVE {_MEMBERS_SQL} SELECT DISTINCT member, role FROM reach WHERE member <> role")
add("aud_effective_all", _brands, f"WITH RECURSIVE {_MEMBERS_SQL} SELECT r.member AS role, count(DISTINCT p_brand) AS brands, count(*) AS grants FROM (SELECT DISTINCT member, role FROM reach WHERE member LIKE 'c%') r JOIN part ON r.role = 'p' || p_partkey GROUP BY r.member")
add("aud_deep_membership", _f(_chained), "SELECT 'r' || i AS grantee FROM range(51) AS t(i) UNION ALL SELECT 'PUBLIC'")
add("aud_identity", lambda s, d: s.createDataFrame([("reader", audit.identity("reader", "reader")), ("root", audit.identity("root", "reader"))], "who string, code int"), "SELECT * FROM (VALUES ('reader', 0), ('root', 2)) AS t(who, code)")
_STEPS = """SELECT 'role' AS part, CAST(NULL AS VARCHAR) AS schema, i AS step, statement FROM (VALUES (0, 'ALTER ROLE "{0}" LOGIN NOCREATEROLE NOINHERIT CONNECTION LIMIT 5;'), (1, 'ALTER ROLE "{0}" SET statement_timeout = ''15s'';'), (2, 'ALTER ROLE "{0}" SET idle_in_transaction_session_timeout = ''30s'';'), (3, 'GRANT SET ON PARAMETER lc_messages TO "{0}";')) AS r(i, statement)
UNION ALL SELECT 'schema', schema, k, replace(CASE k WHEN 0 THEN 'GRANT USAGE ON SCHEMA @ TO "{0}";' WHEN 1 THEN 'GRANT SELECT ON ALL TABLES IN SCHEMA @ TO "{0}";' ELSE 'ALTER DEFAULT PRIVILEGES FOR ROLE CURRENT_USER IN SCHEMA @ GRANT SELECT ON TABLES TO "{0}";' END, '@', '"' || schema || '"') FROM ({1}), range(3) AS x(k)
UNION ALL SELECT 'schema', schema, k, replace(CASE k WHEN 0 THEN 'REVOKE SELECT ON ALL TABLES IN SCHEMA @ FROM "{0}";' WHEN 1 THEN 'REVOKE USAGE ON SCHEMA @ FROM "{0}";' ELSE 'ALTER DEFAULT PRIVILEGES FOR ROLE CURRENT_USER IN SCHEMA @ REVOKE SELECT ON TABLES FROM "{0}";' END, '@', '"' || schema || '"')
FROM (SELECT DISTINCT schema FROM eff WHERE object_kind = 'schema' AND privilege = 'USAGE' AND schema NOT IN ({1})), range(3) AS x(k)"""
_HELD = "SELECT DISTINCT schema FROM (SELECT schema FROM tabs UNION SELECT schema FROM vws UNION SELECT schema FROM fns)"
_PLANNED = ["acl", "members", "roles", "in_scope", "secdef_functions", "default_acl"]


def _planned(role: str, scope: str, before: str = "") -> str:
    eff = _eff(role).replace("FROM acl JOIN", "FROM (SELECT * FROM acl WHERE grantee <> 'PUBLIC') JOIN")
    return _cat(f", {eff} {before} {_STEPS.format(role, scope)}", *_PLANNED)


add("gen_setup_sql", _f(lambda f: provision.plan(_quiet(f), "newcomer")), _planned("newcomer", _HELD, "SELECT 'create' AS part, NULL AS schema, 0 AS step, 'CREATE ROLE \"newcomer\" LOGIN PASSWORD :secret;' AS statement UNION ALL"))
add("gen_setup_scope", _f(lambda f: provision.plan(_quiet(f), "clean", ["shop_ext"])), _planned("clean", "SELECT 'shop_ext' AS schema"))
add("gen_setup_abort", _f(lambda f: provision.plan(f, "reader").select("part", "statement")), with_facts(f"WITH {_eff('reader')} SELECT 'abort' AS part, '-- ' || what AS statement FROM (SELECT 'attribute ' || word AS what FROM roles, (VALUES (1, 'super'), (2, 'createdb'), (3, 'bypassrls'), (4, 'replication')) AS k(i, word) WHERE rolname = 'reader' AND CASE i WHEN 1 THEN super WHEN 2 THEN createdb WHEN 3 THEN bypassrls ELSE replication END UNION SELECT 'member of ' || role FROM members WHERE member = 'reader' UNION SELECT CASE grantee WHEN 'PUBLIC' THEN 'PUBLIC ' ELSE '' END || 'may write ' || schema || '.' || object_id FROM eff WHERE object_kind = 'table' AND privilege <> 'SELECT')", *_AUDIT))
_SCRIPTED = ["BEGIN;", "COMMIT;", "ON COMMIT DROP", "RAISE EXCEPTION", "WHERE NOT EXISTS (SELECT FROM there)", "NOINHERIT", "GRANT SET ON PARAMETER lc_messages", "REVOKE SELECT ON TABLES FROM", "'it''s'", "NOSUPERUSER"]
add("gen_script", lambda s, d: s.createDataFrame([(w, w in provision.script("reader", "it's")) for w in _SCRIPTED], "part string, there boolean"), "SELECT * FROM (VALUES " + ", ".join("('{}', {})".format(w.replace("'", "''"), w != "NOSUPERUSER") for w in _SCRIPTED) + ") AS t(part, there)")
add("pre_stage", lambda s, d: provision.stage(s.createDataFrame([("smoke", "fail"), ("deps", "pass"), ("config", "fail"), ("gitignore", "pass")], "id string, status string")), "SELECT 'config' AS stage")

# --- Results as text ----------------------------------------------------------
add("snk_meta", lambda s, d: s.createDataFrame([tuple(x.split(": ", 1)) for x in sinks.meta("SELECT 1\n-- x\\y", 3, False, 200, 12, "csv").splitlines()], "k string, v string"), r"SELECT * FROM (VALUES ('sql', 'SELECT 1\n-- x\\y'), ('rows', '3'), ('truncated', 'false'), ('limit', '200'), ('elapsed_ms', '12'), ('format', 'csv')) AS t(k, v)")
add("lim_truncate_csv", lambda s, d: s.createDataFrame([sinks.cut_csv('a,b\n1,"x\ny"\n2,z\n3,w\n', 2)], "text string, n int, truncated boolean"), """SELECT 'a,b' || chr(10) || '1,"x' || chr(10) || 'y"' || chr(10) || '2,z' || chr(10) AS text, 2 AS n, true AS truncated""")
add("lim_truncate_text", lambda s, d: s.createDataFrame([sinks.cut_lines("a\nb\nc\n", 2)], "text string, n int, truncated boolean"), "SELECT 'a' || chr(10) || 'b' || chr(10) AS text, 2 AS n, true AS truncated")
