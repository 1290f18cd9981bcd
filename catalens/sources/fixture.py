"""A small catalog in the shape of the PostgreSQL system tables, for tests, queries and oracles.

The same rows are given to Spark as DataFrames and to DuckDB as VALUES.
"""

from __future__ import annotations

from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

APP, EXT, SYS = 1, 2, 3

#: name -> (columns, rows)
FACTS: dict[str, tuple[str, list[tuple[Any, ...]]]] = {
    "pg_namespace": ("oid bigint, nspname string, nspowner string, description string", [
        (APP, "shop", "owner_a", "Shop data"), (EXT, "shop_ext", "owner_b", None), (SYS, "pg_catalog", "postgres", None), (4, "pg_toast", "postgres", None), (5, "information_schema", "postgres", None), (6, "empty_schema", "owner_a", None),
    ]),
    "pg_am": ("oid bigint, amname string", [(2, "heap"), (3, "columnar"), (403, "btree")]),
    "pg_tablespace": ("oid bigint, spcname string", [(1663, "pg_default"), (9001, "fast_disk")]),
    "pg_language": ("oid bigint, lanname string", [(14, "sql"), (13, "plpgsql")]),
    "pg_extension": ("oid bigint, extname string", [(700, "geo")]),
    "pg_depend": ("classid string, objid bigint, refclassid string, refobjid bigint, deptype string", [
        ("pg_class", 150, "pg_extension", 700, "e"), ("pg_proc", 352, "pg_extension", 700, "e"), ("pg_class", 101, "pg_namespace", 1, "n"),
    ]),
    "pg_class": ("oid bigint, relname string, relnamespace bigint, relkind string, reltuples double, reloptions array<string>, relam bigint, reltablespace bigint, reltoastrelid bigint, relispartition boolean, partkey string, relowner string, description string, viewdef string, relispopulated boolean", [
        (101, "users", APP, "r", 1200.0, None, 2, 0, 0, False, None, "owner_a", "User accounts", None, True),
        (102, "categories", APP, "r", 40.0, None, 2, 0, 0, False, None, "owner_a", None, None, True),
        (103, "products", APP, "r", 25000.0, None, 2, 0, 0, False, None, "owner_a", None, None, True),
        (104, "orders", APP, "r", 3000000.0, None, 2, 0, 0, False, None, "owner_a", "Orders", None, True),
        (105, "order_items", APP, "r", 90000000.0, None, 3, 0, 0, False, None, "owner_a", None, None, True),
        (106, "payments", APP, "r", -1.0, None, 2, 9001, 0, False, None, "owner_a", None, None, True),
        (107, "change_notes", APP, "r", 2000000000.0, None, 2, 0, 0, False, None, "owner_a", None, None, True),
        (108, "events", APP, "p", 0.0, None, 0, 0, 0, False, "RANGE (occurred_at)", "owner_a", None, None, True),
        (109, "events_2026_08", APP, "r", 500.0, ["fillfactor=60"], 2, 0, 0, True, None, "owner_a", None, None, True),
        (110, "metrics", APP, "r", 10.0, None, 2, 0, 0, False, None, "owner_a", None, None, True),
        (111, "dialled_meters", APP, "r", 10.0, ["fillfactor=70", "autovacuum_enabled=false"], 2, 0, 0, False, None, "owner_a", None, None, True),
        (112, "long_letters", APP, "r", 10.0, None, 2, 0, 190, False, None, "owner_a", None, None, True),
        (113, "events_2026_08_a", APP, "r", 5.0, None, 2, 0, 0, True, None, "owner_a", None, None, True),
        (114, "remote_items", APP, "f", 0.0, None, 0, 0, 0, False, None, "owner_a", "Items kept elsewhere", None, True),
        (120, "active_users", APP, "v", 0.0, None, 0, 0, 0, False, None, "owner_a", "Users that are active", " SELECT id FROM shop.users;", True),
        (121, "fenced_members", APP, "v", 0.0, ["security_barrier=true"], 0, 0, 0, False, None, "owner_a", None, " SELECT id FROM shop.users;", True),
        (122, "late_sales", APP, "m", 12.0, None, 2, 9001, 191, False, None, "owner_a", None, " SELECT id FROM shop.orders;", True),
        (123, "unfilled_sales", APP, "m", 0.0, None, 2, 0, 0, False, None, "owner_a", None, " SELECT id FROM shop.orders;", False),
        (130, "widgets", EXT, "r", 7.0, None, 2, 0, 0, False, None, "owner_b", None, None, True),
        (150, "geo_points", EXT, "r", 7.0, None, 2, 0, 0, False, None, "owner_b", None, None, True),
        (160, "pg_class", SYS, "r", 7.0, None, 2, 0, 0, False, None, "postgres", None, None, True),
        (170, "order_seq", APP, "S", 1.0, None, 0, 0, 0, False, None, "owner_a", None, None, True),
        (190, "pg_toast_112", 4, "t", 0.0, ["autovacuum_enabled=false"], 2, 0, 0, False, None, "owner_a", None, None, True),
        (191, "pg_toast_122", 4, "t", 0.0, ["autovacuum_enabled=false"], 2, 0, 0, False, None, "owner_a", None, None, True),
        (201, "users_pkey", APP, "i", 0.0, None, 403, 0, 0, False, None, "owner_a", None, None, True),
        (202, "metrics_name_key", APP, "i", 0.0, None, 403, 0, 0, False, None, "owner_a", None, None, True),
        (203, "metrics_value_idx", APP, "i", 0.0, None, 403, 9001, 0, False, None, "owner_a", None, None, True),
        (204, "metrics_broken_idx", APP, "i", 0.0, None, 403, 0, 0, False, None, "owner_a", None, None, True),
        (205, "events_at_idx", APP, "I", 0.0, None, 403, 0, 0, False, None, "owner_a", None, None, True),
        (206, "events_2026_08_at_idx", APP, "i", 0.0, None, 403, 0, 0, True, None, "owner_a", None, None, True),
        (207, "dialled_meters_pkey", APP, "i", 0.0, ["fillfactor=80"], 403, 9001, 0, False, None, "owner_a", None, None, True),
        (208, "unfilled_sales_id_key", APP, "i", 0.0, None, 403, 0, 0, False, None, "owner_a", None, None, True),
    ]),
    "pg_attribute": ("attrelid bigint, attnum int, attname string, atttype string, attnotnull boolean, attisdropped boolean, attfdwoptions array<string>, description string", [
        (101, 1, "id", "bigint", True, False, None, None), (101, 2, "email", "text", False, False, None, "登录邮箱，已脱敏展示"), (101, 3, "created_at", "timestamptz", False, False, None, None), (101, 4, "old", "text", False, True, None, None), (101, -1, "ctid", "tid", True, False, None, None),
        (102, 1, "id", "bigint", True, False, None, None), (102, 2, "parent_id", "bigint", False, False, None, "父级分类，参考 categories 表"), (102, 3, "name", "text", True, False, None, None),
        (103, 1, "id", "bigint", True, False, None, None), (103, 2, "category_id", "bigint", False, False, None, None), (103, 3, "name", "text", True, False, None, "product's name"),
        (104, 1, "id", "bigint", True, False, None, None), (104, 2, "user_id", "bigint", False, False, None, None), (104, 3, "created_by_user_id", "bigint", False, False, None, "see the staff list"), (104, 4, "updated_by", "bigint", False, False, None, "last editor"),
        (104, 5, "status", "integer", False, False, None, "订单状态：0=待处理 1=已完成 2=已取消"), (104, 6, "created_at", "timestamptz", False, False, None, None),
        (105, 1, "id", "bigint", True, False, None, None), (105, 2, "order_id", "bigint", False, False, None, None), (105, 3, "product_id", "bigint", False, False, None, None), (105, 4, "quantity", "integer", False, False, None, None),
        (106, 1, "id", "bigint", True, False, None, None), (106, 2, "order_id", "bigint", False, False, None, "支付关联订单，逻辑关联 shop.orders.id"), (106, 3, "amount", "numeric(12,2)", False, False, None, "  "),
        (107, 1, "id", "bigint", True, False, None, None), (107, 2, "ref_id", "bigint", False, False, None, "关联记录，参见 shop.orders 表"), (107, 3, "action", "text", False, False, None, None),
        (108, 1, "id", "bigint", True, False, None, None), (108, 2, "occurred_at", "timestamptz", True, False, None, None), (108, 3, "payload", "jsonb", False, False, None, None),
        (109, 1, "id", "bigint", True, False, None, None), (109, 2, "occurred_at", "timestamptz", True, False, None, None), (109, 3, "payload", "jsonb", False, False, None, None),
        (110, 1, "id", "bigint", True, False, None, None), (110, 2, "name", "text", True, False, None, None), (110, 3, "value", "numeric", False, False, None, None),
        (111, 1, "id", "integer", True, False, None, None), (111, 2, "hits", "bigint", False, False, None, None),
        (112, 1, "id", "integer", True, False, None, None), (112, 2, "body", "text", False, False, None, None),
        (113, 1, "id", "bigint", True, False, None, None), (113, 2, "occurred_at", "timestamptz", True, False, None, None),
        (114, 1, "id", "bigint", False, False, None, None), (114, 2, "api_token", "text", False, False, ["column_name=tok"], None),
        (120, 1, "id", "bigint", False, False, None, "user id"), (121, 1, "id", "bigint", False, False, None, None), (122, 1, "id", "bigint", False, False, None, None), (123, 1, "id", "bigint", False, False, None, None),
        (130, 1, "id", "bigint", True, False, None, None), (130, 2, "order_id", "bigint", False, False, None, "所属订单，参见 shop.orders 表"),
        (150, 1, "id", "bigint", True, False, None, None),
    ]),
    "pg_attrdef": ("adrelid bigint, adnum int, expr string", [
        (101, 1, "nextval('shop.users_id_seq'::regclass)"), (104, 1, "nextval('order_seq'::regclass)"), (104, 6, "now()"), (104, 5, "0"), (111, 1, "nextval('shop.\"Odd seq\"'::regclass)"),
    ]),
    "pg_index": ("indexrelid bigint, indrelid bigint, indisvalid boolean, definition string", [
        (201, 101, True, "CREATE UNIQUE INDEX users_pkey ON shop.users USING btree (id)"), (202, 110, True, "CREATE UNIQUE INDEX metrics_name_key ON shop.metrics USING btree (name)"),
        (203, 110, True, "CREATE INDEX metrics_value_idx ON shop.metrics USING btree (value) WHERE (value > 0)"), (204, 110, False, "CREATE INDEX metrics_broken_idx ON shop.metrics USING btree (value)"),
        (205, 108, True, "CREATE INDEX events_at_idx ON ONLY shop.events USING btree (occurred_at)"), (206, 109, True, "CREATE INDEX events_2026_08_at_idx ON shop.events_2026_08 USING btree (occurred_at)"),
        (207, 111, True, "CREATE UNIQUE INDEX dialled_meters_pkey ON shop.dialled_meters USING btree (id)"), (208, 123, True, "CREATE UNIQUE INDEX unfilled_sales_id_key ON shop.unfilled_sales USING btree (id)"),
    ]),
    "pg_inherits": ("inhrelid bigint, inhparent bigint", [(109, 108), (206, 205), (113, 109)]),
    "pg_constraint": ("conrelid bigint, conname string, contype string, definition string, conislocal boolean, coninhcount int", [
        (101, "users_pkey", "p", "PRIMARY KEY (id)", True, 0), (101, "users_id_not_null", "n", "NOT NULL id", True, 0), (104, "orders_user_fk", "f", "FOREIGN KEY (user_id) REFERENCES shop.users(id)", True, 0),
        (109, "events_check", "c", "CHECK ((id > 0))", False, 1), (108, "events_check", "c", "CHECK ((id > 0))", True, 0), (109, "events_local_check", "c", "CHECK ((payload IS NOT NULL))", True, 0),
        (110, "metrics_name_key", "u", "UNIQUE (name)", True, 0), (110, "metrics_value_check", "c", "CHECK ((value >= (0)::numeric))", True, 0), (111, "dialled_meters_pkey", "p", "PRIMARY KEY (id)", True, 0),
    ]),
    "pg_trigger": ("oid bigint, tgrelid bigint, tgname string, definition string, tgenabled string, tgisinternal boolean, tgparentid bigint", [
        (401, 110, "metrics_touch", "CREATE TRIGGER metrics_touch BEFORE UPDATE ON shop.metrics FOR EACH ROW EXECUTE FUNCTION shop.noop_trigger()", "D", False, 0),
        (402, 108, "events_touch", "CREATE TRIGGER events_touch BEFORE UPDATE ON shop.events FOR EACH ROW EXECUTE FUNCTION noop_trigger()", "O", False, 0),
        (403, 109, "events_touch_child", "CREATE TRIGGER events_touch_child BEFORE UPDATE ON shop.events_2026_08 FOR EACH ROW EXECUTE PROCEDURE shop.noop_trigger()", "A", False, 402),
        (404, 104, "RI_ConstraintTrigger", "CREATE CONSTRAINT TRIGGER x AFTER UPDATE ON shop.orders EXECUTE FUNCTION pg_catalog.ri()", "O", True, 0),
        (405, 104, "orders_fmt", "CREATE TRIGGER orders_fmt AFTER INSERT ON shop.orders FOR EACH ROW EXECUTE FUNCTION fmt()", "O", False, 0),
    ]),
    "pg_proc": ("oid bigint, proname string, pronamespace bigint, prokind string, identity_args string, proargnames array<string>, result_type string, prolang bigint, prosrc string, definition string, description string, proowner string, prosecdef boolean", [
        (351, "noop_trigger", APP, "f", "", None, "trigger", 13, "BEGIN RETURN NEW; END", "CREATE OR REPLACE FUNCTION shop.noop_trigger()\n RETURNS trigger\n", "Does nothing", "owner_a", False),
        (352, "geo_dist", EXT, "f", "", None, "double precision", 14, "SELECT 1", "CREATE OR REPLACE FUNCTION shop_ext.geo_dist()\n", None, "owner_b", False),
        (353, "plain_fn", APP, "f", "x integer", ["x"], "integer", 14, "SELECT x", "CREATE OR REPLACE FUNCTION shop.plain_fn(x integer)\n", None, "owner_a", False),
        (354, "fmt", APP, "f", "x integer", ["x"], "text", 14, "SELECT x::text", "CREATE OR REPLACE FUNCTION shop.fmt(x integer)\n", "Formats", "owner_a", True),
        (355, "fmt", APP, "f", "x text", ["x"], "text", 14, "SELECT x", "CREATE OR REPLACE FUNCTION shop.fmt(x text)\n", None, "owner_a", False),
        (356, "total", APP, "a", "integer", None, "integer", 14, "", "", None, "owner_a", False),
    ]),
    "pg_foreign_server": ("oid bigint, srvname string", [(800, "warehouse")]),
    "pg_foreign_table": ("ftrelid bigint, ftserver bigint, ftoptions array<string>", [(114, 800, ["table_name=items", "note=it's"])]),
    # Facts of the privilege audit.
    "roles": ("rolname string, super boolean, createdb boolean, bypassrls boolean, replication boolean, createrole boolean", [("reader", False, True, False, False, False), ("writers", False, False, False, False, False), ("admins", False, False, False, False, True), ("owner_a", False, False, False, False, False), ("owner_b", False, False, False, False, False), ("clean", False, False, False, False, False), ("root", True, False, False, False, False)]),
    "members": ("role string, member string", [("writers", "reader"), ("admins", "writers")]),
    "in_scope": ("nspname string", [("shop",)]),
    "acl": ("object_kind string, schema string, object_id string, grantee string, privilege string", [
        ("schema", "shop", "shop", "reader", "USAGE"), ("schema", "shop", "shop", "PUBLIC", "CREATE"), ("schema", "shop_ext", "shop_ext", "writers", "USAGE"), ("schema", "public", "public", "PUBLIC", "USAGE"),
        ("table", "shop", "users", "reader", "SELECT"), ("table", "shop", "users", "writers", "UPDATE"), ("table", "shop", "orders", "PUBLIC", "INSERT"), ("table", "shop_ext", "widgets", "admins", "SELECT"), ("table", "shop", "metrics", "owner_b", "DELETE"),
        ("sequence", "shop", "order_seq", "reader", "USAGE"), ("database", None, "app", "PUBLIC", "TEMP"), ("database", None, "app", "admins", "CREATE"), ("database", None, "other", "PUBLIC", "CONNECT"), ("database", None, "app", "reader", "CONNECT"),
        ("function", "shop", "fmt(x integer)", "PUBLIC", "EXECUTE"), ("function", "shop_ext", "dblink_exec(text)", "reader", "EXECUTE"), ("server", None, "warehouse", "PUBLIC", "USAGE"),
    ]),
    "secdef_functions": ("schema string, signature string, owner string, secdef boolean", [("shop", "fmt(x integer)", "owner_a", True), ("shop_ext", "dblink_exec(text)", "owner_b", True), ("shop", "mine()", "reader", False)]),
    "default_acl": ("schema string, owner string, objtype string, grantee string", [(None, "owner_a", "r", "PUBLIC"), ("shop", "owner_a", "r", "reader"), ("shop_ext", "owner_b", "r", "reader"), ("shop", "owner_a", "S", "someone")]),
}

#: (source, target, ignored) of confirmed relationships, the last two of objects that are gone or ignored.
CONFIRMED = [("shop.order_items.order_id", "shop.orders.id", False), ("shop.orders.user_id", "shop.users.id", True), ("shop.gone.x_id", "shop.users.id", False)]
FACTS["confirmed"] = ("source string, target string, ignored boolean", CONFIRMED)


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def facts(spark: SparkSession) -> dict[str, DataFrame]:
    """The facts as local relations, whose sizes the planner knows: their joins are broadcast joins."""
    out = {}
    for name, (columns, rows) in FACTS.items():
        fields = [c.strip().split(" ") for c in columns.split(",")]
        out[name] = spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], _ARROW[k]) for i, (_, k) in enumerate(fields)], names=[f for f, _ in fields]))
    return out


def _literal(value: Any, kind: str) -> str:
    duck = {"string": "VARCHAR", "double": "DOUBLE", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}[kind]
    if value is None:
        return f"CAST(NULL AS {duck})"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, list):
        return f"CAST([{', '.join(_literal(v, 'string') for v in value)}] AS VARCHAR[])"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return f"CAST({value} AS {duck})"


def with_facts(body: str, *names: str) -> str:
    """DuckDB text of ``body`` with the named fact tables before it."""
    parts = []
    for name in names:
        columns, rows = FACTS[name]
        fields = [c.strip().split(" ") for c in columns.split(",")]
        values = ",\n".join("(" + ", ".join(_literal(v, k) for v, (_, k) in zip(row, fields)) + ")" for row in rows)
        parts.append(f"{name}({', '.join(f for f, _ in fields)}) AS (VALUES {values})")
    return "WITH RECURSIVE " + ",\n".join(parts) + (", " + body.lstrip()[5:] if body.lstrip().upper().startswith("WITH ") else "\n" + body)
