"""Collection: system-table facts to schemas, tables, columns and the rest, and to one nested document.

Every part is a flat DataFrame of joins and filters; arrays are nested last, by
one aggregation a part, so nothing is looked up row by row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Facts = Mapping[str, DataFrame]

TABLE_KINDS = {"r": "table", "p": "partitioned_table", "f": "foreign_table"}
VIEW_KINDS = {"v": "view", "m": "materialized_view"}
VERSION = 1


def not_system(name: Column) -> Column:
    return ~name.isin("pg_catalog", "information_schema") & ~name.like("pg\\_%")


def in_scope(name: Column, scope: str) -> Column:
    """``scope``: names with commas between; empty is all."""
    names = [s.strip() for s in scope.split(",") if s.strip()]
    return name.isin(*names) if names else F.lit(True)


def ext_relations(f: Facts) -> DataFrame:
    """What extensions own."""
    return f["pg_depend"].filter("refclassid = 'pg_extension' AND deptype = 'e'").join(f["pg_extension"], F.col("refobjid") == F.col("oid")).select("classid", "objid")


def own(f: Facts, rows: DataFrame, kind: str) -> DataFrame:
    """``rows`` (with oid) that no extension owns."""
    return rows.join(ext_relations(f).filter(F.col("classid") == kind).select(F.col("objid").alias("oid")), "oid", "left_anti")


def schemas(f: Facts, scope: str = "") -> DataFrame:
    """User schemas in scope that hold a table, view or function of their own."""
    names = f["pg_namespace"].filter(not_system(F.col("nspname")) & in_scope(F.col("nspname"), scope))
    held = own(f, of_kinds(f, TABLE_KINDS | VIEW_KINDS), "pg_class").select(F.col("relnamespace").alias("oid"))
    held = held.unionByName(own(f, f["pg_proc"].filter("prokind = 'f'"), "pg_proc").select(F.col("pronamespace").alias("oid")))
    return names.join(held, "oid", "left_semi").select(F.col("oid").alias("schema_oid"), F.col("nspname").alias("schema"), F.col("description").alias("comment"))


def _mapped(column: str, kinds: Mapping[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for code, name in kinds.items():
        out = F.when(F.col(column) == code, name).otherwise(out)
    return out


def of_kinds(f: Facts, kinds: Mapping[str, str]) -> DataFrame:
    return f["pg_class"].filter(F.col("relkind").isin(*kinds))


def live_columns(f: Facts) -> DataFrame:
    """Columns that users made and didn't drop."""
    return f["pg_attribute"].filter("attnum > 0 AND NOT attisdropped")


def valid_indexes(f: Facts) -> DataFrame:
    return f["pg_index"].filter("indisvalid")


def real_constraints(f: Facts) -> DataFrame:
    """All but NOT NULL, which a column tells itself."""
    return f["pg_constraint"].filter("contype <> 'n'")


def user_triggers(f: Facts) -> DataFrame:
    return f["pg_trigger"].filter("NOT tgisinternal")


def is_local() -> Column:
    """Whether a constraint is the table's own."""
    return F.col("conislocal") & (F.col("coninhcount") == 0)


def row_estimate() -> Column:
    """Estimated rows; never analysed is none."""
    return F.greatest(F.col("reltuples"), F.lit(0.0)).cast("bigint")


def zero_is_none(oid: str) -> Column:
    return F.nullif(F.col(oid), F.lit(0))


def _relations(f: Facts, scope: str, kinds: Mapping[str, str]) -> DataFrame:
    rel = own(f, of_kinds(f, kinds), "pg_class")
    return rel.join(schemas(f, scope).drop("comment"), F.col("relnamespace") == F.col("schema_oid"))


def options(f: Facts) -> DataFrame:
    """(oid, options): a relation's storage options and, prefixed, those of its overflow table, sorted."""
    rel, toast = f["pg_class"], f["pg_class"].select(F.col("oid").alias("reltoastrelid"), F.col("reloptions").alias("toast"))
    mine = rel.select("oid", F.explode("reloptions").alias("option"))
    theirs = rel.filter("reltoastrelid <> 0").select("oid", "reltoastrelid").join(toast, "reltoastrelid").select("oid", F.explode("toast").alias("o")).select("oid", F.concat(F.lit("toast."), "o").alias("option"))
    return mine.unionByName(theirs).groupBy("oid").agg(F.array_sort(F.collect_list("option")).alias("options"))


def foreign(f: Facts) -> DataFrame:
    """(oid, server, foreign_options), options in catalog order."""
    joined = f["pg_foreign_table"].join(f["pg_foreign_server"], F.col("ftserver") == F.col("oid"))
    return joined.select(F.col("ftrelid").alias("oid"), F.col("srvname").alias("server"), F.col("ftoptions").alias("foreign_options"))


def partition_of(f: Facts) -> DataFrame:
    """(oid, partition_of) of partitions."""
    parents = f["pg_class"].select(F.col("oid").alias("inhparent"), F.col("relname").alias("partition_of"))
    children = f["pg_class"].filter("relispartition AND relkind IN ('r', 'p', 'f')").select(F.col("oid").alias("inhrelid"))
    return f["pg_inherits"].join(parents, "inhparent").join(children, "inhrelid").select(F.col("inhrelid").alias("oid"), "partition_of")


def _named(f: Facts, rows: DataFrame) -> DataFrame:
    """Add access_method, tablespace and options; an oid of 0 is none."""
    am = f["pg_am"].select(F.col("oid").alias("_am"), F.col("amname").alias("access_method"))
    space = f["pg_tablespace"].select(F.col("oid").alias("_ts"), F.col("spcname").alias("tablespace"))
    out = rows.withColumn("_am", zero_is_none("relam")).withColumn("_ts", zero_is_none("reltablespace"))
    return out.join(am, "_am", "left").join(space, "_ts", "left").join(options(f), "oid", "left").withColumn("options", F.coalesce("options", F.array().cast("array<string>")))


def tables(f: Facts, scope: str = "") -> DataFrame:
    rel = _named(f, _relations(f, scope, TABLE_KINDS)).join(foreign(f), "oid", "left").join(partition_of(f), "oid", "left")
    return rel.select(
        "oid", "schema", F.col("relname").alias("name"), _mapped("relkind", TABLE_KINDS).alias("kind"), F.col("description").alias("comment"), row_estimate().alias("reltuples"),
        "options", "access_method", "server", "foreign_options", "tablespace", F.col("partkey").alias("partition_key"), "partition_of",
    )


def columns(f: Facts, scope: str = "", kinds: Mapping[str, str] = TABLE_KINDS) -> DataFrame:
    live = live_columns(f)
    default = f["pg_attrdef"].select(F.col("adrelid").alias("attrelid"), F.col("adnum").alias("attnum"), F.col("expr").alias("default"))
    rel = _relations(f, scope, kinds).select(F.col("oid").alias("attrelid"), "schema", F.col("relname").alias("table"))
    number = F.row_number().over(Window.partitionBy("attrelid").orderBy("attnum"))
    return live.join(rel, "attrelid").join(default, ["attrelid", "attnum"], "left").select(
        F.col("attrelid").alias("oid"), "schema", "table", F.col("attnum").alias("position"), F.col("attname").alias("name"), F.col("atttype").alias("type"), "default", (~F.col("attnotnull")).alias("nullable"),
        F.col("description").alias("comment"), F.coalesce("attfdwoptions", F.array().cast("array<string>")).alias("fdw_options"), number.alias("ordinal"),
    )


def indexes(f: Facts, scope: str = "", kinds: Mapping[str, str] = TABLE_KINDS) -> DataFrame:
    """Valid indexes; inherited_from is the index that one of a partition belongs to."""
    rel = _relations(f, scope, kinds).select(F.col("oid").alias("indrelid"), "schema", F.col("relname").alias("table"))
    index = _named(f, f["pg_class"].filter("relkind IN ('i', 'I')"))
    parent = f["pg_class"].filter("relkind IN ('i', 'I')").select(F.col("oid").alias("inhparent"), F.col("relname").alias("inherited_from"))
    inherited = f["pg_inherits"].join(parent, "inhparent").select(F.col("inhrelid").alias("oid"), "inherited_from")
    return valid_indexes(f).join(rel, "indrelid").join(index, F.col("indexrelid") == F.col("oid")).join(inherited, "oid", "left").select(
        F.col("indrelid").alias("oid"), "schema", "table", F.col("relname").alias("name"), "definition", "inherited_from", "tablespace", "options"
    )


def constraints(f: Facts, scope: str = "") -> DataFrame:
    rel = _relations(f, scope, TABLE_KINDS).select(F.col("oid").alias("conrelid"), "schema", F.col("relname").alias("table"))
    return real_constraints(f).join(rel, "conrelid").select(
        F.col("conrelid").alias("oid"), "schema", "table", F.col("conname").alias("name"), F.col("contype").alias("type"), "definition", is_local().alias("is_local")
    )


def triggers(f: Facts, scope: str = "") -> DataFrame:
    rel = _relations(f, scope, TABLE_KINDS).select(F.col("oid").alias("tgrelid"), "schema", F.col("relname").alias("table"))
    parent = f["pg_trigger"].select(F.col("oid").alias("tgparentid"), F.col("tgname").alias("inherited_from"))
    return user_triggers(f).drop("oid").join(rel, "tgrelid").join(parent, "tgparentid", "left").select(
        F.col("tgrelid").alias("oid"), "schema", "table", F.col("tgname").alias("name"), "definition", F.col("tgenabled").alias("enabled"), "inherited_from"
    )


def views(f: Facts, scope: str = "") -> DataFrame:
    return _named(f, _relations(f, scope, VIEW_KINDS)).select(
        "oid", "schema", F.col("relname").alias("name"), _mapped("relkind", VIEW_KINDS).alias("kind"), F.col("description").alias("comment"), F.col("viewdef").alias("definition"), "options", "access_method",
        F.col("relispopulated").alias("populated"), "tablespace",
    )


def functions(f: Facts, scope: str = "") -> DataFrame:
    proc = own(f, f["pg_proc"].filter("prokind = 'f'"), "pg_proc")
    language = f["pg_language"].select(F.col("oid").alias("prolang"), F.col("lanname").alias("language"))
    return proc.join(schemas(f, scope).drop("comment"), F.col("pronamespace") == F.col("schema_oid")).join(language, "prolang").select(
        "schema", F.col("proname").alias("name"), "identity_args", F.coalesce("proargnames", F.array().cast("array<string>")).alias("arg_names"), "result_type", "language", F.col("description").alias("comment"),
        F.col("prosrc").alias("source"), "definition",
    )


def _nested(rows: DataFrame, key: list[str], order: list[str], fields: list[str], name: str) -> DataFrame:
    """One array of structs a key, ordered, in one aggregation."""
    item = F.struct(F.struct(*order).alias("_order"), F.struct(*fields).alias("_item"))
    return rows.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["_item"]).alias(name))


def document(f: Facts, scope: str = "", database: str = "app") -> DataFrame:
    """The nested document: one row, one struct a schema."""
    key = ["oid"]
    cols = lambda kinds, fields: _nested(columns(f, scope, kinds), key, ["position"], fields, "columns")
    t = tables(f, scope)
    for part in (
        cols(TABLE_KINDS, ["position", "name", "type", "default", "nullable", "comment", "fdw_options"]),
        _nested(indexes(f, scope), key, ["name"], ["name", "definition", "inherited_from", "tablespace", "options"], "indexes"),
        _nested(constraints(f, scope), key, ["name"], ["name", "type", "definition", "is_local"], "constraints"),
        _nested(triggers(f, scope), key, ["name"], ["name", "definition", "enabled", "inherited_from"], "triggers"),
    ):
        t = t.join(part, "oid", "left")
    t = t.withColumn("foreign", F.when(F.col("server").isNotNull(), F.struct("server", F.col("foreign_options").alias("options"))))
    fields = ["name", "kind", "comment", "reltuples", "options", "access_method", "foreign", "tablespace", "partition_key", "partition_of", "columns", "indexes", "constraints", "triggers"]
    for part in ("columns", "indexes", "constraints", "triggers"):
        t = t.withColumn(part, F.coalesce(part, F.array().cast(t.schema[part].dataType)))
    v = views(f, scope).join(cols(VIEW_KINDS, ["position", "name", "type", "nullable", "comment"]), "oid", "left")
    v = v.join(_nested(indexes(f, scope, VIEW_KINDS), key, ["name"], ["name", "definition", "options", "tablespace"], "indexes"), "oid", "left")
    for part in ("columns", "indexes"):
        v = v.withColumn(part, F.coalesce(part, F.array().cast(v.schema[part].dataType)))
    view_fields = ["name", "kind", "comment", "definition", "columns", "options", "access_method", "populated", "tablespace", "indexes"]
    fn_fields = ["name", "identity_args", "arg_names", "result_type", "language", "comment", "source", "definition"]
    s = schemas(f, scope).drop("schema_oid")
    parts = {
        "tables": _nested(t, ["schema"], ["name"], fields, "tables"),
        "views": _nested(v, ["schema"], ["name"], view_fields, "views"),
        "functions": _nested(functions(f, scope), ["schema"], ["name", "identity_args"], fn_fields, "functions"),
    }
    for name, part in parts.items():
        s = s.join(part, "schema", "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    all_ = s.agg(F.array_sort(F.collect_list(F.struct("schema", "comment", "tables", "views", "functions"))).alias("schemas"))
    asked = [x.strip() for x in scope.split(",") if x.strip()]
    requested = F.array(*[F.lit(x) for x in asked]) if asked else F.lit(None).cast("array<string>")
    return all_.select(F.lit(VERSION).alias("collect_version"), F.current_timestamp().cast("string").alias("collected_at"), F.lit(database).alias("database"), requested.alias("requested_schemas"), "schemas")
