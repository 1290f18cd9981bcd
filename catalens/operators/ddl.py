"""Statements that would make the collected objects again, as text columns.

Each part of a table's text (sequences, the table, constraints, indexes,
triggers, comments) is one grouped DataFrame of lines; a table's text is the
concatenation of its parts. Nothing is rendered row by row outside of Spark.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.functions import text as T
from catalens.operators import semantics

Parts = Mapping[str, DataFrame]
# The statement that brings back a trigger's state.
TRIGGER_STATES = {"D": "DISABLE TRIGGER", "R": "ENABLE REPLICA TRIGGER", "A": "ENABLE ALWAYS TRIGGER"}
KEY = ["schema", "table"]


def _q(*names: str) -> Column:
    return F.concat_ws(".", *[T.quote_ident(F.col(n)) for n in names])


def _lines(rows: DataFrame, order: list[str], line: Column, name: str, sep: str = "\n") -> DataFrame:
    """One text a table of its rows' lines in order."""
    item = rows.withColumn("_line", line).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(*order, "_line"))).alias("_all"))
    return item.select(*KEY, F.array_join(F.transform("_all", lambda x: x["_line"]), sep).alias(name))


def column_line() -> Column:
    return F.concat(F.lit("  "), F.concat_ws(
        " ", T.quote_ident(F.col("name")), "type", F.when(F.size("fdw_options") > 0, F.concat(F.lit("OPTIONS ("), T.wrapper_options(F.col("fdw_options")), F.lit(")"))),
        F.when(F.coalesce("default", F.lit("")) != "", F.concat(F.lit("DEFAULT "), "default")), F.when(~F.coalesce("nullable", F.lit(False)), F.lit("NOT NULL")),
    ))


def _space(name: str = "name") -> Column:
    """The statement that moves an index to its tablespace, or null."""
    return F.when(F.coalesce("tablespace", F.lit("")) != "", F.concat(F.lit("ALTER INDEX "), _q("schema", name), F.lit(" SET TABLESPACE "), T.quote_ident(F.col("tablespace")), F.lit(";")))


def constraint_lines(constraints: DataFrame, indexes: DataFrame) -> DataFrame:
    backing = indexes.select(*KEY, "name", "tablespace", "options", F.lit(True).alias("_backed"))
    rows = constraints.join(backing, [*KEY, "name"], "left").withColumn("_backed", F.coalesce("_backed", F.lit(False)) & F.col("type").isin("p", "u", "x"))
    add = F.concat(F.lit("ALTER TABLE "), _q(*KEY), F.lit(" ADD CONSTRAINT "), T.quote_ident(F.col("name")), F.lit(" "), "definition", F.lit(";"))
    options = F.when(F.size("options") > 0, F.concat(F.lit("ALTER INDEX "), _q("schema", "name"), F.lit(" SET ("), T.storage_options(F.col("options")), F.lit(");")))
    return _lines(rows, ["name"], F.concat_ws("\n", add, F.when(F.col("_backed"), _space()), F.when(F.col("_backed"), options)), "constraints")


def index_lines(indexes: DataFrame, constraints: DataFrame) -> DataFrame:
    """Indexes that no constraint brings and no parent has."""
    backed = constraints.filter("type IN ('p', 'u', 'x')").select(*KEY, "name")
    rows = indexes.filter("inherited_from IS NULL").join(backed, [*KEY, "name"], "left_anti")
    return _lines(rows, ["name"], F.concat_ws("\n", F.concat("definition", F.lit(";")), _space()), "indexes")


def trigger_lines(triggers: DataFrame, functions: DataFrame) -> DataFrame:
    known = functions.select(F.col("schema").alias("_fs"), F.col("name").alias("_fn")).distinct().withColumn("_known", F.lit(True))
    raw = T.trigger_function(F.col("definition"))
    rows = triggers.withColumn("_raw", raw).withColumn("_fs", F.when(F.contains("_raw", F.lit(".")), F.substring_index("_raw", ".", 1)).otherwise(F.col("schema"))).withColumn("_fn", T.local_name(F.col("_raw")))
    rows = rows.join(known, ["_fs", "_fn"], "left")
    called = F.when(F.col("_known"), T.function_link(F.col("schema"), F.col("_fs"), F.col("_fn"))).otherwise(F.coalesce("_raw", F.lit("unknown")))
    verb = F.lit(None).cast("string")
    for code, words in TRIGGER_STATES.items():
        verb = F.when(F.col("enabled") == code, words).otherwise(verb)
    state = F.when(verb.isNotNull(), F.concat(F.lit("ALTER TABLE "), _q(*KEY), F.lit(" "), verb, F.lit(" "), T.quote_ident(F.col("name")), F.lit(";")))
    return _lines(rows, ["name"], F.concat_ws("\n", F.concat(F.lit("-- calls "), called), F.concat("definition", F.lit(";")), state), "triggers")


def _comment(kind: str, target: Column, comment: Column) -> Column:
    said = F.trim(F.coalesce(comment, F.lit("")))
    return F.when(said != "", F.concat(F.lit(f"COMMENT ON {kind} "), target, F.lit(" IS "), T.sql_literal(said), F.lit(";")))


def column_comments(columns: DataFrame) -> DataFrame:
    line = _comment("COLUMN", _q("schema", "table", "name"), F.col("comment"))
    return _lines(columns.withColumn("_c", line).filter("_c IS NOT NULL"), ["position"], F.col("_c"), "comments")


def child_lines(p: Parts) -> DataFrame:
    """Notes on folded partitions: their names, and what is their own."""
    kids = semantics.folded(p["tables"]).filter("folded")
    own_index = p["indexes"].filter("inherited_from IS NULL").select(*KEY, F.concat(F.lit("--   index "), "name", F.lit(": "), "definition").alias("_d"), F.lit(0).alias("_o"))
    own_check = p["constraints"].filter("is_local").select(*KEY, F.concat(F.lit("--   constraint "), "name", F.lit(": "), "definition").alias("_d"), F.lit(1).alias("_o"))
    facts = kids.select("schema", F.col("name").alias("table"), F.explode(F.array_compact(F.array(
        F.when(F.size("options") > 0, F.concat(F.lit("--   options "), F.array_join("options", ", "))), F.when(F.col("tablespace").isNotNull(), F.concat(F.lit("--   tablespace "), "tablespace")),
        F.when(F.coalesce("access_method", F.lit("heap")) != "heap", F.concat(F.lit("--   access method "), "access_method")), F.when(F.col("server").isNotNull(), F.concat(F.lit("--   server "), "server")),
    ))).alias("_d"), F.lit(2).alias("_o"))
    details = own_index.unionByName(own_check).unionByName(facts).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("_o", "_d"))).alias("_all"))
    named = kids.select("schema", F.col("name").alias("table"), "partition_of").join(details, KEY, "left")
    text = F.when(F.col("_all").isNotNull(), F.concat(F.lit("-- "), F.col("table"), F.lit("\n"), F.array_join(F.transform("_all", lambda x: x["_d"]), "\n")))
    rows = named.withColumn("_text", text).groupBy("schema", F.col("partition_of").alias("table"))
    out = rows.agg(F.array_sort(F.collect_list(F.struct(F.col("table").alias("n"), F.col("_text").alias("t")))).alias("_kids"))
    head = F.concat(F.lit("-- partitions ("), F.size("_kids"), F.lit("): "), F.array_join(F.transform("_kids", lambda x: x["n"]), ", "))
    return out.select(*KEY, F.concat_ws("\n", head, F.array_join(F.transform("_kids", lambda x: x["t"]), "\n")).alias("children"))


def table_ddl(p: Parts) -> DataFrame:
    """(schema, name, ddl) of every table that stands for itself."""
    t = semantics.top_level(p["tables"]).withColumn("table", F.col("name"))
    c = p["columns"]
    seq = semantics.sequences(c)
    parts = [
        _lines(seq, ["position"], F.concat(F.lit("CREATE SEQUENCE IF NOT EXISTS "), "sequence", F.lit(";")), "sequences"), _lines(c, ["position"], column_line(), "body", ",\n"), constraint_lines(p["constraints"], p["indexes"]),
        index_lines(p["indexes"], p["constraints"]), trigger_lines(p["triggers"], p["functions"]), column_comments(c), child_lines(p),
    ]
    for part in parts:
        t = t.join(part, KEY, "left")
    is_foreign = F.col("kind") == "foreign_table"
    tail = F.when(is_foreign, F.concat(F.lit(" SERVER "), T.quote_ident(F.col("server")), F.when(F.size("foreign_options") > 0, F.concat(F.lit(" OPTIONS ("), T.wrapper_options(F.col("foreign_options")), F.lit(")"))).otherwise(F.lit("")))).otherwise(F.concat(
        F.coalesce(F.concat(F.lit(" PARTITION BY "), "partition_key"), F.lit("")), F.when(F.coalesce("access_method", F.lit("heap")) != "heap", F.concat(F.lit(" USING "), T.quote_ident(F.col("access_method")))).otherwise(F.lit("")),
        F.when(F.size("options") > 0, F.concat(F.lit(" WITH ("), T.storage_options(F.col("options")), F.lit(")"))).otherwise(F.lit("")), F.coalesce(F.concat(F.lit(" TABLESPACE "), T.quote_ident(F.col("tablespace"))), F.lit("")),
    ))
    create = F.concat(F.when(is_foreign, F.lit("CREATE FOREIGN TABLE ")).otherwise(F.lit("CREATE TABLE ")), _q(*KEY), F.lit(" (\n"), F.coalesce("body", F.lit("")), F.lit("\n)"), tail, F.lit(";"))
    note = F.when(F.col("note_parent").isNotNull(), F.concat(F.lit("-- partition of "), "note_parent", F.lit(", which is no top-level table of this schema")))
    rows = F.concat(F.lit("-- rows, by order of magnitude: "), T.row_label(F.col("reltuples")), F.when(F.col("kind") == "partitioned_table", F.lit(" (without partitions)")).otherwise(F.lit("")))
    text = F.concat_ws("\n\n", F.concat_ws("\n", note, rows), F.when(~is_foreign, F.col("sequences")), create, "constraints", "indexes", "triggers", F.concat_ws("\n", _comment("TABLE", _q(*KEY), F.col("comment")), "comments"), "children")
    return t.select("schema", "name", F.concat(F.regexp_replace(text, "\n{3,}", "\n\n"), F.lit("\n")).alias("ddl"))


def view_ddl(views: DataFrame, columns: DataFrame, indexes: DataFrame) -> DataFrame:
    mat = F.col("kind") == "materialized_view"
    v = views.withColumn("table", F.col("name")).join(_lines(indexes, ["name"], F.concat_ws("\n", F.concat("definition", F.lit(";")), _space()), "index_lines"), KEY, "left").join(column_comments(columns), KEY, "left")
    kind = F.when(mat, F.lit("MATERIALIZED VIEW")).otherwise(F.lit("VIEW"))
    head = F.concat(
        F.lit("CREATE "), kind, F.lit(" "), _q(*KEY), F.when(mat & (F.coalesce("access_method", F.lit("heap")) != "heap"), F.concat(F.lit(" USING "), T.quote_ident(F.col("access_method")))).otherwise(F.lit("")),
        F.when(F.size("options") > 0, F.concat(F.lit(" WITH ("), T.storage_options(F.col("options")), F.lit(")"))).otherwise(F.lit("")), F.when(mat & F.col("tablespace").isNotNull(), F.concat(F.lit(" TABLESPACE "), T.quote_ident(F.col("tablespace")))).otherwise(F.lit("")), F.lit(" AS"),
    )
    body = F.when(mat & ~F.col("populated"), F.concat(F.regexp_replace(F.rtrim("definition"), ";+$", ""), F.lit("\nWITH NO DATA;"))).otherwise(F.col("definition"))
    own = F.when(mat, _comment("MATERIALIZED VIEW", _q(*KEY), F.col("comment"))).otherwise(_comment("VIEW", _q(*KEY), F.col("comment")))
    said = F.concat_ws("\n", own, "comments")
    return v.select("schema", "name", F.concat(F.concat_ws("\n", head, body, F.when(mat, F.col("index_lines"))), F.when(said != "", F.concat(F.lit("\n\n"), said)).otherwise(F.lit("")), F.lit("\n")).alias("ddl"))


def function_ddl(functions: DataFrame, triggers: DataFrame) -> DataFrame:
    """(schema, name, identity_args, ddl): the definition, its comment and the triggers that call it."""
    calls = semantics.trigger_functions(triggers, functions).filter("identity_args IS NOT NULL")
    used = calls.groupBy(F.col("function_schema").alias("schema"), F.col("function").alias("name"), "identity_args").agg(F.array_sort(F.collect_set("definition")).alias("used"))
    f = functions.join(used, ["schema", "name", "identity_args"], "left")
    said = _comment("FUNCTION", F.concat(_q("schema", "name"), F.lit("("), "identity_args", F.lit(")")), F.col("comment"))
    by = F.concat(F.lit("-- called by triggers:\n"), F.coalesce(F.array_join(F.transform("used", T.comment_lines), "\n"), F.lit("-- (none)")))
    return f.select("schema", "name", "identity_args", F.concat(F.concat_ws("\n\n", F.concat(F.regexp_replace("definition", "\n+$", ""), F.lit(";")), said, by), F.lit("\n")).alias("ddl"))


def schema_index(p: Parts) -> DataFrame:
    """(schema, kind, name, file, note): what a schema's index lists."""
    kids = semantics.children_counts(p["tables"])
    t = semantics.top_level(p["tables"]).join(kids, ["schema", "name"]).select("schema", F.lit("table").alias("kind"), "name", F.concat(F.lit("tables/"), "name", F.lit(".sql")).alias("file"), F.concat_ws("; ", F.when(F.trim(F.coalesce("comment", F.lit(""))) != "", T.escape_cell(F.col("comment"))), T.row_label(F.col("reltuples")), F.when(F.col("children") > 0, F.concat("children", F.lit(" partitions")))).alias("note"))
    v = p["views"].select("schema", F.lit("view").alias("kind"), "name", F.concat(F.lit("views/"), "name", F.lit(".sql")).alias("file"), F.coalesce(T.escape_cell(F.col("comment")), F.lit("")).alias("note"))
    f = p["functions"].groupBy("schema", "name").agg(F.count("*").alias("n")).select("schema", F.lit("function").alias("kind"), "name", F.concat(F.lit("functions/"), "name", F.lit(".sql")).alias("file"), F.concat("n", F.lit(" overloads")).alias("note"))
    return t.unionByName(v).unionByName(f)
