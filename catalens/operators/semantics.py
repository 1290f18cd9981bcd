"""What comments and names say: relations, enumerations, sensitive columns, gaps and partition folding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalens.functions import text as T


def folded(tables: DataFrame) -> DataFrame:
    """Add ``folded``: the table is a partition of a top-level table of its schema and goes with it.

    A partition of a partition, or of a table elsewhere, stands for itself; ``note_parent`` names its parent.
    """
    has = F.col("partition_of").isNotNull() & (F.col("partition_of") != "")
    top = tables.filter(~has).select("schema", F.col("name").alias("partition_of"), F.lit(True).alias("_top"))
    out = tables.join(top, ["schema", "partition_of"], "left").withColumn("folded", has & F.coalesce("_top", F.lit(False)))
    return out.withColumn("note_parent", F.when(has & ~F.col("folded"), F.col("partition_of"))).drop("_top")


def top_level(tables: DataFrame) -> DataFrame:
    return folded(tables).filter(~F.col("folded"))


def top_columns(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Columns of tables that stand for themselves."""
    return columns.join(top_level(tables).select("schema", F.col("name").alias("table")), ["schema", "table"], "left_semi")


def qualified(schema: str = "schema", table: str = "table", name: str = "name") -> Column:
    return F.concat_ws(".", schema, table, name)


def annotated(cols: DataFrame) -> DataFrame:
    """(source, target) that comments annotate."""
    return cols.select(qualified().alias("source"), F.explode(T.relations(F.col("comment"))).alias("target")).distinct()


def enums(cols: DataFrame) -> DataFrame:
    rows = cols.select(qualified().alias("column"), F.explode(T.enum_items(F.col("comment"))).alias("e"))
    return rows.select("column", F.col("e.value").alias("value"), F.col("e.meaning").alias("meaning")).distinct()


def sensitive(cols: DataFrame) -> DataFrame:
    return cols.filter(T.is_sensitive(F.col("name"))).select(qualified().alias("column"), T.declared_safe(F.col("comment")).alias("declared_safe")).distinct()


def gaps(tables: DataFrame, columns: DataFrame, functions: DataFrame) -> DataFrame:
    """(kind, name) of tables, columns and functions without a comment and of sensitive columns not declared safe."""
    bare = F.trim(F.coalesce("comment", F.lit(""))) == ""
    cols = top_columns(tables, columns)
    parts = [
        top_level(tables).filter(bare).select(F.lit("table").alias("kind"), F.concat_ws(".", "schema", "name").alias("name")),
        cols.filter(bare).select(F.lit("column").alias("kind"), qualified().alias("name")),
        functions.filter(bare).select(F.lit("function").alias("kind"), F.concat(F.concat_ws(".", "schema", "name"), F.lit("("), "identity_args", F.lit(")")).alias("name")),
        sensitive(cols).filter(~F.col("declared_safe")).select(F.lit("sensitive").alias("kind"), F.col("column").alias("name")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def merged_relations(marked: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Annotated relations and the confirmed ones that aren't ignored."""
    return marked.unionByName(confirmed.filter(~F.col("ignored")).select("source", "target")).distinct()


def diagram(pairs: DataFrame) -> DataFrame:
    """A line for each pair of tables, with the first of its columns."""
    part = lambda c, i: F.split(c, r"\.")[i]
    node = lambda c: F.concat_ws("_", part(c, 0), part(c, 1))
    rows = pairs.select(node("source").alias("from_node"), node("target").alias("to_node"), part("source", 2).alias("column"))
    return rows.groupBy("from_node", "to_node").agg(F.min("column").alias("label")).withColumn("line", F.concat(F.lit("    "), "to_node", F.lit(" ||--o{ "), "from_node", F.lit(' : "'), "label", F.lit('"')))


def diagram_collisions(pairs: DataFrame) -> DataFrame:
    """Node names that stand for more than one table."""
    ends = pairs.select(F.explode(F.array("source", "target")).alias("c")).select(F.split("c", r"\.").alias("p"))
    tables = ends.select(F.concat_ws("_", F.col("p")[0], F.col("p")[1]).alias("node"), F.concat_ws(".", F.col("p")[0], F.col("p")[1]).alias("table"))
    return tables.groupBy("node").agg(F.countDistinct("table").alias("n_tables")).filter("n_tables > 1")


def own_details(tables: DataFrame, indexes: DataFrame, constraints: DataFrame) -> DataFrame:
    """Folded partitions that have something of their own to tell."""
    mine = indexes.filter("inherited_from IS NULL").select("schema", F.col("table").alias("name")).unionByName(constraints.filter("is_local").select("schema", F.col("table").alias("name"))).distinct().withColumn("_own", F.lit(True))
    kids = folded(tables).filter("folded").join(mine, ["schema", "name"], "left")
    return kids.filter(F.coalesce("_own", F.lit(False)) | (F.size("options") > 0) | F.col("tablespace").isNotNull() | (F.coalesce("access_method", F.lit("heap")) != "heap") | (F.col("kind") == "foreign_table")).select("schema", "name", "partition_of")


def children_counts(tables: DataFrame) -> DataFrame:
    kids = folded(tables).filter("folded").groupBy("schema", F.col("partition_of").alias("name")).agg(F.count("*").alias("children"))
    return top_level(tables).join(kids, ["schema", "name"], "left").select("schema", "name", F.coalesce("children", F.lit(0)).alias("children"))


def schema_counts(schemas: DataFrame, tables: DataFrame, views: DataFrame, functions: DataFrame) -> DataFrame:
    """Tables that stand for themselves, views, and functions by distinct name, of each schema."""
    t = top_level(tables).groupBy("schema").agg(F.count("*").alias("n_tables"))
    v = views.groupBy("schema").agg(F.count("*").alias("n_views"))
    fn = functions.groupBy("schema").agg(F.countDistinct("name").alias("n_functions"))
    out = schemas.select("schema").join(t, "schema", "left").join(v, "schema", "left").join(fn, "schema", "left")
    return out.select("schema", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_tables", "n_views", "n_functions")])


def sequences(columns: DataFrame) -> DataFrame:
    """Sequences of each table's defaults, in column order, each once."""
    named = columns.withColumn("sequence", T.sequence_of(F.col("default"), F.col("schema"))).filter("sequence IS NOT NULL")
    first = named.withColumn("_rn", F.row_number().over(Window.partitionBy("schema", "table", "sequence").orderBy("position"))).filter("_rn = 1")
    return first.select("schema", "table", "sequence", "position")


def trigger_functions(triggers: DataFrame, functions: DataFrame) -> DataFrame:
    """(schema, table, trigger, function_schema, function, identity_args): the argument-free overload, else all."""
    raw = T.trigger_function(F.col("definition"))
    has = F.contains(raw, F.lit("."))
    called = triggers.withColumn("_raw", raw).filter("_raw IS NOT NULL").select(
        "schema", "table", F.col("name").alias("trigger"), "definition", F.when(has, F.substring_index(raw, ".", 1)).otherwise(F.col("schema")).alias("function_schema"), T.local_name(raw).alias("function")
    )
    known = functions.select(F.col("schema").alias("function_schema"), F.col("name").alias("function"), "identity_args")
    free = F.max((F.col("identity_args") == "").cast("int")).over(Window.partitionBy("function_schema", "function"))
    known = known.withColumn("_free", free).filter("_free = 0 OR identity_args = ''").drop("_free")
    return called.join(known, ["function_schema", "function"], "left")
