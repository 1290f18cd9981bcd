"""Relationship candidates from names and comments, and statements that would record the confirmed ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalens.functions import text as T
from catalens.operators.semantics import qualified


def by_name(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """``x_id`` to table ``x``, else ``xs``, of any schema; to its ``id``, else its column of the same name."""
    stems = columns.withColumn("stem", T.id_stem(F.col("name"))).filter("stem IS NOT NULL").select(qualified().alias("source"), F.col("name").alias("column"), "stem")
    names = tables.select(F.col("schema").alias("to_schema"), F.col("name").alias("to_table"))
    exact = stems.join(names, F.col("stem") == F.col("to_table"))
    plural = stems.join(exact.select("source"), "source", "left_anti").join(names, F.concat("stem", F.lit("s")) == F.col("to_table"))
    hits = exact.unionByName(plural)
    targets = columns.select(F.col("schema").alias("to_schema"), F.col("table").alias("to_table"), F.col("name").alias("to_column"))
    joined = hits.join(targets, ["to_schema", "to_table"]).filter((F.col("to_column") == "id") | (F.col("to_column") == F.col("column")))
    best = F.row_number().over(Window.partitionBy("source", "to_schema", "to_table").orderBy(F.when(F.col("to_column") == "id", 0).otherwise(1)))
    out = joined.withColumn("_rn", best).filter("_rn = 1").select("source", F.concat_ws(".", "to_schema", "to_table", "to_column").alias("target"))
    return out.filter("source <> target")


def by_comment(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Tables that a comment names, with their schema or, where only one schema has the name, without; to their ``id``."""
    said = columns.select(qualified().alias("source"), T.without_relations(F.col("comment")).alias("comment")).filter("comment IS NOT NULL")
    names = tables.select(F.col("schema").alias("to_schema"), F.col("name").alias("to_table")).distinct()
    full = said.select("source", F.explode(T.qualified_tokens(F.col("comment"))).alias("q")).select("source", F.col("q.schema").alias("to_schema"), F.col("q.table").alias("to_table")).join(names, ["to_schema", "to_table"])
    single = names.groupBy("to_table").agg(F.count("*").alias("_n"), F.min("to_schema").alias("to_schema")).filter("_n = 1").drop("_n")
    bare = said.select("source", F.explode(T.tokens(F.col("comment"))).alias("to_table")).join(single, "to_table")
    both = full.select("source", "to_schema", "to_table").unionByName(bare.select("source", "to_schema", "to_table")).distinct()
    return both.select("source", F.concat_ws(".", "to_schema", "to_table", F.lit("id")).alias("target")).filter("source <> target")


def candidates(tables: DataFrame, columns: DataFrame, confirmed: DataFrame, marked: DataFrame) -> DataFrame:
    """(source, target, signal), less what is confirmed, ignored or annotated; a name outweighs a comment."""
    both = by_name(tables, columns).withColumn("_p", F.lit(0)).unionByName(by_comment(tables, columns).withColumn("_p", F.lit(1)))
    one = both.groupBy("source", "target").agg(F.min("_p").alias("_p"))
    known = confirmed.select("source", "target").unionByName(marked.select("source", "target"))
    return one.join(known, ["source", "target"], "left_anti").select("source", "target", F.when(F.col("_p") == 0, "column_name").otherwise("comment_ref").alias("signal"))


def stale(columns: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Confirmed relations whose source column is gone."""
    return confirmed.join(columns.select(qualified().alias("source")), "source", "left_anti").select("source", "target")


def pending(columns: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(source, statement): one COMMENT for each source whose confirmed targets its comment doesn't annotate yet."""
    now = columns.select(qualified().alias("source"), F.coalesce("comment", F.lit("")).alias("comment"))
    want = confirmed.filter(~F.col("ignored")).groupBy("source").agg(F.collect_set("target").alias("targets")).join(now, "source")
    new = want.withColumn("new", F.array_sort(F.array_except("targets", T.relations(F.col("comment"))))).filter(F.size("new") > 0)
    notes = F.array_join(F.transform("new", lambda t: F.concat(F.lit("逻辑关联 "), t)), "，")
    comment = F.when(F.trim("comment") == "", notes).otherwise(F.concat(F.col("comment"), F.lit("，"), notes))
    name = F.array_join(F.transform(F.split("source", r"\."), T.quote_ident), ".")
    return new.select("source", F.concat(F.lit("COMMENT ON COLUMN "), name, F.lit(" IS "), T.sql_literal(comment), F.lit(";")).alias("statement"))
