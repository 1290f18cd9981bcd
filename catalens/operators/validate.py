"""Rules that a collected catalog must keep; each is a query for (rule, owner, detail) of what breaks it."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.functions import text as T

MARKER = r"(?m)^--[{}] catalens "
Parts = Mapping[str, DataFrame]


class CatalogInvalid(ValueError):
    """A catalog that breaks a rule; nothing has been written."""


def _bad(rows: DataFrame, rule: str, owner: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), owner.alias("owner"), detail.alias("detail"))


def _named(p: Parts) -> DataFrame:
    return reduce(DataFrame.unionByName, [p[k].select(F.lit(k[:-1]).alias("kind"), "schema", "name") for k in ("tables", "views", "functions")])


def owner() -> Column:
    return F.concat_ws(".", F.col("schema"), F.col("name"))


def identifiers(p: Parts) -> DataFrame:
    return _bad(_named(p).filter(~T.identifier_ok(F.col("name")) | ~T.identifier_ok(F.col("schema"))), "identifier", owner(), F.col("kind"))


def case_collisions(p: Parts) -> DataFrame:
    """Names of one kind that differ in case only would share a file."""
    low = F.lower("name").alias("low")
    rows = _named(p).distinct().groupBy("schema", "kind", low).agg(F.array_sort(F.collect_set("name")).alias("names")).filter(F.size("names") > 1)
    return _bad(rows, "case", F.concat_ws(".", "schema", "low"), F.array_join("names", ", "))


def definitions(p: Parts) -> DataFrame:
    return _bad(p["functions"].filter(F.coalesce(F.trim("definition"), F.lit("")) == ""), "definition", owner(), F.col("identity_args"))


def markers(p: Parts) -> DataFrame:
    """Text that would be taken for a bound of a managed block."""
    texts = reduce(DataFrame.unionByName, [
        p["functions"].select(owner().alias("owner"), F.lit("definition").alias("field"), F.col("definition").alias("text")), p["views"].select(owner().alias("owner"), F.lit("definition").alias("field"), F.col("definition").alias("text")),
        p["tables"].select(owner().alias("owner"), F.lit("comment").alias("field"), F.col("comment").alias("text")), p["columns"].select(F.concat_ws(".", "schema", "table", "name").alias("owner"), F.lit("comment").alias("field"), F.col("comment").alias("text")),
    ])
    return _bad(texts.filter(F.col("text").rlike(MARKER)), "marker", F.col("owner"), F.col("field"))


def storage_options(p: Parts) -> DataFrame:
    rows = p["tables"].select(owner().alias("owner"), F.explode("options").alias("o")).unionByName(p["views"].select(owner().alias("owner"), F.explode("options").alias("o")))
    return _bad(rows.filter(~F.substring_index("o", "=", 1).rlike(r"^[A-Za-z0-9_.]+$")), "option", F.col("owner"), F.col("o"))


def wrapper_options(p: Parts) -> DataFrame:
    """Options of foreign tables need a key and a value."""
    rows = p["tables"].select(owner().alias("owner"), F.explode("foreign_options").alias("o")).unionByName(p["columns"].select(F.concat_ws(".", "schema", "table", "name").alias("owner"), F.explode("fdw_options").alias("o")))
    return _bad(rows.filter(F.locate("=", F.col("o")) < 2), "wrapper_option", F.col("owner"), F.col("o"))


def access_methods(p: Parts) -> DataFrame:
    rows = p["tables"].select("schema", "name", "access_method").unionByName(p["views"].select("schema", "name", "access_method"))
    return _bad(rows.filter("access_method = ''"), "access_method", owner(), F.lit("empty"))


def tablespaces(p: Parts) -> DataFrame:
    rows = p["tables"].select("schema", "name", "tablespace").unionByName(p["views"].select("schema", "name", "tablespace"))
    return _bad(rows.filter("tablespace = ''"), "tablespace", owner(), F.lit("empty"))


def foreign(p: Parts) -> DataFrame:
    """A foreign table has a server, other tables have none."""
    rows = p["tables"].filter((F.col("kind") == "foreign_table") != F.coalesce(F.col("server") != "", F.lit(False)))
    return _bad(rows, "foreign", owner(), F.col("kind"))


def named(p: Parts) -> DataFrame:
    rows = p["columns"].filter("name IS NULL OR name = '' OR type IS NULL OR type = ''")
    return _bad(rows, "named", F.concat_ws(".", "schema", "table"), F.col("position").cast("string"))


def scope(p: Parts, requested: list[str] | None) -> DataFrame:
    """Only schemas that were asked for may be there."""
    rows = p["schemas"].filter(~F.col("schema").isin(*requested)) if requested else p["schemas"].limit(0)
    return _bad(rows, "scope", F.col("schema"), F.lit("not requested"))


RULES = (identifiers, case_collisions, definitions, markers, storage_options, wrapper_options, access_methods, tablespaces, foreign, named)


def violations(p: Parts, requested: list[str] | None = None) -> DataFrame:
    return reduce(DataFrame.unionByName, [*[r(p) for r in RULES], scope(p, requested)])


def check(p: Parts, requested: list[str] | None = None) -> None:
    """Raise for a broken rule, before anything is written."""
    found = violations(p, requested).orderBy("rule", "owner").limit(20).collect()
    if found:
        raise CatalogInvalid("; ".join(f"{r['rule']}: {r['owner']} ({r['detail']})" for r in found))
