"""Catalog documents, confirmed relations, settings and Spark's own catalog as sources."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens.functions import text as T

VERSION = 1
_COLUMN = "struct<position:int,name:string,type:string,default:string,nullable:boolean,comment:string,fdw_options:array<string>>"
_INDEX = "struct<name:string,definition:string,inherited_from:string,tablespace:string,options:array<string>>"
_TABLE = (
    "struct<name:string,kind:string,comment:string,reltuples:bigint,options:array<string>,access_method:string,foreign:struct<server:string,options:array<string>>,tablespace:string,partition_key:string,partition_of:string,"
    f"columns:array<{_COLUMN}>,indexes:array<{_INDEX}>,constraints:array<struct<name:string,type:string,definition:string,is_local:boolean>>,triggers:array<struct<name:string,definition:string,enabled:string,inherited_from:string>>>"
)
_VIEW = f"struct<name:string,kind:string,comment:string,definition:string,columns:array<{_COLUMN}>,options:array<string>,access_method:string,populated:boolean,tablespace:string,indexes:array<{_INDEX}>>"
_FUNCTION = "struct<name:string,identity_args:string,arg_names:array<string>,result_type:string,language:string,comment:string,source:string,definition:string>"
SCHEMA = f"struct<collect_version:int,collected_at:string,database:string,requested_schemas:array<string>,schemas:array<struct<schema:string,comment:string,tables:array<{_TABLE}>,views:array<{_VIEW}>,functions:array<{_FUNCTION}>>>>"


class DocumentInvalid(ValueError):
    """Text that is no catalog document of the known version."""


def parse(spark: SparkSession, text: str) -> DataFrame:
    """One document, one row; what is empty, no JSON or of another version raises."""
    if not text.strip():
        raise DocumentInvalid("the document is empty")
    row = spark.createDataFrame([(text,)], "text string").select(F.from_json("text", SCHEMA, {"mode": "PERMISSIVE"}).alias("d"))
    first = row.select("d.collect_version", F.col("d.schemas").isNotNull().alias("has")).first()
    if first["collect_version"] != VERSION or not first["has"]:
        raise DocumentInvalid(f"collect_version must be {VERSION}, and schemas a list")
    return row.select("d.*")


def parts(document: DataFrame) -> dict[str, DataFrame]:
    """The flat parts of a document, as collection gives them; what is missing is empty."""
    none = F.array().cast("array<string>")
    s = document.select(F.explode("schemas").alias("s")).select("s.*")
    t = s.select("schema", F.explode("tables").alias("t")).select("schema", "t.*")
    v = s.select("schema", F.explode("views").alias("v")).select("schema", "v.*")
    inner = lambda rows, part: rows.select("schema", F.col("name").alias("table"), F.explode(part).alias("x")).select("schema", "table", "x.*")
    options = lambda rows, c="options": rows.withColumn(c, F.coalesce(c, none))
    return {
        "schemas": s.select("schema", "comment"),
        "tables": options(t.withColumn("server", F.col("foreign.server")).withColumn("foreign_options", F.coalesce("foreign.options", none))).drop("foreign", "columns", "indexes", "constraints", "triggers"),
        "columns": options(inner(t, "columns"), "fdw_options"), "indexes": options(inner(t, "indexes")), "constraints": inner(t, "constraints"), "triggers": inner(t, "triggers"),
        "views": options(v).drop("columns", "indexes"), "view_columns": options(inner(v, "columns"), "fdw_options"), "view_indexes": options(inner(v, "indexes")),
        "functions": s.select("schema", F.explode("functions").alias("f")).select("schema", "f.*"),
    }


def slices(document: DataFrame) -> DataFrame:
    """(schema, json) of each schema, without row estimates, nulls kept."""
    s = document.select(F.explode("schemas").alias("s")).withColumn("s", F.col("s").withField("tables", F.transform("s.tables", lambda t: t.dropFields("reltuples"))))
    return s.select("s.schema", F.to_json("s", {"ignoreNullFields": "false", "pretty": "true"}).alias("json"))


def confirmed(spark: SparkSession, text: str) -> tuple[DataFrame, list[str]]:
    """(source, target, ignored) of a relations file and what was wrong with it.

    The file is a list of flat entries (``- key: value``); an entry with other
    keys, a missing end, an end not of three parts or a pair seen before is left
    out with a warning; a file that is no such list is empty with one.
    """
    entries: list[dict[str, str]] = []
    warnings: list[str] = []
    body = [x for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]
    if body and body != ["[]"]:
        for x in body:
            m = re.fullmatch(r"(- |  )(\w+):\s*(.*?)\s*", x)
            if not m or (m[1] == "  " and not entries):
                entries, warnings = [], [f"not a list of entries: {x!r}"]
                break
            if m[1] == "- ":
                entries.append({})
            entries[-1][m[2]] = m[3].strip("'\"")
    rows: dict[tuple[str, str], bool] = {}
    for e in entries:
        pair = (e.get("source", ""), e.get("target", ""))
        good = set(e) <= {"source", "target", "ignore"} and all(re.fullmatch(r"\w+\.\w+\.\w+", p, re.A) for p in pair) and e.get("ignore", "false") in ("true", "false")
        if not good or pair in rows:
            warnings.append(f"entry left out: {e}")
            continue
        rows[pair] = e.get("ignore") == "true"
    return spark.createDataFrame([(a, b, i) for (a, b), i in rows.items()], "source string, target string, ignored boolean"), warnings


# The settings that have a default.
DEFAULTS = {"PGPORT": "5432", "SSH_PORT": "22", "LOCAL_PORT": "15432", "RO_DEFAULT_LIMIT": "200"}


def settings(text: str, known: Mapping[str, str] = DEFAULTS) -> dict[str, str]:
    """KEY=VALUE lines over the defaults: the last of a key holds, unknown keys are left out, other lines raise."""
    out = dict(known)
    for n, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        key, eq, value = line.partition("=")
        if not eq or not re.fullmatch(r"[A-Z][A-Z0-9_]*", key.strip()):
            raise ValueError(f"line {n} is no KEY=VALUE")
        if key.strip() in known:
            out[key.strip()] = value.strip().strip("'\"")
    return out


def scope(option: list[str] | None, configured: str | None) -> list[str]:
    """Schemas to collect: the option, else the setting, else none (all)."""
    names = option if option else (configured or "").split(",")
    return [n.strip() for n in names if n.strip()]


def names_from_files(spark: SparkSession, root: str) -> DataFrame:
    """(schema, table, column) that a dictionary's files tell: columns from CREATE TABLE blocks, other files names only."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.sql").select("value", F.input_file_name().alias("f"))
    at = files.select("value", F.regexp_extract("f", r"/([^/]+)/(tables|views)/([^/]+)\.sql$", 1).alias("schema"), F.regexp_extract("f", r"/(tables|views)/", 1).alias("kind"), F.regexp_extract("f", r"/([^/]+)\.sql$", 1).alias("table"))
    at = at.filter((F.col("kind") != "") & ~F.col("schema").rlike("^[_.]"))
    block = F.regexp_extract("value", r"(?s)CREATE TABLE [^\n]*\(\n(.*?)\n\)", 1)
    column = F.explode_outer(F.when(F.col("kind") == "tables", F.regexp_extract_all(block, F.lit(r'(?m)^  ("(?:[^"]|"")+"|[a-z_][a-z0-9_]*) '), F.lit(1))))
    return at.select("schema", "table", column.alias("column")).withColumn("column", F.regexp_replace("column", '^"|"$', ""))


def spark_catalog(spark: SparkSession, database: str | None = None) -> dict[str, DataFrame]:
    """tables and columns of Spark's own catalog in the shape of collection."""
    names = [(t.namespace[-1] if t.namespace else "", t.name, t.tableType, t.description) for t in spark.catalog.listTables(database)]
    rows = [(s, n, i + 1, c.name, c.dataType, c.nullable, c.description) for s, n, *_ in names for i, c in enumerate(spark.catalog.listColumns(f"{s}.{n}" if s else n))]
    return {
        "tables": spark.createDataFrame([(s, n, "view" if k == "TEMPORARY" or k == "VIEW" else "table", d) for s, n, k, d in names], "schema string, name string, kind string, comment string"),
        "columns": spark.createDataFrame(rows, "schema string, table string, position int, name string, type string, nullable boolean, comment string"),
    }


def jdbc(spark: SparkSession, url: str, user: str, password: str, names: list[str], timeout_s: int = 60) -> dict[str, DataFrame]:
    """System tables over one JDBC url, one DataFrame each; a driver has to be on the class path."""
    options = {"url": url, "user": user, "password": password, "queryTimeout": str(timeout_s), "sessionInitStatement": "SET default_transaction_read_only = on"}
    return {n: spark.read.format("jdbc").options(**options, dbtable=f"pg_catalog.{n}").load() for n in names}


def identifiers_ok(names: DataFrame) -> DataFrame:
    return names.withColumn("ok", T.identifier_ok(F.col("name")))


def dumps(value: dict) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2)
