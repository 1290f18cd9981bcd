"""Effective privileges of a role, judged by rules, each a relational query with the statement that mends it."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.functions.text import always_quoted
from catalens.operators.collect import not_system

Facts = Mapping[str, DataFrame]
BLOCK, REPORT = "block", "report"
WRITES = ["INSERT", "UPDATE", "DELETE", "TRUNCATE", "REFERENCES", "TRIGGER"]
FLAGS = ["super", "createdb", "bypassrls", "replication", "createrole"]
TABLE_RIGHTS = ["SELECT", *WRITES]


def grantees(f: Facts, role: str) -> DataFrame:
    """The role, every role it is a member of by any path however long, and PUBLIC.

    The driver walks the memberships, a row a pair of roles, one step of the path at a time.
    """
    known, step = {role}, {role}
    while step:
        found = f["members"].filter(F.col("member").isin(*step)).select("role").distinct().collect()
        step = {r["role"] for r in found} - known
        known |= step
    return f["roles"].sparkSession.createDataFrame([(x,) for x in [*sorted(known), "PUBLIC"]], "grantee string")


def objects(f: Facts, name: str = "app") -> DataFrame:
    """(object_kind, schema, object_id, owner, rights) of what users have made, and of the database."""
    own = f["pg_namespace"].filter(not_system(F.col("nspname"))).select(F.col("oid").alias("relnamespace"), F.col("nspname").alias("schema"), "nspowner")
    rights = lambda *words: F.array(*[F.lit(w) for w in words])
    shape = lambda rows, kind, schema, what, owner, given: rows.select(F.lit(kind).alias("object_kind"), schema.cast("string").alias("schema"), what.alias("object_id"), owner.cast("string").alias("owner"), given.alias("rights"))
    rel, none = f["pg_class"].join(own, "relnamespace"), F.lit(None)
    col = F.col
    functions = f["pg_proc"].withColumnRenamed("pronamespace", "relnamespace").join(own, "relnamespace").filter("prokind = 'f'").select("schema", F.concat("proname", F.lit("("), "identity_args", F.lit(")")).alias("signature"), col("proowner").alias("owner"))
    functions = functions.unionByName(f["secdef_functions"].select("schema", "signature", "owner")).distinct()
    return reduce(DataFrame.unionByName, [
        shape(rel.filter("relkind IN ('r', 'p', 'f', 'v', 'm')"), "table", col("schema"), col("relname"), col("relowner"), rights(*TABLE_RIGHTS)),
        shape(rel.filter("relkind = 'S'"), "sequence", col("schema"), col("relname"), col("relowner"), rights("USAGE", "SELECT", "UPDATE")),
        shape(own, "schema", col("schema"), col("schema"), col("nspowner"), rights("USAGE", "CREATE")),
        shape(functions, "function", col("schema"), col("signature"), col("owner"), rights("EXECUTE")),
        shape(f["pg_foreign_server"], "server", none, col("srvname"), none, rights("USAGE")),
        shape(f["roles"].sparkSession.createDataFrame([(name,)], "datname string"), "database", none, col("datname"), none, rights("CONNECT", "CREATE", "TEMP")),
    ])


def implied(f: Facts, role: str) -> DataFrame:
    """Rights without a grant: an owner's, also by membership, on what it owns, and a superuser's on everything."""
    every = objects(f)
    owned = every.join(grantees(f, role).withColumnRenamed("grantee", "owner"), "owner").withColumn("grantee", F.col("owner"))
    rows = owned.select("object_kind", "schema", "object_id", "grantee", "rights")
    if not f["roles"].filter((F.col("rolname") == role) & F.col("super")).isEmpty():
        rows = rows.unionByName(every.select("object_kind", "schema", "object_id", F.lit(role).alias("grantee"), "rights"))
    return rows.select("object_kind", "schema", "object_id", "grantee", F.explode("rights").alias("privilege"))


def effective(f: Facts, role: str) -> DataFrame:
    """What the role may do: by any grant, its own, inherited or PUBLIC's, as an owner or as a superuser.

    One row a privilege and the role, or PUBLIC, that it comes from.
    """
    granted = f["acl"].join(grantees(f, role), "grantee").select("object_kind", "schema", "object_id", "grantee", "privilege")
    return granted.unionByName(implied(f, role)).distinct()


def scoped(f: Facts, rows: DataFrame, inside: bool = True) -> DataFrame:
    return rows.join(f["in_scope"].select(F.col("nspname").alias("schema")), "schema", "left_semi" if inside else "left_anti")


def finding(rows: DataFrame, rule: str, severity: str | Column, description: Column, fix: Column) -> DataFrame:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return rows.select(F.lit(rule).alias("rule"), level.alias("severity"), description.alias("description"), fix.alias("fix"))


def _grant(rows: DataFrame, rule: str, severity, kind: str) -> DataFrame:
    """A finding for each grant of ``rows``, mended by a REVOKE."""
    what = F.concat_ws(".", F.when(F.col("object_kind").isin("table", "sequence", "function"), always_quoted(F.col("schema"))), F.when(F.col("object_kind") == "function", F.col("object_id")).otherwise(always_quoted(F.col("object_id"))))
    who = F.when(F.col("grantee") == "PUBLIC", F.lit("PUBLIC")).otherwise(always_quoted(F.col("grantee")))
    return finding(
        rows, rule, severity, F.concat_ws(" ", "privilege", F.lit("on"), F.lit(kind.lower()), F.concat_ws(".", F.when(F.col("object_kind").isin("table", "sequence", "function"), F.col("schema")), "object_id"), F.lit("by"), "grantee"),
        F.concat(F.lit("REVOKE "), "privilege", F.lit(f" ON {kind} "), what, F.lit(" FROM "), who, F.lit(";")),
    )


def flags(f: Facts, role: str) -> DataFrame:
    long = f["roles"].filter(F.col("rolname") == role).unpivot("rolname", FLAGS, "flag", "on").filter("on")
    word = F.when(F.col("flag") == "super", F.lit("SUPERUSER")).otherwise(F.upper("flag"))
    return finding(long, "flags", BLOCK, F.concat(F.lit("role attribute "), word), F.concat(F.lit("ALTER ROLE "), always_quoted(F.col("rolname")), F.lit(" NO"), word, F.lit(";")))


def membership(f: Facts, role: str) -> DataFrame:
    rows = f["members"].filter(F.col("member") == role)
    return finding(rows, "membership", BLOCK, F.concat(F.lit("member of "), "role"), F.concat(F.lit("REVOKE "), always_quoted(F.col("role")), F.lit(" FROM "), always_quoted(F.col("member")), F.lit(";")))


def schema_create(f: Facts, role: str) -> DataFrame:
    return _grant(effective(f, role).filter("object_kind = 'schema' AND privilege = 'CREATE'"), "schema_create", BLOCK, "SCHEMA")


def database(f: Facts, role: str, name: str = "app") -> DataFrame:
    rows = effective(f, role).filter((F.col("object_kind") == "database") & (F.col("object_id") == name) & F.col("privilege").isin("CREATE", "TEMP"))
    return _grant(rows, "database", F.when(F.col("privilege") == "CREATE", BLOCK).otherwise(REPORT), "DATABASE")


def table_write(f: Facts, role: str) -> DataFrame:
    return _grant(effective(f, role).filter((F.col("object_kind") == "table") & F.col("privilege").isin(*WRITES)), "table_write", BLOCK, "TABLE")


def sequence(f: Facts, role: str) -> DataFrame:
    return _grant(effective(f, role).filter("object_kind = 'sequence' AND privilege IN ('USAGE', 'UPDATE')"), "sequence", BLOCK, "SEQUENCE")


def out_usage(f: Facts, role: str) -> DataFrame:
    rows = scoped(f, effective(f, role).filter("object_kind = 'schema' AND privilege = 'USAGE'"), False)
    return _grant(rows, "out_usage", F.when(F.col("schema") == "public", REPORT).otherwise(BLOCK), "SCHEMA")


def out_select(f: Facts, role: str) -> DataFrame:
    return _grant(scoped(f, effective(f, role).filter("object_kind = 'table' AND privilege = 'SELECT'"), False), "out_select", BLOCK, "TABLE")


def ownership(f: Facts, role: str) -> DataFrame:
    rel = f["pg_class"].filter(F.col("relowner") == role).join(f["pg_namespace"].select(F.col("oid").alias("relnamespace"), "nspname"), "relnamespace").select(F.concat_ws(".", "nspname", "relname").alias("what"))
    fn = f["secdef_functions"].filter(F.col("owner") == role).select(F.concat_ws(".", "schema", "signature").alias("what"))
    return finding(rel.unionByName(fn), "ownership", BLOCK, F.concat(F.lit("owns "), "what"), F.concat(F.lit("-- give "), "what", F.lit(" another owner")))


def escape(f: Facts, role: str) -> DataFrame:
    link = effective(f, role).filter("object_kind = 'function' AND privilege = 'EXECUTE' AND object_id LIKE 'dblink%'")
    server = effective(f, role).filter("object_kind = 'server' AND privilege = 'USAGE'")
    return _grant(link, "escape", BLOCK, "FUNCTION").unionByName(_grant(server, "escape", BLOCK, "FOREIGN SERVER"))


def secdef(f: Facts, role: str) -> DataFrame:
    definers = f["secdef_functions"].filter("secdef").select("schema", F.col("signature").alias("object_id"))
    rows = effective(f, role).filter("object_kind = 'function' AND privilege = 'EXECUTE'").join(definers, ["schema", "object_id"], "left_semi")
    scope = f["in_scope"].select(F.col("nspname").alias("schema"), F.lit(True).alias("_in"))
    return _grant(rows.join(scope, "schema", "left"), "secdef", F.when(F.col("_in"), REPORT).otherwise(BLOCK), "FUNCTION")


def default_acl(f: Facts, role: str) -> DataFrame:
    rows = f["default_acl"].filter(F.col("grantee").isin(role, "PUBLIC")).join(f["in_scope"].select(F.col("nspname").alias("schema"), F.lit(True).alias("_in")), "schema", "left")
    where = F.coalesce("schema", F.lit("the database"))
    fix = F.concat(F.lit("ALTER DEFAULT PRIVILEGES FOR ROLE "), always_quoted(F.col("owner")), F.coalesce(F.concat(F.lit(" IN SCHEMA "), always_quoted(F.col("schema"))), F.lit("")), F.lit(" REVOKE ALL ON "), F.when(F.col("objtype") == "S", "SEQUENCES").otherwise("TABLES"), F.lit(" FROM "), F.when(F.col("grantee") == "PUBLIC", F.lit("PUBLIC")).otherwise(always_quoted(F.col("grantee"))), F.lit(";"))
    return finding(rows, "default_acl", F.when(F.col("_in"), REPORT).otherwise(BLOCK), F.concat_ws(" ", F.lit("default privileges in"), where, F.lit("of"), "owner", F.lit("for"), "grantee"), fix)


def connect(f: Facts, role: str, name: str = "app") -> DataFrame:
    return _grant(effective(f, role).filter((F.col("object_kind") == "database") & (F.col("privilege") == "CONNECT") & (F.col("object_id") != name)), "connect", REPORT, "DATABASE")


def owner_gap(f: Facts, role: str) -> DataFrame:
    """Owners of relations in scope whose new tables the role will not get to read."""
    named = f["pg_class"].filter("relkind IN ('r', 'p', 'f', 'v', 'm')").join(f["pg_namespace"].select(F.col("oid").alias("relnamespace"), F.col("nspname").alias("schema")), "relnamespace")
    owners = scoped(f, named).select("schema", F.col("relowner").alias("owner")).distinct()
    given = f["default_acl"].filter((F.col("grantee") == role) & (F.col("objtype") == "r")).select("schema", "owner")
    rows = owners.join(given, ["schema", "owner"], "left_anti")
    fix = F.concat(F.lit("ALTER DEFAULT PRIVILEGES FOR ROLE "), always_quoted(F.col("owner")), F.lit(" IN SCHEMA "), always_quoted(F.col("schema")), F.lit(f" GRANT SELECT ON TABLES TO \"{role}\";"))
    return finding(rows, "owner_gap", REPORT, F.concat_ws(" ", F.lit("new tables of"), "owner", F.lit("in"), "schema"), fix)


RULES = {
    "flags": flags, "membership": membership, "schema_create": schema_create, "database": database, "table_write": table_write, "sequence": sequence, "out_usage": out_usage, "out_select": out_select,
    "ownership": ownership, "escape": escape, "secdef": secdef, "default_acl": default_acl, "connect": connect, "owner_gap": owner_gap,
}


def audit(f: Facts, role: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [rule(f, role) for rule in RULES.values()])


def mends(f: Facts, role: str) -> DataFrame:
    """(fix): the statements that mend what blocks, each once."""
    return audit(f, role).filter(F.col("severity") == BLOCK).select("fix").distinct()


def verdict(f: Facts, role: str, probe: Callable[[], bool] | None = None) -> DataFrame:
    """One row: how many findings block, how many are only reported, and the exit code.

    2 where one blocks (a person has to mend it), else what a session of the role says: 0 if the
    probe is answered, 1 if not. Without a probe an audit that nothing blocks is 0.
    """
    n = audit(f, role).agg(F.count_if(F.col("severity") == BLOCK).alias("n_block"), F.count_if(F.col("severity") == REPORT).alias("n_report"))
    blocked = n.first()["n_block"] > 0
    answered = blocked or probe is None or _answers(probe)
    return n.withColumn("exit_code", F.lit(2 if blocked else 0 if answered else 1))


def _answers(probe: Callable[[], bool]) -> bool:
    try:
        return bool(probe())
    except Exception:  # a session that can't be had is an answer, too
        return False


def identity(current: str, configured: str) -> int:
    """Exit code of the identity rule: the session must be the configured role's."""
    return 0 if current == configured else 2
