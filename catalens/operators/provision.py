"""Statements that would set up a read-only role, and how far an onboarding has come. Nothing is run."""

from __future__ import annotations

import secrets
import string
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.functions.text import always_quoted, sql_literal
from catalens.operators import audit, collect

Facts = Mapping[str, DataFrame]

STAGES = ("deps", "gitignore", "config", "provision", "collect", "smoke")
SAFE = string.ascii_letters + string.digits + "-_"


def password(length: int = 32) -> str:
    return "".join(secrets.choice(SAFE) for _ in range(length))


def password_safe(text: str) -> bool:
    """Long enough, and of characters that no shell, URL or statement reads otherwise."""
    return len(text) >= 16 and set(text) <= set(SAFE)


def name_of(role: str) -> str:
    return '"' + role.replace('"', '""') + '"'


def text_of(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def role_statements(role: str) -> list[str]:
    """What every run brings a role to; the maker of the role needs CREATEROLE only, and a password is left as it is."""
    name = name_of(role)
    return [
        f"ALTER ROLE {name} LOGIN NOCREATEROLE NOINHERIT CONNECTION LIMIT 5;", f"ALTER ROLE {name} SET statement_timeout = '15s';",
        f"ALTER ROLE {name} SET idle_in_transaction_session_timeout = '30s';", f"GRANT SET ON PARAMETER lc_messages TO {name};",
    ]


def dangers(f: Facts, role: str) -> DataFrame:
    """(what): why an existing role must not be made a reader; empty for a role that isn't there."""
    own = f["roles"].filter(F.col("rolname") == role)
    flagged = own.unpivot("rolname", ["super", "createdb", "bypassrls", "replication"], "flag", "on").filter("on").select(F.concat(F.lit("attribute "), "flag").alias("what"))
    member = f["members"].filter(F.col("member") == role).select(F.concat(F.lit("member of "), "role").alias("what"))
    write = audit.effective(f, role).filter((F.col("object_kind") == "table") & F.col("privilege").isin(*audit.WRITES))
    write = write.select(F.concat(F.when(F.col("grantee") == "PUBLIC", F.lit("PUBLIC may write ")).otherwise(F.lit("may write ")), F.concat_ws(".", "schema", "object_id")).alias("what"))
    there = own.select(F.lit(True).alias("there")).limit(1)
    return reduce(DataFrame.unionByName, [flagged, member, write]).distinct().crossJoin(F.broadcast(there)).select("what")


def scope_of(f: Facts, scope: list[str] | None) -> DataFrame:
    """(schema): those named, else all that have an object of their own now."""
    if scope:
        return f["pg_namespace"].sparkSession.createDataFrame([(s,) for s in scope], "schema string")
    return collect.schemas(f).select("schema")


def schema_statements(schemas: DataFrame, scope: DataFrame, role: str) -> DataFrame:
    """(schema, step, statement): grants for the schemas of ``scope``, revocations for others of ``schemas``.

    Default privileges are those of the account that runs the statements; tables that other
    owners make later need theirs (the audit's owner_gap tells).
    """
    name, q = F.lit(name_of(role)), always_quoted(F.col("schema"))
    line = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    own = "ALTER DEFAULT PRIVILEGES FOR ROLE CURRENT_USER IN SCHEMA "
    grants = F.array(line("GRANT USAGE ON SCHEMA ", q, " TO ", name, ";"), line("GRANT SELECT ON ALL TABLES IN SCHEMA ", q, " TO ", name, ";"), line(own, q, " GRANT SELECT ON TABLES TO ", name, ";"))
    revokes = F.array(line("REVOKE SELECT ON ALL TABLES IN SCHEMA ", q, " FROM ", name, ";"), line("REVOKE USAGE ON SCHEMA ", q, " FROM ", name, ";"), line(own, q, " REVOKE SELECT ON TABLES FROM ", name, ";"))
    inside = scope.select("schema").distinct().select("schema", F.posexplode(grants).alias("step", "statement"))
    outside = schemas.select("schema").distinct().join(scope, "schema", "left_anti").select("schema", F.posexplode(revokes).alias("step", "statement"))
    return inside.unionByName(outside)


def plan(f: Facts, role: str, scope: list[str] | None = None) -> DataFrame:
    """(part, schema, step, statement): what would make the role a reader of the catalog as it is now.

    Where an existing role is dangerous only the reasons are given, part ``abort``, and nothing
    else: no change is made. A role that is there isn't created again and keeps its password.
    """
    spark = f["roles"].sparkSession
    bad = dangers(f, role)
    if not bad.isEmpty():
        return bad.select(F.lit("abort").alias("part"), F.lit(None).cast("string").alias("schema"), F.lit(0).alias("step"), F.concat(F.lit("-- "), "what").alias("statement"))
    there = not f["roles"].filter(F.col("rolname") == role).isEmpty()
    steps = [] if there else [("create", None, 0, f"CREATE ROLE {name_of(role)} LOGIN PASSWORD :secret;")]
    steps += [("role", None, i, x) for i, x in enumerate(role_statements(role))]
    used = audit.effective(f, role).filter("object_kind = 'schema' AND privilege = 'USAGE'").select("schema")
    rows = schema_statements(used.filter(collect.not_system(F.col("schema"))), scope_of(f, scope), role)
    return spark.createDataFrame(steps, "part string, schema string, step int, statement string").unionByName(rows.select(F.lit("schema").alias("part"), "schema", "step", "statement"))


def script(role: str, secret: str, scope: list[str] | None = None) -> str:
    """The same as text for ``psql``, made without a connection: it reads the catalog when it is run.

    One transaction: the scope and the dangers are temporary tables, a danger ends it before
    any change, and every statement is made from a query by ``\\gexec``, so a second run does nothing new.
    """
    who, word = text_of(role), text_of(secret)
    user = "nspname NOT IN ('pg_catalog', 'information_schema') AND left(nspname, 3) <> 'pg_'"
    kept = "NOT EXISTS (SELECT FROM pg_depend d WHERE d.deptype = 'e' AND d.objid = {0}.oid AND d.classid = '{1}'::regclass)"
    if scope:
        wanted = "SELECT unnest(ARRAY[" + ", ".join(map(text_of, scope)) + "]::name[]) AS nspname"
    else:
        wanted = (
            f"SELECT nspname FROM pg_namespace n WHERE {user}\n  AND (EXISTS (SELECT FROM pg_class c WHERE c.relnamespace = n.oid AND c.relkind = ANY ('{{r,p,f,v,m}}') AND {kept.format('c', 'pg_class')})\n"
            f"    OR EXISTS (SELECT FROM pg_proc c WHERE c.pronamespace = n.oid AND c.prokind = 'f' AND {kept.format('c', 'pg_proc')}))"
        )
    rights = ",".join(audit.WRITES)
    user_tables = f"pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace WHERE c.relkind = ANY ('{{r,p,f,v,m}}') AND {user}"
    reasons = [
        f"SELECT 'attribute ' || a.word FROM pg_roles r, LATERAL (VALUES ('super', rolsuper), ('createdb', rolcreatedb), ('bypassrls', rolbypassrls), ('replication', rolreplication)) a(word, has) WHERE rolname = {who} AND a.has",
        f"SELECT 'member of ' || g.rolname FROM pg_auth_members m JOIN pg_roles g ON g.oid = m.roleid JOIN pg_roles r ON r.oid = m.member WHERE r.rolname = {who}",
        f"SELECT 'may write ' || c.oid::regclass FROM {user_tables} AND EXISTS (SELECT FROM there) AND has_table_privilege((SELECT oid FROM there), c.oid, '{rights}')",
        f"SELECT 'PUBLIC may write ' || c.oid::regclass FROM {user_tables} AND EXISTS (SELECT FROM there) AND has_table_privilege('public', c.oid, '{rights}')",
    ]
    each = lambda form, source: f"SELECT format({text_of(form)}, nspname, {who}) FROM {source} \\gexec"
    outside = f"pg_namespace n WHERE {user} AND has_schema_privilege({who}, n.oid, 'USAGE') AND nspname NOT IN (SELECT nspname FROM wanted)"
    own = "ALTER DEFAULT PRIVILEGES FOR ROLE CURRENT_USER IN SCHEMA %I"
    return "\n".join([
        "\\set ON_ERROR_STOP on", "-- Holds a password: delete this file when it has been run.", "BEGIN;",
        f"CREATE TEMPORARY TABLE there ON COMMIT DROP AS SELECT oid FROM pg_roles WHERE rolname = {who};", f"CREATE TEMPORARY TABLE wanted ON COMMIT DROP AS {wanted};",
        "CREATE TEMPORARY TABLE dangers (what) ON COMMIT DROP AS\n" + "\nUNION ALL ".join(reasons) + ";",
        "DO $$ BEGIN IF EXISTS (SELECT FROM dangers) THEN RAISE EXCEPTION 'nothing was changed: %', (SELECT string_agg(what, '; ') FROM dangers); END IF; END $$;",
        f"SELECT format('CREATE ROLE %I LOGIN PASSWORD %L', {who}, {word}) WHERE NOT EXISTS (SELECT FROM there) \\gexec",
        *role_statements(role), *[each(f"{verb} %I", "wanted") for verb in ("GRANT USAGE ON SCHEMA %I TO", "GRANT SELECT ON ALL TABLES IN SCHEMA %I TO", f"{own} GRANT SELECT ON TABLES TO")],
        *[each(f"{verb} %I", outside) for verb in (f"{own} REVOKE SELECT ON TABLES FROM", "REVOKE SELECT ON ALL TABLES IN SCHEMA %I FROM", "REVOKE USAGE ON SCHEMA %I FROM")],
        "COMMIT;", "-- If the role was there and is this tool's alone, its password is set by:", f"-- ALTER ROLE {name_of(role)} PASSWORD {word};", "",
    ])


def stage(checks: DataFrame) -> DataFrame:
    """(stage): of checks (id, status), the first stage in order that isn't passed, else ``done``."""
    order = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("id"))
    first = checks.filter("status <> 'pass'").withColumn("o", order).filter("o > 0").agg(F.min_by("id", "o").alias("stage"))
    return first.select(F.coalesce("stage", F.lit("done")).alias("stage"))


def field_state(value: Column, placeholder: Column) -> Column:
    return F.when(value.isNull() | (F.trim(value) == ""), "absent").when(value == placeholder, "placeholder").otherwise("set")


def quoted_pair(identifier: Column, literal: Column) -> Column:
    """An identifier always quoted and a literal, as a generator formats them."""
    return F.concat(always_quoted(identifier), F.lit(" = "), sql_literal(literal))
