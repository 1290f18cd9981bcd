"""Validation without execution: a statement is parsed and analysed, and what fails is triaged."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.errors.exceptions.captured import convert_exception
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as t

from catalens.operators.candidates import rank
from catalens.plans import guard, parameters
from catalens.plans.session import Refused, named, parsed

PASS, HARD, HUMAN, GUARD, INVALID = 0, 1, 2, 3, 4
WRITES = ("InsertIntoStatement", "UpdateTable", "DeleteFromTable", "MergeIntoTable")


@dataclass
class Diagnosis:
    exit_code: int
    sqlstate: str | None = None
    message: str | None = None
    hint: str | None = None
    position: dict | None = None
    parameter_types: list[str] | None = None
    result_types: list[str] | None = None
    candidates: list[dict] | None = None
    suggestion: str | None = field(default=None)

    def as_dict(self) -> dict:
        return asdict(self)


def triage(sqlstate: str | None, schema_known: bool = True) -> int:
    """The exit code of a failure: 4 where the statement is at fault, 2 where rights are, else 1."""
    if not sqlstate:
        return HARD
    if sqlstate == "42501":
        return HUMAN if schema_known else HARD
    if sqlstate in ("42P18", "42P02"):
        return HARD
    return INVALID if sqlstate.startswith("42") or sqlstate == "21S01" else HARD


def line_and_column(sql: str, offset: int) -> dict:
    before = sql[:offset]
    return {"line": before.count("\n") + 1, "column": offset - (before.rfind("\n") + 1) + 1}


def parse_type_array(text: str) -> list[str]:
    """The elements of an array's text form, ``{a,"b,c"}``."""
    inner = text.strip()[1:-1]
    return [re.sub(r"\\(.)", r"\1", q) if q or not bare else bare for q, bare in re.findall(r'"((?:[^"\\]|\\.)*)"|([^,"]+)', inner)]


def type_name(kind: t.DataType) -> str:
    return kind.simpleString()


def _problem(e: Exception) -> PySparkException | None:
    if isinstance(e, PySparkException):
        return e
    return convert_exception(e.java_exception) if isinstance(e, Py4JJavaError) else None


def _position(sql: str, e: PySparkException) -> dict | None:
    contexts = e.getQueryContext() or []
    if contexts and contexts[0].startIndex() >= 0:
        return line_and_column(sql, contexts[0].startIndex())
    m = re.search(r"\(line (\d+), pos (\d+)\)", str(e))
    return {"line": int(m[1]), "column": int(m[2]) + 1} if m else None


def check(spark: SparkSession, sql: str, columns: DataFrame | None = None, tables: DataFrame | None = None, parameter_types: list[str] | None = None, infer: bool = False) -> Diagnosis:
    """Judge a statement; ``columns`` and ``tables`` (candidate, local) are the names to suggest from.

    With ``infer`` the statement may have parameters, whose types are told from their places.
    """
    verdict = guard.evaluate(sql, no_limit=True, mode="prepare")
    if not verdict.ok:
        return Diagnosis(GUARD, message=verdict.reason)
    if not verdict.sql:
        return Diagnosis(INVALID, "42601", "empty statement")
    if infer and parameters.places(verdict.sql):
        given = parameters.infer(spark, verdict.sql)
        typed = parameters.bound(verdict.sql, given)
        out = check(spark, typed, columns, tables, [x or "unknown" for x in given.values()])
        untold = [name for name, kind in given.items() if kind is None]
        if out.exit_code == PASS and untold:
            return Diagnosis(HARD, "42P18", f"nothing tells the type of parameter {', '.join(untold)}", parameter_types=out.parameter_types)
        return out
    try:
        plan = parsed(spark, verdict.sql)
        command = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command")
        kind = plan.getClass().getSimpleName()
        inner = [plan.children().apply(i).getClass().getSimpleName() for i in range(plan.children().size())] if kind == "UnresolvedWith" else []
        writes = kind in WRITES or any(k in WRITES for k in inner)
        if kind == "CompoundBody" or (command.isInstance(plan) and not writes):
            return Diagnosis(INVALID, "42601", f"{kind} is no statement that can be prepared")
        named(spark, plan)
        skip = spark._jvm.org.apache.spark.sql.execution.CommandExecutionMode.SKIP()
        done = spark._jsparkSession.sessionState().executePlan(plan, skip)
        done.assertAnalyzed()
    except Refused as e:
        return Diagnosis(GUARD, message=str(e))
    except (PySparkException, Py4JJavaError) as raw:
        e = _problem(raw)
        if e is None:
            return Diagnosis(HARD, message=str(raw)[:500])
        return _failed(spark, verdict.sql, e, columns, tables, parameter_types)
    types = None if writes else [type_name(f.dataType) for f in t._parse_datatype_json_string(done.analyzed().schema().json()).fields]
    return Diagnosis(PASS, parameter_types=parameter_types or [], result_types=types)


def _failed(spark: SparkSession, sql: str, e: PySparkException, columns, tables, parameter_types) -> Diagnosis:
    state = e.getSqlState()
    out = Diagnosis(triage(state), state, str(e).split("\n")[0], position=_position(sql, e), parameter_types=parameter_types)
    given = e.getMessageParameters() or {}
    out.suggestion = given.get("proposal")
    name, names = None, None
    if state == "42703":
        name, names = given.get("objectName"), columns
    elif state == "42P01":
        name, names = given.get("relationName"), tables
    if name and names is not None and isinstance(e, AnalysisException) and not isinstance(e, ParseException):
        asked = spark.createDataFrame([(name.replace("`", ""),)], "identifier string")
        found = rank(asked, names).orderBy("rank").collect()
        out.candidates = [{"name": r["candidate"], "similarity": r["similarity"]} for r in found]
    return out
