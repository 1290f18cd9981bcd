"""The guarded read path: one statement, judged as text and as a plan, with a bounded result."""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from catalens.plans import allowlist, guard
from catalens.plans.allowlist import items

DEFAULT_LIMIT, NO_LIMIT, TIMEOUT_S = 200, 2147483647, 30
#: Functions that reach beyond data: they call any code of the JVM, or name a relation or function by a string.
DENIED_FUNCTIONS = frozenset({"java_method", "reflect", "try_reflect", "identifier"})
#: What may be shown: names and columns.
SHOWN = frozenset({"ShowTables", "ShowViews", "ShowNamespaces", "ShowColumns", "ShowFunctions", "ShowCurrentNamespaceCommand"})
#: Nodes of a parsed plan that read, or show, a relation by its name.
READING = frozenset({"UnresolvedRelation", "UnresolvedTable", "UnresolvedTableOrView", "UnresolvedView"})


class Refused(ValueError):
    """A statement that the read path does not run; ``reason`` says why."""

    def __init__(self, reason: str, detail: str = ""):
        super().__init__(f"{reason}: {detail}" if detail else reason)
        self.reason = reason


@dataclass
class Result:
    df: DataFrame
    kind: str
    sql: str
    sha8: str
    limit: int | None


def parsed(spark: SparkSession, sql: str):
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)


def nodes(plan, ctes: frozenset[str] = frozenset()) -> Iterable[tuple]:
    """Every node of a parsed plan with the names of the common tables that it sees.

    A WITH is seen by its own query and by its later tables (a recursive one by itself,
    too), not by what stands outside of it.
    """
    todo = [(plan, ctes)]
    while todo:
        node, seen = todo.pop()
        yield node, seen
        own = []
        if _kind(node) == "UnresolvedWith":
            inside = seen
            for cte in items(node.cteRelations()):
                name = cte._1().lower()
                todo.append((cte._2(), inside | {name} if node.allowRecursion() else inside))
                inside = inside | {name}
            own = [(node.child(), inside)]
        else:
            own = [(x, seen) for kids in (node.children(), node.innerChildren()) for x in items(kids) if _is_plan(x)]
        todo += own
        todo += [(x, seen) for x in items(node.subqueries())]


def _is_plan(x) -> bool:
    return hasattr(x, "innerChildren") and hasattr(x, "subqueries")


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def named(spark: SparkSession, plan, relations: Iterable[str] | None = None) -> None:
    """Raise where a parsed plan reads a relation that is not one of ``relations``, or may be a file."""
    names = {r.lower() for r in relations} if relations is not None else None
    for node, ctes in nodes(plan):
        if _kind(node) == "PlanWithUnresolvedIdentifier":
            raise Refused("relation-not-allowed", "a relation named by an expression")
        if _kind(node) in READING:
            parts = items(node.multipartIdentifier())
            name = ".".join(parts).lower()
            own = _kind(node) == "UnresolvedRelation" and name in ctes
            if not own and (name not in names if names is not None else allowlist.names_a_file(spark, parts)):
                raise Refused("relation-not-allowed", name)


def allowed(spark: SparkSession, sql: str, relations: Iterable[str] | None = None) -> None:
    """Raise unless the statement only reads, by what ``allowlist`` lists, what it may read.

    Spark runs commands, and inserts below a WITH, as soon as they are given to
    ``spark.sql``, so this looks at the parsed plan first and then at the analysed one.
    ``relations`` limits what may be read, also by what is explained or shown.
    """
    text = guard.mask(sql, True).lower()
    for name in DENIED_FUNCTIONS:
        if re.search(rf"\b{name}\b`?\s*\(", text):
            raise Refused("function-not-allowed", name)
    plan = parsed(spark, sql)
    if _kind(plan) == "ExplainCommand":
        plan = plan.logicalPlan()
    if _kind(plan).startswith("Show"):
        if _kind(plan) not in SHOWN:
            raise Refused("not-read-only", _kind(plan))
        return named(spark, plan, relations)
    command = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command")
    parse_insert = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.ParsedStatement")
    for node, _ in nodes(plan):
        if command.isInstance(node) or parse_insert.isInstance(node):
            raise Refused("not-read-only", _kind(node))
    named(spark, plan, relations)
    if found := allowlist.refused(spark, (node for node, _ in nodes(plan))):
        raise Refused("not-listed", found)
    skip = spark._jvm.org.apache.spark.sql.execution.CommandExecutionMode.SKIP()
    analysed = spark._jsparkSession.sessionState().executePlan(plan, skip).analyzed()
    if found := allowlist.refused(spark, allowlist.inside(analysed)):
        raise Refused("not-listed", found)


def query(spark: SparkSession, sql: str, limit: int | str | None = DEFAULT_LIMIT, no_limit: bool = False, relations: Iterable[str] | None = None) -> Result:
    """Judge and analyse one statement; its rows are read when the result is used.

    A result has one row over the limit where there are more, to tell that it was cut.
    The session's settings are left as they are, so threads can share it.
    """
    most = guard.positive(limit)
    no_limit = no_limit or (most is not None and most >= NO_LIMIT)  # Spark's own bound of a limit
    verdict = guard.evaluate(sql, limit, no_limit)
    if not verdict.ok:
        raise Refused(verdict.reason)
    allowed(spark, verdict.sql, relations)
    df = spark.sql(verdict.wrapped)
    n = most if verdict.kind in ("select", "with") and not no_limit else None
    return Result(df, verdict.kind, verdict.sql, verdict.sha8, n)


@contextmanager
def timed(spark: SparkSession, timeout_s: float = TIMEOUT_S) -> Iterator[None]:
    """Jobs of this thread are cancelled when the time is over."""
    sc = spark.sparkContext
    tag = f"catalens-{uuid.uuid4().hex}"
    sc.addJobTag(tag)
    timer = threading.Timer(timeout_s, sc.cancelJobsWithTag, [tag])
    timer.start()
    try:
        yield
    finally:
        timer.cancel()
        sc.removeJobTag(tag)


def fetch(result: Result, timeout_s: float = TIMEOUT_S) -> tuple[list, bool, int]:
    """(rows, truncated, elapsed ms) of a result that fits the driver; others go to files by ``sources.results``."""
    began = time.monotonic()
    with timed(result.df.sparkSession, timeout_s):
        rows = result.df.collect()
    cut = result.limit is not None and len(rows) > result.limit
    return rows[: result.limit] if cut else rows, cut, int((time.monotonic() - began) * 1000)
