"""Types of a statement's parameters (``?`` and ``:name``), as the analyser itself would have them.

Each parameter is bound to a typed null of each type in question, and the statement is analysed, not run. The
type for which the analyser adds the fewest casts is what the place asks for: by a comparison, a list, an operator, a
function's signature or an insert's column. Where no type is better than another the place tells nothing. A name has one
type in all of its places; parameters that only meet each other are told once one of them is known.
"""

from __future__ import annotations

import json
import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from catalens.plans import allowlist, guard
from catalens.plans.session import READING, nodes, parsed

#: Types that are tried, before those of the columns that are read; of equals the first is taken.
TYPES = ("string", "int", "bigint", "double", "boolean", "date", "timestamp", "binary")
_MARK = re.compile(r"\?|(?<![:\w)\]`]):([A-Za-z_]\w*)")
#: A limit has to be a number when the statement is analysed.
_LIMIT = re.compile(r"\b(LIMIT|OFFSET)\s+$", re.I)


def places(sql: str) -> list[tuple[int, int, str]]:
    """(start, end, name) of each parameter outside of comments and quoted text; a ``?`` is named by its number."""
    out = []
    for m in _MARK.finditer(guard.mask(sql)):
        out.append((m.start(), m.end(), m.group(1) or str(1 + sum(n.isdigit() for *_, n in out))))
    return out


def bound(sql: str, types: dict[str, str | None]) -> str:
    """``sql`` with typed nulls, or plain ones, for its parameters."""
    parts, at = [], 0
    for start, end, name in places(sql):
        kind = types.get(name)
        parts += [sql[at:start], "1" if _LIMIT.search(sql[at:start]) else f"CAST(NULL AS {kind})" if kind else "NULL"]
        at = end
    return "".join([*parts, sql[at:]])


def _changes(flat: list) -> int:
    """How many casts to another type an expression's JSON has, its subqueries too; a null without a type is of any."""
    n = 0
    for at, node in enumerate(flat):
        if isinstance(node, list):
            n += _changes(node)
        elif isinstance(node, dict):
            child = flat[at + 1].get("dataType") if node.get("class", "").endswith(".Cast") else "void"
            n += child not in ("void", node.get("dataType"))
            n += _changes([v for v in node.values() if isinstance(v, list)])
    return n


def _casts(spark: SparkSession, sql: str) -> int | None:
    """How many casts the analysed statement has; None if it can't be analysed."""
    try:
        skip = spark._jvm.org.apache.spark.sql.execution.CommandExecutionMode.SKIP()
        done = spark._jsparkSession.sessionState().executePlan(parsed(spark, sql), skip)
        done.assertAnalyzed()
        return sum(_changes(json.loads(e.toJSON())) for node in allowlist.inside(done.analyzed()) if allowlist.kind(node) != "View" for e in allowlist.items(node.expressions()))
    except (PySparkException, Py4JJavaError):
        return None


def _read(spark: SparkSession, sql: str) -> list[str]:
    """Types of the columns of the tables that a statement names."""
    found: dict[str, None] = {}
    try:
        for node, _ in nodes(parsed(spark, sql)):
            if allowlist.kind(node) in READING:
                name = ".".join(f"`{p}`" for p in allowlist.items(node.multipartIdentifier()))
                if spark.catalog.tableExists(name):
                    found |= dict.fromkeys(f.dataType.simpleString() for f in spark.table(name).schema.fields)
    except (PySparkException, Py4JJavaError):
        pass
    return list(found)


def infer(spark: SparkSession, sql: str) -> dict[str, str | None]:
    """The type of each parameter in order of their first places; None where nothing tells it."""
    types: dict[str, str | None] = {name: "int" if _LIMIT.search(sql[:start]) else None for start, _, name in places(sql)}
    tried = list(dict.fromkeys([*TYPES, *_read(spark, bound(sql, {}))]))
    for _ in range(2):  # the second time with what the first one told of the others
        for name in [n for n, kind in types.items() if kind is None]:
            costs = {kind: _casts(spark, bound(sql, {**types, name: kind})) for kind in tried}
            able = [c for c in costs.values() if c is not None]
            best = [kind for kind in tried if able and costs[kind] == min(able)]
            if best and 2 * len(best) <= len(tried):  # what suits most types tells none
                types[name] = best[0]
    return types
