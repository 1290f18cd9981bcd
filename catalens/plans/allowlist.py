"""What a statement of the read path may consist of. Anything that is not listed here is refused.

Both the parsed and the analysed plan are walked: all plan nodes, below subqueries and common tables
too, and all expressions. Functions go by the groups of the built-in registry; those that
reach the JVM, the session, files or credentials are in none of the groups taken. A view is
whoever made it's word and is not opened; a relation outside of one must be a table of the catalog,
so that files are never read by their path, whatever the session's settings are.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession

PLANS = frozenset("""
Aggregate CTERelationDef CTERelationRef Deduplicate Distinct Except Expand Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation
LogicalRelation HiveTableRelation DataSourceV2Relation Offset OneRowRelation Pivot Project Range RecursiveCTE ResolvedInlineTable Sample Sort SubqueryAlias Tail Union UnionLoop UnionLoopRef Unpivot UnpivotTransformer
UnresolvedHaving UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction UnresolvedTVFAliases UnresolvedWith UnresolvedHint ResolvedHint
View Window WithCTE WithWindowDefinition
""".split())
EXPRESSIONS = frozenset("""
AggregateExpression Alias AttributeReference CaseWhen Cast CommonExpressionDef CommonExpressionRef Cube CurrentRow$ Exists GroupingSets Grouping GroupingAnalyticsID GroupingID InSubquery InSet
LambdaFunction LateralSubquery LikeAll LikeAny ListQuery Literal MultiAlias NamedLambdaVariable NotLikeAll NotLikeAny OuterReference PivotFirst Rollup ScalarSubquery SortOrder
SpecifiedWindowFrame TempResolvedColumn TypedNullLiteral UnboundedFollowing$ UnboundedPreceding$ UnspecifiedFrame$ WindowExpression WindowSpecDefinition WindowSpecReference With
UnresolvedAlias UnresolvedAttribute UnresolvedExtractValue UnresolvedFunction UnresolvedGenerator UnresolvedNamedLambdaVariable UnresolvedOrdinal UnresolvedStar UnresolvedStarExceptOrReplace UnresolvedWindowExpression UnresolvedCollation ResolvedCollation SemiStructuredExtract
GetArrayItem GetArrayStructFields GetMapValue GetStructField EqualNullSafe IsNotNull Not In And Or
Ceil Floor RoundCeil RoundFloor StringLPad StringRPad BinaryPad Contains StartsWith EndsWith Mode PercentileCont PercentileDisc CurrentDate DatePart Extract Hour Minute Second SecondWithFraction Mask ToCharacter
StringTrim StringTrimLeft StringTrimRight StringTrimBoth Sum Average Explode PosExplode Inline Stack MakeTimestamp TryMakeTimestamp ParseToTimestamp ParseToDate ParseJson VariantGet Collate Collation TryEval
TimeAdd TimestampAddInterval TimestampAddYMInterval DateAddInterval DateAddYMInterval DatetimeSub SubtractDates SubtractTimestamps TimestampAdd TimestampDiff MultiplyDTInterval MultiplyYMInterval MultiplyInterval DivideDTInterval DivideYMInterval DivideInterval
ExtractANSIIntervalDays ExtractANSIIntervalHours ExtractANSIIntervalMinutes ExtractANSIIntervalSeconds ExtractANSIIntervalYears ExtractANSIIntervalMonths KnownNotNull KnownNullable AssertNotNull
""".split())
#: Groups of built-in functions; of the rest, single harmless ones.
GROUPS = frozenset("""
agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs csv_funcs datetime_funcs generator_funcs hash_funcs json_funcs lambda_funcs map_funcs math_funcs
predicate_funcs string_funcs struct_funcs url_funcs variant_funcs window_funcs
""".split())
SINGLE = frozenset({"typeof", "bitmap_bit_position", "bitmap_bucket_number", "bitmap_count", "hll_sketch_estimate", "hll_union", "monotonically_increasing_id"})
#: Functions that may stand where a table does.
TABLES = frozenset({"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple"})

_known: dict[int, tuple[frozenset[str], frozenset[str]]] = {}


def items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def kind(node) -> str:
    return node.getClass().getSimpleName()


def functions(spark: SparkSession) -> tuple[frozenset[str], frozenset[str]]:
    """(names, classes) of the built-in functions that may be called; read once a JVM."""
    if id(spark._jvm) not in _known:
        registry = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
        names, classes = set(SINGLE), set()
        for identifier in items(registry.listFunction()):
            info = registry.lookupFunction(identifier)
            if info.isDefined() and (info.get().getGroup() in GROUPS or info.get().getName() in SINGLE):
                names.add(identifier.funcName().lower())
                classes.add(info.get().getClassName().rsplit(".", 1)[-1])
        _known[id(spark._jvm)] = frozenset(names), frozenset(classes)
    return _known[id(spark._jvm)]


def _trees(flat: list[dict]) -> Iterator[tuple[dict, list]]:
    """Nodes of an expression's JSON, a list in depth-first order; what a view or a replacement holds is left out."""

    def take(at: int, seen: bool) -> tuple[int, list[dict]]:
        node, out = flat[at], []
        if seen:
            out.append(node)
        hidden = node["class"].endswith(".View") or "replacement" in node
        at += 1
        for _ in range(node["num-children"]):
            at, more = take(at, seen and not hidden)
            out += more
        return at, out

    at = 0
    while at < len(flat):
        at, found = take(at, True)
        for node in found:
            yield node, [v for k, v in node.items() if k not in ("class", "num-children", "replacement") and not (node["class"].endswith(".View") and k == "child")]


def _is_tree(value) -> bool:
    return isinstance(value, list) and bool(value) and isinstance(value[0], dict) and "class" in value[0]


def refused_expression(text: str, names: frozenset[str], classes: frozenset[str]) -> str | None:
    """The first thing of an expression (as JSON) that is not listed; plans of its subqueries count as well."""
    todo = [json.loads(text)]
    while todo:
        for node, fields in _trees(todo.pop()):
            short = node["class"].rsplit(".", 1)[-1]
            if short not in EXPRESSIONS and short not in PLANS and short not in classes:
                return short
            if short == "UnresolvedFunction" and node["nameParts"].strip("[]").lower() not in names:
                return node["nameParts"].strip("[]")
            if short == "UnresolvedGenerator" and str(node["name"].get("funcName") if isinstance(node["name"], dict) else node["name"]).lower() not in names:
                return short
            while fields:
                value = fields.pop()
                if _is_tree(value):
                    todo.append(value)
                elif isinstance(value, list):
                    fields += [v for v in value if isinstance(v, list)]
    return None


def refused(spark: SparkSession, plans: Iterable) -> str | None:
    """The first node or expression of a plan's nodes that is not listed."""
    names, classes = functions(spark)
    for node in plans:
        if kind(node) not in PLANS:
            return kind(node)
        if kind(node) == "UnresolvedTableValuedFunction" and ".".join(items(node.name())).lower() not in TABLES:
            return ".".join(items(node.name()))
        if kind(node) == "LogicalRelation" and not node.catalogTable().isDefined():
            return "a relation that is no table of the catalog"
        if kind(node) == "View":
            continue
        for e in items(node.expressions()):
            if found := refused_expression(e.toJSON(), names, classes):
                return found
    return None


def inside(plan) -> Iterator:
    """Every node of an analysed plan and of its subqueries, but for what views hold."""
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        if kind(node) != "View":
            todo += items(node.children()) + items(node.subqueries())
            todo += [x for x in items(node.innerChildren()) if hasattr(x, "subqueries")]


def names_a_file(spark: SparkSession, parts: list[str]) -> bool:
    """Whether a relation's name could be a file's: its first part is neither a catalog nor a database."""
    return len(parts) > 1 and not (spark.catalog.databaseExists(f"`{parts[0]}`") or parts[0] in {c.name for c in spark.catalog.listCatalogs()} or parts[0].lower() == "global_temp")
