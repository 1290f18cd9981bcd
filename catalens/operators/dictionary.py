"""The whole dictionary: from collected parts to files, written only when every rule holds."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from catalens.functions import text as T
from catalens.operators import collect, ddl, inference, semantics, validate
from catalens.sources import documents, sinks


def parts_of(facts: Mapping[str, DataFrame], scope: str = "") -> dict[str, DataFrame]:
    """The flat parts of collection, without a document between."""
    views = collect.VIEW_KINDS
    return {
        "schemas": collect.schemas(facts, scope), "tables": collect.tables(facts, scope), "columns": collect.columns(facts, scope), "indexes": collect.indexes(facts, scope), "constraints": collect.constraints(facts, scope),
        "triggers": collect.triggers(facts, scope), "views": collect.views(facts, scope), "view_columns": collect.columns(facts, scope, views), "view_indexes": collect.indexes(facts, scope, views), "functions": collect.functions(facts, scope),
    }


def run(spark: SparkSession, text: str, root: str, confirmed_text: str = "") -> dict:
    """Bring the files under ``root`` in line with a document; a second run changes nothing.

    What is rendered is metadata, a bounded number of objects, and is written by the driver.
    """
    document = documents.parse(spark, text).cache()
    try:
        head = document.select("requested_schemas").first()
        requested = head["requested_schemas"]
        p = documents.parts(document)
        validate.check(p, requested)
        confirmed, warnings = documents.confirmed(spark, confirmed_text)
        done: dict[str, list[str]] = {"written": [], "deleted": [], "unchanged": []}

        def add(found: Mapping[str, list[str]]) -> None:
            for k, v in found.items():
                done[k] += v

        def whole(path: Path, content: str) -> None:
            done["written" if sinks.replace_file(path, content) else "unchanged"].append(str(path))

        top = Path(root)
        names = sorted(r["schema"] for r in p["schemas"].select("schema").collect())
        present = sorted(d.name for d in top.iterdir() if d.is_dir() and d.name[0] not in "_.") if top.exists() else []
        for gone in set(present) - set(names):
            if requested is None or gone in requested:
                add(sinks.collapse(root, gone))
        rendered = {
            "table": [(r["schema"], r["name"], r["name"], r["ddl"]) for r in ddl.table_ddl(p).collect()],
            "view": [(r["schema"], r["name"], r["name"], r["ddl"]) for r in ddl.view_ddl(p["views"], p["view_columns"], p["view_indexes"]).collect()],
            "function": [(r["schema"], r["name"], f"{r['name']}({r['identity_args']})", r["ddl"]) for r in ddl.function_ddl(p["functions"], p["triggers"]).collect()],
        }
        index = ddl.schema_index(p).orderBy("schema", "kind", "name").collect()
        pieces = {r["schema"]: r["json"] for r in documents.slices(document).collect()}
        for schema in names:
            for kind, rows in rendered.items():
                objects: dict[str, dict[str, str]] = {}
                for s, name, part, body in sorted(rows):
                    if s == schema:
                        objects.setdefault(name, {})[f"{kind}:{part}"] = body
                add(sinks.sync_folder(root, schema, kind, objects))
            lines = [f"| {r['kind']} | [{r['name']}]({r['file']}) | {r['note']} |" for r in index if r["schema"] == schema]
            whole(top / schema / "README.md", f"# {schema}\n\n| kind | name | notes |\n|-|-|-|\n" + "".join(x + "\n" for x in lines))
            whole(top / schema / "_collect.json", pieces[schema] + "\n")
        cols = semantics.top_columns(p["tables"], p["columns"])
        marked = semantics.annotated(cols)
        known = confirmed.join(cols.select(semantics.qualified().alias("source")), "source", "left_semi")
        warnings += [f"confirmed relation of a column that is gone: {r['source']}" for r in inference.stale(cols, confirmed).collect()]
        found = inference.candidates(semantics.top_level(p["tables"]), cols, confirmed, marked).orderBy("source", "target").collect()
        whole(top / "_candidates.yaml", "".join(f"- source: {r['source']}\n  target: {r['target']}\n  signal: {r['signal']}\n" for r in found) or "[]\n")
        statements = inference.pending(cols, known).orderBy("source").collect()
        whole(top / "_pending.sql", "".join(r["statement"] + "\n" for r in statements))
        pairs = semantics.merged_relations(marked, confirmed)
        drawn = semantics.diagram(pairs).orderBy("from_node", "to_node").collect()
        related = pairs.orderBy("target", "source").collect()
        items = semantics.enums(cols).orderBy("column", semantics.F.try_to_number("value", semantics.F.lit("S999999999")), "value").collect()
        private = semantics.sensitive(cols).orderBy("column").collect()
        report = ["# Relations\n\n```mermaid\nerDiagram\n", *[r["line"] + "\n" for r in drawn], "```\n\n", *[f"- {r['target']} <- {r['source']}\n" for r in related]]
        report += ["\n## Enumerations\n\n", *[f"- {r['column']}: {r['value']} = {r['meaning']}\n" for r in items], "\n## Sensitive\n\n", *[f"- {r['column']}{' (declared safe)' if r['declared_safe'] else ''}\n" for r in private]]
        whole(top / "_relations.md", "".join(report))
        missing = semantics.gaps(p["tables"], p["columns"], p["functions"]).orderBy("kind", "name").collect()
        whole(top / "_gaps.md", "# Gaps\n\n" + "".join(f"- {r['kind']}: {r['name']}\n" for r in missing))
        counts = semantics.schema_counts(p["schemas"], p["tables"], p["views"], p["functions"]).orderBy("schema").collect()
        outside = [s for s in present if s not in names and requested is not None and s not in requested]
        body = "".join(f"| {r['schema']} | {r['n_tables']} | {r['n_views']} | {r['n_functions']} |\n" for r in counts) + "".join(f"| {s} | out of scope | | |\n" for s in outside)
        whole(top / "README.md", "# Schemas\n\n| schema | tables | views | functions |\n|-|-|-|-|\n" + body)
        gaps: dict[str, int] = {}
        for r in missing:
            gaps[r["kind"]] = gaps.get(r["kind"], 0) + 1
        return {**done, "schemas": names, "gaps": gaps, "requested_schemas": requested, "out_of_scope_schemas": outside, "warnings": warnings}
    finally:
        document.unpersist()


def row_labels(tables: DataFrame) -> DataFrame:
    return tables.select("schema", "name", T.row_label(semantics.F.col("reltuples")).alias("rows"))
