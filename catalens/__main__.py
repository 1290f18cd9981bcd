"""Command line: ``python -m catalens query|check|dictionary|guard``."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path


def views(spark, folder: str) -> list[str]:
    """Each Parquet table of a folder as a view."""
    names = []
    for path in sorted(Path(folder).glob("*.parquet")):
        spark.read.parquet(str(path)).createOrReplaceTempView(path.stem)
        names.append(path.stem)
    return names


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="catalens")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("query", "check", "guard"):
        s = sub.add_parser(name)
        s.add_argument("--sql", help="the statement; without it, it is read from the standard input")
        s.add_argument("--sql-file")
        if name != "guard":
            s.add_argument("--tables", required=True, help="folder of Parquet tables")
            s.add_argument("--out", default="results")
        if name != "check":
            limits = s.add_mutually_exclusive_group()
            limits.add_argument("--limit", default="200")
            limits.add_argument("--no-limit", action="store_true")
        if name == "query":
            s.add_argument("--dictionary", required=True)
            s.add_argument("--format", choices=("csv", "text"), default="csv")
        if name == "guard":
            s.add_argument("--prepare", action="store_true")
    s = sub.add_parser("dictionary")
    s.add_argument("--root", required=True)
    s.add_argument("--confirmed", help="file of confirmed relations")
    a = p.parse_args(argv)
    statement = lambda: a.sql if a.sql is not None else Path(a.sql_file).read_text() if a.sql_file else sys.stdin.read()

    if a.command == "guard":
        from catalens.plans.guard import evaluate

        verdict = evaluate(statement(), a.limit, a.no_limit, "prepare" if a.prepare else "query")
        print(json.dumps(verdict.as_dict(), ensure_ascii=False))
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("catalens").getOrCreate()
    if a.command == "dictionary":
        from catalens.operators.dictionary import run

        print(json.dumps(run(spark, sys.stdin.read(), a.root, Path(a.confirmed).read_text() if a.confirmed else ""), ensure_ascii=False))
        return 0
    from catalens.plans import entry

    names = views(spark, a.tables)
    if a.command == "query":
        out = entry.run_query(spark, statement(), a.dictionary, a.out, a.limit, a.no_limit, a.format, names)
    else:
        from catalens.operators.candidates import names_of_views

        out = entry.run_check(spark, statement(), a.out, *names_of_views(spark, names))
    print(out.text)
    return out.exit_code


if __name__ == "__main__":
    sys.exit(main())
