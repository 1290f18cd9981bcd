"""The two entries for query authors: run a guarded query to files, and validate a statement to a diagnosis."""

from __future__ import annotations

import json
import time
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from catalens.plans import check, session
from catalens.sources import results, sinks

OK, FAILED, HUMAN, REFUSED = 0, 1, 2, 3
LEAST_VERSION = (3, 5)


@dataclass
class Outcome:
    """What an entry did: an exit code, the files it wrote and the text to show."""

    exit_code: int
    text: str
    path: str | None = None
    meta: str | None = None


def version_ok(version: str, least: tuple[int, int] = LEAST_VERSION) -> bool:
    return tuple(int(x) for x in version.split(".")[:2]) >= least


def has_dictionary(root: str) -> bool:
    """Whether there is a schema folder in ``root``."""
    top = Path(root)
    return top.is_dir() and any(d.is_dir() and d.name[0] not in "_." for d in top.iterdir())


def run_query(
    spark: SparkSession, sql: str, dictionary: str, folder: str, limit: int | str | None = session.DEFAULT_LIMIT, no_limit: bool = False, form: str = "csv",
    relations: Iterable[str] | None = None, timeout_s: float = session.TIMEOUT_S, secrets: Iterable[str] = (),
) -> Outcome:
    """Run one statement and write its rows and what they are; codes 0 done, 1 failed, 2 needs a person, 3 refused.

    A query author has to have read the dictionary, so without one nothing is run.
    EXPLAIN and SHOW give text whatever was asked for. CSV with a limit is streamed to one
    file; without one, executors write a folder of parts. Text is streamed to one file in any case.
    """
    if not has_dictionary(dictionary):
        return Outcome(HUMAN, f"there is no dictionary in {dictionary}; make it first")
    path = None
    try:
        result = session.query(spark, sql, limit, no_limit, relations)
        reads = result.kind in ("select", "with")
        note = "" if reads or form != "csv" else "rows of EXPLAIN and SHOW are text\n"
        form = form if reads else "text"
        began = time.monotonic()
        with session.timed(spark, timeout_s):
            if form == "csv" and result.limit is None:
                path = results.claim(spark, str(Path(folder).absolute()) if "://" not in folder else folder, result.sql)
                done = results.write_parts(result.df, path, secrets)
            else:
                Path(folder).mkdir(parents=True, exist_ok=True)
                path = sinks.claim(folder, result.sql, "csv" if form == "csv" else "txt")
                done = results.stream(result.df, path, result.limit, secrets, form)
        elapsed = int((time.monotonic() - began) * 1000)
    except session.Refused as e:
        return Outcome(REFUSED, str(e))
    except Exception as e:  # a cancelled or failed job comes from the JVM
        if path:
            _give_back(spark, str(path))
        return Outcome(FAILED, sinks.redact(str(e).split("\n")[0], secrets))
    facts = sinks.meta(sinks.redact(result.sql, secrets), done.rows, done.truncated, result.limit, elapsed, form)
    results.put(spark, f"{Path(path).absolute() if '://' not in str(path) else path}.meta", facts)
    shown = f"{path}\n" + "".join(f"{x}\n" for x in done.first) + ("… (truncated, see .meta)\n" if done.truncated and form == "csv" else "")
    return Outcome(OK, note + shown, str(path), facts)


def _give_back(spark: SparkSession, path: str) -> None:
    """Delete what a failed run had claimed."""
    for name in (path, f"{path}.meta"):
        p = spark._jvm.org.apache.hadoop.fs.Path(name)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def run_check(spark: SparkSession, sql: str, folder: str, columns: DataFrame | None = None, tables: DataFrame | None = None, parameter_types: list[str] | None = None) -> Outcome:
    """Validate a statement, write the diagnosis and tell it in a few lines; nothing is executed."""
    if not version_ok(spark.version):
        return Outcome(FAILED, f"version {spark.version} is too old")
    try:
        found = check.check(spark, sql, columns, tables, parameter_types, infer=True)
    except AnalysisException as e:  # a failure of the check itself
        return Outcome(FAILED, str(e).split("\n")[0])
    Path(folder).mkdir(parents=True, exist_ok=True)
    path = sinks.claim(folder, sql, "json")
    sinks.replace_file(path, json.dumps(found.as_dict(), ensure_ascii=False, indent=2) + "\n")
    return Outcome(found.exit_code, told(found), str(path))


def told(d: check.Diagnosis) -> str:
    if d.exit_code == check.PASS:
        return "ok" + (f": {', '.join(d.result_types)}" if d.result_types else "")
    lines = [f"{d.sqlstate or 'refused'}: {d.message}"]
    if d.position:
        lines.append(f"at line {d.position['line']}, column {d.position['column']}")
    if d.suggestion:
        lines.append(f"suggested: {d.suggestion}")
    lines += [f"close: {c['name']} ({c['similarity']})" for c in d.candidates or []]
    return "\n".join(lines)
