"""Results of any size as CSV: streamed through the driver up to a limit, else written by executors in order.

Records are made in Spark, so that both ways give the same text. A cell is empty for null; an empty
string, and what has a comma, a quote or a line end, is quoted; arrays, maps and structs are JSON, binary is
``\\x`` and hexadecimal digits, numbers and times are as Spark casts them to text. No more than a batch of
records is on the driver at a time.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from catalens.plans.guard import sha8
from catalens.sources.sinks import PREVIEW, csv_cell


@dataclass
class Written:
    """What a sink wrote: how many records, whether there were more, and the first ones with the header."""

    rows: int = 0
    truncated: bool = False
    first: list[str] = field(default_factory=list)


def cell(name: str, kind: t.DataType) -> Column:
    value = F.col(f"`{name.replace('`', '``')}`")
    if isinstance(kind, (t.ArrayType, t.MapType, t.StructType)):
        text = F.to_json(value)
    elif isinstance(kind, t.BinaryType):
        text = F.concat(F.lit("\\x"), F.lower(F.hex(value)))
    else:
        text = value.cast("string")
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.isNull() | text.isNull(), "").when((text == "") | text.rlike(r'[,"\n\r]'), quoted).otherwise(text)


def records(df: DataFrame, secrets: Iterable[str] = (), form: str = "csv") -> DataFrame:
    """One column ``record``: each row's CSV, or its cells with tabs between, with secrets redacted."""
    named = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # columns of equal names are columns, too
    cells = [cell(f.name, f.dataType) if form == "csv" else F.coalesce(F.col(f.name).cast("string"), F.lit("")) for f in named.schema.fields]
    out = F.concat_ws("," if form == "csv" else "\t", *cells) if cells else F.lit("")
    for s in sorted({s for s in secrets if s}, key=len, reverse=True):
        out = F.replace(out, F.lit(s), F.lit("[REDACTED]"))
    return named.select(out.alias("record"))


def header(df: DataFrame) -> str:
    return ",".join(map(csv_cell, df.columns))


def stream(df: DataFrame, path: str | os.PathLike, limit: int | None, secrets: Iterable[str] = (), form: str = "csv") -> Written:
    """Write up to ``limit`` records to one file, whole or not at all; a record beyond tells that there were more."""
    done = Written(first=[header(df)] if form == "csv" else [])
    most = PREVIEW - (form != "csv")
    handle, temporary = tempfile.mkstemp(dir=Path(path).parent)
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            f.writelines(f"{x}\n" for x in done.first)
            for r in records(df, secrets, form).toLocalIterator():
                if limit is not None and done.rows == limit:
                    done.truncated = True
                    break
                f.write(r["record"] + "\n")
                done.rows += 1
                if len(done.first) < most:
                    done.first.append(r["record"])
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise
    return done


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def put(spark: SparkSession, path: str, text: str, new: bool = False) -> bool:
    """Write a small file on the cluster's file system; with ``new``, only where there is none: whether it was written."""
    p, files = _files(spark, path)
    try:
        out = files.create(p, not new)
    except Exception:
        if new and files.exists(p):
            return False
        raise
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    return True


def claim(spark: SparkSession, folder: str, sql: str, now: datetime | None = None) -> str:
    """A new folder's path; its facts' file is created with it, in one step that no other run can take as well."""
    stem = f"{folder.rstrip('/')}/{(now or datetime.now(UTC)).strftime('%Y%m%dT%H%M%SZ')}-{sha8(sql)}"
    for n in range(1, 10_000):
        path = f"{stem}.csv" if n == 1 else f"{stem}-{n}.csv"
        if put(spark, f"{path}.meta", "", new=True):
            return path
    raise FileExistsError(stem)


def write_parts(df: DataFrame, path: str, secrets: Iterable[str] = ()) -> Written:
    """Write all records as parts in the order of the rows, by executors; the folder is there whole or not at all.

    ``0-header.csv`` comes first by name, so that the files one after the other are one CSV.
    """
    spark = df.sparkSession
    temporary = f"{path}.{uuid.uuid4().hex}"
    seen = Observation()
    records(df, secrets).observe(seen, F.count("*").alias("n")).write.option("lineSep", "\n").text(temporary)
    put(spark, f"{temporary}/0-header.csv", header(df) + "\n")
    (old, files), (new, _) = _files(spark, temporary), _files(spark, path)
    if not files.rename(old, new):
        files.delete(old, True)
        raise FileExistsError(path)
    return Written(seen.get["n"], False, [header(df)])
