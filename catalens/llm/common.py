"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from types import ModuleType

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens import shared
from catalens.shared import materialize

SLICE = 256


def ship(name: str) -> None:
    """Send functions of module ``name`` to executors by value: they need not have this package."""
    module: ModuleType = sys.modules[name]
    cloudpickle.register_pickle_by_value(module)


ship(__name__)


#: Rows that a reader or a Python worker holds at once. Texts are long: at Spark's defaults one batch has tens of MB.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1024, "spark.sql.parquet.columnarReaderBatchSize": 512}


def small_batches(spark: SparkSession) -> None:
    """Lower the session's batch sizes to ``BATCHES``, where they are higher."""
    for key, most in BATCHES.items():
        if not 0 < int(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file; every machine of a cluster has the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def boxed(docs: DataFrame, strict: bool = True) -> DataFrame | None:
    """_doc (each row whole, so that no name in it can clash), _file and _row: its place in its Parquet file.

    The place is a key that no re-run changes. ``docs`` must read files directly; with
    ``strict`` off None is returned if it doesn't.
    """
    try:
        at = docs.metadataColumn("_metadata")
        return docs.select(F.struct("*").alias("_doc"), F.xxhash64(at["file_path"]).alias("_file"), at["row_index"].alias("_row"), at["file_path"].alias("_path"))
    except AnalysisException:
        if strict:
            raise
        return None


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` itself where it reads files directly, else a written copy."""
    return docs if boxed(docs, strict=False) is not None else materialize(docs, "documents")


#: Rows of a file that share a row of what is broadcast, and how many such chunks are kept together when blocks are made.
CHUNK, TOGETHER = 64, (4096, 256, 16, 1)


def met(docs: DataFrame, rows: DataFrame, then: Callable[[DataFrame], DataFrame], weight: Column | None = None, every: bool = False, most: int | None = None) -> DataFrame:
    """``then`` of the rows of ``docs`` (_doc, _file, _row, _value) that ``rows`` has a _value for; no text is moved.

    ``rows`` (_file, _row, _value, unique by place) is narrow. With ``every`` all rows come,
    those without one with a null _value. ``rows`` may have a further column _layer; a row then
    comes once a layer (not with ``every``).

    ``rows`` is gathered into chunks of ``CHUNK`` neighbouring places, and chunks into blocks of at
    most ``most`` bytes (``weight``: those of a value beyond a number; one chunk is never cut),
    each a run of files. A block is broadcast to the scan of its own files only. Where there is
    more than one block they run one after the other and their results are written, so that
    what is broadcast at once doesn't grow with the data.
    """
    most = shared.BROADCAST_BYTES if most is None else most
    layer = ["_layer"] if "_layer" in rows.columns else []
    entry = F.struct((F.col("_row") % CHUNK).cast("int").alias("k"), F.col("_value").alias("v"))
    size = (F.lit(112) + F.sum(F.lit(32) + (F.lit(0) if weight is None else weight))).cast("long")
    chunks = rows.groupBy("_file", F.expr(f"_row div {CHUNK}").alias("_chunk"), *layer).agg(F.collect_list(entry).alias("_entries"), size.alias("_bytes"))
    chunks = materialize(chunks.select("_file", "_chunk", F.col("_entries.k").alias("_k"), F.col("_entries.v").alias("_v"), "_bytes"), "chunks")
    found = F.expr(f"try_element_at(_v, nullif(cast(array_position(_k, cast(_row % {CHUNK} AS int)) AS int), 0))")

    def join(left: DataFrame, right: DataFrame) -> DataFrame:
        left = left.withColumn("_chunk", F.expr(f"_row div {CHUNK}"))
        both = left.join(F.broadcast(right.drop("_bytes")), ["_file", "_chunk"], "left" if every else "inner").select("_doc", "_file", "_row", found.alias("_value"))
        return then(both if every else both.filter("_value IS NOT NULL"))

    if (chunks.agg(F.sum("_bytes")).first()[0] or 0) <= most:
        return join(boxed(docs), chunks)
    for together in TOGETHER:
        part = F.expr(f"_chunk div {together}")
        sizes = chunks.groupBy("_file", part.alias("part")).agg(F.sum("_bytes").alias("n"))
        if sizes.agg(F.max("n")).first()[0] <= most:
            break
    # One row for some 262,144 documents; the driver holds the list of files for the scan in any case.
    places = boxed(docs).groupBy("_path", "_file", F.expr(f"_row div {CHUNK * together}").alias("part")).count().join(sizes, ["_file", "part"], "left" if every else "inner")
    blocks: list[dict[tuple[str, int], list[int]]] = []
    times: Counter = Counter()
    held = 0
    for path, file, k, n in sorted((r["_path"], r["_file"], r["part"], r["n"] or 0) for r in places.collect()):
        if not blocks or held + n > most:
            blocks.append({})
            held = 0
        if (path, file) not in blocks[-1]:
            times[file] += 1
        blocks[-1].setdefault((path, file), []).append(k)
        held += n
    done = []
    for block in blocks:
        mine = F.col("_file").isin([f for _, f in block])
        for (_, f), own in block.items():
            if times[f] > 1:
                mine = mine & ((F.col("_file") != f) | part.isin(own))
        left = boxed(docs.filter(docs.metadataColumn("_metadata")["file_path"].isin([p for p, _ in block])))
        left = left.withColumn("_chunk", F.expr(f"_row div {CHUNK}")).filter(mine).drop("_chunk")
        done.append(materialize(join(left, chunks.filter(mine)), "block"))
    return reduce(DataFrame.unionByName, done)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut batches so that few rows are unpacked to Python objects at once."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def hashed_share(column: Column) -> Column:
    """A number in [0, 1) that depends on the value of ``column`` only."""
    return F.pmod(F.xxhash64(F.lit(11), column), F.lit(1 << 30)) / F.lit(float(1 << 30))
