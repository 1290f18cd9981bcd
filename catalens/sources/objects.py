"""A dictionary of any number of objects on the cluster's file system, brought in line by what differs only.

Under the root are ``objects/run=<n>``, the bodies that run n wrote, and ``manifests/run=<n>``, all objects there
are since run n: schema, kind, name, hash of the body, and the run whose folder has it. A run compares hashes with
the last manifest, writes new and changed bodies by executors, and its manifest last; readers take the last whole
manifest, so what a stopped run left behind is never read. A run that finds nothing to do writes nothing.

Only keys and hashes are shuffled to be compared; bodies move only if they changed.

Defined cases: a null body is an empty one; rows that are equal are one object; a null in a key, or two bodies under one
key, raises ``ValueError`` before anything is written; an empty table takes all objects away; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens.shared import BROADCAST_BYTES, materialize, small
from catalens.sources.results import _files, put

KEY = ["schema", "kind", "name"]
MANIFEST = "schema string, kind string, name string, sha256 string, held_by long"
#: Bytes of a row of keys in a broadcast; beyond ``BROADCAST_BYTES`` of them both sides are dealt out.
KEY_BYTES = 512


def runs(spark: SparkSession, root: str, whole: bool = True) -> list[int]:
    """Numbers of the runs with a whole manifest, or of all that were begun."""
    folder, files = _files(spark, f"{root}/{'manifests' if whole else 'claims'}")
    found = [f.getPath() for f in files.listStatus(folder)] if files.exists(folder) else []
    named = [(int(p.getName().removeprefix("run=")), p) for p in found if p.getName().startswith("run=")]
    return sorted(n for n, p in named if not whole or files.exists(_files(spark, f"{p}/_SUCCESS")[0]))


def manifest(spark: SparkSession, root: str, run: int | None = None) -> DataFrame:
    """The objects there are since a run, by default the last one; none before the first."""
    run = max(runs(spark, root), default=0) if run is None else run
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifests/run={run}") if run else spark.createDataFrame([], MANIFEST)


def read(spark: SparkSession, root: str, run: int | None = None) -> DataFrame:
    """schema, kind, name and body of all objects since a run."""
    there = manifest(spark, root, run)
    folder, files = _files(spark, f"{root}/objects")
    if not files.exists(folder):
        return there.select(*KEY, F.lit("").alias("body"))
    bodies = spark.read.schema("schema string, kind string, name string, body string, run long").parquet(f"{root}/objects")
    return bodies.withColumnRenamed("run", "held_by").join(there, [*KEY, "held_by"]).select(*KEY, "body")


def differences(objects: DataFrame, root: str) -> DataFrame:
    """schema, kind, name, sha256, held_by and action (new, changed, unchanged, deleted) of every object, old or new."""
    spark = objects.sparkSession
    sha = F.sha2(F.coalesce("body", F.lit("")), 256)
    now = objects.select(*KEY, sha.alias("now")).groupBy(*KEY).agg(F.min("now").alias("now"), F.max("now").alias("other"))
    now = materialize(now, "hashes")
    missing = F.col("schema").isNull() | F.col("kind").isNull() | F.col("name").isNull()
    if wrong := now.filter(missing | (F.col("now") != F.col("other"))).first():
        raise ValueError(f"no key, or two bodies: {wrong['schema']}.{wrong['kind']}.{wrong['name']}")
    both = manifest(spark, root).join(now.drop("other"), KEY, "full")
    action = F.when(F.col("now").isNull(), "deleted").when(F.col("sha256").isNull(), "new").when(F.col("sha256") != F.col("now"), "changed").otherwise("unchanged")
    return materialize(both.select(*KEY, F.coalesce("now", "sha256").alias("sha256"), "held_by", action.alias("action")), "differences")


def sync(objects: DataFrame, root: str) -> DataFrame:
    """Bring the objects under ``root`` in line with schema, kind, name and body of ``objects``; what was done with each."""
    spark = objects.sparkSession
    done = differences(objects, root)
    if done.filter("action <> 'unchanged'").isEmpty():
        return done
    run = max(runs(spark, root, whole=False), default=0) + 1
    while not put(spark, f"{root}/claims/run={run}", "", new=True):
        run += 1
    fresh = done.filter("action IN ('new', 'changed')").select(*KEY)
    if not fresh.isEmpty():
        bodies = objects.select(*KEY, F.coalesce("body", F.lit("")).alias("body"))
        bodies.join(small(fresh, BROADCAST_BYTES // KEY_BYTES), KEY, "left_semi").dropDuplicates(KEY).write.parquet(f"{root}/objects/run={run}")
    held = F.when(F.col("action") == "unchanged", F.col("held_by")).otherwise(F.lit(run)).alias("held_by")
    done = done.select(*KEY, "sha256", held, "action")
    done.filter("action <> 'deleted'").drop("action").write.parquet(f"{root}/manifests/run={run}")
    return done
