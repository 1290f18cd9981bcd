"""Every query of the library by name, and the SQL that tells what it must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalens.operators import cases
from catalens.operators import queries as catalog
from catalens.plans import queries as statements
from catalens.streaming import snapshots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = catalog.QUERIES | statements.QUERIES | cases.QUERIES | {
    "stream_event_counts": lambda spark, sf_dir: snapshots.event_counts(spark.read.parquet(f"{sf_dir}/events.parquet")).selectExpr("CAST(start AS timestamp_ntz) AS start", "event_type", "n", "round(total, 4) AS total"),
}
ORACLES: dict[str, str] = catalog.ORACLES | statements.ORACLES | cases.ORACLES | {
    "stream_event_counts": "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["qry_session"](spark, sf_dir)
