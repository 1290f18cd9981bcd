"""A stream of catalog documents, each brought to the dictionary as it comes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from catalens.operators import dictionary


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Whole-file documents as they appear in ``folder``."""
    return spark.readStream.schema("value string").option("wholetext", True).format("text").load(folder).withColumn("at", F.current_timestamp())


def keep(spark: SparkSession, folder: str, root: str, checkpoint: str, confirmed_text: str = "") -> StreamingQuery:
    """Run the dictionary for each document of each batch; a batch that is run again changes nothing."""

    def apply(batch: DataFrame, _: int) -> None:
        for row in batch.select("value").toLocalIterator():
            dictionary.run(batch.sparkSession, row["value"], root, confirmed_text)

    return documents(spark, folder).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type and window, for streams and tables alike; rows later than ``late`` are left out of streams."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp"))
    at = at.withWatermark("ts", late) if events.isStreaming else at
    return at.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
