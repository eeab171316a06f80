"""The row-wise operators on a stream of turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hemispark.operators.rules import TAGS, rule_tags


def stream_turns(spark: SparkSession, path: str) -> DataFrame:
    """Turns as files arrive; the schema is that of the files present."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("recursiveFileLookup", "true").parquet(path)


def tag_counts(turns: DataFrame, late: str = "30 days", window: str = "7 days") -> DataFrame:
    """Rows and tags per window of arrival; later rows than ``late`` behind the newest are dropped by the watermark."""
    tagged = rule_tags(turns.withColumn("ingested_at", F.col("ingested_at").cast("timestamp")).withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["debate_id", "seq_index"]))
    return tagged.groupBy(F.window("ingested_at", window).alias("w")).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(t).cast("long")).alias(t) for t in TAGS)).select(F.col("w.start").alias("week"), "n", *TAGS)
