"""The same features over a stream: watermarked daily aggregates per user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily_means(events: DataFrame, time: str = "ts", user: str = "user_id", value: str = "value", late: str = "1 day") -> DataFrame:
    """user, day, n, mean: works on a stream, whose state the watermark bounds, and on a table alike."""
    timed = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    out = timed.groupBy(F.window("__t", "1 day").alias("w"), user).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return out.select(user, F.col("w.start").cast("date").alias("day"), "n", "mean")


def run_once(spark: SparkSession, source: str, schema, target: str, checkpoint: str) -> None:
    """Daily means of the files that came since the last run, appended as Parquet."""
    stream = daily_means(spark.readStream.schema(schema).parquet(source))
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
