"""Counts per period from a stream, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_path


def windowed_counts(events: DataFrame, time: str, positive: str, period: str = "1 day", late: str = "2 days") -> DataFrame:
    """``data, total, positivos`` per tumbling period of ``time``; rows later than ``late`` are dropped.

    Works on streams and tables alike; null times are in no period.
    """
    stamped = events.withColumn("__t", F.col(time).cast("timestamp")).filter("__t is not null").withWatermark("__t", late)
    counts = stamped.groupBy(F.window("__t", period)).agg(F.count("*").alias("total"), F.count_if(F.expr(positive)).alias("positivos"))
    return counts.select(F.to_date("window.start").alias("data"), "total", "positivos")


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Process all there is of an aggregated stream and give its final table.

    State and results go to the shared folder; a batch replaces the results of the one before, so a
    batch run again after a failure changes nothing.
    """
    spark = stream.sparkSession
    path, state = new_path(spark, name), new_path(spark, f"{name}-state")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = stream.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", state).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
