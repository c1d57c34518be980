"""Streaming twins of the telemetry operators, over JSON log files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import telemetry as T

SCHEMA = "event_id long, ts timestamp, num_vector_hits int, num_bm25_hits int, num_results int, latency_ms double, user_id long"


def read_log(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def class_counts(log: DataFrame) -> DataFrame:
    return log.groupBy(T.source_class().alias("source")).agg(F.count(F.lit(1)).alias("n"))


def hourly(log: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Counts and mean latency for each hour, closed when the watermark passes."""
    out = log.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("latency_ms"), 4).alias("avg_latency"))
    return out.select(F.col("w.start").alias("hour"), "n", "avg_latency")


def slow(log: DataFrame, limit: float = T.SLOW_MS) -> DataFrame:
    return log.where(F.col("latency_ms") > limit).select("event_id", "latency_ms")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there and return all that was written, the last state of each key in complete mode.

    A batch is written to a folder of its own, so a batch that is run again replaces what it wrote before.
    """

    def write(batch: DataFrame, number: int):
        batch.write.mode("overwrite").parquet(f"{path}/batch={0 if mode == 'complete' else number}")

    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(write).start().awaitTermination()
    return stream.sparkSession.read.parquet(path).drop("batch")


def reset(spark: SparkSession, state: str) -> bool:
    """Forget a stream's state: its next run reads all input again and counts from zero; False if there was none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(state)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
