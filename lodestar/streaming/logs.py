"""Append-only logs as streams: latest record per key, latency windows, resumable appends."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lodestar.sources.storage import shared_dir


def read_log(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def latency_windows(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, mean) per window of event time; rows later than the watermark are dropped."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events.withColumn("ts", F.col("ts").cast("timestamp"))
    w = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("mean_value", 6).alias("mean_value"))


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last record of each key."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def append_once(stream: DataFrame, target: str, checkpoint: str, key: str, work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Runs ``work`` on keys that the target hasn't got yet and appends the result, once for each batch id.

    A batch that is replayed after a failure writes to the same folder again, so nothing is doubled.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            done = spark.read.parquet(target).where(F.col("batch") != batch_id).select(key)
            fresh = fresh.join(done, key, "left_anti")
        work(fresh).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_table_log(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table NAME of a folder as a stream of its files, with the table's own schema."""
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    reader = spark.readStream.schema(table.schema)
    if table.inputFiles()[0].endswith(f"/{name}.parquet"):  # a single file: a stream reads folders
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return reader.parquet(f"{folder}/{name}.parquet")


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """What an aggregated stream holds once all that is there has been read: each batch's whole result replaces the one before."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def latest_stream(stream: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last record of each key, also of a stream: a state of one record a key."""
    row = F.max_by(F.struct(*stream.columns), F.struct(*order))
    return stream.groupBy(key).agg(row.alias("x")).select("x.*")
