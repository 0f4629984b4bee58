"""Structured Streaming jobs over files: work in chunks to the end of what is there, and windows over events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import read, shared_folder


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def stream(spark: SparkSession, sf_dir: str, name: str, files_at_once: int = 50) -> DataFrame:
    """A table's Parquet files as a stream, at most files_at_once a batch."""
    schema = read(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parque[t]")


def counted(spark: SparkSession, sf_dir: str, name: str, by: str) -> DataFrame:
    """Rows by value, over everything there is now; each batch appends its partial counts exactly once by batch id."""
    folder = _folder(spark)

    def take(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(by).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    q = stream(spark, sf_dir, name).writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    kind = read(spark, sf_dir, name).schema[by].dataType.simpleString()
    return spark.read.schema(f"{by} {kind}, n long, batch long").parquet(f"{folder}/out").groupBy(by).agg(F.sum("n").alias("n"))


def windowed(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events by window and type, with a watermark so that state is dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
