"""Operators on Structured Streaming: the same tables read as a stream of files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's parquet file as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def run_once(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a streaming aggregate over what there is and returns its last state. For results of bounded size."""
    spark, name = stream.sparkSession, f"stream_{uuid.uuid4().hex}"
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def count_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_stream(spark, sf_dir, "events")
    return run_once(events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")))
