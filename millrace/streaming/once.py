"""Run a stream over what is there now, into a table in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir; where that is unset, under the warehouse, which must then be a shared folder."""
    top = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream, ts as a timestamp."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", rows["ts"].cast("timestamp"))


def available(stream: DataFrame, name: str) -> DataFrame:
    """All output of a stream in append mode, exactly once."""
    spark, to = stream.sparkSession, folder(stream.sparkSession, name)
    writer = stream.writeStream.format("parquet").option("path", f"{to}/rows").option("checkpointLocation", f"{to}/checkpoint")
    query = writer.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return spark.read.schema(stream.schema).parquet(f"{to}/rows")
