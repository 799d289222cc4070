"""Run a stream over what its source holds now and read its result as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import shared_dir

def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stream over the files of one table."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def replayed(stream: DataFrame, name: str) -> DataFrame:
    """The appended rows of a stream that ends when its source is read."""
    at = f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/rows")
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/rows")
