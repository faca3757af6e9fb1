"""The cleaning rules on a stream: they are columns of one row, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.cleaning import clean_documents


def clean_stream(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str):
    """Clean the Parquet files that arrive in a folder; returns the query, which ends when all present files are done."""
    stream: DataFrame = clean_documents(spark.readStream.schema(schema).parquet(path))
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
