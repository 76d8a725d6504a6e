"""Labelling of context vectors as they arrive: each batch is joined with ground truth and appended to the training set, once."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.compare import training_rows
from ..schemas import CONTEXT
from ..sources.runs import append_once


def label_stream(spark: SparkSession, arriving: str, truth: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Reads Parquet files of context vectors with their method from a folder until none is new. A batch has the name of its stream (by its
    checkpoint) and number, which a repeated attempt has too: whatever fails, its rows are in runs.training_set(out) once."""
    schema = StructType([*CONTEXT.fields, StructField("method", StringType())])
    stream = spark.readStream.schema(schema).parquet(arriving)
    name = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]

    def write(batch: DataFrame, number: int) -> None:
        append_once(training_rows(truth, batch), out, f"{name}-{number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
