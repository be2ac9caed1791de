"""Documents that arrive in a folder, transcoded as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.gltf import transcoded

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", "*.gl[tb]*").load(folder)


def transcode_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Each document once: stateless, so no watermark; the Parquet sink and the checkpoint make it exactly once."""
    rows = transcoded(arriving(spark, folder))
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
