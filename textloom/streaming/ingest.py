"""Uploads as they arrive. An addition of this engine: batches of new uploads are unpacked and appended to the stored files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources.archives import unpack


def stream_uploads(spark: SparkSession, path: str, mode: str = "archive", per_batch: int = 200) -> DataFrame:
    """A stream of the files of new uploads below a path."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    binaries = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(path)
    return unpack(binaries, mode)


def store_stream(files: DataFrame, workspace_id: int, path: str, checkpoint: str, once: bool = False):
    """Starts to append the stream to stored files; with ``once`` it ends with what is there now."""
    writer = files.where("problem IS NULL").withColumn("workspace_id", F.lit(workspace_id).cast("long")).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("workspace_id")
    return (writer.trigger(availableNow=True) if once else writer).start()
