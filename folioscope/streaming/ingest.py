"""Incremental ingest: each new content once, whatever the number of copies and restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope.sources.files import with_cache_key


def file_stream(spark: SparkSession, root: str, pattern: str = "*.docx") -> DataFrame:
    """Files below root as they come: path, content, sha256."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return files.select("path", "content", F.sha2("content", 256).alias("sha256"))


def ingest(stream: DataFrame, extract, table: str, checkpoint: str) -> StreamingQuery:
    """Appends extract(files) of contents that the table does not have yet; runs until all that is there has been read."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keyed = with_cache_key(batch.dropDuplicates(["sha256"]))
        try:
            seen = spark.read.parquet(table).where(F.col("batch") != number).select("cache_key").distinct()
            keyed = keyed.join(seen, "cache_key", "left_anti")
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(error):
                raise
        # a batch that runs again replaces its own part
        extract(keyed).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
