"""A streaming front end: new diff files are parsed as they arrive, and what they change is appended to tables.

The review itself has no streams; this runs the same operators on each micro-batch. Parsing needs no state between files, so no
watermark is needed, and a batch that runs again writes the same rows under the same batch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from patchloom.operators import diffs, filters


def stream_diffs(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """(diff_id, path, text) of diff files as they appear in a folder."""
    rows = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).load(path)
    rows = rows.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    return rows.select(F.xxhash64("path").alias("diff_id"), "path", "text")


def write_parsed(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Parse every batch and write its files and changed lines to ``out``/files and ``out``/lines, one folder a batch; stops when all is read."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        files = diffs.diff_files(rows).withColumn("language", filters.language("path"))
        files.write.mode("overwrite").parquet(f"{out}/files/batch={batch_id}")
        diffs.diff_lines(rows).where("change_type <> ' '").write.mode("overwrite").parquet(f"{out}/lines/batch={batch_id}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
