"""File-stream form of the extract reader + date repair (stateless).

A stream's files are read by their header: the names come from the files that
are there when it starts, and a later file whose header differs, in its names
or their order, fails the micro-batch instead of loading into other columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tillpoint.operators.repair import lines_repaired
from tillpoint.sources import quarantine
from tillpoint.sources.extract import from_named_columns


def _texts(spark: SparkSession, path: str, mode: str, max_files_per_trigger: int) -> DataFrame:
    schema = quarantine.text_schema(quarantine.header_of(spark, path))
    return (spark.readStream.schema(schema).option("header", True).option("enforceSchema", False).option("encoding", "UTF-8")
            .option("mode", mode).option("columnNameOfCorruptRecord", quarantine.BROKEN).option("columnPruning", False)
            .option("maxFilesPerTrigger", max_files_per_trigger).csv(path)
            .select("*", F.col("_metadata.file_path").alias(quarantine.FILE)))


def repaired_line_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 100) -> DataFrame:
    """Streaming DataFrame of repaired lines from CSV files arriving in ``path``,
    with the column expressions of the batch view; a malformed value, record or
    timestamp fails the micro-batch."""
    texts = _texts(spark, path, "FAILFAST", max_files_per_trigger)
    return lines_repaired(from_named_columns(texts.drop(quarantine.BROKEN, quarantine.FILE)))


def judged_line_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 100) -> DataFrame:
    """The same files with every row judged instead (``sources.quarantine``)."""
    return quarantine.judged(_texts(spark, path, "PERMISSIVE", max_files_per_trigger))


def write_repaired_lines(stream: DataFrame, out_path: str, checkpoint_path: str,
                         once: bool = False) -> StreamingQuery:
    """Append repaired lines as parquet; the checkpoint (a shared folder on
    a cluster) makes the file sink exactly-once across restarts."""
    w = (stream.writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint_path).outputMode("append"))
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="1 minute")
    return w.start()
