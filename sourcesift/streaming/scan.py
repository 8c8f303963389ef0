"""Structured Streaming forms of the scan: new files, de-duplication, counts per window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sourcesift.operators.matching import scan_rules
from sourcesift.rules.model import Rule


def stream_artifacts(spark: SparkSession, directory: str, suffix: str = ".js") -> DataFrame:
    """Text files as they land in a directory, stamped with their modification time."""
    files = (
        spark.readStream.option("pathGlobFilter", f"*{suffix}").format("text")
        .option("wholetext", True).load(directory)
    )
    return files.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_modification_time").alias("ts"),
        F.col("value").alias("src"),
    ).withColumn("artifact_id", F.xxhash64("path")).withColumn("content_md5", F.md5("src"))


def stream_scan(artifacts: DataFrame, rules: list[Rule], ids=("artifact_id", "path")) -> DataFrame:
    """Findings of a stream of artifacts: the same shuffle-free projection as in batch."""
    return scan_rules(artifacts, rules, ids=ids)


def stream_dedupe(artifacts: DataFrame, horizon: str = "1 day") -> DataFrame:
    """Each (path, hash) once per horizon; state older than the watermark is dropped."""
    return artifacts.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["path", "content_md5"])


def severity_windows(findings: DataFrame, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Findings per tumbling window and severity; on a stream, late rows follow the watermark."""
    rows = findings.withWatermark("ts", lateness) if findings.isStreaming else findings
    counted = rows.groupBy(F.window("ts", width).alias("w"), "severity").agg(F.count("*").alias("findings"))
    return counted.selectExpr("w.start AS window_start", "w.end AS window_end", "severity", "findings")


def append_batches(df: DataFrame, target: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Write each micro-batch to its own folder under ``target``.

    The folder is named by the batch id, so a batch repeated after a failure replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = shape(batch) if shape else batch
        rows.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return (
        df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
