"""Tables and files as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def uploads(spark: SparkSession, folder: str, max_bytes: int = 50 << 20, pattern: str = "*.pdf") -> DataFrame:
    """(path, length, status) of files, by path: 200, 413 if too large, 415 without the magic in the first 16 bytes.

    Files that are too large aren't read; of the others 16 bytes leave the scan, so contents are never shuffled.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    head = F.regexp_replace(F.decode(F.substring("content", 1, 16), "ISO-8859-1"), r"^\s+", "")
    read = files.where(F.col("length") <= max_bytes).select("path", "length", F.when(head.startswith("%PDF-"), 200).otherwise(415).alias("status"))
    large = files.where(F.col("length") > max_bytes).select("path", "length", F.lit(413).alias("status"))
    return read.unionByName(large).orderBy("path")


def accepted(spark: SparkSession, folder: str, max_bytes: int = 50 << 20, pattern: str = "*.pdf") -> DataFrame:
    """(path, content) of the files that uploads() accepts, read where they are used."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).where(F.col("length") <= max_bytes)
    head = F.regexp_replace(F.decode(F.substring("content", 1, 16), "ISO-8859-1"), r"^\s+", "")
    return files.where(head.startswith("%PDF-")).select("path", "content")


def stage_events(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of JSON event logs; bad lines become null fields."""
    return spark.read.schema(EVENT_SCHEMA).option("mode", "PERMISSIVE").json(folder)


EVENT_SCHEMA = "job_id string, seq bigint, stage string, status string, progress int, route string, route_reason string, error string, worker_pid int, updated_at timestamp, table_count int, details map<string,string>"
