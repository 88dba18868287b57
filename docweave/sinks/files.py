"""Reports and states as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.jobs import latest


def write_report(results: DataFrame, path: str) -> None:
    """A JSON record a row. A result that failed is a record with its error, so one bad document doesn't stop a report."""
    results.select(F.to_json(F.struct(*results.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def append_events(stream: DataFrame, log: str, state: str, checkpoint: str, key: str = "job_id", order: str = "seq"):
    """Starts a stream that appends events to a log of JSON lines, and keeps a table with the last event of each key.

    Every batch has its own folder in the log, so a batch that is run again replaces itself. The table is written under a new name
    and readers take the newest name that is complete; the two before it are kept for those that still read.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").json(f"{log}/batch={batch_id}")
        before = newest(spark, state, batch_id)
        rows = batch if before is None else batch.unionByName(spark.read.schema(batch.schema).parquet(before))
        latest(rows, key, order).write.mode("overwrite").parquet(f"{state}/v={batch_id}")
        fs, path = _path(spark, f"{state}/v={batch_id - 3}")
        fs.delete(path, True)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def newest(spark, state: str, below: int | None = None) -> str | None:
    """The folder of the last complete table of append_events(), of a batch below the given one."""
    fs, path = _path(spark, state)
    if not fs.exists(path):
        return None
    names = [s.getPath() for s in fs.listStatus(path)]
    done = [int(p.getName()[2:]) for p in names if p.getName().startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    done = [n for n in done if below is None or n < below]
    return f"{state}/v={max(done)}" if done else None


def _path(spark, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path
