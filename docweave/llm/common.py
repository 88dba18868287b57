"""What the operators of this subpackage share: Arrow mapping, tables that cut lineage, sampling."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions of this subpackage travel by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

_ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
    "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()),
    "array<double>": pa.list_(pa.float64()),
}

SLICE_ROWS, SLICE_BYTES = 256, 8 << 20
#: Share of a table's rows, and least rows, from which on a join key is dealt to several tasks.
HOT, FEW = 256, 64


def slices(batch: pa.RecordBatch, at: int, rows: int = SLICE_ROWS, room: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in slices of at most so many rows, each ended by the row with which the texts of column at reach room bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        end = min(start + rows, int(np.searchsorted(ends, before + room)) + 1, batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def map_texts(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    fields: dict[str, str],
    make: Callable[[], Callable[[list], dict]],
    binary: bool = False,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """A row (id_col, *fields) for each row of docs, computed from whole texts in Arrow slices.

    make() runs once in a task and returns a function from a list of texts (None for null) to a list
    for each field. Slices hold at most slice_rows rows and about SLICE_BYTES of text, so a worker's
    memory is bounded by its longest text. Only the two named columns are read, so further columns of
    docs, whatever their names, don't matter.
    """
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    types = {name: _ARROW[kind] for name, kind in fields.items()}
    names = [id_col, *fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for part in slices(batch, 1, slice_rows):
                ids, texts = part.column(0), part.column(1)
                columns = compute((texts.cast(pa.binary()) if binary else texts).to_pylist())
                arrays = [pa.array(columns[name], kind) for name, kind in types.items()]
                yield pa.RecordBatch.from_arrays([ids, *arrays], names)

    kind = source.schema["_id"].dataType.simpleString()
    ddl = ", ".join(f"`{name}` {kind}" for name, kind in {id_col: kind, **fields}.items())
    return source.mapInArrow(run, ddl)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one of our own only where none is set and all run on this machine (tests)."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not where and context._jsc.sc().getCheckpointDir().isDefined():
        where = context._jsc.sc().getCheckpointDir().get()
    if not where and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="docweave-")
        context.setCheckpointDir(where)
    return where


def cut(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df as a table written to the shared folder: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docweave/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docweave_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes tables that cut() wrote; they can't be read afterwards."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._docweave_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left, a table of cut(), joined on key with right, which has a row for each key; no task gets more than a few 1 / HOT of left.

    A key with more than 1 / HOT of left's rows (and FEW) is dealt to several tasks, and its row of right copied to each.
    There are at most HOT such keys, so they are broadcast.
    """
    n = left.count()
    hot = left.groupBy(key).agg(F.count("*").alias("_c")).where((F.col("_c") * HOT > n) & (F.col("_c") > FEW))
    hot = F.broadcast(hot.select(key, F.ceil(F.col("_c") * HOT / max(n, 1)).cast("int").alias("_s")))
    salt = F.pmod(F.xxhash64(*left.columns), F.coalesce("_s", F.lit(1)))
    dealt = left.join(hot, key, "left").withColumn("_salt", salt.cast("int")).drop("_s")
    copied = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_s", F.lit(1)) - 1))).drop("_s")
    return dealt.join(copied, [key, "_salt"]).drop("_salt")


def remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % divisor


def sampled(rows: DataFrame, label: str, key: Column, per_label: int) -> DataFrame:
    """About per_label rows of each non-null label at most twice that, chosen by a hash of key.

    The counts by label come from one aggregation over the label column; the rows are then filtered
    where they stand, without a shuffle.
    """
    counts = {r[label]: r["n"] for r in rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).collect()}
    keep = F.lit(False)
    for value, n in counts.items():
        share = min(1.0, per_label / n)
        keep = keep | ((F.col(label) == F.lit(value)) & (F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1_000_003)) < int(share * 1_000_003)))
    return rows.where(keep)


__all__ = ["cut", "drop", "map_texts", "remainder", "sampled", "shared_dir", "slices", "spread_join"]
