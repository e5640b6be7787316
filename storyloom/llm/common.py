"""What several operators of this subpackage share: the shared work folder, written tables, and text arrays."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space as the contracts name it, [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Arrow batches from Spark are worked on in slices of at most about this many text bytes (one row at least).
SLICE_BYTES = 3 << 20


def shipped(spark: SparkSession) -> None:
    """Hands this package to the session's Python workers, once; they may not have it on their path."""
    if getattr(spark.sparkContext, "_storyloom_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="storyloom-")) / "storyloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    spark.sparkContext.addPyFile(str(archive))
    spark.sparkContext._storyloom_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset on one machine, as in tests, a new temporary one is set.

    On a cluster a folder of one machine would lose data, so an unset one is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = getattr(spark, "_storyloom_folder", None) or tempfile.mkdtemp(prefix="storyloom-")
        spark._storyloom_folder = folder
    return folder.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder, which cuts its lineage and outlives lost executors."""
    return Tables(df.sparkSession).write(df, label)


class Tables:
    """Parquet tables of one run in the shared folder, deleted when the run has no more use for them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{shared_folder(self.spark)}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def counted(self, df: DataFrame, label: str) -> tuple[DataFrame, int]:
        """The table, and how many rows it has, without another pass."""
        seen = Observation()
        out = self.write(df.observe(seen, F.count(F.lit(1)).alias("n")), label)
        return out, seen.get["n"]

    def drop(self, *keep: DataFrame) -> None:
        """Deletes all tables but those that a result still reads."""
        kept = {id(t) for t in keep}
        for k in [k for k in self.paths if k not in kept]:
            remove(self.spark, self.paths.pop(k)[1])


#: Bits of the map that screened() broadcasts: 4 MB at most, however many values are wanted.
SCREEN = 1 << 25


def screened(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows whose `column` may be among the values of wanted's only column; a bitmap of fixed size tells which may.

    A semi or inner join has still to follow; it moves fewer rows then.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SCREEN))
    held = wanted.select(slot(F.col(wanted.columns[0])).alias("slot"))
    maps = held.groupBy(F.bitmap_bucket_number("slot").alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_bits"))
    byte = "cast(conv(hex(substring(_bits, cast(bitmap_bit_position(_slot) div 8 as int) + 1, 1)), 16, 10) as int)"
    out = rows.withColumn("_slot", slot(F.col(column))).join(F.broadcast(maps), F.bitmap_bucket_number("_slot") == F.col("_part"))
    return out.where(f"shiftright({byte}, cast(bitmap_bit_position(_slot) % 8 as int)) & 1 = 1").select(rows.columns)


def set_aside(df: DataFrame, *names: str) -> DataFrame:
    """df with columns of these names, which an operator is to add, renamed to end in _in (and as many _ as it takes)."""
    for name in names:
        if name in df.columns:
            other = name + "_in"
            while other in df.columns:
                other += "_"
            df = df.withColumnRenamed(name, other)
    return df


def numbered(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """rows with a number from 0 among those alike in key: first inside a partition, then by what the partitions before hold.

    A group that holds a third of all rows is numbered in as many tasks as it lies in partitions. rows must lie alike in their
    partitions whenever they are read, as a table's do.
    """
    rows = rows.withColumn("_pid", F.spark_partition_id())
    inside = F.row_number().over(Window.partitionBy(*key, "_pid").orderBy(F.lit(1))) - 1
    sums = rows.groupBy(*key, "_pid").agg(F.count("*").alias("_n"))
    before = sums.groupBy(*key).agg(F.count("*").alias("_c"), F.collect_list(F.struct("_pid", "_n")).alias("_all")).where("_c > 1")  # one entry for each partition
    before = before.select(*key, F.explode("_all").alias("_e"), "_all")
    before = before.select(*key, F.col("_e._pid").alias("_pid"), F.aggregate(F.filter("_all", lambda x: x["_pid"] < F.col("_e._pid")), F.lit(0).cast("long"), lambda a, x: a + x["_n"]).alias("_before"))
    named = before.select(*(F.col(k).alias(f"{k}_b") for k in key), F.col("_pid").alias("_pid_b"), "_before")
    same = [F.col(k).eqNullSafe(F.col(f"{k}_b")) for k in [*key, "_pid"]]
    out = rows.withColumn(name, inside).join(named, same, "left").withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0)))
    return out.drop("_pid", "_pid_b", "_before", *(f"{k}_b" for k in key))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that written() or a run index made, by the file system of its path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else kept."""
    return F.translate(text, UPPER, LOWER)


def ascii_words(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def give_back() -> None:
    """Returns memory that is free in this process to the system: Python workers stay, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def collected(spark: SparkSession) -> None:
    """Asks every executor for a garbage collection, a task a core: what earlier jobs left in their heaps goes back to the system.

    Python workers need that memory: a heap filled by shuffles otherwise keeps its full size beside them.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(n, numPartitions=n).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def by_bytes(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes in a text column; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if len(sizes) > start:
        yield batch.slice(start)
    give_back()


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiplications and three shifts) over an array of unsigned integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each starts (one more entry than texts); null is empty."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    ends = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    body = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None and len(ends) else np.zeros(0, np.uint8)
    return body, ends - (ends[0] if len(ends) else 0)
