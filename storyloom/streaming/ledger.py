"""The ledger as a stream: appended rows in, the running summary of each arm out, the same as in batch; and phase progress."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from storyloom.sources.corpus import LEDGER


def ledger_stream(spark: SparkSession, path: str) -> DataFrame:
    """Rows as they are appended."""
    return spark.readStream.schema(LEDGER).json(path)


def running_summary(rows: DataFrame) -> DataFrame:
    """(arm, status) counts and hours so far, from which the summary of an arm follows."""
    return rows.groupBy("arm", "status").agg(F.count("*").alias("attempts"), F.sum(F.coalesce("gpu_hours", F.lit(0.0))).alias("gpu_hours"))


def start_summary(rows: DataFrame, name: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keeps the running summary as an in-memory table; a restart goes on from the checkpoint without counting twice."""
    out = running_summary(rows).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def on_progress(timings: DataFrame, act: Callable[[int], None], checkpoint: str) -> StreamingQuery:
    """Calls act(n) when the number of evaluated phases (eval_s above zero) grows. timings: a stream of (run, phase, eval_s).

    The number acted on last is kept beside the stream's checkpoint, so that a restart doesn't act on it again; act is
    called before it is written, at least once for each number.
    """
    spark = timings.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(f"{checkpoint}-acted")
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())

    def batch(rows: DataFrame, _: int) -> None:
        n = rows.where("eval_s > 0").select("phase").distinct().count()
        system.mkdirs(root)
        if n > max((int(s.getPath().getName()) for s in system.listStatus(root)), default=0):
            act(n)
            system.create(hadoop.Path(root, str(n)), True).close()

    grouped = timings.groupBy("phase").agg(F.max("eval_s").alias("eval_s"))
    return grouped.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()


def wait_for_phases(query: StreamingQuery, count: Callable[[], int], n: int, seconds: float = 60.0) -> bool:
    """Whether n phases are there once all that has come was processed, looking again until the time is over."""
    until = time.monotonic() + seconds
    while True:
        if query.isActive:
            query.processAllAvailable()
        if count() >= n:
            return True
        if time.monotonic() > until:
            return False
        time.sleep(0.05)


def event_windows(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Extension: counts and sums of events in tumbling windows under a watermark, by type; batch or stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")
