"""The logical tables of story analytics, as views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt anew by a key of many values over four tasks a core: a small file is one task however much is made of its rows."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as training stories."""
    phase = F.pmod("doc_id", F.lit(7)).cast("int")
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), phase.alias("phase"), F.col("lang").alias("tier"), F.col("text").alias("story"), F.col("doc_id").alias("lineno"), F.col("source").alias("model"))


def exam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items as exam stories."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.pmod("item_id", F.lit(7)).cast("int").alias("phase"), F.col("text").alias("story"))


def by_language(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents of two sources as the exam, of all others as training: a second pair of sides, which share texts."""
    rows = train(spark, sf_dir)
    return rows.where("model in ('src1', 'src2')"), rows.where("model not in ('src1', 'src2')")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ledger rows."""
    arm = F.element_at(F.array(*map(F.lit, ("phase0", "A", "B", "C", "D", "D-nr", "E"))), (F.pmod("user_id", F.lit(7)) + 1).cast("int"))
    events = table(spark, sf_dir, "events")
    return events.select(arm.alias("arm"), F.pmod("user_id", F.lit(3)).cast("int").alias("seed"), F.col("event_type").alias("status"), F.col("value").alias("gpu_hours"), F.concat(F.lit("gpu"), F.pmod("user_id", F.lit(2)).cast("string")).alias("gpu_name"))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as score cells: a run for each of 21 groups of users, its cells the mean values by phase pair; i = -1 is untrained."""
    e = table(spark, sf_dir, "events")
    run = F.pmod("user_id", F.lit(21)).cast("int")
    keys = [run.alias("run"), (F.pmod("event_id", F.lit(8)) - 1).cast("int").alias("i"), F.pmod(F.floor(F.col("event_id") / 8), F.lit(7)).cast("int").alias("j")]
    cells = e.groupBy(*keys).agg(F.sum(F.floor(F.col("value") * 100).cast("long")).alias("s"), F.count("value").alias("n"))
    return cells.select("run", F.when(F.col("run") % 2 == 0, "continuation").otherwise("perplexity").alias("exam"), "i", "j", (F.col("s") / F.col("n") / 100).alias("value"))


def two_exams(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as scores of three runs of each arm on two exams, by the event's parity, and the runs with their hours."""
    e = table(spark, sf_dir, "events").withColumn("run", F.pmod("user_id", F.lit(21)).cast("int"))
    exam = F.when(F.col("event_id") % 2 == 0, "continuation").otherwise("cloze").alias("exam")
    keys = ["run", exam, (F.pmod(F.floor(F.col("event_id") / 2), F.lit(8)) - 1).cast("int").alias("i"), F.pmod(F.floor(F.col("event_id") / 16), F.lit(7)).cast("int").alias("j")]
    cents = F.floor(F.col("value") * 100).cast("long")
    cells = e.groupBy(*keys).agg((F.sum(cents) / F.count("value") / 100).alias("value"))
    arm = F.element_at(F.array(*map(F.lit, ("phase0", "A", "B", "C", "D", "D-nr", "E"))), F.col("run") % 7 + 1)
    runs = e.groupBy("run").agg((F.sum(cents) / 100).alias("gpu_hours")).select("run", arm.alias("arm"), F.floor(F.col("run") / 7).cast("int").alias("seed"), "gpu_hours")
    return cells, runs


def grid(spark: SparkSession, kind: str) -> DataFrame:
    """A grid of runs that confirms every hypothesis, or one that kills them; the tests' expectations, no query reads it."""
    means = GRIDS[kind]
    rows = [(arm, seed, acc + (seed - 1) * 0.005, forg + (seed - 1) * 0.004, forg / (acc + forg), hours) for arm, (acc, forg, hours) in means.items() for seed in range(3)]
    return spark.createDataFrame(rows, "arm string, seed int, accuracy double, forgetting double, lost double, gpu_hours double")


#: Accuracy, forgetting and hours of each arm.
GRIDS = {
    "confirming": {"A": (0.30, 0.30, 1.0), "B": (0.40, 0.30, 1.0), "C": (0.50, 0.20, 1.1), "D": (0.60, 0.10, 1.4), "D-nr": (0.45, 0.25, 1.4), "E": (0.62, 0.02, 1.0)},
    "killing": {"A": (0.48, 0.02, 1.0), "B": (0.55, 0.10, 1.0), "C": (0.55, 0.30, 1.0), "D": (0.55, 0.30, 2.1), "D-nr": (0.55, 0.30, 1.0), "E": (0.60, 0.05, 1.0)},
}
