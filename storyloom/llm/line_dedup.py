"""Line dedup over levelled sorted runs of line hashes.

A run is a bucketed table, sorted by hash inside its buckets: (hash, documents, largest document). Documents come in
batches. A batch's entries are merge-anti-joined with the runs: an entry that a run has settled (enough documents
already, and a larger one) adds nothing and goes; the others become a run of level 0. Each time a level
holds `fanout` runs, they are compacted into one of the next level, which adds up the entries of a hash. Runs and
batches share the bucketing, so that these joins move no run. A line's key is hashed to 128 bits, so that two keys are
never taken for one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import ASCII_SPACE, Tables, ascii_lower, remove, set_aside, shared_folder

#: A hash of more documents than this share of all entries is joined by broadcast; there are at most as many such hashes.
HOT_HASHES = 2000


def line_key(line: Column) -> Column:
    """ASCII white space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def lines_of(text: Column) -> Column:
    """The lines of a text as an array; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hash(key: Column) -> Column:
    return F.unhex(F.md5(key))


def _among(ordered: Column, powers: Column, value: Column) -> Column:
    """Whether a value is in an ordered array: binary search by steps of the powers of two up to its size, the largest first."""
    at = lambda p: F.element_at(ordered, p)
    place = F.aggregate(powers, F.lit(0), lambda p, step: F.when((p + step <= F.size(ordered)) & (at(F.least(p + step, F.size(ordered))) <= value), p + step).otherwise(p))
    return F.element_at(F.transform(F.array(place), lambda p: (p > 0) & (at(F.greatest(p, F.lit(1))) == value)), 1)


class LineRuns:
    """Levelled runs of one index, in the shared folder. add() takes a batch of entries; merged() is all of them, by hash."""

    def __init__(self, spark: SparkSession, buckets: int, min_docs: int, fanout: int = 3):
        self.spark, self.buckets, self.min_docs, self.fanout = spark, buckets, min_docs, fanout
        self.name = f"runs_{uuid.uuid4().hex}"
        self.folder = f"{shared_folder(spark)}/{self.name}"
        self.levels: list[list[str]] = []
        self.count = 0

    def _run(self, entries: DataFrame, level: int) -> None:
        table = f"{self.name}_{self.count}"
        self.count += 1
        (entries.repartition(self.buckets, "hash").write.bucketBy(self.buckets, "hash").sortBy("hash").option("path", f"{self.folder}/{table}").saveAsTable(table))
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)

    def _summed(self, tables: list[str]) -> DataFrame:
        rows = self.spark.table(tables[0])
        for t in tables[1:]:  # sorted runs of one bucketing: merged bucket by bucket
            more = self.spark.table(t).select("hash", F.col("n").alias("m"), F.col("largest").alias("other"))
            rows = rows.join(more, "hash", "full_outer")
            rows = rows.select("hash", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"), F.greatest("largest", "other").alias("largest"))
        return rows

    def _drop(self, tables: list[str]) -> None:
        for t in tables:
            self.spark.sql(f"DROP TABLE {t}")
            remove(self.spark, f"{self.folder}/{t}")

    def add(self, entries: DataFrame) -> None:
        """Anti-joins a batch with each run, writes the rest as a run and compacts the levels that are full."""
        for table in (t for level in self.levels for t in level):
            run = self.spark.table(table).where(F.col("n") >= self.min_docs).select("hash", F.col("largest").alias("run_largest"))
            entries = entries.join(run, (entries["hash"] == run["hash"]) & (run["run_largest"] >= entries["largest"]), "left_anti")
        self._run(entries, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        """The runs of a level become one of the next."""
        old, self.levels[level] = self.levels[level], []
        self._run(self._summed(old), level + 1)
        self._drop(old)

    def merged(self) -> DataFrame:
        """One row for each hash: documents (exact while below min_docs, else at least that) and the largest."""
        return self._summed([t for level in self.levels for t in level])

    def drop(self) -> None:
        self._drop([t for level in self.levels for t in level])


def deduped(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs with text replaced by its kept lines, and n_lines and n_dropped added.

    A key (line_key) of min_chars code points or more in min_docs documents or more loses all its lines except in the
    largest id that holds it. Rows that repeat an id are one document, of which each row comes out. Rows with a null
    id count for no key and keep all lines. Other columns pass through, those named like the two added as {name}_in; an
    empty table gives an empty result. Work on a text grows as its lines do, times the logarithm of those it loses.
    """
    spark, docs = docs.sparkSession, set_aside(docs, "n_lines", "n_dropped")
    tables = Tables(spark)
    buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text, key = F.col(text_col), "_storyloom_id"
    keys = F.filter(F.transform(lines_of(text), line_key), lambda k: F.length(k) >= min_chars)
    # Arrays of strings are made distinct by a hash set, of binaries pair by pair.
    hashes = F.transform(F.array_distinct(F.transform(keys, F.md5)), F.unhex)
    bounds = docs.agg(F.percentile_approx(id_col, [i / batches for i in range(1, batches)], 1000)).first()[0] or [] if batches > 1 else []
    # Batches are ranges of ids, the largest first: what a run has settled is then settled for good.
    batch = sum((F.when(F.col("id") <= b, 1).otherwise(0) for b in bounds), F.lit(0))
    some = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), batch.alias("batch"), F.explode(hashes).alias("hash"))
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    some.write.partitionBy("batch").parquet(path)
    held = spark.read.schema("id long, hash binary, batch int").parquet(path)
    runs = LineRuns(spark, buckets, min_docs)
    for b in range(len(bounds) + 1):
        runs.add(held.where(F.col("batch") == b).groupBy("hash").agg(F.countDistinct("id").alias("n"), F.max("id").alias("largest")))
    frequent = tables.write(runs.merged().where(F.col("n") >= min_docs), "frequent")
    runs.drop()
    remove(spark, runs.folder)
    hot = F.col("n") > max(1, (frequent.agg(F.sum("n")).first()[0] or 0) // HOT_HASHES)
    hottest, others = (frequent.where(x).select("hash", "largest") for x in (hot, ~hot))
    # At most HOT_HASHES rows are broadcast; any other hash has few documents, so no task of the other join gets many.
    lost = held.join(F.broadcast(hottest), "hash").unionByName(held.join(F.broadcast(hottest), "hash", "left_anti").join(others, "hash"))
    lost = lost.where("id <> largest")
    lost = lost.groupBy(F.col("id").alias(key)).agg(F.sort_array(F.collect_set("hash")).alias("_storyloom_lost"))
    lost = tables.write(lost, "lost")
    remove(spark, path)
    tables.drop(lost)
    powers = F.reverse(F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.size("_storyloom_lost"))).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int")))
    lost = lost.withColumn("_storyloom_powers", powers)
    joined = docs.join(lost, F.col(id_col).cast("long") == F.col(key), "left")
    gone = lambda k: _among(F.col("_storyloom_lost"), F.col("_storyloom_powers"), _hash(k))
    lines = F.transform(lines_of(text), lambda x: F.struct(x.alias("x"), line_key(x).alias("k")))
    kept = F.filter(lines, lambda x: (F.length(x["k"]) < min_chars) | ~gone(x["k"]))
    kept = F.transform(kept, lambda x: x["x"])
    some_gone = F.col("_storyloom_lost").isNotNull()
    n_lines = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[^\n]+", "")) + 1
    out = joined.withColumn("_storyloom_kept", F.when(some_gone, kept)).withColumn("n_lines", n_lines.cast("long"))
    out = out.withColumn("n_dropped", F.when(some_gone, F.col("n_lines") - F.size("_storyloom_kept")).otherwise(F.lit(0)).cast("long"))
    return out.withColumn(text_col, F.when(some_gone, F.array_join("_storyloom_kept", "\n")).otherwise(F.coalesce(text, F.lit("")))).drop(key, "_storyloom_lost", "_storyloom_powers", "_storyloom_kept")
