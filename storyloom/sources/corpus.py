"""Readers of story corpora, replay lists, exam folders, manifests, run folders and ledgers; writers of probes and ledgers.

Schemas are fixed. JSON lines keep their line numbers, and are read in splits all the same.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.operators.guard import ContractViolation

STORY = "prompt_hash string, phase int, tier string, story string, model string, timestamp string, split string, id string"
MANIFEST = "experiment_id string, generator_model string, seed int, files array<struct<path_relative_to_exam_dir: string, sha256: string, phase: int, kind: string>>, stories array<struct<story_id: string, prompt_hash: string, story_sha256: string, phase: int>>"
LEDGER = "arm string, seed int, run_dir string, status string, gpu_hours double, gpu_name string, commit7 string, note string, recorded_at string"


def phase_of(path: Column) -> Column:
    """The phase in a file's name."""
    return F.regexp_extract(path, r"_phase_(\d+)\.jsonl?$", 1).cast("int")


def corpus_files(spark: SparkSession, folder: str, phases: list[int] | None = None, name: str = "train") -> list[str]:
    """Paths of {name}_phase_{k}.jsonl right in a folder, by phase; declared phases must be there, others are passed over.

    Refuses a folder without any, and files that lie elsewhere (links out of the folder).
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(folder)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        raise ContractViolation(f"no folder {folder}")
    real = str(system.resolvePath(root))
    found = {}
    for status in system.listStatus(root):
        part = re.fullmatch(rf"{re.escape(name)}_phase_(\d+)\.jsonl", status.getPath().getName())
        if part and (phases is None or int(part[1]) in phases):
            path = status.getPath()
            if path.toUri().getScheme() == "file":
                inside = Path(path.toUri().getPath()).resolve().parent == Path(root.toUri().getPath()).resolve()
            else:
                inside = str(system.resolvePath(path).getParent()) == real
            if not inside:
                raise ContractViolation(f"file outside its folder: {path}")
            found[int(part[1])] = path.toString()
    lost = [k for k in phases or [] if k not in found]
    if lost or not found:
        raise ContractViolation(f"no {name} file in {folder} for phases {lost}" if lost else f"no {name} files in {folder}")
    return [found[k] for k in sorted(found)]


#: Splits of files whose counts of lines are broadcast at most; the counts of more are joined by a shuffle.
MOST_SPLITS = 100_000


def _heads(spark: SparkSession, files: list[str]) -> tuple[int, list[str]]:
    """Bytes of all files, and those that begin with a byte order mark, which the line reader takes away."""
    hadoop, conf, size, marked = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration(), 0, []
    for f in files:
        path = hadoop.Path(f)
        system = path.getFileSystem(conf)
        size += system.getFileStatus(path).getLen()
        stream = system.open(path)
        if [stream.read() for _ in range(3)] == [0xEF, 0xBB, 0xBF]:
            marked.append(path.toUri().getPath())
        stream.close()
    return size, marked


def numbered_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """(path, lineno, line) of every line, blank ones too, parted by CRLF, CR or LF; lineno from 1 in each file.

    Files are read in splits, by as many tasks as their bytes ask for. A first pass counts the lines of each split; the sum of
    the counts before a split is what its own lines' numbers begin after. A line's place in its split comes from the order in
    which its task reads it, which is held against the first pass: if the splits were cut otherwise, the row raises.
    """
    size, marked = _heads(spark, files)
    read = spark.read.text(files).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"), "value")
    splits = read.groupBy("path", "at").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.withColumn("before", F.coalesce(before, F.lit(0)))
    if size // spark._jsparkSession.sessionState().conf().filesOpenCostInBytes() + len(files) <= MOST_SPLITS:  # no split is smaller, but a file's last
        splits = F.broadcast(splits)
    place = F.col("row") - F.col("first")
    lineno = F.when((place >= 0) & (place < F.col("n")), F.col("before") + place + 1).otherwise(F.raise_error(F.lit("files were split otherwise than when their lines were counted")))
    # A split that the first pass did not see has no count, and raises as well.
    out = read.join(splits, ["path", "at"], "left").select("path", lineno.alias("lineno"), F.col("value").alias("line"))
    if not marked:
        return out
    own = F.array_contains(F.array(*map(F.lit, marked)), F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "^[a-zA-Z0-9]+:(//[^/]*)?", ""))
    return out.withColumn("line", F.when((F.col("lineno") == 1) & own, F.concat(F.lit(BOM), "line")).otherwise(F.col("line")))


BOM = "\ufeff"


def story_rows(spark: SparkSession, files: list[str]) -> DataFrame:
    """Stories of files of JSON lines by line, with lineno, and `corrupt` where a line is no JSON; blank lines are passed over."""
    lines = numbered_lines(spark, files).where(F.trim("line") != "")
    parsed = F.from_json("line", f"{STORY}, corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
    out = lines.select("path", "line", phase_of(F.col("path")).alias("file_phase"), "lineno", parsed.alias("r"))
    return out.select("path", "lineno", F.coalesce("r.phase", "file_phase").alias("phase"), F.coalesce("r.prompt_hash", "r.id").alias("id"), "r.prompt_hash", "r.tier", "r.story", "r.model", "r.timestamp", "r.split", "r.corrupt", F.startswith("line", F.lit(BOM)).alias("has_bom"))


def stories(spark: SparkSession, folder: str, phases: list[int] | None = None, name: str = "train") -> DataFrame:
    """story_rows() of {name}_phase_{k}.jsonl in a folder; undeclared phases are not opened."""
    return story_rows(spark, corpus_files(spark, folder, phases, name))


def replay_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """(phase, id) of replay/phase_{k}.json."""
    files = spark.read.schema("seed long, prompt_hashes array<string>").option("multiLine", True).json(f"{folder}/replay/phase_*.json")
    return files.select(F.regexp_extract(F.col("_metadata.file_name"), r"phase_(\d+)", 1).cast("int").alias("phase"), F.explode("prompt_hashes").alias("id")).distinct()


def manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Stories and files of a manifest."""
    doc = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    return doc.select(F.inline("stories")), doc.select(F.inline("files"))


def readable(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text, refused): files below a folder as UTF-8 without a byte order mark; text files that aren't UTF-8 are refused."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    text = F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), "^﻿", "")
    return files.select("path", text.alias("text"), (text.isNull() & F.col("path").rlike(r"\.(jsonl|json|txt)$")).alias("refused"))


def exam_story_phases(spark: SparkSession, folder: str, phases: list[int] | None = None) -> DataFrame:
    """(story_sha256, phase) of all exam stories of a folder."""
    rows = stories(spark, f"{folder}/stories", phases, "exam")
    return rows.select(T.story_sha256(F.col("story")).alias("story_sha256"), "phase").distinct()


def run_folders(spark: SparkSession, folder: str) -> DataFrame:
    """(run_id, commit_txt, matrix, timings, config): the four files of each folder below, null where one is missing."""
    files = spark.read.text(f"{folder}/*/*", wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    parts = files.withColumn("run_id", F.element_at(F.split("path", "/"), -2)).withColumn("name", F.element_at(F.split("path", "/"), -1))
    names = ["commit.txt", "matrix.json", "timings.json", "config.json"]
    wide = parts.where(F.col("name").isin(*names)).groupBy("run_id").pivot("name", names).agg(F.first("value"))
    return wide.toDF("run_id", "commit_txt", "matrix", "timings", "config")


def matrix_cells(folders: DataFrame) -> DataFrame:
    """(run, exam, i, j, value) of the matrices; bare NaN is read as such, null stays null."""
    shape = "untrained map<string, array<double>>, M map<string, array<array<double>>>"
    doc = folders.select(F.col("run_id").alias("run"), F.from_json("matrix", shape).alias("m"))
    cells = doc.select("run", F.explode("m.M").alias("exam", "rows")).select("run", "exam", F.posexplode("rows").alias("i", "row")).select("run", "exam", "i", F.posexplode("row").alias("j", "value"))
    base = doc.select("run", F.explode("m.untrained").alias("exam", "row")).select("run", "exam", F.lit(-1).alias("i"), F.posexplode("row").alias("j", "value"))
    return cells.unionByName(base)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows; none if it is absent."""
    try:
        return spark.read.schema(LEDGER).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], LEDGER)
        raise


def append_ledger(rows: DataFrame, path: str) -> None:
    """Appends; old rows are never edited."""
    rows.write.mode("append").json(path)


def write_probes(items: DataFrame, folder: str, kind: str) -> None:
    """Items as JSON lines, a folder for each kind and phase, in the order of their ids."""
    items.withColumn("kind", F.lit(kind)).repartition("phase").sortWithinPartitions("phase", "story_id").write.mode("overwrite").partitionBy("kind", "phase").json(folder)


def write_pairs_report(pairs: DataFrame, folder: str) -> None:
    """Near-duplicate pairs as JSON lines with sorted keys, in the order of exam phase, exam story, training phase and training story."""
    rows = pairs.select(*sorted(pairs.columns))
    rows.repartitionByRange("exam_phase", "exam_id").sortWithinPartitions("exam_phase", "exam_id", "train_phase", "train_id").write.mode("overwrite").json(folder)


def report_lines(aggregates: DataFrame, excluded: DataFrame) -> list[str]:
    """A report's lines: arms with mean, spread, number and seeds of each metric (one row an arm and metric), and runs left out with why."""
    shown = aggregates.select("arm", "metric", F.format_string("%.4f +- %.4f (n=%d; seeds %s)", "mean", "sd", "n", "seeds").alias("x")).orderBy("metric", "arm").collect()
    lost = excluded.orderBy("run_id").select("run_id", "reason").toLocalIterator()
    return [f"{r['metric']} {r['arm']}: {r['x']}" for r in shown] + [f"left out {r['run_id']}: {r['reason']}" for r in lost]
