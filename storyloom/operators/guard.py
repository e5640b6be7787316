"""Contract checks as violation rows, the leak guard, and reconciliation of an exam with its manifest.

A rule yields (rule, entity, detail); enforce() raises on the first few. Checks are queries of their own, so that no filter
of the data can hide a row from them.
"""

from __future__ import annotations

from pathlib import PurePosixPath
from posixpath import normpath
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.functions.leaves import json_strings

#: Fixed value: violations listed in a refusal.
MAX_LISTED = 50


class ContractViolation(ValueError):
    """Data that the contract refuses."""


def enforce(violations: DataFrame, most: int = MAX_LISTED) -> None:
    """Raises ContractViolation if there is a violation; lists at most `most` of them."""
    rows = violations.limit(most + 1).collect()
    if rows:
        more = f" ... and {violations.count() - most} more" if len(rows) > most else ""
        raise ContractViolation("; ".join(f"{r['rule']}: {r['entity']} ({r['detail']})" for r in rows[:most]) + more)


def _rows(df: DataFrame, rule: str, entity: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), entity.cast("string").alias("entity"), F.coalesce(detail.cast("string"), F.lit("<missing>")).alias("detail"))


def split_violations(stories: DataFrame) -> DataFrame:
    """Rows whose split isn't exactly 'train', and rows without a model, a story or an id."""
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    out = _rows(stories.where(~F.col("split").eqNullSafe("train")), "split", F.col("id"), F.col("split"))
    for c in ("model", "story"):
        out = out.unionByName(_rows(stories.where(blank(c)), c, F.col("id"), F.lit("empty")))
    return out.unionByName(_rows(stories.where("id is null"), "id", F.lit("?"), F.lit("empty")))


def provenance_violations(stories: DataFrame, exam_model: str | None = None) -> DataFrame:
    """More than one model in a phase or overall, none at all, or another one than the exam's; models are listed in order."""
    of = lambda df: df.agg(F.array_sort(F.collect_set("model")).alias("models"), F.count("*").alias("n"))
    listed = F.array_join("models", ",")
    phases = of(stories.groupBy("phase"))
    whole = of(stories.groupBy())
    out = _rows(phases.where(F.size("models") != 1), "phase_models", F.col("phase"), listed)
    out = out.unionByName(_rows(whole.where((F.size("models") != 1) & (F.col("n") > 0)), "models", F.lit("all"), listed))
    if exam_model is not None:
        out = out.unionByName(_rows(whole.where(~F.array_contains("models", exam_model)), "exam_model", F.lit(exam_model), listed))
    return out


def manifest_of(exam: DataFrame) -> DataFrame:
    """(story_id, prompt_hash, story_sha256, phase) of each exam story."""
    return exam.select(F.col("id").alias("story_id"), F.sha2(F.col("id").cast("string"), 256).alias("prompt_hash"), T.story_sha256(F.col("story")).alias("story_sha256"), "phase")


def manifest_violations(manifest: DataFrame) -> DataFrame:
    """Entries with a malformed hash, an empty prompt hash or no phase from 0 to 6, and ids that come twice."""
    out = _rows(manifest.where(~F.coalesce(F.lower("story_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))), "story_sha256", F.col("story_id"), F.col("story_sha256"))
    out = out.unionByName(_rows(manifest.where("prompt_hash is null or prompt_hash = ''"), "prompt_hash", F.col("story_id"), F.col("prompt_hash")))
    out = out.unionByName(_rows(manifest.where("phase is null or phase not between 0 and 6"), "phase", F.col("story_id"), F.col("phase")))
    return out.unionByName(_rows(manifest.groupBy("story_id").count().where("count > 1"), "duplicate", F.col("story_id"), F.col("count")))


def _looked_up(leaves: DataFrame, manifest: DataFrame) -> DataFrame:
    """leaves without their values, with reason and story_id, both null where a leaf is no hit. Only hashes are shuffled."""
    prompts = manifest.where("prompt_hash is not null").groupBy(F.sha2("prompt_hash", 256).alias("plain")).agg(F.max("story_id").cast("string").alias("by_prompt"))
    stories = manifest.groupBy(F.lower("story_sha256").alias("sha")).agg(F.max("story_id").cast("string").alias("by_story"))
    out = leaves.withColumns({"plain": F.sha2("value", 256), "sha": T.story_sha256(F.col("value"))}).drop("value")
    out = out.join(prompts, "plain", "left").join(stories, "sha", "left").drop("plain", "sha")
    reason = F.when(F.col("by_prompt").isNotNull(), "prompt_hash").when(F.col("by_story").isNotNull(), "story_sha256")
    return out.withColumns({"reason": reason, "story_id": F.coalesce("by_prompt", "by_story")}).drop("by_prompt", "by_story")


def leaf_hits(leaves: DataFrame, manifest: DataFrame) -> DataFrame:
    """String leaves (entity, location, value) that equal an exam prompt hash or else hold an exam story.

    A leaf that equals a prompt hash isn't looked up as a story as well. A story hash or a prompt hash that two entries share
    is that of the larger id.
    """
    return _looked_up(leaves, manifest).where("reason is not null").select("entity", "location", "reason", "story_id")


def leaves_of(df: DataFrame, entity: str, columns: list[str]) -> DataFrame:
    """The string values of some columns as (entity, location, value)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("location"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(F.col(entity).cast("string").alias("entity"), pairs.alias("p")).select("entity", "p.location", "p.value").where("value is not null")


def json_leaves(df: DataFrame, entity: str, column: str) -> DataFrame:
    """(entity, location, value) of every string leaf at any depth of a column of JSON documents, keys left out; other texts have none."""
    return json_strings(df, entity, column).where("is_json").drop("is_json")


def reconcile(disk: DataFrame, manifest: DataFrame) -> DataFrame:
    """Differences of exam stories (id, phase, story) and manifest: not in it, wrong phase, duplicate, missing from disk."""
    d = disk.select("phase", T.story_sha256(F.col("story")).alias("sha")).groupBy("sha").agg(F.count("*").alias("n"), F.min("phase").alias("disk_phase"), F.max("phase").alias("disk_phase_2"))
    m = manifest.select(F.lower("story_sha256").alias("sha"), "phase", "story_id").groupBy("sha").agg(F.max_by("phase", "story_id").alias("phase"))
    both = d.join(m, "sha", "full_outer")
    other = (F.col("disk_phase") != F.col("phase")) | (F.col("disk_phase_2") != F.col("phase"))
    problem = F.when(F.col("phase").isNull(), "not in manifest").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").when(other, "wrong phase")
    return both.select("sha", problem.alias("problem"), F.coalesce("n", F.lit(0)).alias("n")).where("problem is not null")


def story_duplicates(stories: DataFrame) -> DataFrame:
    """Hashes that more than one story has: how many, and the first id."""
    return stories.groupBy(T.story_sha256(F.col("story")).alias("story_sha256")).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def majority(runs: DataFrame, value: str, order: str, by: list[str]) -> DataFrame:
    """Rows whose value is the most frequent of their group; of ties the one that comes first by `order`."""
    counts = runs.groupBy(*by, value).agg(F.count("*").alias("c"), F.min(order).alias("first"))
    best = counts.withColumn("nr", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("c"), "first"))).where("nr = 1")
    return runs.join(best.select(*by, value), [*by, value], "left_semi")


def disjoint(one: str, other: str) -> None:
    """Refuses folders that are the same, or of which one holds the other."""
    a, b = (PurePosixPath(normpath(urlsplit(x).path or "/")) for x in (one, other))
    if a == b or a in b.parents or b in a.parents:
        raise ContractViolation(f"folders overlap: {one} and {other}")


def file_hits(files: DataFrame, listed: DataFrame) -> DataFrame:
    """(path, exam_path) of files that are byte for byte an exam file. files: (path, sha256); listed: (path_relative_to_exam_dir, sha256, at), of equal files the first counts."""
    exam = listed.groupBy(F.lower("sha256").alias("sha256")).agg(F.min_by("path_relative_to_exam_dir", "at").alias("exam_path"))
    return files.select("path", F.lower("sha256").alias("sha256")).join(exam, "sha256").select("path", "exam_path")


def text_hits(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, line, location, reason, story_id) of what texts of files share with an exam.

    A file is looked at whole, as one story; a .json file as a document, string by string; and every line that isn't blank, as JSON
    where it parses, else as a text. A line of a .jsonl file that doesn't parse is itself a hit. line 0 is the whole
    file. A string of a .json file of one line is so found twice, as document and as line.
    """
    kind = F.lower(F.regexp_extract("path", r"\.(jsonl?|txt)$", 1))
    whole = files.select(F.col("path").alias("entity"), F.lit("whole").alias("location"), F.col("text").alias("value"))
    whole = leaf_hits(whole, manifest).where("reason = 'story_sha256'").withColumn("line", F.lit(0))
    documents = leaf_hits(json_leaves(files.where(kind == "json"), "path", "text"), manifest).withColumn("line", F.lit(0))
    lines = files.select("path", F.posexplode(T.loader_lines(F.col("text"))).alias("n", "raw")).withColumn("value", T.stripped(F.col("raw"))).where("value <> ''")
    lines = lines.select(F.concat_ws(":", "path", (F.col("n") + 1).cast("string")).alias("entity"), "value")
    rows = _looked_up(json_strings(lines, "entity", "value"), manifest)
    part = lambda i, k="string": F.regexp_extract("entity", r"^(.*):(\d+)$", i).cast(k)
    broken = ~F.col("is_json") & F.lower("entity").rlike(r"\.jsonl:\d+$")
    found = F.array(F.when(F.col("reason").isNotNull(), F.struct("reason", "story_id")), F.when(broken, F.struct(F.lit("unparsable").alias("reason"), F.lit(None).cast("string").alias("story_id"))))
    by_line = rows.select(part(1).alias("entity"), part(2, "int").alias("line"), "location", F.inline(F.filter(found, lambda x: x.isNotNull())))
    out = whole.unionByName(documents).select("entity", "line", "location", "reason", "story_id").unionByName(by_line)
    return out.withColumnRenamed("entity", "path")


def model_violations(lines: DataFrame, exam_model: str, examples: int = 3) -> DataFrame:
    """(rule, detail) of story lines (place, model): none at all, without a model, of several models, of another than the exam's; the first that fails.

    detail: models with their number of lines, and up to three places of each, in order.
    """
    rows = lines.select("place", F.coalesce(F.when(F.trim("model") != "", F.col("model")), F.lit("<missing>")).alias("model"))
    sums = rows.groupBy("model").agg(F.count("*").alias("n"))
    first = rows.withColumn("nr", F.row_number().over(Window.partitionBy("model").orderBy("place"))).where(F.col("nr") <= examples)
    first = first.groupBy("model").agg(F.array_join(F.array_sort(F.collect_list("place")), " ").alias("places"))
    each = F.struct("model", F.concat(F.col("model"), F.lit(" "), F.col("n").cast("string"), F.lit(": "), F.col("places")).alias("shown"))
    models = sums.join(first, "model").agg(F.array_sort(F.collect_list(each)).alias("all"))  # as many as there are models
    names, shown = F.transform("all", lambda x: x["model"]), F.array_join(F.transform("all", lambda x: x["shown"]), "; ")
    rule = F.when(F.size("all") == 0, "no story lines").when(F.array_contains(names, "<missing>"), "no model").when(F.size("all") > 1, "several models").when(F.get(names, F.lit(0)) != exam_model, "exam_model")
    return models.select(rule.alias("rule"), shown.alias("detail")).where("rule is not null")


def manifest_refusals(manifests: DataFrame, entity: str = "path") -> DataFrame:
    """(entity, rule) of manifests as texts (entity, text): the first rule that refuses each one."""
    v = F.try_parse_json("text")
    kind = lambda p: F.schema_of_variant(F.try_variant_get("v", p, "variant"))
    blank = lambda p: ~F.coalesce((kind(p) == "STRING") & (F.trim(F.try_variant_get("v", p, "string")) != ""), F.lit(False))
    entries = lambda p: F.coalesce(F.try_variant_get("v", p, "array<variant>"), F.array().cast("array<variant>"))
    text = lambda e, p: F.when(F.schema_of_variant(F.try_variant_get(e, p, "variant")) == "STRING", F.try_variant_get(e, p, "string"))
    files, stories = entries("$.files"), entries("$.stories")
    lacks = lambda e: F.exists(F.array(*[F.try_variant_get(e, f"$.{f}", "variant").isNull() for f in ("story_id", "prompt_hash", "story_sha256", "phase")]), lambda x: x)
    is_object = lambda e: F.coalesce(F.schema_of_variant(e).startswith("OBJECT"), F.lit(False))
    rules = [
        ("unreadable", F.col("v").isNull()),
        ("no object", ~is_object(F.col("v"))),
        ("no files", F.size(files) == 0),
        ("file hash", F.exists(files, lambda e: ~is_object(e) | (F.coalesce(text(e, "$.sha256"), F.lit("")) == ""))),
        ("experiment_id", blank("$.experiment_id")),
        ("generator_model", blank("$.generator_model")),
        ("no stories", F.size(stories) == 0),
        ("story is no object", F.exists(stories, lambda e: ~is_object(e))),
        ("story fields", F.exists(stories, lacks)),
        ("story_sha256", F.exists(stories, lambda e: ~F.coalesce(F.lower(text(e, "$.story_sha256")).rlike("^[0-9a-f]{64}$"), F.lit(False)))),
        ("prompt_hash", F.exists(stories, lambda e: F.coalesce(text(e, "$.prompt_hash"), F.lit("")) == "")),
        ("story phase", F.exists(stories, lambda e: F.schema_of_variant(F.try_variant_get(e, "$.phase", "variant")) != "BIGINT")),
    ]
    first = F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules])
    return manifests.select(F.col(entity).cast("string").alias("entity"), v.alias("v")).select("entity", first.alias("rule")).where("rule is not null")


def notebook_problems(notebooks: DataFrame) -> DataFrame:
    """(path, cell, problem) of code cells of notebooks (path, text) with outputs or an execution count."""
    cells = F.from_json("text", "cells array<struct<cell_type: string, outputs: array<string>, execution_count: int>>")
    rows = notebooks.select("path", F.posexplode(cells["cells"]).alias("cell", "c")).where("c.cell_type = 'code'")
    found = F.array(F.when(F.size("c.outputs") > 0, F.lit("outputs")), F.when(F.col("c.execution_count").isNotNull(), F.lit("execution_count")))
    return rows.select("path", "cell", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("problem"))


def bundle_problems(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, problem) of a bundle's files (path, sha256) against what is expected of them: unsafe paths, missing and changed files."""
    unsafe = F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), "..")
    rows = expected.select("path", F.lower("sha256").alias("due")).join(files.select("path", F.lower("sha256").alias("sha256")), "path", "left")
    problem = F.when(unsafe, "unsafe path").when(F.col("sha256").isNull(), "missing").when(F.col("sha256") != F.col("due"), "changed")
    return rows.select("path", problem.alias("problem")).where("problem is not null")
