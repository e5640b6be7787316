"""A whole exam: what is wrong with its folder, and the scores of every exam type on every phase by one scorer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.operators import guard, probes, scoring
from storyloom.sources import corpus

#: Phases of an experiment, and the scores of a row of its matrix.
PHASES, SCORES = 7, ("perplexity", "cloze", "continuation", "continuation_summed")
CLOZE = "id string, phase int, text_with_mask string, answer string, candidates array<string>, story_id string, story_sha256 string"
CONTINUATION = "id string, phase int, prefix string, options array<string>, answer_index int, distractor_phases array<int>, option_sources array<struct<story_id: string, story_sha256: string, phase: int>>"


def evaluated(stories: DataFrame, cloze: DataFrame, continuation: DataFrame, scorer: scoring.Scorer, phases: list[int] | None = None, block: int = scoring.BLOCK, key: tuple[str, ...] = ("phase", "id"), encode: scoring.Encode | None = None, end: int = scoring.END) -> DataFrame:
    """For each phase: loss by token, cloze accuracy, continuation accuracy by PMI and by sums, with numbers of items and chance.

    All phases have a row. One that isn't scored, or has no items of a kind, has NaN, a count of 0 and no chance there.
    """
    wanted = sorted(set(range(PHASES) if phases is None else phases))
    if any(not 0 <= k < PHASES for k in wanted):
        raise ValueError(f"phases are 0 to {PHASES - 1}, not {wanted}")
    of = lambda df: df.where(F.col("phase").isin(wanted))
    loss = scoring.windowed_perplexity(of(stories), scorer, "phase", "story", block, encode).select("phase", F.col("loss").alias("perplexity"), "n_tokens")
    filled = scoring.cloze_results(of(cloze), scorer, block, key, encode).select("phase", F.col("accuracy").alias("cloze"), F.col("n").alias("n_cloze"), F.col("chance").alias("cloze_chance"))
    chosen = scoring.option_results(of(continuation), scorer, block, key, encode, end)
    chosen = chosen.select("phase", (F.col("n_pmi") / F.col("n")).alias("continuation"), (F.col("n_summed") / F.col("n")).alias("continuation_summed"), F.col("n").alias("n_continuation"), F.col("chance").alias("continuation_chance"))
    every = stories.sparkSession.range(PHASES).select(F.col("id").cast("int").alias("phase"))
    out = every.join(loss, "phase", "left").join(filled, "phase", "left").join(chosen, "phase", "left")
    return out.fillna(float("nan"), list(SCORES)).fillna(0, ["n_tokens", "n_cloze", "n_continuation"])


def matrix_row(scores: DataFrame) -> DataFrame:
    """One row: each score as an array over the phases, as a run's matrix holds it."""
    rows = F.array_sort(F.collect_list(F.struct("phase", *SCORES)))
    return scores.agg(rows.alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in SCORES])


def story_violations(stories: DataFrame, frozen: DataFrame, phases: list[int]) -> DataFrame:
    """(rule, entity, detail) of exam stories (file_phase, phase, id, story) that aren't those frozen (story_sha256, phase), phase by phase."""
    rows = stories.select("file_phase", "phase", F.coalesce("id", F.lit("?")).alias("id"), "story", T.story_sha256(F.col("story")).alias("sha"))
    known = frozen.groupBy(F.lower("story_sha256").alias("sha")).agg(F.max("phase").alias("frozen_phase"))
    joined = rows.join(known, "sha", "left")
    said = lambda rule, df, detail="sha": df.select(F.lit(rule).alias("rule"), F.col("id").cast("string").alias("entity"), F.coalesce(F.col(detail).cast("string"), F.lit("")).alias("detail"))
    out = said("no story", rows.where("story is null"), "file_phase")
    out = out.unionByName(said("filed under another phase", rows.where("phase <> file_phase"), "file_phase"))
    out = out.unionByName(said("not frozen", joined.where("story is not null and frozen_phase is null")))
    out = out.unionByName(said("frozen for another phase", joined.where("frozen_phase <> file_phase")))
    twice = rows.where("story is not null").groupBy("file_phase", "sha").agg(F.count("*").alias("n"), F.max("id").alias("id")).where("n > 1")
    out = out.unionByName(said("twice", twice))
    lost = known.where(F.col("frozen_phase").isin(phases)).join(rows.select("sha", F.col("file_phase").alias("frozen_phase")), ["sha", "frozen_phase"], "left_anti").withColumn("id", F.col("frozen_phase"))
    return out.unionByName(said("missing", lost))


def item_violations(cloze: DataFrame, continuation: DataFrame, frozen: DataFrame) -> DataFrame:
    """(rule, entity, detail) of items that can't be scored: no single mask, no answer among the candidates, options without proper sources."""
    masks = (F.length("text_with_mask") - F.length(F.replace("text_with_mask", F.lit(T.MASK), F.lit("")))) / len(T.MASK)
    bad = F.when(~F.coalesce(masks == 1, F.lit(False)), "one mask").when(~F.coalesce(F.array_contains("candidates", F.col("answer")), F.lit(False)), "answer missing")
    out = cloze.select(bad.alias("rule"), F.col("id").alias("entity"), F.col("phase").cast("string").alias("detail")).where("rule is not null")
    manifest = frozen.select("story_sha256", "phase", F.lit("").alias("story_id"))
    rules = probes.continuation_contract(continuation, manifest, frozen.limit(0).select("story_sha256"), n_options=None)
    return out.unionByName(rules.select("rule", F.col("id").alias("entity"), F.col("phase").cast("string").alias("detail")))


def _items(spark: SparkSession, folder: str, kind: str, schema: str, phases: list[int]) -> DataFrame:
    files = corpus.corpus_files(spark, f"{folder}/probes", phases, kind)
    return spark.read.schema(schema).json(files).where("id is not null or phase is not null")


def evaluate_folder(spark: SparkSession, folder: str, scorer: scoring.Scorer, phases: list[int] | None = None, frozen: DataFrame | None = None, block: int = scoring.BLOCK, encode: scoring.Encode | None = None, end: int = scoring.END) -> DataFrame:
    """evaluated() of an exam folder: stories/exam_phase_k.jsonl, probes/cloze_phase_k.jsonl and probes/continuation_phase_k.jsonl.

    frozen: the manifest's stories (story_sha256, phase); the stories on disk must then be exactly these for every phase that is
    scored, else ContractViolation is raised before anything is. Without it options' sources must be stories on disk.
    """
    wanted = sorted(set(range(PHASES) if phases is None else phases))
    if any(not 0 <= k < PHASES for k in wanted):
        raise ValueError(f"phases are 0 to {PHASES - 1}, not {wanted}")
    rows = corpus.stories(spark, f"{folder}/stories", wanted, "exam").withColumn("file_phase", corpus.phase_of(F.col("path")))
    if frozen is not None:
        if frozen.isEmpty():
            raise guard.ContractViolation("no frozen stories to hold the exam against")
        guard.enforce(story_violations(rows, frozen, wanted))
    else:
        frozen = corpus.exam_story_phases(spark, folder)
    cloze, continuation = (_items(spark, folder, k, s, wanted) for k, s in (("cloze", CLOZE), ("continuation", CONTINUATION)))
    guard.enforce(item_violations(cloze, continuation, frozen))
    return evaluated(rows.select(F.col("file_phase").alias("phase"), "story"), cloze, continuation, scorer, wanted, block, encode=encode, end=end)
